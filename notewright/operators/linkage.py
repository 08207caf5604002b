"""Probabilistic record linkage of mentions.

A mention frame has one row per mention; missing values are null, never '', so that they neither
block nor agree. Blocking is one equi-join per rule, never an OR in one join. Scoring is CASE
ladders and a sum of weights from a small table of parameters, which rides along as literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions import contact, names
from notewright.storage import materialize

# Blocking rules; a pair is credited to the first that proposes it, so new ones are appended.
BLOCKING = (
    ("email",), ("npi",), ("tin",), ("phone7",), ("address_key",), ("full_name",), ("name_sorted",), ("name_soundex", "first_name"),
    ("last_name",), ("emb_bucket",), ("ssn",), ("vin",),
)
#: Rules of high precision that the match prior is estimated from, and the share of matches that they catch.
PRIOR_RULES = (("email",), ("npi",), ("phone7",), ("full_name", "dob"), ("full_name", "address_key"), ("name_sorted", "claim_id"))
PRIOR_RECALL = 0.7
IDENTIFIERS = ("email", "phone", "npi", "tin", "ssn", "vin", "dob", "address")


class UncalibratedModel(RuntimeError):
    """A model is used on data or rules that it wasn't trained for."""


def first_identifiers(observations: DataFrame, assertions: DataFrame | None = None) -> DataFrame:
    """mention_id and its first value of each kind: observations first, then assertions, by seq.

    observations: mention_id, kind, value, seq. assertions: the same and grounded, polarity; those
    that aren't grounded, or are negated or retracted, don't count.
    """
    rows = observations.select("mention_id", "kind", "value", F.lit(0).alias("lane"), "seq")
    if assertions is not None:
        good = assertions.where("grounded = 1 and polarity not in ('negated', 'retracted')")
        rows = rows.unionByName(good.select("mention_id", "kind", "value", F.lit(1).alias("lane"), "seq"))
    rows = rows.where("mention_id is not null and value <> ''")
    return rows.groupBy("mention_id").pivot("kind", list(IDENTIFIERS)).agg(F.min_by("value", F.struct("lane", "seq", "value")))


def mention_frame(mentions: DataFrame, identifiers: DataFrame) -> DataFrame:
    """E5: mentions (mention_id, claim_id, surface) with names' parts and keys, and their identifiers' keys."""
    norm = names.normalize_name(F.col("surface"))
    tokens = F.filter(F.split(norm, " "), lambda t: t != "")
    none = lambda c: F.nullif(c, F.lit(""))
    base = mentions.withColumn("full_name", norm).withColumn("tokens", tokens).join(identifiers, "mention_id", "left")
    parts = contact.address_parts("address")
    last = F.element_at(F.col("tokens"), -1)
    return base.withColumn("parts", F.when(F.col("address").isNotNull(), parts)).select(
        "mention_id",
        "claim_id",
        "full_name",
        F.array_join(F.array_sort("tokens"), " ").alias("name_sorted"),
        F.get("tokens", 0).alias("first_name"),
        F.when(F.size("tokens") > 0, last).alias("last_name"),
        F.when(F.size("tokens") > 0, names.soundex_key(last)).alias("name_soundex"),
        none(F.col("email")).alias("email"),
        none(contact.phone_last7(F.col("phone"))).alias("phone7"),
        *[none(F.col(c)).alias(c) for c in ("npi", "tin", "ssn", "vin", "dob")],
        none(contact.address_key(F.col("address"))).alias("address_key"),
        *[none(F.col(f"parts.{c}")).alias(f"address_{c}") for c in ("street", "city", "state", "zip")],
    )


#: Mentions in a task's share of one value: a value of more is dealt over several shares, in which LEFT_SHARE mentions meet RIGHT_SHARE.
LEFT_SHARE, RIGHT_SHARE = 2_048, 65_536
#: Mentions for each task of a rule's join; the pairs grow faster than the rows, so rows alone don't give the number of tasks.
TASK_MENTIONS = 8_192


def block(frame: DataFrame, rules: tuple[tuple[str, ...], ...] = BLOCKING, new_ids: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """id_l < id_r and match_key, the first rule that proposes the pair.

    Rules whose columns the frame lacks propose nothing but keep their number. new_ids (mention_id):
    only pairs with one of these are proposed, by joins that have them on one side. A value that
    very many mentions share makes a pair for each two of them by the rule's own meaning; most, if
    given, leaves values of more mentions than that to the other rules, and is never set silently.
    """
    return _proposed(frame, rules, new_ids, most)[0].select("id_l", "id_r", "match_key")


def candidates(frame: DataFrame, rules: tuple[tuple[str, ...], ...] = BLOCKING, new_ids: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """The pairs of block() with the columns of both mentions, as name_l and name_r."""
    pairs, whole = _proposed(frame, rules, new_ids, most)
    return pairs if whole else paired(pairs, frame)


def _proposed(frame: DataFrame, rules: tuple[tuple[str, ...], ...], new_ids: DataFrame | None, most: int | None) -> tuple[DataFrame, bool]:
    """The pairs, once each, and whether they hold the columns of both mentions.

    Mentions are shuffled, pairs never: a rule's join carries the digests of the rules before it, and leaves out what
    those propose, so each pair comes once and with its columns. Only a frame with repeated mentions, whose pairs
    a row alone doesn't tell, or with two values of one digest, is paired by a shuffle of pairs.
    """
    used = [i for i, rule in enumerate(rules) if all(c in frame.columns for c in rule)]
    if not used:
        raise ValueError("the frame has the columns of no blocking rule")
    frame = materialize(frame, "block-frame")
    n, plain = _digests_tell(frame, [rules[i] for i in used])
    plain = plain and most is None
    parts = 1 + n // TASK_MENTIONS
    if new_ids is None:
        sides = [(frame, frame)]
    else:  # a new mention and any greater one, a new one and any lesser one that isn't new
        new = materialize(frame.join(new_ids.select("mention_id").distinct(), "mention_id", "left_semi"), "block-new")
        sides = [(new, frame), (frame.join(new.select("mention_id"), "mention_id", "left_anti"), new)]
    found = None
    for at, i in enumerate(used):
        rule = list(rules[i])
        common = None
        if most is not None:
            common = frame.where(" and ".join(f"`{c}` is not null" for c in rule)).groupBy(*rule).count().where(F.col("count") > most).select(*rule)
        for one, other in sides:
            earlier = [rules[e] for e in used[:at]] if plain else []
            pairs = _within(one, other, rule, earlier, common, parts).withColumn("match_key", F.lit(i))
            found = pairs if found is None else found.unionByName(pairs)
    return (found, True) if plain else (found.groupBy("id_l", "id_r").agg(F.min("match_key").alias("match_key")), False)


def _digest(rule: tuple[str, ...], seed: int = 42) -> Column:
    """A long of a rule's values, null if one is missing."""
    return F.when(reduce(and_, [F.col(c).isNotNull() for c in rule]), F.xxhash64(F.lit(seed), *rule))


def _digests_tell(frame: DataFrame, rules: list[tuple[str, ...]]) -> tuple[int, bool]:
    """How many mentions there are, and whether none is repeated and no two values of a rule have one digest (a second one tells them apart)."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), _digest(r).alias("d"), _digest(r, 43).alias("s")) for i, r in enumerate([("mention_id",), *rules])])
    seen = frame.select(F.explode(each).alias("x")).where("x.d is not null").groupBy("x.i", "x.d").agg(F.count("*").alias("n"), F.min("x.s").alias("a"), F.max("x.s").alias("b"))
    n, odd = seen.agg(F.coalesce(F.sum(F.when(F.col("i") == 0, F.col("n"))), F.lit(0)), F.count_if((F.col("a") != F.col("b")) | ((F.col("i") == 0) & (F.col("n") > 1)))).first()
    return n, odd == 0


def _within(one: DataFrame, other: DataFrame, rule: list[str], earlier: list[tuple[str, ...]], common: DataFrame | None, parts: int) -> DataFrame:
    """Pairs, the lesser mention of one and the greater of other, with equal values of a rule that aren't common, and not of an earlier rule. A value of many rows is several tasks' work."""
    keys = [f"__k{i}" for i in range(len(rule))]
    known = lambda df: reduce(lambda d, kc: d.where(F.col(kc[1]).isNotNull()).withColumn(kc[0], F.col(kc[1])), zip(keys, rule, strict=True), df)
    one, other = known(one), known(other)
    if common is not None:
        common = common.toDF(*keys)
        one, other = one.join(common, keys, "left_anti"), other.join(common, keys, "left_anti")
    # Values of more rows than a share: at most a row of this table for so many of the frame, whatever its size.
    large = lambda df, share, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / share).cast("int").alias(name)).where(F.col(name) > 1)
    sizes = F.broadcast(large(one, LEFT_SHARE, "__a").join(large(other, RIGHT_SHARE, "__b"), keys, "full"))
    placed = lambda df: df.join(sizes, keys, "left").fillna(1, ["__a", "__b"])
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    deal = lambda df, i, j: df.withColumn("__i", i).withColumn("__j", j).drop("__a", "__b").repartition(parts, *keys, "__i", "__j")
    # The test of a pair must stay so short that the JVM compiles it: a long for each earlier rule, which differs where a value is missing.
    tested = [f"__e{i}" for i in range(len(earlier))]
    tests = lambda s: [_digest(e).alias(f"{n}_{s}") for n, e in zip(tested, earlier, strict=True)]
    side = lambda df, s: placed(df).select(*keys, "__a", "__b", *tests(s), *[F.col(c).alias(f"id_{s}" if c == "mention_id" else f"{c}_{s}") for c in df.columns if not c.startswith("__")])
    own = lambda n, by: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
    left = deal(side(one, "l"), own("__a", "id_l"), F.explode(every("__b")))
    right = deal(side(other, "r"), F.explode(every("__a")), own("__b", "id_r"))
    new = [F.coalesce(F.col(f"{n}_l") != F.col(f"{n}_r"), F.lit(True)) for n in tested]
    pairs = left.join(right, [*keys, "__i", "__j"]).where(reduce(and_, new, F.col("id_l") < F.col("id_r")))
    return pairs.drop(*[c for c in pairs.columns if c.startswith("__")])


#: Rules whose subsets are counted; of more, pairs are made to be counted.
COUNTED_RULES = 12


def rule_counts(frame: DataFrame, rules: tuple[tuple[str, ...], ...] = BLOCKING) -> DataFrame:
    """match_key and n, how many pairs of block() are credited to each rule that has any, without making a pair.

    For each set of rules the mentions that agree on all of it are counted (values by 128 bits); the pairs that a rule proposes and
    none before it are those counts by inclusion and exclusion. Work is in proportion to mentions, for given rules.
    """
    used = [i for i, rule in enumerate(rules) if all(c in frame.columns for c in rule)]
    if not used:
        raise ValueError("the frame has the columns of no blocking rule")
    frame = materialize(frame, "counts-frame")
    mentions, plain = _digests_tell(frame, [rules[i] for i in used])
    if len(used) > COUNTED_RULES or not plain:
        return block(frame, rules).groupBy("match_key").agg(F.count("*").alias("n"))
    digests = [_digest(rules[i], s + 2 * i).alias(f"d{s}_{at}") for at, i in enumerate(used) for s in (0, 1)]
    own = frame.where("mention_id is not null").select(*digests).repartition(1 + mentions // TASK_MENTIONS)  # few bytes, many sets
    held = "|".join(f"if(d0_{at} is null, 0, {1 << at})" for at in range(len(used)))
    sets = own.withColumn("held", F.expr(held)).withColumn("rules", F.explode(F.sequence(F.lit(1), F.lit((1 << len(used)) - 1)))).where("rules & held = rules")
    both_ = ["^".join(f"if(rules & {1 << at} = 0, 0, d{s}_{at})" for at in range(len(used))) for s in (0, 1)]
    agree = sets.select("rules", *[F.expr(e).alias(n) for e, n in zip(both_, "ab", strict=True)]).groupBy("rules", "a", "b").agg(F.count("*").alias("k")).where("k > 1")
    signed = F.when(F.bit_count("rules") % 2 == 1, F.lit(1)).otherwise(F.lit(-1)) * F.expr("k * (k - 1) div 2")
    last = F.get(F.array(*[F.lit(i) for i in used]), F.length(F.bin("rules")) - 1)
    return agree.groupBy(last.alias("match_key")).agg(F.sum(signed).alias("n")).where("n > 0")


def links(frame: DataFrame, rules: tuple[tuple[str, ...], ...]) -> DataFrame:
    """id_l < id_r: each mention with the least one of its value, for each rule: fewer than block()'s pairs, no more than mentions a rule, with the same components."""
    found = None
    for rule in rules:
        own = frame.where(reduce(and_, [F.col(c).isNotNull() for c in rule])).select("mention_id", *rule)
        tied = own.join(own.groupBy(*rule).agg(F.min("mention_id").alias("id_l")), list(rule)).where("id_l < mention_id").select("id_l", F.col("mention_id").alias("id_r"))
        found = tied if found is None else found.union(tied)
    return found


def paired(pairs: DataFrame, frame: DataFrame) -> DataFrame:
    """Pairs with the columns of both mentions, as name_l and name_r."""
    side = lambda s: frame.select(*[F.col(c).alias(f"id_{s}" if c == "mention_id" else f"{c}_{s}") for c in frame.columns])
    return pairs.join(side("l"), "id_l").join(side("r"), "id_r")


def both(name: str) -> Column:
    """The two sides agree; null sides never do."""
    return F.coalesce(F.col(f"{name}_l") == F.col(f"{name}_r"), F.lit(False))


def exact_level(name: str) -> Column:
    """-1: a side is missing; 1: equal; 0: else."""
    return F.coalesce((F.col(f"{name}_l") == F.col(f"{name}_r")).cast("int"), F.lit(-1))


def name_level(similarity: Column) -> Column:
    """H9: 5 exact, 4 and 3 by Jaro-Winkler 0.95 and 0.88, 2 contained in the other on one claim, 1 on different claims, 0 else, -1 missing."""
    a, b = (F.concat(F.lit(" "), F.col(f"name_sorted_{s}"), F.lit(" ")) for s in "lr")
    contained = a.contains(b) | b.contains(a)
    missing = F.col("name_sorted_l").isNull() | F.col("name_sorted_r").isNull()
    return F.when(missing, -1).when(both("name_sorted"), 5).when(similarity >= 0.95, 4).when(similarity >= 0.88, 3).when(contained & both("claim_id"), 2).when(contained, 1).otherwise(0)


def address_level() -> Column:
    """3 street with zip or city, 2 street, 1 zip or city and state, 0 else, -1 a side without street, city and zip."""
    gone = lambda s: F.coalesce(*[F.col(f"address_{c}_{s}") for c in ("street", "city", "zip")]).isNull()
    street, city, state, code = (F.col(f"address_{c}_l") == F.col(f"address_{c}_r") for c in ("street", "city", "state", "zip"))  # null, and so no branch's, where one is missing
    return F.when(gone("l") | gone("r"), -1).when(street & (code | city), 3).when(street, 2).when(code | (city & state), 1).otherwise(0)


def email_level(similarity: Column) -> Column:
    """4 equal, 3 the same name before the at-sign, 2 a like one (0.88), 1 the same domain, 0 else, -1 missing."""
    user = lambda s: F.substring_index(f"email_{s}", "@", 1)
    domain = lambda s: F.substring_index(f"email_{s}", "@", -1)
    missing = F.col("email_l").isNull() | F.col("email_r").isNull()
    return F.when(missing, -1).when(both("email"), 4).when(user("l") == user("r"), 3).when(similarity >= 0.88, 2).when(domain("l") == domain("r"), 1).otherwise(0)


def full_name_level(first: Column, last: Column) -> Column:
    """5 both names equal, 4 swapped, 3 both alike (0.88), 2 last equal, 1 first equal, 0 else, -1 missing."""
    missing = F.col("last_name_l").isNull() | F.col("last_name_r").isNull()
    swapped = (F.col("first_name_l") == F.col("last_name_r")) & (F.col("last_name_l") == F.col("first_name_r"))
    return F.when(missing, -1).when(both("first_name") & both("last_name"), 5).when(swapped, 4).when((first >= 0.88) & (last >= 0.88), 3).when(both("last_name"), 2).when(both("first_name"), 1).otherwise(0)


EXACT = ("phone7", "npi", "tin", "ssn", "vin", "dob")
#: Levels above 0 of each comparison.
LEVELS = {"full_name": 5, "name_sorted": 5, "email": 4, "address": 3, **dict.fromkeys(EXACT, 1)}


def gammas(pairs: DataFrame) -> DataFrame:
    """H8: the pairs with gamma_<comparison>, the level of each. Comparisons whose columns the pairs lack are left out."""
    has = lambda *names_: all(f"{n}_l" in pairs.columns for n in names_)
    jw = names.jaro_winkler("plain")
    out = pairs
    if has("first_name", "last_name"):
        out = out.withColumn("gamma_full_name", full_name_level(jw("first_name_l", "first_name_r"), jw("last_name_l", "last_name_r")))
    if has("name_sorted", "claim_id"):
        out = out.withColumn("gamma_name_sorted", name_level(jw("name_sorted_l", "name_sorted_r")))
    if has("email"):
        user = lambda s: F.substring_index(f"email_{s}", "@", 1)
        out = out.withColumn("gamma_email", email_level(jw(user("l"), user("r"))))
    if has("address_street", "address_city", "address_state", "address_zip"):
        out = out.withColumn("gamma_address", address_level())
    for c in EXACT:
        if has(c):
            out = out.withColumn(f"gamma_{c}", exact_level(c))
    return out


@dataclass
class Model:
    """Match prior, and m and u of each comparison's levels (0 first); estimated marks levels that data reached."""

    prior: float
    m: dict[str, list[float]]
    u: dict[str, list[float]]
    estimated: dict[str, list[bool]] = field(default_factory=dict)
    rules: tuple = BLOCKING

    def signature(self) -> tuple:
        """What the model was trained for: comparisons, their levels, and the blocking rules."""
        return tuple(sorted((k, len(v)) for k, v in self.m.items())), self.rules

    def bits(self, name: str, level: int) -> float:
        return math.log2(self.m[name][level] / self.u[name][level]) if level >= 0 else 0.0

    def check(self, comparisons: list[str], rules: tuple = BLOCKING) -> None:
        """Refuse data with other comparisons, or other rules, than the model's."""
        if set(comparisons) != set(self.m) or rules != self.rules:
            raise UncalibratedModel(f"trained for {sorted(self.m)} with {len(self.rules)} rules, used for {sorted(comparisons)} with {len(rules)}")


def rising(levels: int) -> list[float]:
    """A distribution over levels from 0 up, each twice as likely as the one below: where EM starts."""
    return [2.0**i / (2.0**levels - 1) for i in range(levels)]


def default_model(comparisons: list[str]) -> Model:
    """Parameters that depend on the levels' number alone, for tests and for data too small to train on."""
    m, u = {}, {}
    for c in comparisons:
        n = LEVELS[c] + 1
        m[c] = rising(n)
        down = [4.0**-i for i in range(n)]
        u[c] = [x / sum(down) for x in down]
    return Model(0.01, m, u, {c: [True] * (LEVELS[c] + 1) for c in comparisons})


def weight(model: Model, name: str) -> Column:
    """Bits that a comparison's level adds; 0 for missing."""
    bits = F.array(*[F.lit(model.bits(name, level)) for level in range(len(model.m[name]))])  # a constant: a ladder of CASEs makes more code than the JVM compiles
    return F.coalesce(F.get(bits, F.col(f"gamma_{name}")), F.lit(0.0))


def score(levels: DataFrame, model: Model, threshold: float = 0.01) -> DataFrame:
    """Pairs with match_weight, probability and uncalibrated (names of comparisons at a level that data never reached), from the threshold up."""
    present = [c.removeprefix("gamma_") for c in levels.columns if c.startswith("gamma_")]
    model.check(present, model.rules)
    total = F.lit(math.log2(model.prior / (1 - model.prior)))
    for c in present:
        total = total + weight(model, c)
    odd = [F.when(F.col(f"gamma_{c}").isin([i for i, e in enumerate(model.estimated.get(c, [])) if not e] or [-9]), F.lit(c)) for c in present]
    scored = levels.withColumn("match_weight", total).withColumn("probability", 1 / (1 + F.pow(F.lit(2.0), -F.col("match_weight"))))
    return scored.withColumn("uncalibrated", F.array_join(F.array_compact(F.array(*odd)), ",")).where(F.col("probability") >= threshold)


def contributions(levels: DataFrame, model: Model) -> DataFrame:
    """id_l, id_r, step, comparison, level, bits, running_probability: the pair's evidence in order, from the prior (step 0)."""
    present = [c.removeprefix("gamma_") for c in levels.columns if c.startswith("gamma_")]
    prior = math.log2(model.prior / (1 - model.prior))
    first = F.struct(F.lit(0).alias("step"), F.lit("prior").alias("comparison"), F.lit(-1).alias("level"), F.lit(prior).alias("bits"))
    rest = [F.struct(F.lit(i).alias("step"), F.lit(c).alias("comparison"), F.col(f"gamma_{c}").alias("level"), weight(model, c).alias("bits")) for i, c in enumerate(present, 1)]
    rows = levels.withColumn("all", F.array(first, *rest))
    running = F.transform("all", lambda x, i: F.struct(x["step"].alias("step"), x["comparison"].alias("comparison"), x["level"].alias("level"), x["bits"].alias("bits"), F.aggregate(F.slice("all", F.lit(1), i + 1), F.lit(0.0), lambda a, y: a + y["bits"]).alias("total")))
    each = rows.select("id_l", "id_r", F.explode(running).alias("s"))
    return each.select("id_l", "id_r", "s.step", "s.comparison", "s.level", "s.bits", (1 / (1 + F.pow(F.lit(2.0), -F.col("s.total")))).alias("running_probability"))


def estimate_prior(frame: DataFrame, rules: tuple = PRIOR_RULES, recall: float = PRIOR_RECALL) -> DataFrame:
    """H5: n_mentions, n_caught, prior: pairs that a rule of high precision catches, over recall, over all pairs."""
    caught = rule_counts(frame, rules).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_caught"))
    n = frame.agg(F.count("*").alias("n_mentions"))
    both_ = n.crossJoin(caught)  # one row each
    pairs = F.col("n_mentions") * (F.col("n_mentions") - 1) / 2
    return both_.select("n_mentions", "n_caught", F.when(pairs > 0, F.col("n_caught") / F.lit(recall) / pairs).alias("prior"))


def estimate_u(frame: DataFrame, most_pairs: int = 2_000_000, seed: int = 7) -> dict[str, list[float]]:
    """H6: level frequencies over all pairs of mentions drawn at random.

    most_pairs is the sample's documented bound: as many mentions are drawn first as make so many
    pairs (2,000 for 2 million), so no pair is made to be thrown away, whatever the frame's size. The draw is by
    a hash of the mention, so it is the same again.
    """
    n = frame.count()
    if n < 2:
        raise ValueError("u needs two mentions")
    drawn = 1 + math.isqrt(2 * most_pairs)
    own = frame
    if n > drawn:
        by = F.xxhash64("mention_id", F.lit(seed))
        bound = int(-(2**63) + 2**64 * min(1.0, (drawn + 4 * math.sqrt(drawn)) / n))
        # A few more than wanted pass the bound; the first of them by the hash are taken.
        own = frame.withColumn("__h", by).where(F.col("__h") < F.lit(min(bound, 2**63 - 1))).orderBy("__h", "mention_id").limit(drawn).drop("__h")
    own = materialize(own, "u-sample")
    ids = own.select("mention_id")
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the sample is one file, its pairs are many
    pairs = ids.toDF("id_l").repartition(parts).join(F.broadcast(ids.toDF("id_r")), F.col("id_l") < F.col("id_r"))  # drawn rows at most
    return _frequencies(gammas(paired(pairs, own)))


def _frequencies(levels: DataFrame) -> dict[str, list[float]]:
    present = [c.removeprefix("gamma_") for c in levels.columns if c.startswith("gamma_")]
    row = levels.agg(*[F.count_if(F.col(f"gamma_{c}") == i).alias(f"{c}:{i}") for c in present for i in range(LEVELS[c] + 1)]).first()
    out = {}
    for c in present:
        counts = [row[f"{c}:{i}"] + 0.5 for i in range(LEVELS[c] + 1)]
        out[c] = [x / sum(counts) for x in counts]
    return out


def patterns(levels: DataFrame, by: str) -> dict[int, list[tuple[dict[str, int], int]]]:
    """H7: for each value of `by`, the distinct vectors of levels and how many pairs have each: at most the product of the levels' numbers, whatever the data."""
    present = [c for c in levels.columns if c.startswith("gamma_")]
    out: dict[int, list[tuple[dict[str, int], int]]] = {}
    for r in levels.groupBy(by, *present).count().collect():
        out.setdefault(r[by], []).append(({c.removeprefix("gamma_"): r[c] for c in present}, r["count"]))
    return out


def expectation_maximisation(counts: list[tuple[dict[str, int], int]], u: dict[str, list[float]], prior: float, fixed: frozenset[str] = frozenset(), rounds: int = 25) -> tuple[dict[str, list[float]], dict[str, list[bool]]]:
    """H7: m of each comparison from counted patterns, u held; comparisons in fixed were blocked on and stay out. Also which levels were seen."""
    names_ = [c for c in u if c not in fixed]
    m = {c: rising(len(u[c])) for c in names_}
    seen = {c: [any(p[c] == i for p, _ in counts) for i in range(len(u[c]))] for c in names_}
    lam = max(prior, 1e-6)
    for _ in range(rounds):
        sums = {c: [1e-6] * len(u[c]) for c in names_}
        total = weight_ = 0.0
        for p, n in counts:
            a, b = lam, 1 - lam
            for c in names_:
                if p[c] >= 0:
                    a *= m[c][p[c]]
                    b *= u[c][p[c]]
            r = a / (a + b) if a + b else 0.0
            total += n
            weight_ += r * n
            for c in names_:
                if p[c] >= 0:
                    sums[c][p[c]] += r * n
        m = {c: [x / sum(s) for x in s] for c, s in sums.items()}
        lam = min(max(weight_ / total if total else prior, 1e-6), 1 - 1e-6)
    return m, seen


#: Blocking of the training passes, and what each holds fixed.
PASSES = ((("email",), ("email",)), (("phone7",), ("phone7",)), (("address_key",), ("address",)), (("full_name",), ("full_name", "name_sorted")), (("last_name",), ("full_name", "name_sorted")))


def train(frame: DataFrame, least_pairs: int = 20) -> Model:
    """Prior, u by sampling, m by EM over several blockings, averaged; passes of fewer than least_pairs pairs are skipped.

    A level that no pass reached keeps a default and is marked, so that scores that use it say so.
    """
    frame = materialize(frame, "train-frame")
    prior = estimate_prior(frame).first()["prior"] or 1e-4
    u = estimate_u(frame)
    runs: list[dict[str, list[float]]] = []
    seen: dict[str, list[bool]] = {c: [False] * len(v) for c, v in u.items()}
    passes = [(rule, held) for rule, held in PASSES if all(c in frame.columns for c in rule)]
    blocked = None  # the pairs of all passes, whose patterns one job counts
    for i, (rule, _) in enumerate(passes):
        own = block(frame, (rule,)).select("id_l", "id_r", F.lit(i).alias("pass"))
        blocked = own if blocked is None else blocked.union(own)
    found = patterns(gammas(paired(blocked, frame)), "pass") if passes else {}
    for i, (_, held) in enumerate(passes):
        counts = found.get(i, [])
        if sum(n for _, n in counts) < least_pairs:
            continue
        m, own = expectation_maximisation(counts, u, prior, frozenset(held))
        runs.append(m)
        for c, v in own.items():
            seen[c] = [a or b for a, b in zip(seen[c], v, strict=True)]
    m = {}
    for c in u:
        got = [r[c] for r in runs if c in r]
        m[c] = [sum(x) / len(got) for x in zip(*got, strict=True)] if got else default_model([c]).m[c]
    return Model(min(max(prior, 1e-6), 0.5), m, u, seen)


def cannot_link() -> Column:
    """Why two mentions of a pair can't be one entity, null if they can; a missing value never conflicts."""
    a, b = names.name_suffix(F.col("full_name_l")), names.name_suffix(F.col("full_name_r"))
    out = F.when((a != b) & both("address_key"), "jr_sr_conflict")
    for c in ("npi", "tin", "ssn"):
        out = out.when(F.col(f"{c}_l") != F.col(f"{c}_r"), f"conflicting_{c}")
    return out


def majority(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Key and the value that most of its rows have; of equals the one seen first, by order."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", F.negative("at"))).alias(value))


def materialise(components: DataFrame, mentions: DataFrame) -> DataFrame:
    """entity_id, canonical_name, entity_class, n_mentions: one row per component.

    components: node, component. mentions: mention_id, surface, entity_class, position. The id is a
    digest of the members that doesn't depend on their order (120 bits of the exclusive or of their hashes, their
    number and the least of them), so the same members give the same id and a component of any size
    is aggregated, never gathered.
    """
    own = components.join(mentions.withColumnRenamed("mention_id", "node"), "node")
    digest = F.md5(F.col("node").cast("string"))
    half = lambda at: F.bit_xor(F.conv(F.substring(digest, at, 15), 16, 10).cast("long"))
    members = own.groupBy("component").agg(half(1).alias("x"), half(16).alias("y"), F.count("*").alias("n_mentions"), F.min("node").alias("least"))
    ids = members.select("component", "n_mentions", F.concat(F.lit("E"), F.substring(F.sha1(F.concat_ws(":", "x", "y", "n_mentions", "least")), 1, 12)).alias("entity_id"))
    name = majority(own, "component", "surface", "position").withColumnRenamed("surface", "canonical_name")
    kind = majority(own, "component", "entity_class", "position")
    return ids.join(name, "component").join(kind, "component").select("entity_id", "canonical_name", "entity_class", "n_mentions")


def calibration_report(spark, model: Model) -> DataFrame:
    """Comparison, level, m, u, bits, estimated: what each level of each comparison is worth, a row a level."""
    rows = [(c, i, model.m[c][i], model.u[c][i], model.bits(c, i), bool(model.estimated.get(c, [])[i : i + 1] == [True])) for c in sorted(model.m) for i in range(len(model.m[c]))]
    return spark.createDataFrame(rows, "comparison string, level int, m double, u double, bits double, estimated boolean")
