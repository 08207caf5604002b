"""Append-only record logs and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of records, forms of mentions, fields of details and states.
KINDS = ("mention", "detail", "description", "action", "unclear")
FORMS = ("name", "alias", "pronoun", "description")
OWNED = ("mention", "detail", "description", "action")
IGNORED = ("row_id", "revision", "created_at", "after_seal")


def current(log: DataFrame, key: str = "uid") -> DataFrame:
    """The highest revision of each record, where it is accepted."""
    best = log.groupBy(key).agg(F.max_by(F.struct(*log.columns), "revision").alias("r"))
    return best.select("r.*").where("state = 'accepted'")


def retire(log: DataFrame, uids: DataFrame, reason: str) -> DataFrame:
    """K1: the log with a new retired revision of each of these records; nothing is ever changed in place."""
    now = current(log).join(uids.select("uid"), "uid", "left_semi")
    gone = now.withColumn("revision", F.col("revision") + 1).withColumn("state", F.lit("retired")).withColumn("reason", F.lit(reason))
    return log.unionByName(gone.select(*log.columns))


def history(log: DataFrame, uid: Column) -> DataFrame:
    """K1: all revisions of a record, oldest first."""
    return log.where(F.col("uid") == uid).orderBy("revision")


def violations(records: DataFrame, entities: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """K2: uid, problem: a row for each rule that a record breaks.

    records: uid, kind, claim, reviewer, entity_id, entity2_id, form, field, value, reason, start, end, note_length, quote.
    """
    e = entities.select(F.col("entity_id").alias("__e"), F.col("claim").alias("__c"), F.col("reviewer").alias("__r"))
    j = records.join(e, records["entity_id"] == F.col("__e"), "left")
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = [
        ("unknown kind", ~F.col("kind").isin(*KINDS)),
        ("no owner", F.col("kind").isin(*OWNED) & empty("entity_id")),
        ("owner of another claim", F.col("__e").isNotNull() & ((F.col("__c") != F.col("claim")) | (F.col("__r") != F.col("reviewer")))),
        ("unknown owner", ~empty("entity_id") & F.col("__e").isNull()),
        ("no form", (F.col("kind") == "mention") & ~F.coalesce(F.col("form").isin(*FORMS), F.lit(False))),
        ("no field", (F.col("kind") == "detail") & ~F.coalesce(F.col("field").isin(*fields), F.lit(False))),
        ("no value", (F.col("kind") == "detail") & empty("value")),
        ("no reason", (F.col("kind") == "unclear") & empty("reason")),
        ("same parties", (F.col("kind") == "action") & F.coalesce(F.col("entity_id") == F.col("entity2_id"), F.lit(False))),
        ("bad span", ~F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("note_length")), F.lit(False))),
        ("empty quote", empty("quote")),
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    return j.select("uid", F.explode(found).alias("problem"))


def identical(records: DataFrame, candidates: DataFrame, on: list[str]) -> DataFrame:
    """K3: candidates (candidate_id and the columns on) with the uid of a current record that agrees in all, nulls included."""
    # One row for equal records: candidates meet each at most once, however many agree.
    r = records.groupBy(*[F.col(c).alias(f"{c}_r") for c in on]).agg(F.min("uid").alias("uid"))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_r"))
    return candidates.join(r, same).groupBy("candidate_id").agg(F.min("uid").alias("uid"))


def basis(records: DataFrame, by: str = "entity_id") -> DataFrame:
    """A digest of an entity's evidence: any change of a record changes it."""
    columns = [c for c in records.columns if c not in (*IGNORED, by)]
    row = F.to_json(F.struct(*columns))
    return records.groupBy(by).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(row))), 256).alias("basis"))


def stale(decisions: DataFrame, bases: DataFrame, by: str = "entity_id") -> DataFrame:
    """K4: decisions whose basis is not that of the present evidence."""
    now = bases.withColumnRenamed("basis", "__now")
    return decisions.join(now, by, "left").where(~F.col("basis").eqNullSafe(F.col("__now"))).drop("__now")


def completeness(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Claim, n_rows, n_decided, complete, digest of the decided rows."""
    d = rows.join(decisions, "row_id", "left")
    mark = F.concat_ws(":", F.col("row_id").cast("string"), F.coalesce(F.col("decision").cast("string"), F.lit("")))
    return d.groupBy("claim").agg(F.count("*").alias("n_rows"), F.count("decision").alias("n_decided"), F.bool_and(F.col("decision").isNotNull()).alias("complete"), F.sha2(F.array_join(F.array_sort(F.collect_list(mark)), "|"), 256).alias("digest"))


def category_problems(decisions: DataFrame) -> DataFrame:
    """K5: entity_id, problem. decisions: status, category, n_supports, n_conflicts, subcategory, subcategory_quoted."""
    found = F.array_compact(
        F.array(
            F.when((F.col("status") == "assigned") & (F.coalesce("n_supports", F.lit(0)) == 0), "assigned without support"),
            F.when((F.col("status") == "assigned") & F.col("category").isNull(), "assigned without category"),
            F.when((F.col("status") == "conflicting") & (F.coalesce("n_conflicts", F.lit(0)) == 0), "conflicting without conflict"),
            F.when(F.col("subcategory").isNotNull() & ~F.coalesce("subcategory_quoted", F.lit(False)), "subcategory not quoted"),
        )
    )
    return decisions.select("entity_id", F.explode(found).alias("problem"))


def three_way(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Key, change (missing, extra, changed), before, after. Full outer join; equal rows are left out."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    b, a = b.withColumn("__b", F.lit(True)), a.withColumn("__a", F.lit(True))
    j = b.join(a, key, "full_outer")
    change = F.when(F.col("__a").isNull(), "missing").when(F.col("__b").isNull(), "extra").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return j.select(key, change.alias("change"), "before", "after").where("change is not null")


def undo(log: DataFrame, action: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K7: (log with the inverse of an action as new revisions, uids that refuse). action: uid, before and after (json or null).

    A record refuses if its present state isn't the action's after.
    """
    body = F.to_json(F.struct(*[c for c in log.columns if c not in (*IGNORED, "uid")]))
    now = log.groupBy("uid").agg(F.max_by(F.struct(*log.columns), "revision").alias("r")).select("r.*").withColumn("__body", body)
    j = action.join(now, "uid", "left")
    refused = j.where(~F.col("after").eqNullSafe(F.col("__body"))).select("uid")
    good = j.join(refused, "uid", "left_anti")
    kind = log.select([c for c in log.columns if c not in (*IGNORED, "uid")]).schema
    state = F.when(F.col("before").isNull(), "retired").otherwise(F.from_json("before", kind)["state"])
    restored = good.select(
        *[
            (F.col("revision") + 1).alias(c) if c == "revision" else state.alias(c) if c == "state" else F.col(c) if c in (*IGNORED, "uid") else F.coalesce(F.from_json("before", kind)[c], F.col(c)).alias(c)
            for c in log.columns
        ]
    )
    return log.unionByName(restored), refused


def freeze_refusals(reviews: DataFrame, entities: DataFrame, drafts: DataFrame) -> DataFrame:
    """K6: claim, reviewer, refused: why a review can't be frozen, the first reason of several; null if it can, or is frozen already.

    reviews: claim, reviewer, frozen, exposed (the firm's output was seen), complete (all notes are done),
    attested. entities: claim, reviewer, reviewed. drafts: claim, reviewer, status.
    """
    key = ["claim", "reviewer"]
    open_ = entities.where("not reviewed").select(*key).distinct().withColumn("__entity", F.lit(True))
    left = drafts.where("status in ('ready', 'needs_attention')").select(*key).distinct().withColumn("__draft", F.lit(True))
    why = (
        F.when(F.col("frozen"), None)
        .when(F.col("exposed"), "seen before")
        .when(~F.col("complete"), "notes are open")
        .when(F.col("__entity"), "entities are not reviewed")
        .when(F.col("__draft"), "drafts are open")
        .when(~F.col("attested"), "not attested")
    )
    return reviews.join(open_, key, "left").join(left, key, "left").select(*key, why.alias("refused"))


def freeze(reviews: DataFrame, entities: DataFrame, drafts: DataFrame, records: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """K6: (records of the reviews that may be frozen, as they are now, seals: claim, reviewer, frozen_at). Write the first once and never again."""
    good = freeze_refusals(reviews, entities, drafts).where("refused is null").join(reviews.where("not frozen").select("claim", "reviewer"), ["claim", "reviewer"], "left_semi")
    seals = good.select("claim", "reviewer", at.alias("frozen_at"))
    return records.join(seals, ["claim", "reviewer"]), seals


def replace_documents(old: DataFrame, new: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The old rows of other documents and the new rows: ingesting a document again leaves no trace of its first time."""
    return old.join(docs.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows instead of old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def corrected(placements: DataFrame, corrections: DataFrame) -> DataFrame:
    """doc_id, start, end, kind, gt_id after corrections in order of seq.

    A correction names the span it replaces (orig_start, orig_end; its own span if those are null)
    and a later one finds what an earlier one moved or added. Chains are followed by their last
    link: each correction's root is the span that the chain began with.
    """
    c = corrections.select("doc_id", F.coalesce("orig_start", "start").alias("os"), F.coalesce("orig_end", "end").alias("oe"), F.col("start").alias("ns"), F.col("end").alias("ne"), "kind", "gt_id", "seq")
    here = lambda a, b: F.concat_ws(":", a, b)
    per_doc = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", here("os", "oe").alias("from_"), here("ns", "ne").alias("to_"), "ns", "ne", "kind", "gt_id"))).alias("cs"))
    base = placements.select("doc_id", here("start", "end").alias("root"), F.struct(F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e"), "kind", "gt_id").alias("v"))
    fixed = per_doc.withColumn(
        "roots",
        F.expr("aggregate(cs, cast(map() as map<string,string>), (m, c) -> map_concat(map_filter(m, (k, v) -> k <> c.to_), map(c.to_, coalesce(try_element_at(m, c.from_), c.from_))))"),
    )
    last = fixed.select("doc_id", F.explode(F.expr("transform(map_entries(roots), x -> named_struct('root', x.value, 'c', element_at(filter(cs, c -> c.to_ = x.key), -1)))")).alias("x"))
    latest = last.groupBy("doc_id", F.col("x.root").alias("root")).agg(F.max_by("x.c", "x.c.seq").alias("c"))
    j = base.join(latest, ["doc_id", "root"], "full_outer")
    return j.select("doc_id", F.coalesce(F.col("c.ns").cast("int"), F.col("v.s")).alias("start"), F.coalesce(F.col("c.ne").cast("int"), F.col("v.e")).alias("end"), F.coalesce("c.kind", "v.kind").alias("kind"), F.coalesce("c.gt_id", "v.gt_id").alias("gt_id"))


def accepted_drafts(drafts: DataFrame, records: DataFrame, compare: list[str]) -> DataFrame:
    """K8: draft_id, uid, edited: accepted drafts, and whether their record differs from what was drafted."""
    r = records.select("uid", "draft_id", *[F.col(c).alias(f"{c}_r") for c in compare])
    differs = F.lit(False)
    for c in compare:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"{c}_r"))
    return drafts.where("status = 'accepted'").join(r, "draft_id").select("draft_id", "uid", differs.alias("edited"))


def resolve_repeats(drafts: DataFrame, occurrences: DataFrame) -> DataFrame:
    """K9: drafts of one quote take its occurrences in reading order, where there are as many of one as of the other.

    drafts: note, quote, seq, draft_id. occurrences: note, quote, start. Others keep a null start.
    """
    w = lambda o: Window.partitionBy("note", "quote").orderBy(o)
    all_ = Window.partitionBy("note", "quote")
    d = drafts.withColumn("rank", F.row_number().over(w("seq"))).withColumn("n", F.count("*").over(all_))
    o = occurrences.withColumn("rank", F.row_number().over(w("start"))).withColumn("n", F.count("*").over(all_))
    return d.join(o, ["note", "quote", "rank", "n"], "left").select("draft_id", "note", "quote", "start")


def exclusive_pairings(pairings: DataFrame) -> DataFrame:
    """The latest pairing of each firm row and reviewer; problem where it names an entity and says that there is none."""
    best = pairings.groupBy("firm_row_id", "reviewer").agg(F.max_by(F.struct("entity_id", "not_in_notes", "seq"), "seq").alias("p"))
    return best.select("firm_row_id", "reviewer", "p.entity_id", "p.not_in_notes", (F.col("p.entity_id").isNotNull() & F.col("p.not_in_notes")).alias("problem"))


def watchlist_eligible(rows: DataFrame, done: DataFrame) -> DataFrame:
    """row_id, note: flagged rows that cite a note, without those reviewed. rows: row_id, flagged, notes (array); done: row_id, note."""
    each = rows.where("flagged").select("row_id", F.explode("notes").alias("note"))
    return each.join(done, ["row_id", "note"], "left_anti")
