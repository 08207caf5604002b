"""Measures against gold data, as conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.operators.intervals import overlap_join


def ratio(num: Column, den: Column) -> Column:
    """num / den; null for nothing to score."""
    return F.when(den > 0, num / den)


def b_cubed(items: DataFrame) -> DataFrame:
    """N, precision, recall, f1 of items (item, pred, gold). Sums over cells of (pred, gold), never over pairs of items."""
    cells = items.where("pred is not null and gold is not null").groupBy("pred", "gold").agg(F.count("*").alias("c"))
    p = cells.groupBy("pred").agg(F.sum("c").alias("np"))
    g = cells.groupBy("gold").agg(F.sum("c").alias("ng"))
    s = cells.join(p, "pred").join(g, "gold").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c") / F.col("np")).alias("p"), F.sum(F.col("c") * F.col("c") / F.col("ng")).alias("r"))
    out = s.select("n", (F.col("p") / F.col("n")).alias("precision"), (F.col("r") / F.col("n")).alias("recall"))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def b_cubed_sweep(labels: DataFrame, gold: DataFrame) -> DataFrame:
    """Threshold and its B-cubed figures. labels: threshold, item, pred; gold: item, gold."""
    joined = labels.join(gold, "item")
    cells = joined.groupBy("threshold", "pred", "gold").agg(F.count("*").alias("c"))
    p = cells.groupBy("threshold", "pred").agg(F.sum("c").alias("np"))
    g = cells.groupBy("threshold", "gold").agg(F.sum("c").alias("ng"))
    s = cells.join(p, ["threshold", "pred"]).join(g, ["threshold", "gold"]).groupBy("threshold").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c") / F.col("np")).alias("p"), F.sum(F.col("c") * F.col("c") / F.col("ng")).alias("r"))
    out = s.select("threshold", "n", (F.col("p") / F.col("n")).alias("precision"), (F.col("r") / F.col("n")).alias("recall"))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def merges(items: DataFrame) -> DataFrame:
    """Kind (over or under), id, n, parts: system entities of several gold ones, and gold entities of several system ones."""
    over = items.groupBy(F.col("pred").cast("string").alias("id")).agg(F.count("*").alias("n"), F.count_distinct("gold").alias("parts")).select(F.lit("over").alias("kind"), "id", "n", "parts")
    under = items.groupBy(F.col("gold").cast("string").alias("id")).agg(F.count("*").alias("n"), F.count_distinct("pred").alias("parts")).select(F.lit("under").alias("kind"), "id", "n", "parts")
    return over.union(under).where("parts > 1")


def recall_by(gold: DataFrame, found: DataFrame, by: str, key: str = "doc_id") -> DataFrame:
    """By, total, hits, recall of gold spans that a found span overlaps. Gold rows whose `by` is null count as (none)."""
    marked = gold.withColumn("__g", F.monotonically_increasing_id())
    hit = overlap_join(marked, found.select(key, "start", "end"), key, "left_semi").select("__g").distinct().withColumn("hit", F.lit(1))
    all_ = marked.join(hit, "__g", "left").withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("(none)")))
    return all_.groupBy(by).agg(F.count("*").alias("total"), F.count("hit").alias("hits")).withColumn("recall", ratio(F.col("hits"), F.col("total")))


def recall_by_tag(gold: DataFrame, found: DataFrame, tags: str, key: str = "doc_id") -> DataFrame:
    """As recall_by, over an array of tags; a row counts for each of its tags, for (none) without any."""
    each = gold.withColumn(tags, F.explode(F.when(F.size(tags) > 0, F.col(tags)).otherwise(F.array(F.lit("(none)")))))
    return recall_by(each, found, tags, key)


def mention_precision(found: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each found span with the gold id it overlaps first (null: false positive). found: mention_id; gold: gt_id."""
    hits = overlap_join(found, gold.select(key, "start", "end", "gt_id"), key)
    first = hits.groupBy("mention_id").agg(F.min_by("gt_id_r", F.struct("start_r", "end_r", "gt_id_r")).alias("gt_id"))
    return found.select("mention_id").join(first, "mention_id", "left")


def identifier_recall(gold: DataFrame, found: DataFrame) -> DataFrame:
    """identifier_kind, orphan, total, hits, recall."""
    marked = gold.withColumn("__g", F.monotonically_increasing_id())
    hit = overlap_join(marked, found.select("doc_id", "start", "end"), "doc_id", "left_semi").select("__g").distinct().withColumn("hit", F.lit(1))
    return marked.join(hit, "__g", "left").groupBy("identifier_kind", "orphan").agg(F.count("*").alias("total"), F.count("hit").alias("hits")).withColumn("recall", ratio(F.col("hits"), F.col("total")))


def coref_accuracy(chains: DataFrame, links: DataFrame, by: str) -> DataFrame:
    """By, total, attempted, correct, coverage, of_attempted, of_all. chains: anaphor, referent, by; links: anaphor, antecedent_entity."""
    j = chains.join(links, "anaphor", "left")
    a = j.groupBy(by).agg(F.count("*").alias("total"), F.count("antecedent_entity").alias("attempted"), F.count_if(F.col("antecedent_entity") == F.col("referent")).alias("correct"))
    return a.withColumn("coverage", ratio(F.col("attempted"), F.col("total"))).withColumn("of_attempted", ratio(F.col("correct"), F.col("attempted"))).withColumn("of_all", ratio(F.col("correct"), F.col("total")))


def majority_mapping(items: DataFrame) -> DataFrame:
    """Pred and the gold entity most of its items have, the least of equals; n and share."""
    c = items.groupBy("pred", "gold").agg(F.count("*").alias("c"))
    return c.groupBy("pred").agg(F.min_by("gold", F.struct(F.negative("c"), "gold")).alias("gold"), F.sum("c").alias("n"), F.max("c").alias("of")).select("pred", "gold", "n", ratio(F.col("of"), F.col("n")).alias("share"))


def never_recovered(gold: DataFrame, mapping: DataFrame) -> DataFrame:
    """Gold ids that no system entity maps to."""
    return gold.select("gold").distinct().join(mapping.select("gold"), "gold", "left_anti")


def top_misses(recalls: DataFrame, least: int = 20, below: float = 0.95, n: int = 6) -> DataFrame:
    """The n weakest patterns (name, total, recall) of at least `least` cases."""
    return recalls.where((F.col("total") >= least) & (F.col("recall") < below)).orderBy("recall", F.desc("total"), "name").limit(n)


def ablation(found: DataFrame, gold: DataFrame, stages: list[str]) -> DataFrame:
    """Stage, position, n_found, recall, lift, newly_rescued, newly_lost: each stage's gold hits against the stage before.

    found: stage, gold_id hit there; gold: gold_id.
    """
    order = F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))])
    hits = found.join(gold, "gold_id", "left_semi").select("stage", "gold_id").distinct().withColumn("position", order[F.col("stage")])
    total = gold.select(F.count_distinct("gold_id").alias("total"))
    now, before = hits.select("gold_id", "position"), hits.select("gold_id", (F.col("position") + 1).alias("position"))
    rescued = now.join(before, ["gold_id", "position"], "left_anti").groupBy("position").agg(F.count("*").alias("newly_rescued"))
    lost = before.where(F.col("position") < len(stages)).join(now, ["gold_id", "position"], "left_anti").groupBy("position").agg(F.count("*").alias("newly_lost"))
    spine = gold.sparkSession.createDataFrame([(s, i) for i, s in enumerate(stages)], "stage string, position int")
    n = hits.groupBy("position").agg(F.count("*").alias("n_found"))
    all_ = spine.join(n, "position", "left").join(rescued, "position", "left").join(lost, "position", "left").crossJoin(F.broadcast(total))  # total is one row
    filled = all_.fillna(0, ["n_found", "newly_rescued", "newly_lost"]).withColumn("recall", ratio(F.col("n_found"), F.col("total")))
    return filled.withColumn("lift", F.col("recall") - F.lag("recall").over(Window.orderBy("position"))).drop("total")  # a row a stage


def literal_recall(docs: DataFrame, values: DataFrame, found: DataFrame) -> DataFrame:
    """Kind, total, hits, recall of the documents that hold a value literally, by whether a found span overlaps one of its places.

    values: doc_id, kind, value. found: doc_id, start, end.
    """
    places = docs.join(values, "doc_id").withColumn("start", F.instr("text", F.col("value")) - 1).where("start >= 0").withColumn("end", F.col("start") + F.length("value"))
    return recall_by(places.select("doc_id", "kind", "start", "end"), found, "kind")


def jaccard_agreement(records: DataFrame) -> DataFrame:
    """Claim, note, reviewer_a < reviewer_b, shared, either, agreement over (kind, start, end, field)."""
    sets = records.groupBy("claim", "note", "reviewer").agg(F.collect_set(F.struct("kind", "start", "end", F.coalesce("field", F.lit("")).alias("field"))).alias("s"))
    b = sets.select("claim", "note", F.col("reviewer").alias("reviewer_b"), F.col("s").alias("t"))
    pairs = sets.withColumnRenamed("reviewer", "reviewer_a").join(b, ["claim", "note"]).where("reviewer_a < reviewer_b")
    shared, either = F.size(F.array_intersect("s", "t")), F.size(F.array_union("s", "t"))
    return pairs.select("claim", "note", "reviewer_a", "reviewer_b", shared.alias("shared"), either.alias("either"), ratio(shared, either).alias("agreement"))


def similarity_bin(value: Column) -> Column:
    """95–100, 85–94, 75–84 or below 75."""
    return F.when(value >= 95, "95–100").when(value >= 85, "85–94").when(value >= 75, "75–84").otherwise("below 75")


def similarity_bins(flags: DataFrame) -> DataFrame:
    """Range, flags, confirmed_same, cant_tell, rate over those decided. flags: similarity, decision."""
    g = flags.groupBy(similarity_bin(F.col("similarity")).alias("range")).agg(F.count("*").alias("flags"), F.count_if(F.col("decision") == "same").alias("confirmed_same"), F.count_if(F.col("decision") == "cant_tell").alias("cant_tell"))
    return g.withColumn("rate", ratio(F.col("confirmed_same"), F.col("flags") - F.col("cant_tell")))


def watchlist_methods(flags: DataFrame) -> DataFrame:
    """Method, same, different, cant_tell, precision. flags: methods (array), decision."""
    each = flags.select(F.explode("methods").alias("method"), "decision")
    g = each.groupBy("method").agg(F.count_if(F.col("decision") == "same").alias("same"), F.count_if(F.col("decision") == "different").alias("different"), F.count_if(F.col("decision") == "cant_tell").alias("cant_tell"))
    return g.withColumn("precision", ratio(F.col("same"), F.col("same") + F.col("different")))


def detail_scores(reported: DataFrame, gold: DataFrame) -> DataFrame:
    """Reported, correct, right_owner, made_up, gold_details, missed, and their rates; one row.

    reported: claim, entity_id (the paired owner, null if none), field, value. gold: claim, entity_id, field, value.
    """
    own = gold.select("claim", "entity_id", "field", "value").distinct()
    any_ = own.select("claim", "field", "value").distinct().withColumn("__any", F.lit(1))
    owned = own.withColumn("__own", F.lit(1))
    j = reported.join(any_, ["claim", "field", "value"], "left").join(owned, ["claim", "entity_id", "field", "value"], "left")
    r = j.agg(F.count("*").alias("reported"), F.count("__any").alias("correct"), F.count("__own").alias("right_owner"), F.count_if(F.col("__any").isNull()).alias("made_up"))
    missed = own.join(reported, ["claim", "entity_id", "field", "value"], "left_anti").agg(F.count("*").alias("missed"))
    n = own.agg(F.count("*").alias("gold_details"))
    out = r.crossJoin(missed).crossJoin(n)  # one row each
    return out.withColumn("detail_accuracy", ratio(F.col("correct"), F.col("reported"))).withColumn("right_owner_rate", ratio(F.col("right_owner"), F.col("correct"))).withColumn("made_up_rate", ratio(F.col("made_up"), F.col("reported"))).withColumn("missed_rate", ratio(F.col("missed"), F.col("gold_details")))


def draft_scores(drafts: DataFrame, records: DataFrame) -> DataFrame:
    """draft_precision, correction_rate, miss_rate; one row. drafts: claim, note, status, edited. records: claim, note, source."""
    d = drafts.agg(F.count_if(F.col("status") == "accepted").alias("a"), F.count_if(F.col("status") == "dismissed").alias("d"), F.count_if((F.col("status") == "accepted") & F.col("edited")).alias("e"))
    r = records.join(drafts.select("claim", "note").distinct(), ["claim", "note"], "left_semi").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "manual").alias("m"))
    return d.crossJoin(r).select(ratio(F.col("a"), F.col("a") + F.col("d")).alias("draft_precision"), ratio(F.col("e"), F.col("a")).alias("correction_rate"), ratio(F.col("m"), F.col("n")).alias("miss_rate"))


def micro_macro(rows: DataFrame, by: str, num: str, den: str) -> DataFrame:
    """Micro (of sums) and macro (mean of ratios that can be scored); one row."""
    g = rows.groupBy(by).agg(F.sum(num).alias("n"), F.sum(den).alias("d"))
    return g.agg(ratio(F.sum("n"), F.sum("d")).alias("micro"), F.avg(ratio(F.col("n"), F.col("d"))).alias("macro"), F.count("*").alias("groups"))


def head_nouns(names: DataFrame, least: int = 3, most_leading: int = 0) -> DataFrame:
    """Token: words that end names after `least` different beginnings and lead at most most_leading. names: words (array)."""
    multi = names.where(F.size("words") >= 2)
    ends = multi.select(F.element_at("words", -1).alias("token"), F.array_join(F.slice("words", F.lit(1), F.size("words") - 1), " ").alias("rest")).groupBy("token").agg(F.count_distinct("rest").alias("n")).where(F.col("n") >= least)
    leads = multi.groupBy(F.get("words", 0).alias("token")).agg(F.count("*").alias("leads"))
    return ends.join(leads, "token", "left").where(F.coalesce("leads", F.lit(0)) <= most_leading).select("token")


def overlay(found: DataFrame, gold: DataFrame) -> DataFrame:
    """doc_id, start, end, verdict: TP and FP for found spans, FN for gold ones that none overlaps."""
    hit = overlap_join(found.select("doc_id", "start", "end").distinct(), gold.select("doc_id", "start", "end"), "doc_id", "left_semi").withColumn("verdict", F.lit("TP"))
    miss = overlap_join(found.select("doc_id", "start", "end").distinct(), gold.select("doc_id", "start", "end"), "doc_id", "left_anti").withColumn("verdict", F.lit("FP"))
    lost = overlap_join(gold.select("doc_id", "start", "end").distinct(), found.select("doc_id", "start", "end"), "doc_id", "left_anti").withColumn("verdict", F.lit("FN"))
    return hit.unionByName(miss).unionByName(lost)


def worst_documents(verdicts: DataFrame, n: int = 40) -> DataFrame:
    """doc_id, problems: documents with most false verdicts first."""
    return verdicts.where("verdict <> 'TP'").groupBy("doc_id").agg(F.count("*").alias("problems")).orderBy(F.desc("problems"), "doc_id").limit(n)


def contamination(labels: DataFrame, gold: DataFrame, gold_id: Column) -> DataFrame:
    """Component, of_gold, others: where the mentions of one gold entity went, and who else is there."""
    mine = gold.where(F.col("gold") == gold_id)
    own = labels.join(mine, "item").groupBy("component").agg(F.count("*").alias("of_gold"))
    all_ = labels.join(gold, "item").join(own.select("component"), "component", "left_semi").groupBy("component").agg(F.count_if(F.col("gold") != gold_id).alias("others"))
    return own.join(all_, "component")
