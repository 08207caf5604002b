"""Notes, firm exports, hashes and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# The columns of a firm's export, as its header spells them, and other spellings of them.
FIRM_COLUMNS = (
    "claim_number", "recordType", "entity_category_name", "entity_subcategory_name", "entity_name", "entity_address", "entity_city",
    "entity_state", "entity_zip_code", "entity_phone", "entity_TIN", "entity_NER_tag", "Entity_Watchlist_flag", "Exact_search_Note_ID",
    "Exact_search_matched_watchlist_entity_name", "GenAI_search_Note_ID", "GenAI_entityNameClearned", "GenAI_tok_sort_similarity",
    "Watchlist_entity_id", "Watchlist_entity_name", "watchlist_address", "watchlist_city", "watchlist_state", "watchlist_zip_code",
    "watchlist_phone", "watchlist_TIN",
)
ALIASES = {
    "recordtype (entity/ genai_only/ exact_search)": "recordType", "entity_category": "entity_category_name",
    "entity_subcategory": "entity_subcategory_name", "entity_zip": "entity_zip_code", "entity_ner": "entity_NER_tag",
    "genai_note_id": "GenAI_search_Note_ID", "genai_entitynamecleaned": "GenAI_entityNameClearned",
}


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """A1: doc_id and text of every .txt file under path; ids are file names without ending."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return files.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1).alias("doc_id"), F.col("value").alias("text"))


def read_notes_strict(spark: SparkSession, path: str) -> DataFrame:
    """A4: doc_id, text, sha256 of the raw bytes, valid; a byte-order mark is dropped, invalid UTF-8 has no text."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    body = F.when(F.hex(F.substring("content", 1, 3)) == "EFBBBF", F.expr("substring(content, 4, length(content) - 3)")).otherwise(F.col("content"))
    text = F.try_validate_utf8(body.cast("string"))
    return raw.select(F.regexp_extract("path", r"([^/]*)\.txt$", 1).alias("doc_id"), text.alias("text"), F.sha2("content", 256).alias("sha256"), text.isNotNull().alias("valid"))


def named(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """A1: only the named documents; ids repeat or are missing without harm."""
    return docs.join(ids.select("doc_id"), "doc_id", "left_semi")


def ingest(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Documents with claim and occurrence from the index (never from the text), category of the header, length."""
    unknown = lambda c: F.coalesce(c, F.lit("UNKNOWN")).alias(c)
    j = docs.join(index.select("doc_id", "claim_id", "occurrence_id"), "doc_id", "left")
    return j.select("doc_id", unknown("claim_id"), unknown("occurrence_id"), F.lower(F.regexp_extract("text", r"^\[([A-Z0-9_]+)\]", 1)).alias("category"), F.length("text").cast("long").alias("n_chars"), "text")


def parse_names(files: DataFrame, stem: str, order: str) -> DataFrame:
    """A3: claim and note by the last underscore; names without both are left out; duplicate marks all but the first by order."""
    p = files.withColumn("claim", F.regexp_extract(stem, "^(.+)_([^_]+)$", 1)).withColumn("note", F.regexp_extract(stem, "^(.+)_([^_]+)$", 2)).where("claim <> '' and note <> ''")
    w = Window.partitionBy("claim", "note").orderBy(order)
    return p.withColumn("duplicate", F.row_number().over(w) > 1)


def natural(name: str) -> Column:
    """A3: a sort key by which N2 comes before N10: every run of digits is padded to 20."""
    pieces = F.regexp_extract_all(name, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 20, "0")).otherwise(F.lower(p))), "")


def hashes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key and the SHA-256 of each text."""
    return docs.select(key, F.sha2("text", 256).alias("hash"))


class HashMismatch(RuntimeError):
    """A corpus isn't the one that its hashes were written for."""


def verify_hashes(written: DataFrame, now: DataFrame, key: str = "doc_id") -> None:
    """Raise if a document is missing, extra or changed."""
    from notewright.operators.annotate import three_way

    odd = three_way(written, now, key, "hash").groupBy("change").count().collect()
    if odd:
        raise HashMismatch(", ".join(f"{r['count']} {r['change']}" for r in sorted(odd)))


def firm_rows(raw: DataFrame) -> tuple[DataFrame, list[str]]:
    """A firm's rows by canonical columns, all strings, and warnings. Raises for a table that can't be read safely.

    Headers are matched without case; other spellings are known; missing columns are ''. Row ids
    are claim#n in the order of the input, which raw keeps in __order.
    """
    known = {c.lower(): c for c in FIRM_COLUMNS} | ALIASES
    mapped = {c: known.get(c.strip().lower(), c.strip()) for c in raw.columns if c != "__order"}
    if len(set(mapped.values())) < len(mapped):
        raise ValueError("ambiguous duplicate columns")
    if not {"claim_number", "entity_name"} <= set(mapped.values()):
        raise ValueError("needs at least claim_number and entity_name")
    back = {v: k for k, v in mapped.items()}
    missing = [c for c in FIRM_COLUMNS if c not in back]
    cell = lambda c: F.trim(F.coalesce(F.col(f"`{back[c]}`").cast("string"), F.lit(""))) if c in back else F.lit("")
    rows = raw.select("__order", *[cell(c).alias(c) for c in FIRM_COLUMNS]).where("claim_number <> ''")
    n = F.row_number().over(Window.partitionBy("claim_number").orderBy("__order"))
    out = rows.withColumn("seq", n).withColumn("row_id", F.concat("claim_number", F.lit("#"), F.col("seq").cast("string"))).drop("__order")
    return out, [f"missing columns {', '.join(missing)} (treated as empty)"] if missing else []


def read_firm_csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Firm rows of a CSV file or folder; cells keep leading zeros, may hold line ends and doubled quotes."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, encoding="UTF-8")
    raw = raw.toDF(*[c.removeprefix("﻿") for c in raw.columns])
    return firm_rows(raw.withColumn("__order", F.monotonically_increasing_id()))


def bind_surfaces(relations: DataFrame, mentions: DataFrame, gap: int = 12) -> DataFrame:
    """Rel, mention, how: by equal surface, else by containment either way with lengths at most gap apart; the least mention of several.

    relations: rel, t. mentions: mention, s. Containment has no equi-key of its own; a shared
    trigram is one, as every string of three characters or more within another shares them all.
    """
    # Each text is met once, with its least mention, however many mentions or relations have it.
    mentions = mentions.where("s is not null").groupBy("s").agg(F.min("mention").alias("mention"))
    exact = relations.join(mentions, F.col("t") == F.col("s")).groupBy("rel").agg(F.min("mention").alias("mention")).withColumn("how", F.lit("exact"))
    rest = relations.join(exact, "rel", "left_anti").where("t is not null")
    texts = rest.select("t").distinct()
    # The rarest trigram of the shorter string isn't known before the join; its first one is in the longer string too.
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    head = lambda c: F.substring(c, 1, 3)
    near = (F.col("t") != F.col("s")) & (F.abs(F.length("t") - F.length("s")) <= gap) & (F.col("s").contains(F.col("t")) | F.col("t").contains(F.col("s")))
    inside = texts.withColumn("g", head(F.col("t"))).join(mentions.withColumn("g", F.explode(grams(F.col("s")))), "g").where(near)
    around = texts.withColumn("g", F.explode(grams(F.col("t")))).join(mentions.withColumn("g", head(F.col("s"))), "g").where(near)
    least = inside.select("t", "mention").union(around.select("t", "mention")).groupBy("t").agg(F.min("mention").alias("mention"))
    partial = rest.join(least, "t").groupBy("rel").agg(F.min("mention").alias("mention")).withColumn("how", F.lit("partial"))
    return exact.unionByName(partial)


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """A table as Parquet."""
    df.write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table whose files may have gained columns over time."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def migrate(df: DataFrame, schema) -> DataFrame:
    """The rows with every declared column; those they lack are null, nothing is dropped or renamed."""
    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in have])


def export_bundle(tables: dict[str, DataFrame], path: str, sealed: DataFrame | None = None, practice: Column | None = None) -> None:
    """Each table as a CSV folder. sealed (claim, reviewer): only what a reviewer has sealed; practice: rows to leave out."""
    for name, df in tables.items():
        out = df
        if sealed is not None and {"claim", "reviewer"} <= set(df.columns):
            out = out.join(sealed.select("claim", "reviewer").distinct(), ["claim", "reviewer"], "left_semi")
        if practice is not None and "claim" in df.columns:
            out = out.where(~practice)
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in out.dtypes]
        out.select(*flat).write.mode("overwrite").csv(f"{path}/{name}", header=True, quote='"', escape='"')


def comparison_table(firm: DataFrame, pairings: DataFrame, gold: DataFrame) -> DataFrame:
    """Firm rows with their paired gold entity, and gold entities that no row names; source tells them apart."""
    left = firm.join(pairings.select("row_id", "entity_id"), "row_id", "left").withColumn("source", F.when(F.col("entity_id").isNull(), "firm only").otherwise("both"))
    only = gold.join(pairings.where("entity_id is not null").select("entity_id"), "entity_id", "left_anti").select("claim", "entity_id").withColumn("source", F.lit("gold only"))
    return left.unionByName(only, allowMissingColumns=True)
