"""Line dedup: lines that occur in many documents are dropped everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relimpute.llm.tables import ascii_lower, sent_if_small, stored

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    """128 bits, so that distinct lines don't meet by chance at any size of corpus."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep: list[str] | None = None) -> DataFrame:
    """Drop every line whose key is found in at least `min_docs` documents.

    Returns one row per input row: doc_id, text (the lines that stay, joined by a line feed), n_lines
    (before dropping), n_dropped, and the columns named in `keep`. Every document contributes a key once, however often it
    repeats a line and however many rows have its doc_id; rows without doc_id are documents of their own. Every row is
    judged by its own text. NULL and empty texts have one empty line. Keys under
    `min_chars` code points are never dropped. Empty tables give empty results; other columns are ignored.

    Documents emit hashes, not lines. Counting combines them before the exchange, and a hash in a
    third of all documents is one row per task there; only rows of a repeated doc_id are made distinct first. The join that brings frequent hashes
    back to their documents repeats a hot hash on one side only, where Spark splits it; their lines
    are then cut out of the text in place, which keeps positions without sorting.
    """
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"), F.struct(*[docs[f"`{c}`"] for c in keep or []], F.lit(0).alias("_")).alias("rest"))
    # A key of its own for every text: rows may share a doc_id.
    rows = rows.withColumn("row", F.struct("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")))
    keys = F.array_distinct(F.transform(F.split("text", "\n"), line_key))
    keyed = rows.select("row", F.explode(keys).alias("key")).where(F.length("key") >= min_chars).select("row", key_hash(F.col("key")).alias("hash"))
    again = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again"))
    again = stored(again, "repeated-ids")
    if again.isEmpty():
        counts = keyed.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    else:
        told = keyed.withColumn("doc_id", F.col("row.doc_id")).join(sent_if_small(again), F.col("doc_id") == F.col("again"), "left")
        single = told.where("again IS NULL").groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
        several = told.where("again IS NOT NULL").select("hash", "doc_id").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
        counts = single.unionByName(several).groupBy("hash").agg(F.sum("n").alias("n"))
    # A table of its own, so that the join below has its own exchange, which Spark can split.
    frequent = stored(counts.where(F.col("n") >= min_docs).select("hash"), "frequent-lines")
    drops = keyed.join(frequent, "hash").groupBy("row").agg(F.collect_set("hash").alias("drops"))
    joined = rows.join(drops, rows["row"].eqNullSafe(drops["row"]), "left").select("doc_id", "text", "rest", F.coalesce("drops", F.array().cast(drops.schema["drops"].dataType)).alias("drops"))
    lines = F.split("text", "\n")
    stays = lambda line: (F.length(line_key(line)) < min_chars) | ~F.array_contains("drops", key_hash(line_key(line)))
    some = F.size("drops") > 0
    kept = F.when(some, F.filter(lines, stays))
    return joined.select("doc_id", "rest", F.size(lines).cast("bigint").alias("n_lines"), "text", kept.alias("kept")).select(
        "doc_id",
        F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
        "n_lines",
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("kept")).cast("bigint").alias("n_dropped"),
        *[F.col("rest").getField(c).alias(c) for c in keep or []],
    )


def line_dedup_digest(docs: DataFrame, **options) -> DataFrame:
    """`line_dedup` with the digest of the kept text in its place."""
    return line_dedup(docs, **options).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
    SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
    SELECT doc_id, pos, line, key IN (SELECT key FROM frequent) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
