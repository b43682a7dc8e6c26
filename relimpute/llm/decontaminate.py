"""Benchmark decontamination: windows of item words found in documents, by a prefix-filtered set join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relimpute.llm.tables import ascii_lower, sent_if_small, stored, taken, unused

#: What lies between words, after A-Z are in lower case: all of ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def item_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """item_id (text), key (the words, joined by spaces), n: every run of `size` words, or a shorter item as a whole."""
    split = taken(items, item_id=id_col, text=text_col).where("item_id IS NOT NULL").select(F.col("item_id").cast("string"), words_of(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    runs = F.transform(starts, lambda i: F.slice("words", i, size))
    return split.where(F.size("words") > 0).select("item_id", F.explode(runs).alias("run")).select("item_id", F.array_join("run", " ").alias("key"), F.size("run").alias("n")).distinct()


def rarest_words(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """Per distinct window its rarest word by count over all documents, and where it stands: word, at, n, key, wid.

    A window whose words don't all occur can not occur itself and is left out.
    """
    spelled = windows.select("key", "n").distinct().select("key", "n", F.posexplode(F.split("key", " ")).alias("at", "word"))
    vocabulary = stored(spelled.select("word").distinct(), "bench-words")
    counts = docs.select(F.explode("words").alias("word")).join(sent_if_small(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("seen"))
    first = spelled.join(counts, "word").groupBy("key", "n").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("seen", "word", "at")).alias("rare"))
    return first.where("found = n").select(F.col("rare.word").alias("word"), F.col("rare.at").alias("at"), "n", "key", F.xxhash64("key").alias("wid"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """Find every occurrence of an item's window in every document.

    A window is `size` consecutive words of an item; an item of fewer words, but not none, is one window.
    Returns doc_id, n_words, n_hit (words inside any occurrence), hits (start and length of each occurrence,
    in words), items (ids whose windows occur, sorted as text), contaminated. NULL texts have no words.
    Items without an id or without words take no part; repeated items count once. Rows that share a
    doc_id but not the text stay apart; rows that repeat both come out once. Empty tables give no hits or no rows.

    The rarest word of a window is its necessary prefix: no document without it can hold the window. Every
    document word that is such a prefix proposes the windows around it; those that would begin before or
    end after the document are out by position and length, the others are compared word by word where
    they were proposed, so that only true occurrences leave the scan. Words of documents are never exchanged.
    """
    rows = taken(docs, doc_id=doc_id, text=doc_text).select("doc_id", F.xxhash64("text").alias("version"), words_of(F.col("text")).alias("words"))
    windows = stored(item_windows(items, item_id, item_text, size), "windows")
    rare = stored(rarest_words(windows, rows), "rarest")
    spread = rows.select("doc_id", "version", "words", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    proposed = spread.join(sent_if_small(rare), "word", "left")
    start = F.col("pos") - F.col("at")
    inside = F.col("wid").isNotNull() & (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    same = inside & (F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.coalesce("n", F.lit(1))), " ") == F.col("key"))
    found = proposed.withColumn("same", F.coalesce(same, F.lit(False))).where(F.col("same") | (F.coalesce("pos", F.lit(0)) == 0))
    only = lambda c: F.when(F.col("same"), c)
    found = stored(found.select("doc_id", "version", "n_words", only(start).alias("start"), only(F.col("n")).alias("n"), only(F.col("wid")).alias("wid")), "occurrences")

    row = ["doc_id", "version"]
    places = F.collect_set(F.when(F.col("wid").isNotNull(), F.struct("start", "n")))
    per_doc = found.groupBy(*row).agg(F.max("n_words").cast("bigint").alias("n_words"), places.alias("hits"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))
    owners = windows.select(F.xxhash64("key").alias("wid"), "item_id")
    listed = found.where("wid IS NOT NULL").select(*row, "wid").distinct().join(owners, "wid").groupBy(*row).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    listed = listed.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "items")
    out = per_doc.join(listed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left")
    return out.select(
        "doc_id", "version", "n_words", F.size(covered).cast("bigint").alias("n_hit"), F.array_sort("hits").alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminate_digest(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """`decontaminate` with the item list as a count and a digest."""
    found = decontaminate(docs, items, **options)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` in which no window of an item occurs, with all their columns."""
    id_, version = unused(docs, "hit_id", "hit_version")
    bad = decontaminate(docs, items).where("contaminated").select(F.col("doc_id").alias(id_), F.col("version").alias(version))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(version)), "left_anti")


SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), starts AS (
    SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, array_to_string(w[s + 1 : s + 10], ' ') AS key, least(len(w), 10) AS n FROM starts
), places AS (
    SELECT doc_id, w, unnest(range(0, len(w))) AS s FROM d
), runs AS (
    SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS key FROM places, (SELECT DISTINCT n FROM windows) WHERE s + n <= len(w)
), occurs AS (
    SELECT doc_id, s, r.n, item_id FROM runs r JOIN windows USING (key)
), hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occurs) GROUP BY doc_id
), listed AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM occurs) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
