"""Weighted vote over candidates, rankings and write-back of the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relimpute.functions.text import as_double, canonical_text, normalize_value
from relimpute.sources.catalog import Catalog


def votes(weighted: DataFrame, summary: DataFrame) -> DataFrame:
    """(qid, attr, value, w, r): summed weight and ratio per distinct candidate value.

    `summary` holds a handful of (path, column) pairs per attribute. With candidates partitioned by
    `qid` neither this nor the steps after it exchange again.
    """
    chosen = summary.select("attr", "path_id", "col", "ratio")
    picked = weighted.join(F.broadcast(chosen), ["attr", "path_id"])
    valued = picked.withColumn("value", F.element_at("payload", F.col("col"))).where(F.col("value").isNotNull())
    return valued.groupBy("qid", "attr", "value").agg(F.sum("weight").alias("w"), F.sum("ratio").alias("r"))


def counted_votes(scored: DataFrame, summary: DataFrame) -> DataFrame:
    """(qid, attr, value, text, w, r): the votes of all candidates of a cell, however many.

    Equal values are added up where they are found, and so is the total of the cell: what is
    exchanged and normalised is a row per value, not per candidate. `value` is canonical text,
    by which values are told apart; `text` is the lowest of the texts that were found for it.
    """
    # a handful of pairs per attribute
    picks = summary.groupBy("attr", "path_id").agg(F.collect_list(F.struct("col", "ratio")).alias("picks"))
    held = F.transform("picks", lambda p: F.struct(F.element_at("payload", p["col"]).alias("text"), p["ratio"].cast("double").alias("ratio")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("text"), F.lit(0.0).alias("ratio")))
    entries = F.concat(whole, F.filter(F.coalesce(held, F.array().cast("array<struct<text:string,ratio:double>>")), lambda p: p["text"].isNotNull()))
    rows = scored.join(F.broadcast(picks), ["attr", "path_id"], "left").select("qid", "attr", F.exp("score").alias("e"), F.explode(entries).alias("p"))
    rows = rows.select("qid", "attr", "e", normalize_value(F.col("p.text")).alias("value"), "p.text", "p.ratio")
    sums = rows.groupBy("qid", "attr", "value").agg(F.min("text").alias("text"), F.sum("e").alias("w"), F.sum("ratio").alias("r"))
    total = F.max(F.when(F.col("value").isNull(), F.col("w"))).over(W.partitionBy("qid", "attr"))
    return sums.withColumn("w", F.col("w") / total).where(F.col("value").isNotNull())


def answers(voted: DataFrame) -> DataFrame:
    """(qid, attr, value[, text], w, r): the value with the largest (weight, ratio), ties to the lowest value."""
    best = F.min_by(F.struct(*[c for c in ("value", "text", "w", "r") if c in voted.columns]), F.struct((-F.round("w", 9)), (-F.round("r", 9)), F.col("value")))
    return voted.groupBy("qid", "attr").agg(best.alias("_b")).select("qid", "attr", "_b.*")


def value_ranking(voted: DataFrame) -> DataFrame:
    """(qid, attr, value, score): every candidate value scored by its place, worst = 1.

    A cell has at most as many values as top candidates times chosen columns.
    """
    order = W.partitionBy("qid", "attr").orderBy(F.round("w", 9), F.round("r", 9), F.desc("value"))
    ranked = voted.withColumn("score", F.row_number().over(order).cast("double"))
    return ranked.select("qid", "attr", normalize_value(F.col("value")).alias("value"), "score")


def qrels(answered: DataFrame, clean: Catalog, table: str) -> DataFrame:
    """(qid, attr, value, rel): the true value of every imputed cell.

    The wanted attributes of a row are gathered first, so the clean table is joined row by row.
    """
    df = clean.table(table)
    asked = answered.groupBy("qid").agg(F.collect_set("attr").alias("_asked"))
    attrs = [c for c in clean.descriptors(table)]
    cells = F.array(
        *[F.struct(F.lit(a).alias("attr"), canonical_text(F.col(a), df.schema[a].dataType).alias("value")) for a in attrs]
    )
    rows = df.select(clean.row_id(table).alias("qid"), cells.alias("_cells"))
    opened = rows.join(asked, "qid").select("qid", "_asked", F.explode("_cells").alias("c"))
    kept = opened.where(F.array_contains("_asked", F.col("c.attr")) & F.col("c.value").isNotNull())
    return kept.select("qid", "c.attr", "c.value", F.lit(1).alias("rel"))


def answer_columns(answered: DataFrame, attributes: list[str]) -> DataFrame:
    """One row per query row with its answers as columns, as they were found where that is known."""
    found = "text" if "text" in answered.columns else "value"
    picks = [F.max(F.when(F.col("attr") == a, F.col(found))).alias(f"_a_{a}") for a in attributes]
    return answered.groupBy("qid").agg(*picks)


def write_back(catalog: Catalog, table: str, answered: DataFrame, attributes: list[str]) -> DataFrame:
    """The dirty table with its null cells filled.

    Known cells never change; an answer that does not fit the column type stays NULL. Pass the
    table through `widened` first to keep fractional answers to whole-number columns.
    """
    df = catalog.table(table)
    wide = answer_columns(answered, attributes)
    joined = df.withColumn("_qid", catalog.row_id(table)).join(wide, F.col("_qid") == F.col("qid"), "left")
    filled = {}
    for a in attributes:
        data_type = df.schema[a].dataType
        filled[a] = F.coalesce(F.col(a), F.col(f"_a_{a}").try_cast(data_type))
    return joined.withColumns(filled).select(df.columns)


def typed_answers(answered: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    """Adds `fits`: whether the answer can be cast to the type of its column."""
    fits = F.lit(False)
    for attr, data_type in types.items():
        fits = F.when(F.col("attr") == attr, F.col("value").try_cast(data_type).isNotNull()).otherwise(fits)
    return answered.withColumn("fits", fits)


def widened(df: DataFrame, answered: DataFrame) -> DataFrame:
    """Whole-number columns that received a fractional answer, cast to double."""
    number = as_double(F.col("value"))
    fractional = answered.where(number != F.floor(number)).select("attr").distinct()
    hit = {r["attr"] for r in fractional.collect()}
    whole = [f.name for f in df.schema.fields if f.name in hit and isinstance(f.dataType, T.IntegralType)]
    return df.withColumns({c: F.col(c).cast("double") for c in whole})


def evaluated_rows(keys: DataFrame, result: DataFrame, key: list[str]) -> DataFrame:
    """Only the evaluated keys, each with its row of the result (or nulls)."""
    return keys.select(*key).join(result, key, "left")
