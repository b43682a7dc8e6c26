"""Meta-path induction: which path and column reproduce known values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relimpute.functions.ranking import top_k
from relimpute.functions.text import truth_or_null
from relimpute.operators.instances import copies

PATH_SUMMARY = "attr string, path_id string, col string, n bigint, ratio double"


def _level() -> Column:
    """The weight by which candidates are ranked; weights that differ in rounding only are ties."""
    return F.round("weight", 12)


def cell_cuts(weighted: DataFrame, k: int) -> DataFrame:
    """(qid, attr, cut): the weight down to which candidates are among the `k` best of their cell, ties included.

    Equal weights are counted where they are found; of a cell at most its k highest distinct weights are ranked.
    """
    levels = weighted.groupBy("qid", "attr", _level().alias("_w")).agg(F.sum(copies(weighted)).alias("_n"))
    best = top_k(levels, ["qid", "attr"], [F.desc("_w")], k, "_p")
    ahead = F.sum("_n").over(W.partitionBy("qid", "attr").orderBy(F.desc("_w")).rowsBetween(W.unboundedPreceding, -1))
    kept = best.withColumn("_ahead", F.coalesce(ahead, F.lit(0))).where(F.col("_ahead") < k)
    return kept.groupBy("qid", "attr").agg(F.min("_w").alias("cut"))


def matching_columns(weighted: DataFrame, k: int = 3) -> DataFrame:
    """(qid, attr, path_id, instance_id, col): columns of a cell's top candidates, ties included, that hold the truth.

    Only candidates that hold it meet the cut of their cell, so no cell is ranked as a whole. Of bundles,
    `bundle` and `copies` stand in for the instance.
    """
    best = weighted.where(F.col("hits").isNotNull()).join(cell_cuts(weighted, k), ["qid", "attr"]).where(_level() >= F.col("cut"))
    named = [c for c in ("instance_id", "bundle", "copies") if c in weighted.columns]
    opened = best.select("qid", "attr", "path_id", *named, F.explode("hits").alias("col"))
    return opened.where(F.col("col").isNotNull())


def path_summary(matches: DataFrame, k: int = 5) -> DataFrame:
    """(attr, path_id, col, n, ratio): the `k` most frequent pairs, ratio over all pairs of the attribute."""
    counted = matches.groupBy("attr", "path_id", "col").agg(F.sum(copies(matches)).alias("n"))
    # one row per (path, column) of an attribute
    shared = counted.withColumn("ratio", F.col("n") / F.sum("n").over(W.partitionBy("attr")))
    return top_k(shared, ["attr"], [F.desc("n"), F.col("path_id"), F.col("col")], k).drop("rank")


def settle(summary: DataFrame) -> DataFrame:
    """Fix a summary as a small local table, so later plans do not repeat the induction."""
    return summary.sparkSession.createDataFrame([tuple(r) for r in summary.collect()], PATH_SUMMARY)


def top_path(matches: DataFrame) -> DataFrame:
    return path_summary(matches, 1)


def induction_flags(weighted: DataFrame, k: int = 3) -> DataFrame:
    """(qid, attr, notnull, valid, max): truth known, in any candidate, in a top-k candidate."""
    known = truth_or_null(F.col("truth"))
    held = F.col("hits").isNotNull()
    cells = weighted.groupBy("qid", "attr").agg(
        F.max(known.isNotNull().cast("int")).alias("notnull"), F.max(held.cast("int")).alias("valid"), F.max(F.when(held, _level())).alias("_best")
    )
    joined = cells.join(cell_cuts(weighted, k), ["qid", "attr"])
    return joined.select("qid", "attr", "notnull", "valid", F.coalesce((F.col("_best") >= F.col("cut")).cast("int"), F.lit(0)).alias("max"))


def coverage(flags: DataFrame) -> DataFrame:
    """(attr, cells, valid_rate, max_rate): shares among the cells with a known truth."""
    sums = flags.groupBy("attr").agg(F.sum("notnull").alias("cells"), F.sum("valid").alias("v"), F.sum("max").alias("m"))
    known = F.nullif(F.col("cells"), F.lit(0))
    return sums.select("attr", "cells", (F.col("v") / known).alias("valid_rate"), (F.col("m") / known).alias("max_rate"))


def valid_attributes(flags: DataFrame, accuracy: float = 0.8) -> DataFrame:
    return coverage(flags).where(F.col("max_rate") > accuracy)


def covered_attributes(flags: DataFrame, rate: float = 0.95) -> DataFrame:
    return coverage(flags).where(F.col("valid_rate") > rate)
