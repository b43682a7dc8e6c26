"""Missing-value injection and encodings of the dirty table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relimpute.functions.hashing import draw, drawn
from relimpute.functions.ranking import hash_first_n, positions


def null_where(column: str, mask: Column) -> Column:
    """The column with NULL where the mask holds; nulls already there stay."""
    return F.when(~mask, F.col(column))


def inject_missing(df: DataFrame, key: Column, targets: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """Null a fraction of every target column, each column drawn independently of the others.

    One projection: no shuffle, and a rerun task draws the same cells.
    """
    return df.withColumns({c: null_where(c, drawn(draw(key, c, seed), fraction)) for c in targets})


def inject_missing_exact(df: DataFrame, key: str, target: str, fraction: float, seed: int = 42) -> DataFrame:
    """Null exactly round(rows x fraction) cells of one column: those with the lowest draws."""
    hashed = df.select(F.col(key), draw(F.col(key), target, seed).alias("_draw"))
    masked = hash_first_n(hashed, [], "_draw", F.round(F.col("rows") * fraction)).select(key, F.lit(True).alias("_hit"))
    joined = df.join(masked, key, "left")
    return joined.withColumn(target, null_where(target, F.col("_hit").isNotNull())).select(df.columns)


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop()


def map_values(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Replace values by a dictionary; a value without an entry reads '', an empty entry is NULL."""
    text = F.col(column).cast("string")
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    looked_up = F.element_at(F.create_map(*entries), text) if entries else F.lit(None)
    blank = [k for k, v in mapping.items() if v == ""]
    found = F.when(text.isNotNull() & ~text.isin(*blank), F.coalesce(looked_up, F.lit("")))
    return df.withColumn(column, found.cast("string"))


def unmapped_values(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Values without a dictionary entry, with their row counts; must be empty for a full mapping."""
    known = df.sparkSession.createDataFrame([(k,) for k in mapping], "value string")
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value"))
    return counts.agg(F.count(F.lit(1)).alias("n")).join(known, "value", "left_anti")


def first_seen_codes(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, code): 0, 1, 2, ... in the order in which values first appear by `order`.

    Only the distinct values are ranked, over a range exchange, so a column of mostly distinct
    values does not end up in one task.
    """
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
    first = first.agg(F.min(order).alias("_first"))
    return positions(first, ["_first", "value"], "code").select("value", (F.col("code") - 1).alias("code"))


def encode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Replace a column by its codes; null and unknown values stay empty."""
    looked_up = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    joined = df.join(looked_up, F.col(column) == F.col("_value"), "left")
    return joined.withColumn(column, F.col("_code")).drop("_value", "_code")


def encode_strings(clean: DataFrame, dirty: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Codes learned on the clean table, applied to the string descriptors of the dirty one."""
    for c in columns:
        if isinstance(clean.schema[c].dataType, T.StringType):
            dirty = encode(dirty, c, first_seen_codes(clean, c, order))
    return dirty
