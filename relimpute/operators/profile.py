"""Column statistics and semantic types from one pass over value counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relimpute.functions.ranking import quantile_columns
from relimpute.functions.text import is_value, short_key, texts
from relimpute.sources.catalog import Catalog

RARE = 4
STATS = "attr string, max double, min double, mean double, std double, median double, ndv bigint"


def value_counts(df: DataFrame, columns: list[str], key_of=short_key) -> DataFrame:
    """(col, value, n) with NULL kept as a value; counted map-side before the one exchange."""
    long = texts(df, columns).unpivot([], columns, "col", "value")
    return long.groupBy("col", key_of(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def column_profile(catalog: Catalog, table: str, columns: list[str] | None = None) -> DataFrame:
    """rows, non_null, ndv, min_count, all_whole and stype per column of a table."""
    df = catalog.table(table)
    columns = [f.name for f in df.schema.fields if is_value(f.dataType) and f.name in (columns or df.columns)]
    whole = F.col("value").try_cast("double")
    stats = value_counts(df, columns).groupBy("col").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
        F.count("value").alias("ndv"),
        F.min(F.when(F.col("value").isNotNull(), F.col("n"))).alias("min_count"),
        F.coalesce(F.bool_and(whole == F.floor(whole)), F.lit(False)).alias("all_whole"),
    )
    joined = catalog.columns([table]).join(stats, "col").withColumn("stype", semantic_type())
    return joined.select("table", "col", "role", "dtype", "rows", "non_null", "ndv", "min_count", "all_whole", "stype")


def semantic_type() -> Column:
    """num / cat / NULL from dtype, null presence, wholeness and the rarest value's count."""
    floating = F.col("dtype").isin("double", "float") | F.col("dtype").startswith("decimal")
    whole_with_gaps = (F.col("non_null") < F.col("rows")) & F.col("all_whole")
    numeric = floating | F.col("dtype").isin("tinyint", "smallint", "int", "bigint", "boolean")
    return (
        F.when(F.col("non_null") == 0, F.lit(None).cast("string"))
        .when(floating & ~whole_with_gaps, F.lit("num"))
        .when(numeric & (F.col("min_count") > RARE), F.lit("cat"))
        .when(numeric, F.lit("num"))
        .otherwise(F.lit("cat"))
    )


def database_types(catalog: Catalog, tables: list[str] | None = None) -> DataFrame:
    """(table, col, dtype, stype) of every descriptor with at least one value."""
    parts = None
    for name in tables or catalog.names:
        plain = [c for c in catalog.descriptors(name) if is_value(catalog.table(name).schema[c].dataType)]
        if plain:
            part = column_profile(catalog, name, plain).where(F.col("stype").isNotNull())
            part = part.select("table", "col", "dtype", "stype")
            parts = part if parts is None else parts.unionByName(part)
    return parts


def list_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, stype) of array columns: embedding, sequence_numerical or multicategorical."""
    aggregates, kinds = [], {}
    for c in columns:
        element = df.schema[c].dataType.elementType
        kinds[c] = element
        sound = F.lit(True)
        if isinstance(element, (T.DoubleType, T.FloatType)):
            bad = [float("inf"), float("-inf")]
            sound = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & ~x.isin(*bad))
        aggregates.append(
            F.struct(
                F.lit(c).alias("col"), F.min(F.size(c)).alias("lo"), F.max(F.size(c)).alias("hi"),
                F.coalesce(F.bool_and(sound), F.lit(False)).alias("sound"),
            ).alias(c)
        )
    rows = df.select(*columns).agg(*aggregates).select(F.explode(F.array(*[F.col(c) for c in columns])).alias("s"))
    floating = [c for c in columns if isinstance(kinds[c], (T.DoubleType, T.FloatType))]
    numeric = [c for c in columns if isinstance(kinds[c], T.NumericType)]
    s = F.col("s")
    kind = (
        F.when(s["col"].isin(*floating) & (s["lo"] == s["hi"]) & s["sound"], "embedding")
        .when(s["col"].isin(*numeric), "sequence_numerical")
        .otherwise("multicategorical")
    )
    return rows.select(s["col"].alias("col"), kind.alias("stype"))


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per column plus one `all` row over all cells of the table."""
    counts = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    rows = df.agg(F.count(F.lit(1)).alias("_rows"), *counts)
    total = F.aggregate(F.array(*[F.col(c) for c in columns]), F.lit(0).cast("bigint"), lambda a, x: a + x)
    wide = rows.withColumn("all", total)
    long = wide.unpivot(["_rows"], [*columns, "all"], "col", "nulls")
    cells = F.when(F.col("col") == "all", F.col("_rows") * len(df.columns)).otherwise(F.col("_rows"))
    return long.select("col", "nulls", (F.col("nulls") / cells).alias("share"))


def dtype_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, kind, dim, classes): strings are categorical over their ndv, the rest real."""
    is_text = {c: isinstance(df.schema[c].dataType, T.StringType) for c in columns}
    strings = [c for c in columns if is_text[c]]
    others = df.sparkSession.createDataFrame(
        [(c, "real", 1, "") for c in columns if not is_text[c]], "col string, kind string, dim bigint, classes string"
    )
    if not strings:
        return others
    ndv = value_counts(df, strings).groupBy("col").agg(F.count("value").alias("dim"))
    found = ndv.select("col", F.lit("categorical").alias("kind"), "dim", F.col("dim").cast("string").alias("classes"))
    return found.unionByName(others)


def clean_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(attr, max, min, mean, std, median, ndv) of numeric columns; a null counts as a value."""
    if not columns:
        return df.sparkSession.createDataFrame([], STATS)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "attr", "v")
    counted = long.groupBy("attr", "v").agg(F.count(F.lit(1)).alias("n"))
    # from value counts, so every group is small when it meets its reducer
    moments = long.groupBy("attr").agg(
        F.max("v").alias("max"), F.min("v").alias("min"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")
    )
    distinct = counted.groupBy("attr").agg(F.count(F.lit(1)).alias("ndv"))
    medians = quantile_columns(long, ["attr"], "v", {"median": 0.5}, derived=False)
    return moments.join(medians, "attr", "left").join(distinct, "attr").select(
        "attr", "max", "min", "mean", "std", "median", "ndv"
    )


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, share) over the non-null values of a column."""
    counts = value_counts(df, [column], key_of=lambda v: v).where(F.col("value").isNotNull())
    totals = counts.groupBy("col").agg(F.sum("n").alias("total"))
    # one row
    return counts.join(F.broadcast(totals), "col").select("value", (F.col("n") / F.col("total")).alias("share"))


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, mode, lo, hi): the most frequent value, the lowest of tied ones, and the numeric range.

    Numbers compare as numbers. All three come from the value counts, in one pass.
    """
    numeric = {c: isinstance(df.schema[c].dataType, T.NumericType) for c in columns}
    counts = value_counts(df, columns, key_of=lambda v: v).where(F.col("value").isNotNull())
    number = F.when(F.col("col").isin(*[c for c in columns if numeric[c]]), F.col("value").try_cast("double"))
    return counts.groupBy("col").agg(
        F.min_by("value", F.struct(-F.col("n"), number, F.col("value"))).alias("mode"), F.min(number).alias("lo"), F.max(number).alias("hi")
    )


def table_sizes(catalog: Catalog, tables: list[str] | None = None) -> DataFrame:
    """(table, rows)."""
    parts = None
    for name in tables or catalog.names:
        part = catalog.table(name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def training_tables(catalog: Catalog, tables: list[str] | None = None, low: int = 100, high: int = 10_000) -> DataFrame:
    """(table, rows, fit): every table, and whether low < rows <= high."""
    return table_sizes(catalog, tables).withColumn("fit", (F.col("rows") > low) & (F.col("rows") <= high))
