"""Feature preparation of typed columns and hashed row embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import FeatureHasher, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relimpute.functions.ranking import positions
from relimpute.functions.text import as_double
from relimpute.operators.profile import database_types, modes
from relimpute.sources.catalog import Catalog

# fixed values: what reads as true
TRUE_WORDS = ("yes", "true", "1", "t")


def coerced(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles; what does not parse is NULL."""
    def number(c: str) -> Column:
        return as_double(F.col(c)) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c).cast("double")

    return df.withColumns({c: number(c) for c in columns})


def numeric_prep(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Doubles, nulls filled with the lowest mode, scaled to [0, 1].

    Mode, minimum and maximum, three numbers per column, come from one pass over value counts and
    are literals of the projection; the rows are not shuffled.
    """
    columns = list(columns)
    if not columns:
        return df
    df = coerced(df, columns)
    known = {r["col"]: r for r in modes(df, columns).collect()}

    def scaled(c: str) -> Column:
        if c not in known:
            return F.lit(None).cast("double")
        lo, hi = known[c]["lo"], known[c]["hi"]
        return (F.coalesce(F.col(c), F.lit(float(known[c]["mode"]))) - lo) / ((hi - lo) or 1.0)

    return df.withColumns({c: scaled(c) for c in columns})


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls filled with the lowest mode of their column."""
    columns = [c for c in columns]
    if not columns:
        return df
    mode = {r["col"]: r["mode"] for r in modes(df, columns).collect()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(mode.get(c)).try_cast(df.schema[c].dataType)) for c in columns})


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): 0-based codes in the order of the sorted categories."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return positions(values, ["value"], "_p").select("value", (F.col("_p") - 1).alias("code"))


def categorical_prep(df: DataFrame, columns: Sequence[str], encode: bool = True, fill: bool = True) -> DataFrame:
    """Mode fill, then sorted ordinal codes or strings."""
    df = fill_mode(df, columns) if fill else df
    for c in columns:
        if encode:
            codes = category_codes(df, c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
            df = df.join(codes, F.col(c) == F.col("_value"), "left").withColumn(c, F.col("_code")).drop("_value", "_code")
        else:
            df = df.withColumn(c, F.col(c).cast("string"))
    return df


def binary_prep(df: DataFrame, columns: Sequence[str], true_words: Sequence[str] = TRUE_WORDS) -> DataFrame:
    """Mode fill, then 1 for the words that read as true and 0 for all others."""
    df = fill_mode(df, columns)
    return df.withColumns({c: F.lower(F.col(c).cast("string")).isin(*true_words).cast("int") for c in columns})


def feature_table(df: DataFrame, key: Sequence[str], binary: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], encode: bool = False) -> DataFrame:
    """key + binary + numeric + categorical, prepared."""
    prepared = categorical_prep(numeric_prep(binary_prep(df, binary) if binary else df, numeric), categorical, encode)
    return prepared.select(*key, *binary, *numeric, *categorical)


def row_embeddings(catalog: Catalog, table: str, dimension: int = 64, masked: Sequence[str] = ()) -> DataFrame:
    """(table, row_id, embedding): hashed features of the descriptors of a row, unit length.

    Numeric descriptors weigh by their scaled value, categorical ones by presence. `masked`
    attributes are left out, as for a query row that asks for them.
    """
    types = {r["col"]: r["stype"] for r in database_types(catalog, [table]).collect()}
    used = [c for c in catalog.descriptors(table) if c in types and c not in masked]
    numeric = [c for c in used if types[c] == "num"]
    categorical = [c for c in used if types[c] == "cat"]
    df = catalog.table(table).withColumn("row_id", catalog.row_id(table))
    features = feature_table(df.select("row_id", *used), ["row_id"], [], numeric, categorical)
    hasher = FeatureHasher(inputCols=[*numeric, *categorical], outputCol="_hashed", numFeatures=dimension)
    hashed = Normalizer(inputCol="_hashed", outputCol="_unit").transform(hasher.transform(features))
    return hashed.select(F.lit(table).alias("table"), "row_id", vector_to_array("_unit").alias("embedding"))


def database_embeddings(catalog: Catalog, query_table: str, tables: Sequence[str] | None = None, dimension: int = 64) -> DataFrame:
    """Embeddings of every table but the query table."""
    out = None
    for table in tables or catalog.names:
        if table != query_table and catalog.descriptors(table):
            part = row_embeddings(catalog, table, dimension)
            out = part if out is None else out.unionByName(part)
    return out
