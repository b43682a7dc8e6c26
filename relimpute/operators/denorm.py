"""Redundancy injection: copy attributes of heavily referenced tables to their referencing tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relimpute.operators.profile import column_profile
from relimpute.sources.catalog import Catalog

# column types a copied attribute may have
COPIED_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "string")


def hub_tables(catalog: Catalog, min_refs: int = 5) -> DataFrame:
    """(dst_table, referencing): tables that more than `min_refs` distinct tables point at."""
    counted = catalog.fk_edges().groupBy("dst_table").agg(F.count_distinct("src_table").alias("referencing"))
    return counted.where(F.col("referencing") > min_refs)


def edge_usage(catalog: Catalog, edges: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """Per foreign key the referencing rows, the distinct parents in use and the dangling rows.

    Rows are counted per key value first, so the join with the parent sees every value once.
    """
    parts = None
    for src, column, dst, key in edges or catalog.edges():
        used = catalog.table(src).where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("k"))
        used = used.agg(F.count(F.lit(1)).alias("n"))
        parents = catalog.table(dst).select(catalog.row_id(dst).alias("k"), F.lit(1).alias("hit"))
        part = used.join(parents, "k", "left").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count("hit").alias("parents"),
            F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("n"))), F.lit(0)).alias("dangling"),
        )
        part = part.select(
            F.lit(src).alias("src_table"), F.lit(column).alias("src_col"), F.lit(dst).alias("dst_table"),
            F.lit(key).alias("dst_col"), "rows", "parents", "dangling",
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def informative_columns(profile: DataFrame, min_ndv: int = 5, min_fill: float = 0.8) -> DataFrame:
    """Profile rows of the descriptors worth copying; a null counts as one more value."""
    values = F.col("ndv") + F.when(F.col("non_null") < F.col("rows"), 1).otherwise(0)
    return profile.where(
        (F.col("role") == "desc")
        & F.col("dtype").isin(*COPIED_TYPES)
        & (values > min_ndv)
        & (F.col("non_null") / F.col("rows") > min_fill)
    )


@dataclass(frozen=True)
class Hub:
    """A hub table and the columns of it that are copied."""

    table: str
    columns: tuple[str, ...]


def choose_hubs(catalog: Catalog, min_refs: int = 5, min_ndv: int = 5, min_fill: float = 0.8) -> list[Hub]:
    """Profile the hub tables and settle which columns are copied (names only reach the driver)."""
    hubs = []
    for row in hub_tables(catalog, min_refs).orderBy("dst_table").collect():
        kept = informative_columns(column_profile(catalog, row["dst_table"]), min_ndv, min_fill)
        names = {r["col"] for r in kept.select("col").collect()}
        hubs.append(Hub(row["dst_table"], tuple(c for c in catalog.table(row["dst_table"]).columns if c in names)))
    return hubs


def complete_rows(df: DataFrame, columns: list[str], key: list[str] = ()) -> DataFrame:
    """Rows without a null in `columns`, reduced to key and those columns."""
    return df.na.drop(subset=list(columns)).select(*key, *columns) if columns else df.select(*key)


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Key values that occur more than once; empty means a lookup on `key` keeps the row count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def denormalize(catalog: Catalog, table: str, hubs: list[Hub], verify: bool = False) -> DataFrame:
    """`table` with the hub columns as `<fk>_<col>`, one set per foreign key into a hub.

    All parts of the hub key take part in the join and the foreign key always stays. The side to
    broadcast is left to Spark, which knows the sizes; a hot foreign key is split by the adaptive
    skew join.
    """
    by_name = {hub.table: hub for hub in hubs}
    out = catalog.table(table)
    for column, parent in catalog.specs[table].fks:
        hub = by_name.get(parent)
        if hub is None or not hub.columns:
            continue
        spec = catalog.specs[parent]
        source = catalog.table(parent)
        if verify and not repeated_keys(source, list(spec.pk)).isEmpty():
            raise ValueError(f"key of {parent} is not unique, the lookup would add rows to {table}")
        key = F.col(spec.pk[0]) if len(spec.pk) == 1 else catalog.row_id(parent)
        kept = source.na.drop(subset=list(hub.columns))
        lookup = kept.select(key.alias("_key"), *[F.col(c).alias(f"{column}_{c}") for c in hub.columns])
        own = F.col(column) if len(spec.pk) == 1 else F.col(column).cast("string")
        out = out.withColumn("_fk", own).join(lookup, F.col("_fk") == F.col("_key"), "left").drop("_fk", "_key")
    return out
