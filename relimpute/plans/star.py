"""The key schema of the star tables and their loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relimpute.sources.catalog import Catalog

STAR_SCHEMA = """{
  "region":        {"pkey_col": "r_regionkey",   "fkey_col_to_pkey_table": {}},
  "nation":        {"pkey_col": "n_nationkey",   "fkey_col_to_pkey_table": {"n_regionkey": "region"}},
  "customer":      {"pkey_col": "c_custkey",     "fkey_col_to_pkey_table": {"c_nationkey": "nation"}},
  "supplier":      {"pkey_col": "s_suppkey",     "fkey_col_to_pkey_table": {"s_nationkey": "nation"}},
  "part":          {"pkey_col": "p_partkey",     "fkey_col_to_pkey_table": {}},
  "orders":        {"pkey_col": "o_orderkey",    "fkey_col_to_pkey_table": {"o_custkey": "customer"}},
  "lineitem":      {"pkey_col": "row_id",        "fkey_col_to_pkey_table": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}},
  "events":        {"pkey_col": "event_id",      "fkey_col_to_pkey_table": {"user_id": "customer"}},
  "documents":     {"pkey_col": "doc_id",        "fkey_col_to_pkey_table": {}},
  "labels":        {"pkey_col": "doc_id",        "fkey_col_to_pkey_table": {"doc_id": "documents"}},
  "conversations": {"pkey_col": "conv_id, turn", "fkey_col_to_pkey_table": {}}
}"""


def with_row_id(name: str, df: DataFrame) -> DataFrame:
    """`lineitem` has no key of its own; its rows are all distinct, so a digest of the row is one."""
    if name != "lineitem":
        return df
    return df.withColumn("row_id", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])))


def star_catalog(spark: SparkSession, folder: str) -> Catalog:
    """Scans of the star tables under `folder`; nothing is read before a query runs."""
    return Catalog.from_json(spark, STAR_SCHEMA).load(folder, "parquet", narrow=False, prepare=with_row_id, spread=("customer", "supplier", "part", "orders", "lineitem", "events"))
