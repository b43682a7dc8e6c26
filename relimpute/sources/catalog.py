"""Key schema, table loading and key normalisation."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FK_EDGE_SCHEMA = "src_table string, src_col string, dst_table string, dst_col string"
NULL_KEY_PART = "nan"


@dataclass(frozen=True)
class TableSpec:
    """Primary-key parts and foreign keys (column, parent table) of one table."""

    name: str
    pk: tuple[str, ...]
    fks: tuple[tuple[str, str], ...] = ()

    @property
    def key(self) -> str:
        """The one key column; the parts of a composite key are merged under this name."""
        return "__".join(self.pk)

    @property
    def fk_columns(self) -> tuple[str, ...]:
        return tuple(column for column, _ in self.fks)


def parse_schema(text: str) -> dict[str, TableSpec]:
    """Read `table -> {pkey_col, fkey_col_to_pkey_table}`; commas separate composite key parts."""
    specs = {}
    for name, entry in json.loads(text).items():
        pk = tuple(part.strip().lower() for part in entry["pkey_col"].split(","))
        fks = tuple((column.lower(), parent) for column, parent in entry["fkey_col_to_pkey_table"].items())
        specs[name] = TableSpec(name, pk, fks)
    return specs


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def merge_key(spec: TableSpec) -> Column:
    """The primary key as one string; a missing part of a composite key reads `nan`."""
    if len(spec.pk) == 1:
        return F.col(spec.pk[0]).cast("string")
    return F.concat_ws("__", *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_KEY_PART)) for c in spec.pk])


def normalize_key(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Key to string; the parts of a composite key go unless they are foreign keys too."""
    df = df.withColumn(spec.key, merge_key(spec))
    if len(spec.pk) == 1:
        return df
    return df.drop(*[c for c in spec.pk if c not in spec.fk_columns])


def keys_to_string(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Primary- and foreign-key columns as strings; string columns are left alone."""
    keys = [c for c in df.columns if c in (*spec.pk, *spec.fk_columns, spec.key)]
    return df.withColumns({c: F.col(c).cast("string") for c in keys if not isinstance(df.schema[c].dataType, T.StringType)})


def split_key(df: DataFrame, spec: TableSpec, data_type: str = "bigint") -> DataFrame:
    """Take a merged composite key apart again."""
    parts = F.split(F.col(spec.key), "__")
    return df.withColumns({c: parts[i].try_cast(data_type) for i, c in enumerate(spec.pk)})


def whole_number_columns(df: DataFrame) -> list[str]:
    """Floating columns without a fractional value (also all-null ones), found in one pass."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floating:
        return []
    checks = [F.coalesce(F.bool_and(F.isnan(c) | (F.col(c) == F.floor(c))), F.lit(True)).alias(c) for c in floating]
    row = df.agg(*checks).first()
    return [c for c in floating if row[c]]


def narrow_whole_numbers(df: DataFrame) -> DataFrame:
    """Floating columns that hold whole numbers only become bigint, so keys read `1`, not `1.0`."""
    return df.withColumns(
        {c: F.when(~F.isnan(c), F.col(c)).cast("bigint") for c in whole_number_columns(df)}
    )


def dealt_out(df: DataFrame) -> DataFrame:
    """One exchange for a table in fewer splits than cores; a table in enough splits is untouched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


@dataclass
class Catalog:
    """Tables with their key schema.

    A table is a lazy DataFrame with native key types. Its files are not looked at before the
    table is first asked for.
    """

    spark: SparkSession
    specs: dict[str, TableSpec]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    scan: Callable[[str], DataFrame] | None = None

    @classmethod
    def from_json(cls, spark: SparkSession, schema: str | Path) -> Catalog:
        text = schema if isinstance(schema, str) and schema.lstrip().startswith("{") else Path(schema).read_text()
        return cls(spark, parse_schema(text))

    def load(
        self,
        path: str,
        fmt: str = "csv",
        overrides: dict[str, str] | None = None,
        null_flag: str | None = None,
        schemas: dict[str, T.StructType | str] | None = None,
        narrow: bool = True,
        prepare: Callable[[str, DataFrame], DataFrame] | None = None,
        spread: Sequence[str] = (),
    ) -> Catalog:
        """Scan one file or folder per schema table.

        `overrides` reads a table from elsewhere (the dirty query table), `null_flag` names the
        written form of a missing value, `schemas` avoids inference. Tables named in `spread` are
        dealt out over the cores when their files offer fewer splits than there are cores.
        """

        def scan(name: str) -> DataFrame:
            reader = self.spark.read.format(fmt)
            given = (schemas or {}).get(name)
            if given is not None:
                reader = reader.schema(given)
            if fmt == "csv":
                reader = reader.option("header", True).option("inferSchema", given is None)
                if null_flag is not None:
                    reader = reader.option("nullValue", null_flag)
            df = lower_names(reader.load((overrides or {}).get(name, f"{path.rstrip('/')}/{name}.{fmt}")))
            if name in spread:
                df = dealt_out(df)
            if prepare is not None:
                df = prepare(name, df)
            return narrow_whole_numbers(df) if narrow else df

        return Catalog(self.spark, self.specs, scan=scan)

    def with_tables(self, **tables: DataFrame) -> Catalog:
        """A catalog in which some tables are replaced (denormalised or dirty forms)."""
        return Catalog(self.spark, self.specs, {**self.tables, **tables}, self.scan)

    def part(self, names: Sequence[str]) -> Catalog:
        """The catalog of some of the tables only."""
        specs = {n: s for n, s in self.specs.items() if n in names}
        return Catalog(self.spark, specs, self.tables, self.scan)

    @property
    def names(self) -> list[str]:
        """Tables of the schema that can be read."""
        return [n for n in self.specs if self.scan is not None or n in self.tables]

    def table(self, name: str) -> DataFrame:
        if name not in self.tables and self.scan is not None:
            self.tables[name] = self.scan(name)
        return self.tables[name]

    def row_id(self, name: str) -> Column:
        spec = self.specs[name]
        return F.col(spec.key).cast("string") if spec.key in self.table(name).columns else merge_key(spec)

    def key_columns(self, name: str) -> set[str]:
        spec = self.specs[name]
        return {*spec.pk, spec.key, *spec.fk_columns}

    def descriptors(self, name: str) -> list[str]:
        keys = self.key_columns(name)
        return [c for c in self.table(name).columns if c not in keys]

    def edges(self) -> list[tuple[str, str, str, str]]:
        """Foreign keys as (src_table, src_col, dst_table, dst_col)."""
        return [
            (s.name, column, parent, self.specs[parent].key)
            for s in self.specs.values()
            for column, parent in s.fks
            if parent in self.specs
        ]

    def fk_edges(self) -> DataFrame:
        return self.spark.createDataFrame(self.edges(), FK_EDGE_SCHEMA)

    def columns(self, tables: Sequence[str] | None = None) -> DataFrame:
        """(table, col, role, dtype) of the tables."""
        rows = []
        for name in tables or self.names:
            df = self.table(name)
            spec = self.specs[name]
            for f in df.schema.fields:
                role = "pk" if f.name in (*spec.pk, spec.key) else "fk" if f.name in spec.fk_columns else "desc"
                rows.append((name, f.name, role, f.dataType.simpleString()))
        return self.spark.createDataFrame(rows, "table string, col string, role string, dtype string")
