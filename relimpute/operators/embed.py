"""Additive row embeddings: hashed values of a row, from which the part of one attribute can be taken out.

A value counts by its canonical text, whatever column it stands in, so rows of different tables that share values are near
each other. Nothing is fitted: a row is embedded where it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relimpute.functions.text import canonical_text, is_value
from relimpute.sources.catalog import Catalog

DIMENSION = 64
#: Weight of a number's sign and size beside that of its exact value.
SIZE_WEIGHT = 0.5


def _part(attribute: str, token: Column, weight: float, dimension: int) -> Column:
    """(attr, slot, w): slot and sign from the md5 of the token; NULL without a token."""
    h = F.md5(token)
    slot = (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dimension).cast("int")
    signed = F.when(F.substring(h, 9, 1) < "8", weight).otherwise(-weight)
    return F.when(token.isNotNull(), F.struct(F.lit(attribute).alias("attr"), slot.alias("slot"), signed.alias("w")))


def _size(text: Column) -> Column:
    """Sign and number of whole digits of a number's canonical text, exponents left aside: `#3`, `#-3`."""
    digits = F.length(F.regexp_extract(text, r"^-?(\d+)", 1))
    sign = F.when(text.startswith("-"), "-").otherwise("")
    return F.when(digits > 0, F.concat(F.lit("#"), sign, digits.cast("string")))


def parts(catalog: Catalog, table: str, dimension: int = DIMENSION, keys: bool = False, own_key: bool = True) -> Column:
    """array<struct<attr, slot, w>> of the known values of a row; key columns on request, its own key only if `own_key`."""
    df = catalog.table(table)
    left = set() if keys else catalog.key_columns(table)
    if not own_key:
        left |= catalog.key_columns(table) - set(catalog.specs[table].fk_columns)
    columns = [c for c in df.columns if is_value(df.schema[c].dataType) and c not in left]
    found = []
    for c in columns:
        text = canonical_text(F.col(c), df.schema[c].dataType)
        found.append(_part(c, text, 1.0, dimension))
        if isinstance(df.schema[c].dataType, T.NumericType):
            found.append(_part(c, _size(text), SIZE_WEIGHT, dimension))
    empty = F.array().cast("array<struct<attr:string,slot:int,w:double>>")
    return F.array_compact(F.array(*found)) if found else empty


def unit_vector(found: Column, dimension: int = DIMENSION) -> Column:
    """The parts of a row summed into one vector of length one; without parts it stays zero.

    Sums are multiples of a half, so their order is free. A batch of rows is summed at once.
    """
    @F.arrow_udf("array<double>")
    def summed(slots: pa.Array, weights: pa.Array) -> pa.Array:
        rows = len(slots)
        row = np.repeat(np.arange(rows), pc.list_value_length(slots).to_numpy(zero_copy_only=False))
        place = row * dimension + slots.flatten().to_numpy(zero_copy_only=False)
        sums = np.bincount(place, weights=weights.flatten().to_numpy(zero_copy_only=False), minlength=rows * dimension).reshape(rows, dimension)
        norm = np.sqrt((sums * sums).sum(1))
        scaled = sums / np.where(norm > 0, norm, 1.0)[:, None]
        return pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * dimension, scaled.ravel())

    # "not deterministic" keeps filters inferred from the vector (by an explode, say) from summing it a second time below an exchange
    return summed.asNondeterministic()(F.transform(found, lambda p: p["slot"]), F.transform(found, lambda p: p["w"]))


def row_vectors(catalog: Catalog, table: str, dimension: int = DIMENSION, keys: bool = False) -> DataFrame:
    """(table, row_id, embedding) of every row."""
    found = unit_vector(parts(catalog, table, dimension, keys), dimension)
    return catalog.table(table).select(F.lit(table).alias("table"), catalog.row_id(table).alias("row_id"), found.alias("embedding"))


def database_vectors(catalog: Catalog, query_table: str, tables: Sequence[str] | None = None, dimension: int = DIMENSION, keys: bool = False) -> DataFrame:
    """(table, row_id, embedding) of every table but the query table."""
    out = None
    for table in tables or catalog.names:
        if table != query_table:
            part = row_vectors(catalog, table, dimension, keys)
            out = part if out is None else out.unionByName(part)
    return out


def query_vectors(catalog: Catalog, table: str, asked: dict[str, Column], dimension: int = DIMENSION, keys: bool = False) -> DataFrame:
    """(qid, attr, truth, embedding): one row per asked attribute of a row, embedded without that attribute.

    `asked` maps attributes to a column that is NULL where a row does not ask (see `instances.known`, `instances.missing`). The values of
    a row are hashed once; per asked attribute its own parts are left out of the sum, so asking for
    every attribute still leaves each of them a vector. The row's own key is left out too: it numbers
    rows, and other tables number theirs alike.
    """
    cells = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(a).alias("attr"), c.alias("truth"))) for a, c in asked.items()]))
    rows = catalog.table(table).select(catalog.row_id(table).alias("qid"), parts(catalog, table, dimension, keys, False).alias("_parts"), cells.alias("_cells"))
    opened = rows.select("qid", "_parts", F.explode("_cells").alias("_c"))
    others = F.filter("_parts", lambda p: p["attr"] != F.col("_c.attr"))
    return opened.select("qid", "_c.attr", "_c.truth", unit_vector(others, dimension).alias("embedding"))
