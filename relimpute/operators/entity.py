"""Entity graph export: cells as entities, rows and keys as triples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relimpute.functions.ranking import hashed_ids
from relimpute.functions.text import is_value, plain_text
from relimpute.sources.catalog import Catalog

ENTITY = ["table", "col", "value"]


def _parts(catalog: Catalog, table: str) -> tuple[list[str], list[str]]:
    df = catalog.table(table)
    return list(catalog.specs[table].fk_columns), [c for c in catalog.descriptors(table) if is_value(df.schema[c].dataType)]


def row_triples(catalog: Catalog, tables: Sequence[str]) -> DataFrame:
    """(table, head_col, head, relation, tail_col, tail): key-descriptor pairs of a row, both ways.

    A narrow transformation: the pairs of a row are formed inside the row.
    """
    out = None
    for table in tables:
        df = catalog.table(table)
        fks, descriptors = _parts(catalog, table)
        text = {c: plain_text(F.col(c), df.schema[c].dataType) for c in (*fks, *descriptors)}
        keys = [(catalog.specs[table].key, catalog.row_id(table), "pk")] + [(c, text[c], "fk") for c in fks]
        triples = []
        for key, value, kind in keys:
            for d in descriptors:
                both = value.isNotNull() & text[d].isNotNull()
                for h, hv, t, tv, r in ((key, value, d, text[d], f"{kind}_desc"), (d, text[d], key, value, f"desc_{kind}")):
                    triple = F.struct(
                        F.lit(h).alias("head_col"), hv.alias("head"), F.lit(r).alias("relation"), F.lit(t).alias("tail_col"), tv.alias("tail")
                    )
                    triples.append(F.when(both, triple))
        if triples:
            part = df.select(F.lit(table).alias("table"), F.explode(F.array_compact(F.array(*triples))).alias("_t"))
            part = part.select("table", "_t.*")
            out = part if out is None else out.unionByName(part)
    return out


def entities(catalog: Catalog, tables: Sequence[str]) -> DataFrame:
    """Distinct (table, col, value) of rows that have a key and a descriptor."""
    triples = row_triples(catalog, tables)
    return triples.select("table", F.col("head_col").alias("col"), F.col("head").alias("value")).distinct()


def link_triples(catalog: Catalog, tables: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """fk_pk and pk_fk triples between entities that both exist."""
    known = entities(catalog, tables) if known is None else known
    out = None
    for src, column, dst, key in catalog.edges():
        if src not in tables or dst not in tables:
            continue
        used = catalog.table(src).where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value"))
        part = used.select(
            F.lit(src).alias("src_table"), F.lit(column).alias("src_col"), F.lit(dst).alias("dst_table"), F.lit(key).alias("dst_col"), "value"
        )
        out = part if out is None else out.unionByName(part)
    for side in ("src", "dst"):
        names = known.select(F.col("table").alias(f"{side}_table"), F.col("col").alias(f"{side}_col"), "value")
        out = out.join(names, [f"{side}_table", f"{side}_col", "value"], "left_semi")
    ways = [
        F.struct(*[F.col(c).alias(n) for c, n in zip(order, ("head_table", "head_col", "tail_table", "tail_col"))], F.lit(r).alias("relation"))
        for order, r in (
            (("src_table", "src_col", "dst_table", "dst_col"), "fk_pk"),
            (("dst_table", "dst_col", "src_table", "src_col"), "pk_fk"),
        )
    ]
    return out.select("value", F.explode(F.array(*ways)).alias("_t")).select("_t.*", "value")


def entity_ids(known: DataFrame) -> DataFrame:
    """Dense ids of entities; `table` and `col` are the type of an entity."""
    return hashed_ids(known, ENTITY)


def encoded_triples(catalog: Catalog, tables: Sequence[str], ids: DataFrame) -> DataFrame:
    """(head_id, relation, tail_id) of all triples."""
    rows = row_triples(catalog, tables)
    rows = rows.select(
        F.col("table").alias("head_table"), "head_col", "head", "relation", F.col("table").alias("tail_table"), "tail_col", "tail"
    )
    links = link_triples(catalog, tables).select(
        "head_table", "head_col", F.col("value").alias("head"), "relation", "tail_table", "tail_col", F.col("value").alias("tail")
    )
    out = rows.unionByName(links)
    for side in ("head", "tail"):
        names = ids.select(
            F.col("table").alias(f"{side}_table"), F.col("col").alias(f"{side}_col"), F.col("value").alias(side), F.col("id").alias(f"{side}_id")
        )
        out = out.join(names, [f"{side}_table", f"{side}_col", side])
    return out.select("head_id", "relation", "tail_id")


def query_entities(known: DataFrame, valid_columns: DataFrame, table: str) -> DataFrame:
    """Entities of the query table in its valid columns."""
    return known.where(F.col("table") == table).join(valid_columns.select("col"), "col", "left_semi").select(*ENTITY)
