"""Candidates of attributes without a key path: the nearest rows of tables that share their values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relimpute.functions.text import canonical_text, plain_text, truth_or_null
from relimpute.operators import embed, instances, sample, vectors
from relimpute.session import cut_lineage
from relimpute.sources.catalog import Catalog

NEIGHBOURS = 5


def tables_of(related: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """related table -> the attributes it serves."""
    out: dict[str, list[str]] = {}
    for attr, tables in related.items():
        for t in tables:
            out.setdefault(t, []).append(attr)
    return out


def _neighbours(catalog: Catalog, table: str, related: str, asked: dict[str, Column], picked: DataFrame | None, k: int, dimension: int, approximate: bool) -> DataFrame:
    """(qid, attr, truth, target_id, near): the k nearest rows of one related table per asked cell."""
    names = sorted(asked)
    queries = embed.query_vectors(catalog, table, asked, dimension, keys=True)
    if picked is not None:
        queries = queries.join(picked.select("qid", "attr"), ["qid", "attr"], "left_semi")
    # A cell is named by the number of its attribute and the row.
    number = F.element_at(F.create_map(*[x for i, a in enumerate(names) for x in (F.lit(a), F.lit(str(i)))]), F.col("attr"))
    queries = cut_lineage(queries.withColumn("id", F.concat(number, F.lit(":"), "qid")))
    targets = embed.row_vectors(catalog, related, dimension, keys=True).select(F.col("row_id").alias("id"), "embedding")
    search = vectors.bucketed_knn if approximate else vectors.knn_join
    found = search(queries.select("id", "embedding"), targets, k, query=("id", "embedding"), target=("id", "embedding"))
    # Both sides have length one: cosine from the distance.
    near = F.round(1 - F.col("distance") * F.col("distance") / 2, 9)
    return queries.select("id", "qid", "attr", "truth").join(found.select(F.col("query_id").alias("id"), "target_id", near.alias("near")), "id").drop("id")


def candidates(
    catalog: Catalog, table: str, related: dict[str, Sequence[str]], known: bool = False, n: int = 800, payload: Sequence[str] | None = None,
    k: int = NEIGHBOURS, dimension: int = embed.DIMENSION, approximate: bool = False,
) -> DataFrame:
    """Candidates from related tables, each a path of one node: (qid, attr, path_id, instance_id, row_ids, near, …).

    Asked are the null cells, with the neighbour's `payload` as it is written; or, with `known`, n sampled known cells per attribute (all when
    n <= 0) with their `truth` and `hits`, the columns of the neighbour that hold it. A query row is embedded without the
    asked attribute; a neighbour counts with its keys, since a key value that both rows hold is what ties them
    together when no foreign key says so. `near` is the cosine. `path_id` is the table's name.
    """
    picked = sample.known_cells(catalog, table, sorted(related), n) if known and n > 0 else None
    picked = cut_lineage(picked) if picked is not None else None
    parts = None
    for name, attributes in tables_of(related).items():
        asked = instances.known(catalog, table, attributes) if known else instances.missing(attributes)
        near = _neighbours(catalog, table, name, asked, picked, k, dimension, approximate)
        cells = instances.payload_columns(catalog, name, payload, False, canonical_text if known else plain_text)
        held = catalog.table(name).select(catalog.row_id(name).alias("target_id"), *[c.alias(f"_p_{a}") for a, c in cells.items()])
        joined = near.join(held, "target_id")
        head = ["qid", "attr", F.lit(name).alias("path_id"), F.md5("target_id").alias("instance_id"), F.array("target_id").alias("row_ids"), "near"]
        if known:
            truth = truth_or_null(F.col("truth"))
            met = [F.when(F.col(f"_p_{c}") == truth, F.lit(c)) for c in cells]
            hits = F.when(F.coalesce(*met, F.lit(None)).isNotNull(), F.array(*met)) if met else F.lit(None).cast("array<string>")
            part = joined.select(*head, "truth", hits.alias("hits"))
        else:
            entries = [x for c in cells for x in (F.lit(c), F.col(f"_p_{c}"))]
            part = joined.select(*head, (F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")).alias("payload"))
        parts = part if parts is None else parts.unionByName(part)
    return parts
