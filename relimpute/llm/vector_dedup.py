"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside a cell."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from relimpute.llm.components import components, forest
from relimpute.llm.tables import stored, taken

#: Distinct vectors up to which there is one cell, so that all pairs are compared.
ONE_CELL = 2048
MOST_CELLS = 4096
#: Vectors the centroids are fitted on, at most.
SAMPLE = 20_000
#: Cells in which a vector stands: its nearest ones.
PROBES = 6
#: Rows of a block; a larger cell is compared as pairs of blocks.
BLOCK = 1024
#: Pairs looked at together for their first common cell.
PAIRS = 1 << 18


def distinct_vectors(rows: DataFrame, dtype: str) -> DataFrame:
    """vec_id, key (one number per distinct vector; NULL if it can't be compared), dim, vec (its bytes)."""

    def run(batches):
        for batch in batches:
            keys, dims, data = [], [], []
            for value in batch.column("embedding"):
                v = np.array([] if not value.is_valid else [math.nan if x is None else x for x in value.as_py()], dtype)
                # +0.0: both zeros are one number.
                v = v + np.zeros(1, dtype)
                top = np.abs(v.astype(float)).max(initial=0)
                good = np.isfinite(top) and top > 0
                data.append(v.tobytes() if good else None)
                keys.append(int.from_bytes(hashlib.blake2b(data[-1], digest_size=8).digest(), "little", signed=True) if good else None)
                dims.append(len(v))
            yield pa.record_batch([batch.column("vec_id"), pa.array(keys, pa.int64()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], names=["vec_id", "key", "dim", "vec"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, key bigint, dim int, vec binary")


def unit_rows(column, dtype: str) -> np.ndarray:
    """Vectors of one length as rows of norm 1, in double precision. Powers of two go first, so that no square overflows or vanishes."""
    x = np.stack([np.frombuffer(v.as_buffer(), dtype) for v in column]).astype(float)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k directions; a cell that loses all its members keeps its direction."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[i : i + BLOCK] @ centres.T, axis=1) for i in range(0, len(x), BLOCK)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


def assigned(vectors: DataFrame, centres: np.ndarray, dim: int, probes: int, dtype: str) -> DataFrame:
    """key, vec, n and cells: the nearest cells; vectors of another length share the cell -(their length)."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cells = np.repeat(-dims.astype(np.int64)[:, None], probes, axis=1)
            usual = np.flatnonzero(dims == dim)
            if len(usual):
                near = unit_rows(batch.column("vec").take(pa.array(usual)), dtype) @ centres.T
                cells[usual] = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            flat = pa.array(np.sort(cells, axis=1).astype(np.int32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(dims) + 1, dtype=np.int32) * probes), flat)
            yield pa.record_batch([batch.column("key"), batch.column("vec"), batch.column("n"), lists], names=["key", "vec", "n", "cells"])

    return vectors.mapInArrow(run, "key bigint, vec binary, n bigint, cells array<int>")


def first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest cell that stands in both rows of cells."""
    same = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return np.where(same, a, np.iinfo(a.dtype).max).min(axis=1)


def compared(placed: DataFrame, least: float, dtype: str) -> DataFrame:
    """Links of a cell's blocks: per vector a (b NULL) the number of rows it links with, and links (a, b) that join what is linked.

    A pair that meets in several cells counts in the first one.
    """

    def run(table: pa.Table) -> pa.Table:
        cell, i, j = (table.column(c)[0].as_py() for c in ("cell", "i", "j"))
        own, key, n = (table.column(c).to_numpy() for c in ("own", "key", "n"))
        vectors = unit_rows(table.column("vec"), dtype)
        cells = np.stack(table.column("cells").to_numpy())
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        near = vectors[left] @ vectors[right].T >= least
        if i == j:
            near = np.triu(near, 1)
        x, y = np.nonzero(near)
        x, y = left[x], right[y]
        ours = [first_common(cells[x[p : p + PAIRS]], cells[y[p : p + PAIRS]]) == cell for p in range(0, len(x), PAIRS)]
        ours = np.concatenate(ours) if ours else np.zeros(0, bool)
        links = np.bincount(x[ours], n[y[ours]], len(key)) + np.bincount(y[ours], n[x[ours]], len(key))
        root = forest(x, y, len(key))
        joined = np.flatnonzero(root != np.arange(len(key)))
        some = np.flatnonzero(links > 0)
        a, b = np.r_[key[some], key[joined]], np.r_[np.zeros(len(some), np.int64), key[root[joined]]]
        no = np.r_[np.ones(len(some), bool), np.zeros(len(joined), bool)]
        return pa.table({"a": pa.array(a), "b": pa.array(b, mask=no), "links": pa.array(np.r_[links[some].astype(np.int64), np.zeros(len(joined), np.int64)])})

    return placed.groupBy("cell", "i", "j").applyInArrow(run, "a bigint, b bigint, links bigint")


def vector_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9, cells: int | None = None, probes: int = PROBES) -> DataFrame:
    """Link vectors whose cosine, in double precision, is at least `least`.

    Returns one row per input row: vec_id, n_links (other rows linked directly), component_id (the smallest vec_id
    reachable by links, itself included), kept (vec_id = component_id, also where both are NULL). NULL, empty and zero vectors and those with a
    NULL or non-finite component link with nothing and stand for themselves; vectors of different lengths don't link.
    Repeated rows are rows that link with each other. Empty tables give empty results; other columns are ignored.

    Equal vectors become one, with a count. Centroids are fitted on at most 20,000 vectors drawn by hash; every vector is
    then put into its `probes` nearest cells. No pair below `least` is ever linked; a pair at or above it is missed
    only if the two have no cell in common, which can't happen up to 2,048 distinct vectors (one cell). Cells are cut into blocks
    of bounded size, each pair of blocks is one matrix product, and what leaves a block is a count per
    vector and a forest, never the pairs.
    """
    kind = vectors.schema[vec_col].dataType
    dtype = "<f4" if isinstance(kind.elementType, FloatType) else "<f8"
    rows = taken(vectors, vec_id=id_col, embedding=vec_col)
    if dtype == "<f8":
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = stored(distinct_vectors(rows, dtype), "vectors")
    counts = rows.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    counts = stored(counts, "vector-counts")
    first = rows.where("key IS NOT NULL").select("key", "dim", "vec").dropDuplicates(["key"])
    unique = stored(first.join(counts.select("key", "n"), "key"), "distinct-vectors")
    total = unique.count()
    usual = unique.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = usual["dim"] if usual else 0
    k = cells or (1 if total <= ONE_CELL else min(MOST_CELLS, 2 * math.isqrt(total)))
    sample = unique.where(F.col("dim") == dim).orderBy(F.xxhash64("key"), "key").limit(max(SAMPLE, k)).select("vec").toArrow() if total else None
    centres = np.zeros((1, max(dim, 1)))
    if total and len(sample):
        fit = unit_rows(sample.column("vec"), dtype)
        k = min(k, len(fit))
        centres = spherical_kmeans(fit, k) if k > 1 else fit[:1]
    probes = min(probes, len(centres))
    placed = stored(assigned(unique, centres, dim, probes, dtype), "cells")
    standing = placed.withColumn("cell", F.explode(F.array_distinct("cells")))
    # One row per cell, so never more than cells and lengths.
    sizes = standing.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = standing.join(F.broadcast(sizes), "cell").withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "n", "vec", "cells")
    out = stored(compared(blocks, least, dtype), "vector-links")
    links = out.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    found = components(out.where("b IS NOT NULL").select("a", "b"), "vectors")
    rooted = counts.join(found.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    rooted = stored(rooted.select("key", "least", F.coalesce("root", "key").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vectors-rooted")
    label = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "n_links", "component_id")
    joined = rows.select("vec_id", "key").join(label, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = r"""
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
), links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), n AS (
    SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(any_value(n_links), 0) AS n_links, min(b) AS component_id, vec_id = min(b) AS kept
FROM embeddings JOIN reach ON reach.a = vec_id LEFT JOIN n ON n.a = vec_id GROUP BY vec_id
"""
