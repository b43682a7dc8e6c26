"""Approximate nearest neighbours: cross-polytope hashing with Hadamard pseudo-rotations, several probes, exact re-ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relimpute.functions.ranking import top_k
from relimpute.llm.tables import sent_if_small, stored
from relimpute.llm.vector_rows import matrices, vector_rows

#: Rows and queries of one matrix product.
ROWS, QUERIES = 8192, 1024
ROTATIONS = 3
#: Scores of a matrix product may differ by this much from those of single rows.
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Powers of two are taken out first, so that no square overflows or vanishes and no digit is lost."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision and independent of what else is computed."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) for x in (a, b))
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row, scaled to keep lengths; the width is a power of two."""
    n, width, half = len(x), x.shape[1], 1
    while half < width:
        x = x.reshape(n, -1, 2, half)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        half *= 2
    return x.reshape(n, width) / np.sqrt(width)


def axes(x: np.ndarray, table: int, polytope: int, seed: int) -> np.ndarray:
    """Nearness of rotated unit rows to the signed axes +0, ..., -0, ...: three times random signs and the transform.

    Signs come from (seed, table, polytope, width), so every task draws the same ones.
    """
    width = 1 << max(x.shape[1] - 1, 0).bit_length()
    signs = np.random.default_rng([seed, table, polytope, width]).choice([-1.0, 1.0], (ROTATIONS, width))
    y = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for s in signs:
        y = hadamard(y * s)
    return np.concatenate([y, -y], axis=1)


def cells(x: np.ndarray, table: int, polytopes: int, probes: int, seed: int) -> np.ndarray:
    """The `probes` nearest cells of every row, nearest first. A cell is one signed axis per polytope; nearness adds up over them."""
    sums, codes = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for polytope in range(polytopes):
        near = axes(x, table, polytope, seed)
        order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        grown = (sums[:, :, None] + np.take_along_axis(near, order, 1)[:, None, :]).reshape(len(x), -1)
        named = (codes[:, :, None] * near.shape[1] + order[:, None, :]).reshape(len(x), -1)
        best = np.argsort(-grown, axis=1, kind="stable")[:, :probes]
        sums, codes = np.take_along_axis(grown, best, 1), np.take_along_axis(named, best, 1)
    return codes


def placed(rows: DataFrame, tables: int, polytopes: int, probes: int, seed: int, id_type: str) -> DataFrame:
    """(tab, dim, cell, id, vec): every row in `probes` cells of every table."""

    def run(batches):
        for batch in batches:
            for own, x in matrices(batch):
                part, x = batch.take(pa.array(own)), unit(x)
                for table in range(tables):
                    codes = cells(x, table, polytopes, probes, seed)
                    again = part.take(pa.array(np.repeat(np.arange(len(own)), codes.shape[1])))
                    n = again.num_rows
                    heads = [pa.array(np.full(n, table, np.int32)), pa.array(np.full(n, x.shape[1], np.int32)), pa.array(codes.ravel())]
                    yield pa.record_batch([*heads, again.column("id"), again.column("vec")], names=["tab", "dim", "cell", "id", "vec"])

    vec_type = rows.schema["vec"].dataType.simpleString()
    return rows.select("id", "vec").mapInArrow(run, f"tab int, dim int, cell bigint, id {id_type}, vec {vec_type}")


def best(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int):
    """Per row of a the first k rows of b by descending exact cosine, then id: (row, row, cosine). `ids` are the ids' order."""
    near = unit(a) @ unit(b).T
    n = min(k, len(b))
    kth = np.partition(near, len(b) - n, axis=1)[:, len(b) - n]
    r, c = np.nonzero(near >= kth[:, None] - SLACK)
    score = cosines(a[r], b[c])
    order = np.lexsort((ids[c], -score, r))
    r, c, score = r[order], c[order], score[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < n
    return r[first], c[first], score[first]


def compared(left: DataFrame, right: DataFrame, k: int, query_type: str, id_type: str) -> DataFrame:
    """(query, id, score): per query the first k rows of every block of a cell that it meets."""
    schema = f"query {query_type}, id {id_type}, score double"
    empty = pa.table({"query": pa.array([], pa.binary()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not ours.num_rows or not theirs.num_rows:
            return empty.set_column(1, "id", theirs.column("id").slice(0, 0)).set_column(0, "query", ours.column("id").slice(0, 0))
        theirs = theirs.combine_chunks().sort_by("id")
        (_, a), = matrices(ours)
        (_, b), = matrices(theirs)
        found = [(r + at, c, s) for at in range(0, len(a), QUERIES) for r, c, s in [best(a[at : at + QUERIES], b, np.arange(len(b)), k)]]
        r, c, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query": ours.column("id").combine_chunks().take(pa.array(r)), "id": theirs.column("id").take(pa.array(c)), "score": score})

    key = ["tab", "dim", "cell", "i", "j"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


def nearest(
    vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
    tables: int = 12, probes: int = 8, polytopes: int = 1, seed: int = 13,
) -> DataFrame:
    """The k nearest other rows, by cosine, of the rows whose (whole-number) id is divisible by `every`: query_id, rank, vec_id, score.

    Found are neighbours that share a cell with the query: a row lies in one cell of each of `tables` tables (per polytope the
    nearest of 2 x dimensions signed axes after a pseudo-rotation), a query looks into its `probes` nearest cells of each. What is found is
    ranked by the exact cosine in double precision, ties by smaller id. Nothing is fitted, every row is indexed, no cell is cut.
    More `polytopes` make more and smaller cells, for tables whose cells get too large to read.

    Rows without id or vector, with a zero or empty vector, or with a NULL or non-finite component take no part; vectors of different lengths
    do not meet. Rows with the query's id are the query; a repeated id counts once, with its best score; a query id with
    several vectors gets an answer for each. Fewer than k found: all of them. Empty tables: no rows. Other columns are ignored.

    Of equal vectors only those with the k + 1 smallest ids can be in an answer, and queries with equal vectors have one
    search: so a vector that a third of all rows share is compared once. Cells are cut into blocks of about 8,192 rows and
    1,024 queries; a task compares two blocks and sends k + 1 rows per query and block.
    """
    rows = vector_rows(vectors, id_col, vec_col, False)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    # 128 bits name a vector; -0.0 and 0.0 hash alike.
    name = F.struct(F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(seed), "vec").alias("b"))
    rows = rows.select(F.col("vec_id").alias("id"), name.alias("name"), "vec")
    indexed = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("name").orderBy("id"))).where(F.col("place") <= k + 1)
    indexed = indexed.dropDuplicates(["name", "id"]).select("id", "vec")
    asked = stored(rows.where(F.col("id") % every == 0), "queries")
    searched = asked.dropDuplicates(["name"]).select(F.col("name").alias("id"), "vec")
    held = stored(placed(indexed, tables, polytopes, 1, seed, id_type), "index")
    sought = stored(placed(searched, tables, polytopes, probes, seed, "struct<a:bigint,b:bigint>"), "probes")
    cell = ["tab", "dim", "cell"]
    sizes = held.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / ROWS).alias("ni")).join(sought.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("nj")), cell)
    # A row per cell with queries; sent along only if there are few.
    sizes = sent_if_small(stored(sizes, "cell-sizes"))
    part = lambda n: F.pmod(F.xxhash64("id"), n)
    every_ = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    right = held.join(sizes, cell).withColumn("i", part(F.col("ni"))).withColumn("j", every_("nj")).drop("ni", "nj")
    left = sought.join(sizes, cell).withColumn("j", part(F.col("nj"))).withColumn("i", every_("ni")).drop("ni", "nj")
    near = compared(left, right, k + 1, "struct<a:bigint,b:bigint>", id_type).groupBy("query", "id").agg(F.max("score").alias("score"))
    near = top_k(near, ["query"], [F.desc("score"), F.col("id")], k + 1, "place").select(F.col("query").alias("name"), F.col("id").alias("vec_id"), "score")
    answers = asked.select(F.col("id").alias("query_id"), "name").distinct().join(near, "name").where(F.col("vec_id") != F.col("query_id"))
    return top_k(answers, ["query_id", "name"], [F.desc("score"), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")

