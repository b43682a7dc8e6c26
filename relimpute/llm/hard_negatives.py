"""Hard-negative mining: scores of anchors against all rows, sorted per anchor inside partitions, windows opened as positives pass by."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from relimpute.llm.tables import shared_folder, stored
from relimpute.llm.vector_rows import matrices, read_table, slabs, vector_rows, write_table

#: Anchors of a file, anchors and rows of one matrix product.
FILE, TILE, SLAB = 2048, 256, 8192
#: Up to this bound sums of products of whole numbers are exact in double precision.
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1
#: Below every score, in both number kinds.
NONE = -np.inf
POSITIVE, NEGATIVE = 0, 1
PAIRS = "anchor bigint, anchor_id bigint, kind int, score bigint, id bigint"


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles where they are exact, else Python's whole numbers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * x)
    if np.abs(scaled).max(initial=0) < EXACT:
        return scaled
    return np.array([[int(v * scale // 1) if abs(v * scale) < EXACT else int(v) * scale for v in row] for row in x.tolist()], dtype=object)


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, rows x anchors; beyond 64 bits they stop at the bounds of 64 bits."""
    if rows.dtype != object and anchors.dtype != object and np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0) * rows.shape[1] < EXACT:
        return rows @ anchors.T
    as_int = np.vectorize(int, otypes=[object])
    return np.clip(as_int(rows) @ as_int(anchors).T, LEAST, MOST)


def first_rows(scores: np.ndarray, open_: np.ndarray, k: int):
    """Per column the first k open rows by descending score, then row number: (row, column) of all of them."""
    left = np.where(open_, scores, NONE)
    for _ in range(min(k, len(left))):
        best = left.argmax(axis=0)
        some = np.flatnonzero(left[best, np.arange(left.shape[1])] != NONE)
        if not len(some):
            return
        yield best[some], some
        left[best[some], some] = NONE


def bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole numbers n with low * score <= 100 * n <= high * score, as first and last."""
    return -((-low * score) // 100), (high * score) // 100


def open_windows(scores: list[list[int]], low: int, high: int, dtype):
    """Bounds of the windows of some anchors, place by place of their positives; (1, 0) where an anchor has fewer."""
    own = [[bounds(s, low, high) for s in positive] for positive in scores]
    for place in range(max(map(len, own), default=0)):
        yield np.array([w[place] if place < len(w) else (1, 0) for w in own], dtype=dtype).T


def anchor_files(anchors: DataFrame, folder: str) -> list[str]:
    """The anchors as files of at most 2,048 rows in the shared folder. The driver keeps their names: one per 2,048 anchors."""
    parts = max(1, -(-anchors.count() // FILE))

    def run(batches):
        for table in slabs(batches, FILE):
            yield pa.record_batch([pa.array([write_table(folder, table)])], names=["uri"])

    # Names are fixed by writing them once.
    return sorted(r["uri"] for r in stored(anchors.coalesce(parts).mapInArrow(run, "uri string"), "anchor-files").collect())


def scored(rows: DataFrame, uris: list[str], windows: list[str] | None, positives: int, negatives: int, low: int, high: int, scale: int) -> DataFrame:
    """Per slab of rows and anchor what may enter an answer: the first `positives` rows of its label, or, with `windows`, the first
    `negatives` rows of other labels in each of its windows."""

    def run(batches):
        for slab in slabs(batches, SLAB):
            slab = slab.sort_by("vec_id")
            ids, labels = slab.column("vec_id").to_numpy(), np.array(slab.column("label").to_pylist(), dtype=object)
            cut = [(own, whole(x, scale), x.shape[1]) for own, x in matrices(slab)]
            for number, uri in enumerate(uris):
                block = read_table(uri)
                block_ids, block_labels = block.column("vec_id").to_numpy(), np.array(block.column("label").to_pylist(), dtype=object)
                opened = None
                if windows is not None:
                    if windows[number] is None:
                        continue
                    opened = read_table(windows[number]).column("scores").to_pylist()
                out: list[tuple] = []
                for theirs, y in matrices(block):
                    for own, x, size in cut:
                        if size != y.shape[1]:
                            continue
                        for at in range(0, len(theirs), TILE):
                            tile = theirs[at : at + TILE]
                            s = products(x, whole(y[at : at + TILE], scale))
                            same = labels[own][:, None] == block_labels[tile][None, :]
                            found = []
                            if opened is None:
                                other = ids[own][:, None] != block_ids[tile][None, :]
                                found = list(first_rows(s, same & other, positives))
                            else:
                                for lo, hi in open_windows([opened[i] for i in tile], low, high, s.dtype):
                                    found += first_rows(s, ~same & (s >= lo[None, :]) & (s <= hi[None, :]), negatives)
                            for r, c in found:
                                out.append((number * FILE + tile[c], block_ids[tile[c]], s[r, c], own[r]))
                if out:
                    anchor, anchor_id, score, row = (np.concatenate(x) for x in zip(*out, strict=True))
                    if opened is not None:
                        # A row that lies in several windows of its anchor is sent once.
                        _, once = np.unique(np.stack([anchor, row]), axis=1, return_index=True)
                        anchor, anchor_id, score, row = anchor[once], anchor_id[once], score[once], row[once]
                    kind = np.full(len(anchor), POSITIVE if opened is None else NEGATIVE, np.int32)
                    columns = [pa.array(anchor), pa.array(anchor_id), pa.array(kind), pa.array(score.astype(np.int64)), pa.array(ids[row])]
                    yield pa.record_batch(columns, names=["anchor", "anchor_id", "kind", "score", "id"])

    return rows.mapInArrow(run, PAIRS)


def mined(pairs: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """The secondary sort: rows packed under (anchor, descending score, kind, id); a positive opens its window, negatives fill the open ones."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        current, windows = None, []
        for batch in batches:
            out = []
            for anchor, anchor_id, kind, score, row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "anchor_id", "kind", "score", "id")), strict=True):
                if anchor != current:
                    current, windows = anchor, []
                if kind == POSITIVE:
                    windows.append([row, score, *bounds(score, low, high), 0])
                    continue
                for window in windows:
                    if window[2] <= score <= window[3] and window[4] < negatives:
                        window[4] += 1
                        out.append((anchor_id, window[0], window[4], row, window[1], score))
            if out:
                yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    keyed = pairs.repartition("anchor").sortWithinPartitions("anchor", F.desc("score"), "kind", "id")
    return keyed.mapInArrow(run, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def hard_negatives(
    vectors: DataFrame, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """Hard negatives of the anchors, the rows whose (whole-number) id is divisible by `every`.

    A row's score is the inner product of its vector with the anchor's, components floored after times `scale`. An anchor's positives are the
    first `positives` other rows of its label by descending score, then id. For each, the first `negatives` rows of other labels with
    low % of its score <= their score <= high % of it: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows without id, label or vector, with an empty vector or with a NULL or non-finite component take no part; vectors of
    different lengths have no score. Rows that share the anchor's id are the anchor. Scores beyond 64 bits
    stop there. A repeated row counts as often as it occurs; an anchor that occurs
    twice is answered twice. No anchors, empty tables: no rows. Other columns are ignored.

    Anchors are written to the shared folder in files of 2,048; every task holds a slab of 8,192 rows against one file after the other. Rows are
    read twice: first for the positives, then, the windows being known, for what can stand in one. A slab sends at most `positives` and
    `positives` x `negatives` rows per anchor, whatever it holds, so no anchor and no label is ever collected and
    the exchange shrinks with the slab. The last exchange sorts by (anchor, descending score, kind, id) and streams.
    """
    spark = vectors.sparkSession
    rows = vector_rows(vectors, id_col, vec_col, True, label=label_col).where("label IS NOT NULL")
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), "vec")
    folder = f"{shared_folder(spark)}/llm-anchors-{uuid.uuid4().hex}"
    uris = anchor_files(stored(rows.where(F.col("vec_id") % every == 0), "anchors"), folder)
    if not uris:
        return mined(spark.createDataFrame([], PAIRS), negatives, low, high)
    limits = (positives, negatives, low, high, scale)
    ranked = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    chosen = scored(rows, uris, None, *limits).withColumn("place", ranked).where(F.col("place") <= positives)
    chosen = stored(chosen.drop("place"), "positives")

    def write(table: pa.Table) -> pa.Table:
        number = table.column("anchor")[0].as_py() // FILE
        scores: list[list[int]] = [[] for _ in range(FILE)]
        for anchor, score in sorted(zip(table.column("anchor").to_pylist(), table.column("score").to_pylist(), strict=True)):
            scores[anchor % FILE].append(score)
        return pa.table({"number": [number], "uri": [write_table(folder, pa.table({"scores": pa.array(scores, pa.list_(pa.int64()))}))]})

    # At most 2,048 x `positives` rows per group.
    written = chosen.groupBy(F.floor(F.col("anchor") / FILE)).applyInArrow(write, T.StructType([T.StructField("number", T.LongType()), T.StructField("uri", T.StringType())]))
    by_file = {r["number"]: r["uri"] for r in stored(written, "window-files").collect()}
    found = scored(rows, uris, [by_file.get(i) for i in range(len(uris))], *limits)
    return mined(chosen.unionByName(found), negatives, low, high)


SQL = r"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
    FROM v AS a JOIN v ON a.vec_id <> v.vec_id AND len(a.e) = len(v.e) WHERE a.vec_id % 50 = 0
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
    s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""
