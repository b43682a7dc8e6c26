"""Row embeddings: lookup, cosine, path similarity and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relimpute.functions.hashing import bucket_of, draw
from relimpute.functions.ranking import top_k
from relimpute.operators.graph import MetaPath
from relimpute.session import cut_lineage
from relimpute.sources.catalog import dealt_out

DIMENSION = 64
MAX_PIVOTS = 1024
BLOCK = 4096
#: `knn_join` compares blocks of up to `LARGE * BLOCK` rows, 32 MB of 64 dimensions each: larger blocks are sent less often.
LARGE = 16
#: Pairs of one task that wait for the cut to k, and whose distances are taken at once.
WAITING = 1 << 18
#: Candidates that a task of `shared_similarity` makes at a time.
PAIRS = 250_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """NULL when either vector is zero or absent."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def lookup(rows: DataFrame, embeddings: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """`rows` (table, row_id, …) with their embedding, zeros where none is stored."""
    zeros = F.array_repeat(F.lit(0.0), dimension)
    joined = rows.join(embeddings, ["table", "row_id"], "left")
    return joined.withColumn("embedding", F.coalesce("embedding", zeros))


def _of_tables(embeddings: DataFrame, tables: Iterable[str]) -> DataFrame:
    """The vectors of some tables; those of others are not made."""
    return embeddings.where(F.col("table").isin(sorted(set(tables))))


def path_similarity(instances: DataFrame, paths: Sequence[MetaPath], embeddings: DataFrame) -> DataFrame:
    """`instances` with `sim`, the mean cosine of consecutive nodes; NULL for one-node paths.

    Every distinct pair of neighbouring rows is compared once, whatever the number of instances
    that pass through it.
    """
    tables = F.create_map(*[x for p in paths for x in (F.lit(p.path_id), F.array(*[F.lit(e.dst_table) for e in p.edges]))])
    nodes = F.zip_with(F.element_at(tables, F.col("path_id")), F.col("row_ids"), lambda t, r: F.struct(t.alias("table"), r.alias("row_id")))
    hops = F.transform(
        F.sequence(F.lit(1), F.size("_nodes") - 1), lambda i: F.struct(F.col("_nodes")[i - 1].alias("a"), F.col("_nodes")[i].alias("b"))
    )
    opened = instances.select("qid", "path_id", "instance_id", nodes.alias("_nodes")).where(F.size("_nodes") > 1)
    opened = opened.select("qid", "path_id", "instance_id", F.explode(hops).alias("h")).select("qid", "path_id", "instance_id", "h.a", "h.b")
    pairs = opened.select("a", "b").distinct()
    embeddings = _of_tables(embeddings, [e.dst_table for p in paths for e in p.edges])
    for side in ("a", "b"):
        named = embeddings.select(F.struct("table", "row_id").alias(side), F.col("embedding").alias(f"e{side}"))
        pairs = pairs.join(named, side, "left")
    compared = pairs.select("a", "b", cosine(F.col("ea"), F.col("eb")).alias("cos"))
    sims = opened.join(compared, ["a", "b"]).groupBy("qid", "path_id", "instance_id").agg(F.avg("cos").alias("sim"))
    return instances.join(sims, ["qid", "path_id", "instance_id"], "left")


def query_similarity(instances: DataFrame, paths: Sequence[MetaPath], queries: DataFrame, embeddings: DataFrame) -> DataFrame:
    """`instances` with `query_sim`, the cosine of the query row (`queries`: row_id, embedding) and the last node."""
    goals = F.create_map(*[x for p in paths for x in (F.lit(p.path_id), F.lit(p.goal))])
    ends = instances.withColumns({"_goal": F.element_at(goals, F.col("path_id")), "_last": F.element_at("row_ids", -1)})
    asked = queries.select(F.col("row_id").alias("qid"), F.col("embedding").alias("_q"))
    held = embeddings.select(F.col("table").alias("_goal"), F.col("row_id").alias("_last"), F.col("embedding").alias("_e"))
    joined = ends.join(asked, "qid", "left").join(held, ["_goal", "_last"], "left")
    return joined.select(*instances.columns, cosine(F.col("_q"), F.col("_e")).alias("query_sim"))


def asked_similarity(candidates: DataFrame, goals: dict[str, str], queries: DataFrame, embeddings: DataFrame) -> DataFrame:
    """`candidates` with `query_sim`, the cosine of the asked cell (`queries`: qid, attr, embedding) and the candidate's last row.

    `goals` maps a path to the table it ends in. Every distinct (cell, last row) is compared once.
    """
    ends = F.create_map(*[x for p, t in goals.items() for x in (F.lit(p), F.lit(t))])
    named = candidates.withColumns({"_goal": F.element_at(ends, F.col("path_id")), "_last": F.element_at("row_ids", -1)})
    pairs = named.select("qid", "attr", "_goal", "_last").distinct()
    held = _of_tables(embeddings, goals.values()).select(F.col("table").alias("_goal"), F.col("row_id").alias("_last"), F.col("embedding").alias("_e"))
    pairs = pairs.join(held, ["_goal", "_last"]).join(queries.select("qid", "attr", F.col("embedding").alias("_q")), ["qid", "attr"])
    pairs = pairs.select("qid", "attr", "_goal", "_last", cosine(F.col("_q"), F.col("_e")).alias("query_sim"))
    return named.join(pairs, ["qid", "attr", "_goal", "_last"], "left").drop("_goal", "_last")


def _held_rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray] | None:
    """The vectors of a column as a matrix and their lengths, zeros where none is held; None without any."""
    there = np.flatnonzero(column.is_valid().to_numpy())
    if not len(there):
        return None
    vectors = np.asarray(pc.list_flatten(column).to_numpy(), dtype=np.float64).reshape(len(there), -1)
    out = np.zeros((len(column), vectors.shape[1]))
    out[there] = vectors
    return out, np.sqrt((out * out).sum(1))


def shared_similarity(members: DataFrame, cells: DataFrame, goals: dict[str, str], queries: DataFrame, embeddings: DataFrame, named: bool = True) -> DataFrame:
    """Candidates with `query_sim` as `asked_similarity` gives it, for query rows (`members`: qid, ask) that share them (`cells`: ask, attr, row_ids, …).

    Vectors of the cells of an ask meet those of its candidates in blocks of about `PAIRS` pairs, so that what is written grows with
    rows, and a pair only leaves its task in what is made of it. Without `named` no row ids are sent along.
    """
    ends = F.create_map(*[x for p, t in goals.items() for x in (F.lit(p), F.lit(t))])
    ended = cells.withColumns({"_goal": F.element_at(ends, F.col("path_id")), "_last": F.element_at("row_ids", -1)})
    held = _of_tables(embeddings, goals.values()).select(F.col("table").alias("_goal"), F.col("row_id").alias("_last"), F.col("embedding").cast("array<double>").alias("_e"))
    ended = ended.join(held, ["_goal", "_last"], "left").drop("_goal", "_last", *([] if named else ["row_ids", "instance_id"]))
    many = members.groupBy("ask").agg(F.count(F.lit(1)).alias("_m"))
    sizes = cells.groupBy("ask", "attr").agg(F.count(F.lit(1)).alias("_c")).join(many, "ask")
    sizes = sizes.select("ask", "attr", F.least("_m", F.ceil(F.col("_m") * F.col("_c") / PAIRS)).cast("int").alias("_parts"))
    # a cell whose key comes twice has two vectors; what can not be compared counts once
    first = F.row_number().over(W.partitionBy("qid", "attr").orderBy("qid")) == 1
    asking = queries.select("qid", "attr", F.col("embedding").cast("array<double>").alias("_q"), first.alias("_first"))
    asking = members.join(sizes, "ask").join(asking, ["qid", "attr"], "left").withColumn("_part", F.pmod(F.xxhash64("qid"), F.col("_parts")).cast("int"))
    sent = ended.join(sizes, ["ask", "attr"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    own = [f for f in sent.schema.fields if f.name not in ("ask", "_e", "_part")]
    schema = T.StructType([T.StructField("qid", members.schema["qid"].dataType), *own, T.StructField("query_sim", T.DoubleType())])

    def compare(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        rows, places = np.repeat(np.arange(len(ours)), len(theirs)), np.tile(np.arange(len(theirs)), len(ours))
        asked, offered = _held_rows(ours["_q"]), _held_rows(theirs["_e"])
        if asked is None or offered is None:
            similar = pa.nulls(len(rows), pa.float64())
        else:
            lengths = asked[1][:, None] * offered[1][None, :]
            similar = pa.array((asked[0] @ offered[0].T / np.where(lengths > 0, lengths, 1.0)).ravel(), mask=lengths.ravel() == 0)
        kept = ours["_first"].fill_null(True).to_numpy()[rows] | theirs["_e"].is_valid().to_numpy()[places]
        at = pa.array(places[kept])
        return pa.table({"qid": ours["qid"].take(pa.array(rows[kept])), **{f.name: theirs[f.name].take(at) for f in own}, "query_sim": similar.filter(pa.array(kept))})

    block = ["ask", "attr", "_part"]
    asking = asking.select("qid", "_q", "_first", *[F.col(c).alias(f"_by_{c}") for c in block])
    return asking.groupBy(*[f"_by_{c}" for c in block]).cogroup(sent.groupBy(*block)).applyInArrow(compare, schema)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(squared, 0.0))


def _sides(df: DataFrame, key: str, vector: str, metric: str) -> DataFrame:
    df, vec = dealt_out(df), F.col(vector).cast("array<double>")
    if metric == "cosine":
        norm = F.sqrt(dot(vec, vec))
        df = df.where(norm > 0)
        # held in a struct, so that it is taken once per vector and not once per component
        held = F.array(F.struct(vec.alias("vec"), norm.alias("norm")))
        vec = F.element_at(F.transform(held, lambda h: F.transform(h["vec"], lambda x: x / h["norm"])), 1)
    return df.select(F.col(key).alias("id"), vec.alias("vec"))


def knn_join(
    queries: DataFrame, targets: DataFrame, k: int, metric: str = "l2", query: tuple[str, str] = ("id", "vec"),
    target: tuple[str, str] = ("id", "vec"),
) -> DataFrame:
    """(query_id, target_id, distance, rank): exact k nearest targets of every query.

    Targets are grouped by their nearest pivot row, and groups that lie near each other share a
    block. The triangle inequality bounds the distance of a query to every group, and a query is
    sent only to blocks with a group that can hold one of its k nearest. Blocks, and the queries sent
    to one, are cut into parts of bounded size; a task compares two parts tile by tile as matrices and
    emits k rows per query, never the pairs. With metric `cosine` vectors are scaled to unit length
    first (zero vectors have no neighbours) and the distance is one minus the cosine.
    """
    spark = targets.sparkSession
    left = _sides(queries, *query, metric)
    right = cut_lineage(_sides(targets, *target, metric))
    key_type = right.schema["id"].dataType.simpleString()
    query_type = left.schema["id"].dataType.simpleString()
    size = right.count()
    pivots = min(MAX_PIVOTS, max(1, int(size**0.5)))
    # at most MAX_PIVOTS vectors reach the driver
    chosen = right.orderBy(draw(F.col("id"), "pivot", 0), "id").limit(pivots).select("vec").collect()
    if not chosen:
        return spark.createDataFrame([], f"query_id {query_type}, target_id {key_type}, distance double, rank int")
    centres = spark.sparkContext.broadcast(np.array([r["vec"] for r in chosen], dtype=np.float64))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            far = _distances(_matrix(batch["vec"]), centres.value)
            batch["cell"] = far.argmin(1)
            batch["radius"] = far.min(1)
            yield batch

    placed = cut_lineage(right.mapInPandas(assign, f"id {key_type}, vec array<double>, cell int, radius double"))
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("lo"), F.max("radius").alias("hi")).collect()
    found = {c: np.array([r[c] for r in stats]) for c in ("cell", "n", "lo", "hi")}
    found["block"] = _blocks(centres.value[found["cell"]], found["n"])
    cells = spark.sparkContext.broadcast(found)
    blocks = found["block"].max() + 1

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = cells.value
        for batch in batches:
            if batch.empty:
                continue
            far = _distances(_matrix(batch["vec"]), centres.value[c["cell"]])
            upper = far + c["hi"]
            order = upper.argsort(1)
            enough = (c["n"][order].cumsum(1) >= min(k, c["n"].sum())).argmax(1)
            reach = np.take_along_axis(upper, order, 1)[np.arange(len(far)), enough]
            lower = np.maximum(np.maximum(far - c["hi"], c["lo"] - far), 0.0)
            batch["blocks"] = [np.unique(c["block"][row <= r * (1 + 1e-9) + 1e-9]) for row, r in zip(lower, reach)]
            yield batch

    routed = cut_lineage(left.mapInPandas(route, f"id {query_type}, vec array<double>, blocks array<int>"))
    asked, sent = routed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("blocks")), F.lit(0))).first()
    merged = -(-int(blocks) // -(-size // (LARGE * BLOCK)))
    if merged > 1 and 2 * sent > blocks * asked:
        # hardly a block is ruled out: few large ones, since a cut is found anew in each
        found["block"] = found["block"] // merged
        routed = routed.withColumn("blocks", F.array_distinct(F.transform("blocks", lambda b: F.floor(b / merged).cast("int"))))
        sent = -(-sent // merged)
    # as many queries at once as leave every core some work
    many = min(LARGE * BLOCK, max(BLOCK, sent // (8 * spark.sparkContext.defaultParallelism)))
    # one row per group
    named = spark.createDataFrame([(int(c), int(b)) for c, b in zip(found["cell"], found["block"])], "cell int, block int")
    held = placed.join(F.broadcast(named), "cell")
    near = _compared(routed.withColumn("block", F.explode("blocks")), held, ["block"], k, metric, True, many, LARGE * BLOCK)
    # distances that differ in rounding only are ties, decided by id
    return top_k(near, ["query_id"], [F.round("distance", 9), F.col("target_id")], k)


def _blocks(centres: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The block of every group: groups are chained from neighbour to neighbour, and the chain is cut into blocks of about equal size."""
    count = max(-(-int(sizes.sum()) // (LARGE * BLOCK)), min(LARGE, len(sizes)))
    left, chain = np.ones(len(sizes), bool), [0]
    left[0] = False
    while left.any():
        rest = np.flatnonzero(left)
        chain.append(rest[_distances(centres[chain[-1]][None], centres[rest])[0].argmin()])
        left[chain[-1]] = False
    middle = sizes[chain].cumsum() - sizes[chain] / 2
    out = np.empty(len(sizes), np.int32)
    out[chain] = np.unique(middle * count // sizes.sum(), return_inverse=True)[1]
    return out


def _compared(
    routed: DataFrame, placed: DataFrame, cell: list[str], k: int, metric: str, few: bool, queries: int | None = None, targets: int | None = None,
) -> DataFrame:
    """(query_id, target_id, distance): k targets per query and part of a cell; `few` cells are sent to every task.

    At most about `queries` rows are compared with `targets` rows at a time, by default `BLOCK` each.
    """
    key_type, query_type = (df.schema["id"].dataType.simpleString() for df in (placed, routed))
    asked = routed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / (queries or BLOCK)).alias("qparts"))
    held = placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / (targets or BLOCK)).alias("tparts"))
    parts = asked.join(held, cell)
    parts = F.broadcast(parts) if few else parts
    q = routed.join(parts, cell).withColumn("qpart", bucket_of(draw(F.col("id"), "block", 0), F.col("qparts")))
    q = q.withColumn("tpart", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tparts") - 1)))
    t = placed.join(parts, cell).withColumn("tpart", bucket_of(draw(F.col("id"), "block", 0), F.col("tparts")))
    t = t.withColumn("qpart", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("qparts") - 1)))
    block = [*cell, "qpart", "tpart"]
    width, waiting = BLOCK, WAITING

    def compare(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        # places in the sorted targets stand for their ids
        theirs = theirs.take(pc.sort_indices(theirs, sort_keys=[("id", "ascending")]))
        rows, places, distance = _nearest(_rows(ours), _rows(theirs), k, metric, width, waiting)
        return pa.table({"query_id": ours["id"].take(pa.array(rows)), "target_id": theirs["id"].take(pa.array(places)), "distance": distance})

    schema = f"query_id {query_type}, target_id {key_type}, distance double"
    return q.select("id", "vec", *block).groupBy(*block).cogroup(t.select("id", "vec", *block).groupBy(*block)).applyInArrow(compare, schema)


def _rows(table: pa.Table) -> np.ndarray:
    """The vectors of a table as a matrix."""
    held = table["vec"].combine_chunks()
    flat = np.asarray(pc.list_flatten(held).to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(table), -1) if len(table) and len(flat) else np.zeros((len(table), 1))


def _few_copies(b: np.ndarray, k: int) -> np.ndarray:
    """Places of the targets that come before the k-th copy of their vector: later ones are nobody's k nearest."""
    b = np.ascontiguousarray(b + 0.0)  # one zero only
    _, kind = np.unique(b.view(np.dtype((np.void, b.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.argsort(kind, kind="stable")
    new = np.r_[True, kind[order][1:] != kind[order][:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(len(kind)), 0))
    return np.sort(order[np.arange(len(kind)) - first < k])


def _nearest(a: np.ndarray, b: np.ndarray, k: int, metric: str, width: int, waiting: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k nearest rows of b per row of a, ties to the lower row of b.

    Tiles of the distance matrix are cut by the k-th distance seen so far, so what is ranked is little more than k rows
    of b per row of a; ties at the k-th place stay in until they are ranked by exact distances. Tiles are in single
    precision, about the centre of b and with the cut as one more factor, so that a sign tells; the cut has room for their
    rounding. Where this room is not small beside the distances, they are in double precision.
    """
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    kept = _few_copies(b, k)
    near = b[kept]
    scale = float((near * near).sum(1).max() / 2) if len(near) else 0.0
    n, d = near.shape
    centre = near.mean(0)
    size = float(np.sqrt(max(((near - centre) ** 2).sum(1).max(), ((a - centre) ** 2).sum(1).max())))
    usual = np.float32 if 1e-100 < size < 1e100 else np.float64
    if usual is np.float64:
        centre, size = np.zeros(d), 1.0
    room = {t: 2 * (d + 8) * float(np.finfo(t).eps) for t in (np.float32, np.float64)}
    step, wide = max(1, width // 16), max(8, width // 32 * 8)
    sides = {}

    def side(kind):
        """Targets with half their square and a one, in eights; what fills the last eight is infinitely far."""
        if kind not in sides:
            moved = (near - centre) / size
            sides[kind] = np.zeros((n + -n % 8, d + 2), kind)
            sides[kind][:n, :d], sides[kind][:n, d], sides[kind][n:, d], sides[kind][:, d + 1] = moved, (moved * moved).sum(1) / 2, np.inf, 1
        return sides[kind]

    out = []
    for at in range(0, len(a), step):
        ours, kind = a[at : at + step], usual
        # cosines are told apart to nine digits, which near zero is far more than so much of a distance
        slack = 1e-12 * ((ours * ours).sum(1) + scale) + (1e-9 if metric == "cosine" else 0.0)
        moved = (ours - centre) / size
        own = (moved * moved).sum(1) / 2
        last = np.full(len(ours), np.inf)
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def cut():
            """The k-th distance in the terms of the tiles, with room for rounding and ties."""
            return (last * last / 2 + 1e-7 * last + slack) / size**2 - own + room[kind]

        def queries():
            left = np.ones((len(ours), d + 2), kind)
            left[:, :d], left[:, d + 1] = -moved, -cut()
            return left

        def ranked(found, rows, places):
            """What is found and the new pairs, cut to k per row."""
            distance = np.empty(len(rows))
            for i in range(0, len(rows), waiting):
                x, y = ours[rows[i : i + waiting]], near[places[i : i + waiting]]
                distance[i : i + waiting] = 1.0 - np.einsum("ij,ij->i", x, y) if metric == "cosine" else np.sqrt(((x - y) ** 2).sum(1))
            rows, places, distance = (np.concatenate(x) for x in zip(found, (rows, places, distance)))
            order = np.lexsort((places, distance.round(9), rows))
            rows, places, distance = rows[order], places[order], distance[order]
            begin = np.searchsorted(rows, np.arange(len(ours) + 1))
            rank = np.arange(len(rows)) - begin[rows]
            full = begin[1:] - begin[:-1] >= k
            furthest = distance[begin[:-1][full] + k - 1]
            last[full] = np.sqrt(np.maximum(2 * furthest, 0)) if metric == "cosine" else furthest
            return rows[rank < k], places[rank < k], distance[rank < k]

        new, count, due, left = [], 0, wide, None
        for start in range(0, n, wide):
            if start == 0 and k <= min(n, wide):
                tile = _uncut(moved, kind) @ side(kind)[:wide].T
                kth = np.partition(tile, k - 1, axis=1)[:, k - 1].astype(np.float64)
                last = size * np.sqrt(np.maximum(2 * (kth + room[kind] + own), 0))
            left = queries() if left is None else left
            theirs = side(kind)[start : start + wide]
            eights = np.less_equal(left @ theirs.T, 0).reshape(-1, 8)
            held = np.flatnonzero(eights.view(np.uint64).ravel())
            which, bit = np.nonzero(eights[held])
            rows, places = np.divmod(held[which] * 8 + bit, len(theirs))
            new.append((rows, places + start))
            count += len(rows)
            if count > waiting or start + wide >= min(due, n):
                found = ranked(found, *(np.concatenate(x) for x in zip(*new)))
                new, count, due, left = [], 0, max(due, 2 * (start + wide)), None
                if kind is np.float32 and room[kind] > np.median(last * last) / size**2 / 100:
                    kind = np.float64
        out.append((found[0] + at, kept[found[1]], found[2]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _uncut(moved: np.ndarray, kind) -> np.ndarray:
    return np.hstack([-moved, np.ones((len(moved), 1)), np.zeros((len(moved), 1))]).astype(kind)


def _projected(vec: np.ndarray, axes: np.ndarray, shifts: np.ndarray, width: float) -> np.ndarray:
    """Place of every vector on every projection in bucket widths: (vectors, tables, projections)."""
    return np.einsum("nd,tpd->ntp", vec, axes) / width + shifts


def _bucket(places: np.ndarray, mixers: np.ndarray) -> np.ndarray:
    """One 64-bit number per list of bucket places; two lists that share a number only cost a comparison."""
    return (places.astype(np.int64).astype(np.uint64) * mixers).sum(-1, dtype=np.uint64).view(np.int64)


def _steps(projections: int) -> np.ndarray:
    """Moves to other buckets: none, one step on one projection, one step on two."""
    single = [(i, s) for i in range(projections) for s in (-1, 1)]
    chosen = [[], *[[x] for x in single], *[[x, y] for x in single for y in single if x[0] < y[0]]]
    moves = np.zeros((len(chosen), projections), np.int64)
    for row, steps in zip(moves, chosen, strict=True):
        for i, s in steps:
            row[i] = s
    return moves


def bucketed_sides(
    queries: DataFrame, targets: DataFrame, k: int, metric: str = "l2", query: tuple[str, str] = ("id", "vec"), target: tuple[str, str] = ("id", "vec"),
    tables: int = 8, projections: int = 6, probes: int = 12, width: float | None = None, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """Queries and targets with the buckets (tab, cell) they are compared in: a target in one bucket per table, a query in `probes`.

    A bucket is a list of intervals of random projections. A query looks into its own bucket and those nearest to
    it, by the distance to their borders. Without a `width` an interval is four times the median distance to the k-th
    neighbour within a sample of at most 1,024 targets.
    """
    left, right = _sides(queries, *query, metric), cut_lineage(_sides(targets, *target, metric))
    key_type, query_type = (df.schema["id"].dataType.simpleString() for df in (right, left))
    sample = [r["vec"] for r in right.orderBy(draw(F.col("id"), "pivot", 0), "id").limit(MAX_PIVOTS).select("vec").collect()]
    size = len(sample[0]) if sample else 1
    if width is None:
        far = np.sort(_distances(np.array(sample), np.array(sample)), axis=1) if len(sample) > 1 else np.ones((1, 2))
        width = 4 * float(np.median(far[:, min(k, far.shape[1] - 1)])) or 1.0
    rng = np.random.default_rng(seed)
    axes, shifts = rng.normal(size=(tables, projections, size)), rng.random((tables, projections))
    mixers = rng.integers(0, 2**63, (tables, projections), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    moves = _steps(projections)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                spots = np.floor(_projected(_matrix(batch["vec"]), axes, shifts, width))
                batch["cells"] = list(_bucket(spots, mixers))
                yield batch

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at : at + BLOCK].copy()
                spots = _projected(_matrix(part["vec"]), axes, shifts, width)
                inside = spots - np.floor(spots)
                # squared distance to the border that a step crosses
                cost = np.einsum("ntp,mp->ntm", inside**2, moves == -1) + np.einsum("ntp,mp->ntm", (1 - inside) ** 2, moves == 1)
                best = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
                found = _bucket(np.floor(spots)[:, :, None, :] + moves[best], mixers[None, :, None, :])
                part["cells"] = list(found.reshape(len(part), -1))
                yield part

    def opened(df: DataFrame, each: int) -> DataFrame:
        cells = df.select("id", "vec", F.posexplode("cells").alias("_at", "cell"))
        return cells.select("id", "vec", F.floor(F.col("_at") / each).cast("int").alias("tab"), "cell").distinct()

    each = min(probes, len(moves))
    held = opened(right.mapInPandas(place, f"id {key_type}, vec array<double>, cells array<bigint>"), 1)
    asked = opened(left.mapInPandas(probe, f"id {query_type}, vec array<double>, cells array<bigint>"), each)
    return cut_lineage(asked), cut_lineage(held)


def bucketed_knn(
    queries: DataFrame, targets: DataFrame, k: int, metric: str = "l2", query: tuple[str, str] = ("id", "vec"), target: tuple[str, str] = ("id", "vec"), **options,
) -> DataFrame:
    """(query_id, target_id, distance, rank): approximately the k nearest targets, with exact distances.

    The approximate mode of `knn_join`, which is quadratic where its pivots rule nothing out. Only rows that share a bucket
    (see `bucketed_sides` for the options) are compared, in blocks of bounded size, so a crowded bucket is split and
    never cut. A query that shares buckets with fewer than k targets gets fewer. How much is found depends on the
    vectors: in tight groups nearly everything at a few per cent of the pairs; between vectors that are all about
    equally far apart no bucket helps and `knn_join` is the choice.
    """
    asked, held = bucketed_sides(queries, targets, k, metric, query, target, **options)
    near = _compared(asked, held, ["tab", "cell"], k, metric, False).groupBy("query_id", "target_id").agg(F.min("distance").alias("distance"))
    return top_k(near, ["query_id"], [F.round("distance", 9), F.col("target_id")], k)


def cosine_top_n(queries: DataFrame, targets: DataFrame, n: int = 5, query=("id", "vec"), target=("id", "vec")) -> DataFrame:
    """(query_id, target_id, similarity, rank): the n most similar targets of every query."""
    near = knn_join(queries, targets, n, "cosine", query, target)
    return near.select("query_id", "target_id", (1 - F.col("distance")).alias("similarity"), "rank")


def neighbour_candidates(queries: DataFrame, table: str, embeddings: DataFrame, k: int = 5) -> DataFrame:
    """Direct candidates from a related table for cells without a path: each neighbour is a one-node path."""
    own = embeddings.where(F.col("table") == table).select(F.col("row_id").alias("id"), F.col("embedding").alias("vec"))
    near = knn_join(queries.select(F.col("qid").alias("id"), F.col("embedding").alias("vec")), own, k)
    return near.select(
        F.col("query_id").alias("qid"), F.lit(table).alias("path_id"), F.md5("target_id").alias("instance_id"),
        F.array("target_id").alias("row_ids"), "distance", "rank",
    )
