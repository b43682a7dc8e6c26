"""Packing documents into training sequences: cutting stock solved by column generation."""

from __future__ import annotations

import base64
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relimpute.llm.tables import stored, taken

#: Fixed value: how the byte-level vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Length classes of pieces; a class rounds lengths up to its width.
CLASSES = 256
END = 1

_encoders: dict = {}


def encoder(path: str):
    """Ids of a text by the byte-level vocabulary at `path`; loaded once in a worker. Strings of special tokens are text."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _encoders[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int, keep_ids: bool) -> DataFrame:
    """Every document's ids and an end id, cut at multiples of the capacity.

    doc_id, start, length, ids_crc32, doc_tokens, class (its length in units, rounded up), chunk (the task
    that made it), nth (its number within chunk and class); ids (array of int) if asked for.
    """
    unit = -(-capacity // CLASSES)

    def run(batches):
        encode, chunk = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(-(-capacity // unit) + 1, np.int64)
        for batch in batches:
            rows, source, ids = [], [], []
            for i, text in enumerate(batch.column("text")):
                whole = array("I", [*encode(text.as_py() or ""), END]).tobytes()
                view, tokens = memoryview(whole), len(whole) // 4
                for start in range(0, tokens, capacity):
                    part = view[4 * start : 4 * (start + capacity)]
                    length = len(part) // 4
                    kind = -(-length // unit)
                    rows.append((start, length, zlib.crc32(part), tokens, kind, int(seen[kind])))
                    seen[kind] += 1
                    source.append(i)
                    if keep_ids:
                        ids.append(np.frombuffer(part, np.uint32).astype(np.int32))
            table = np.array(rows, np.int64).reshape(-1, 6)
            columns = [batch.column("doc_id").take(pa.array(source, pa.int64())), *(pa.array(table[:, c]) for c in range(6)), pa.array(np.full(len(rows), chunk, np.int64))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "nth", "chunk"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.record_batch(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class bigint, nth bigint, chunk bigint" + (", ids array<int>" if keep_ids else ""))


def best_pattern(worth: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The knapsack over one sequence: the most valuable multiset of classes that fits, by dynamic programming."""
    value, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        value[c] = value[c - 1]
        fits = np.searchsorted(sizes, c, "right")
        if fits:
            with_it = value[c - sizes[:fits]] + worth[:fits]
            k = int(np.argmax(with_it))
            if with_it[k] > value[c] + 1e-12:
                value[c], took[c] = with_it[k], k
    pattern, c = np.zeros(len(sizes)), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(value[room]), pattern


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, in fractions: the linear program of the cutting stock.

    Begins with one pattern per class; the duals of the current basis price new patterns by the knapsack,
    the best one replaces a basic one, until no pattern can lower the number of sequences by more than `gap`.
    """
    m = len(sizes)
    basis = np.diag(room // sizes).astype(float)
    used = demand / np.diag(basis)
    for _ in range(40 * m):
        worth = np.linalg.solve(basis.T, np.ones(m))
        price, pattern = best_pattern(worth, sizes, room)
        # No solution is below demand @ worth / price.
        if price <= 1 + 1e-9 or used.sum() * (1 - 1 / price) <= gap * used.sum():
            break
        step = np.linalg.solve(basis, pattern)
        up = step > 1e-9
        ratio = np.full(m, np.inf)
        ratio[up] = used[up] / step[up]
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        used = np.maximum(used - ratio[out] * step, 0)
        used[out] = ratio[out]
        basis[:, out] = pattern
    return basis, used


def rounded(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {class index: pieces}) with whole numbers that use up the demand exactly.

    The linear program's uses are rounded down; what is left, at most a sequence per pattern,
    is filled class by class, largest first, each into the fullest sequence that has room.
    """
    basis, used = solve(sizes, demand.astype(float), room)
    left, out = demand.copy(), []
    for p in np.argsort(-used, kind="stable"):
        pattern = basis[:, p].astype(np.int64)
        held = pattern > 0
        times = min(int(used[p] + 1e-9), int((left[held] // pattern[held]).min()))
        if times > 0:
            left = left - times * pattern
            out.append((times, {int(k): int(pattern[k]) for k in np.flatnonzero(held)}))
    rooms: list[list[dict[int, int]]] = [[] for _ in range(room + 1)]
    for k in np.argsort(-sizes, kind="stable"):
        size = int(sizes[k])
        for _ in range(int(left[k])):
            free = next((f for f in range(size, room) if rooms[f]), None)
            held = rooms[free].pop() if free is not None else {}
            held[int(k)] = held.get(int(k), 0) + 1
            rooms[(room if free is None else free) - size].append(held)
    return out + [(1, held) for free in rooms for held in free]


def plan(histogram: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """Per class the ranks and sequences of its patterns: rows (first rank, pieces in a sequence, first sequence)."""
    unit = -(-capacity // CLASSES)
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    filled = np.zeros(len(sizes), np.int64)
    rows: dict[int, list[tuple[int, int, int]]] = {int(s): [] for s in sizes}
    sequence = 0
    for times, held in rounded(sizes, demand, capacity // unit) if len(sizes) else []:
        for k, many in held.items():
            rows[int(sizes[k])].append((int(filled[k]), many, sequence))
            filled[k] += times * many
        sequence += times
    return {s: np.array(r, np.int64) for s, r in rows.items()}


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens with little padding.

    A document is the ids of its text and the end id; NULL is an empty text. Returns one row per piece: doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for. Rows are documents: a
    repeated row is packed again, and rows without doc_id as well. An empty table gives no rows; other columns are ignored.

    Documents are cut at multiples of the capacity where they are read, so ids never move: only one small
    row per piece is exchanged. The driver sees the histogram of at most 256 length classes, whatever
    the input: column generation finds patterns of classes, and their rounded numbers deal out ranks.
    A piece's rank in its class is its number within its task plus the counts of the tasks before.
    """
    unit = -(-capacity // CLASSES)
    if capacity % unit:
        raise ValueError(f"capacity must be at most {CLASSES} or a multiple of its {CLASSES}th part, rounded up")
    cut = stored(pieces(taken(docs, doc_id=id_col, text=text_col), vocabulary, capacity, keep_ids), "pieces")
    counts = cut.groupBy("class", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("class").orderBy("chunk")) - F.col("n"))
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    dealt = plan(histogram, capacity)
    ranked = cut.join(before.select("class", "chunk", "before"), ["class", "chunk"]).withColumn("rank", F.col("before") + F.col("nth"))

    def run(batches):
        for batch in batches:
            kind, rank = (batch.column(c).to_numpy() for c in ("class", "rank"))
            sequence = np.zeros(len(kind), np.int64)
            for k in np.unique(kind):
                here = kind == k
                first, many, base = dealt[int(k)].T
                p = np.searchsorted(first, rank[here], "right") - 1
                sequence[here] = base[p] + (rank[here] - first[p]) // many[p]
            yield pa.record_batch([*batch.columns, pa.array(sequence)], names=[*batch.schema.names, "sequence_id"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    placed = ranked.mapInArrow(run, f"{schema}, sequence_id bigint")
    inside = W.partitionBy("sequence_id").orderBy("class", "rank")
    offset = F.sum("length").over(inside) - F.col("length")
    return placed.withColumn("offset", offset).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))
