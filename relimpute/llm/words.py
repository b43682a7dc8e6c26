"""Words of Arrow text columns as 64-bit numbers, with numpy and without Python strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers: the one of the word polynomial has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
CHUNK = 1 << 20
#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
AS_TERM = LOWER.astype(U64) + U64(1)

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> U64(30))
    x = x * MIX_A
    x = x ^ (x >> U64(27))
    x = x * MIX_B
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    if n > len(_powers.get("up", ())):
        n = max(n, 2 * CHUNK)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 22):
    """Parts of a batch with about `most` bytes of text each; a longer text is a part of its own."""
    at = text_buffers(batch.column(column))[1]
    group = (at[1:] - at[0]) // most
    cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def word_hashes(column: pa.Array, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, A-Z as a-z, and where each row's words begin (rows + 1 entries)."""
    data, at = text_buffers(column)
    hashes, counts, rows, first = [], [], len(at) - 1, 0
    while first < rows:
        last = max(int(np.searchsorted(at, at[first] + CHUNK, "right")) - 1, first + 1)
        h, n = _chunk(data[at[first] : at[last]], at[first : last + 1] - at[first], blank)
        hashes.append(h)
        counts.append(n)
        first = last
    starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), starts.astype(np.int64)


def _chunk(data: np.ndarray, at: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(at) - 1, np.int64)
    up, down = powers(n)
    word = ~blank[data]
    edges = at[(at > 0) & (at < n)]
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    before[edges] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    after[edges - 1] = False
    begin, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(AS_TERM[data] * up[:n], out=sums[1:])
    h = (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64) * MIX_B
    return mix(h), np.diff(np.searchsorted(begin, at))


def shingle_hashes(words: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each row, or of a shorter row's words as one; and where each row's begin."""
    counts = np.diff(starts)
    lengths = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begins = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    out = np.empty(int(begins[-1]), U64)
    if len(words) >= k:
        runs = np.zeros(len(words) - k + 1, U64)
        for j in range(k):
            runs = runs * U64(BASE) + words[j : len(words) - k + 1 + j]
        # A run's place in `out`: runs begin at word starts[r] + i for i < lengths[r].
        row = np.repeat(np.arange(len(counts)), np.where(counts >= k, lengths, 0))
        inner = np.arange(len(row)) - np.repeat(np.cumsum(np.where(counts >= k, lengths, 0)) - np.where(counts >= k, lengths, 0), np.where(counts >= k, lengths, 0))
        out[begins[row] + inner] = mix(runs[starts[row] + inner] + U64(k))
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        h = U64(0)
        with np.errstate(over="ignore"):
            for w in words[starts[r] : starts[r + 1]]:
                h = h * U64(BASE) + w
            out[begins[r]] = mix(np.array([h + U64(counts[r])], U64))[0]
    return out, begins
