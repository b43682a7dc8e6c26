"""N-gram Jaccard join: exact links between documents by the overlap of their word shingles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relimpute.llm.components import components, forest
from relimpute.llm.tables import partitions, sent_if_small, stored, taken, unused
from relimpute.llm.words import MIX_A, mix, shingle_hashes, slices, word_hashes

U64 = np.uint64
#: Frequent shingles that the order of shingles takes into account: 8 bytes each in every task.
FREQUENT = 1 << 18
#: Prefix shingles per tile: 16 bytes each in one task.
TILE = 1 << 21
#: Weight of the sets compared as one block; longer runs are split into pairs of blocks. A set weighs 1, and 1 more per `WEIGHT` shingles.
BLOCK = 2048
WEIGHT = 1024
#: Blocks that a group of possible partners may weigh to be intersected as a whole: up to 64 MB of sets.
WHOLE = 4
#: Sets intersected with one at once.
AT_ONCE = 64
#: Rows on a side of a bitmap comparison.
SIDE = 256


def row_sets(texts: pa.Array, k: int):
    """The sorted distinct shingles of each row."""
    shingles, begins = shingle_hashes(*word_hashes(texts), k)
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        yield np.unique(shingles[a:b])


def set_keys(shingles: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two independent numbers for a set, equal for equal sets; the first in `bits` bits."""
    with np.errstate(over="ignore"):
        n = U64(len(shingles))
        first, second = mix(np.array([mix(shingles).sum(dtype=U64) + n, mix(shingles ^ MIX_A).sum(dtype=U64) ^ mix(n[None])[0]], U64))
    return int(first) >> (64 - bits), int(second)


def named(shingles: np.ndarray, clashing: frozenset[int], bits: int) -> int:
    """The number that stands for a set: the first one, or the second where different sets share the first."""
    first, second = set_keys(shingles, bits)
    return second if first in clashing else first


def keyed_rows(docs: DataFrame, k: int, key_bits: int) -> DataFrame:
    """Per row doc_id, n (set size), two numbers of the set (NULL if empty) and bits; besides, rows (token, times) on shingles frequent within a batch."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            sets = list(row_sets(batch.column("text"), k))
            n = np.array([len(s) for s in sets], np.int64)
            keys = np.array([set_keys(s, key_bits) for s in sets], U64).reshape(-1, 2).view(np.int64)
            token, times = np.unique(np.concatenate(sets), return_counts=True) if len(sets) else (np.zeros(0, U64), np.zeros(0, np.int64))
            often = times >= 3
            token, times = token[often].view(np.int64), times[often]
            there, more = len(sets), len(token)
            no_set = np.r_[n == 0, np.ones(more, bool)]
            yield pa.record_batch(
                [
                    pa.concat_arrays([batch.column("doc_id"), pa.nulls(more, batch.column("doc_id").type)]),
                    pa.array(np.r_[n, np.zeros(more, np.int64)], mask=np.r_[np.zeros(there, bool), np.ones(more, bool)]),
                    pa.array(np.r_[keys[:, 0], np.zeros(more, np.int64)], mask=no_set),
                    pa.array(np.r_[keys[:, 1], np.zeros(more, np.int64)], mask=no_set),
                    pa.array([bitmap(s).tobytes() if len(s) else None for s in sets] + [None] * more, pa.binary()),
                    pa.array(np.r_[np.zeros(there, np.int64), token], mask=np.r_[np.ones(there, bool), np.zeros(more, bool)]),
                    pa.array(np.r_[np.zeros(there, np.int64), times], mask=np.r_[np.ones(there, bool), np.zeros(more, bool)]),
                ],
                names=["doc_id", "n", "set_key", "second", "bits", "token", "times"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n bigint, set_key bigint, second bigint, bits binary, token bigint, times bigint")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """set_key, least (the smallest doc_id), n and bits of every set; `mixed` where different sets share the number."""
    by_set = rows.where("set_key IS NOT NULL").groupBy("set_key")
    return by_set.agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"), (F.min("second") != F.max("second")).alias("mixed"))


def prefix_tiles(docs: DataFrame, k: int, percent: int, tiles: int, frequent: np.ndarray, clashing: frozenset[int], key_bits: int) -> DataFrame:
    """tile, tokens, keys: the necessary prefix of every set, shingles in one order for all sets, dealt by shingle.

    Two sets of the asked similarity share a shingle among the first n - ceil(percent * n / 100) + 1 of
    each, in any common order. Shingles outside `frequent` come first, in the order of their hash; then
    those of `frequent` (sorted from rare to frequent). A set that a task meets again is not sent again.
    """
    rank_of = np.argsort(frequent, kind="stable")
    known = frequent[rank_of]

    def prefix(shingles: np.ndarray) -> np.ndarray:
        take = len(shingles) - -(-percent * len(shingles) // 100) + 1
        at = np.searchsorted(known, shingles)
        at[at == len(known)] = 0
        common = known[at] == shingles if len(known) else np.zeros(len(shingles), bool)
        rare = shingles[~common]
        if len(rare) >= take:
            return rare[:take]
        rest = rank_of[at[common]]
        return np.concatenate([rare, frequent[np.sort(rest)][: take - len(rare)]])

    def run(batches):
        met: set[int] = set()
        for batch in (part for whole in batches for part in slices(whole)):
            tokens, keys = [], []
            for shingles in row_sets(batch.column("text"), k):
                if not len(shingles) or (key := named(shingles, clashing, key_bits)) in met:
                    continue
                met.add(key)
                tokens.append(prefix(shingles))
                keys.append(np.full(len(tokens[-1]), key, U64))
            if not tokens:
                continue
            token, key = np.concatenate(tokens), np.concatenate(keys)
            tile = (mix(token) % U64(tiles)).astype(np.int64)
            order = np.argsort(tile, kind="stable")
            token, key, tile = token[order], key[order], tile[order]
            edges = np.r_[0, np.flatnonzero(np.diff(tile)) + 1, len(tile)]
            spans = list(zip(edges[:-1], edges[1:], strict=True))
            yield pa.record_batch(
                [pa.array(tile[edges[:-1]]), pa.array([token[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([key[a:b].tobytes() for a, b in spans], pa.binary())],
                names=["tile", "tokens", "keys"],
            )

    return docs.select("text").mapInArrow(run, "tile bigint, tokens binary, keys binary")


def shared_runs(tiles: DataFrame) -> DataFrame:
    """run, head, member: sets with a prefix shingle in common, as links of the smallest one (head) to each other one.

    A run is named by its sets, so that shingles shared by the same sets make one run.
    """

    def run(table: pa.Table) -> pa.Table:
        token = np.concatenate([np.frombuffer(x.as_py(), U64) for x in table.column("tokens")])
        key = np.concatenate([np.frombuffer(x.as_py(), U64) for x in table.column("keys")])
        order = np.lexsort((key, token))
        token, key = token[order], key[order]
        fresh = np.r_[True, (token[1:] != token[:-1]) | (key[1:] != key[:-1])]
        token, key = token[fresh], key[fresh]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[first, len(token)])
        first, size = first[size > 1], size[size > 1]
        with np.errstate(over="ignore"):
            sums = np.concatenate([[U64(0)], np.cumsum(mix(key))])
            same = mix(sums[first + size] - sums[first] + size.astype(U64))
        _, pick = np.unique(same, return_index=True)
        first, size = first[pick], size[pick]
        rest = size - 1
        inner = np.arange(int(rest.sum())) - np.repeat(np.cumsum(rest) - rest, rest)
        return pa.table({"run": np.repeat(same[pick], rest).view(np.int64), "head": np.repeat(key[first], rest).view(np.int64), "member": key[np.repeat(first + 1, rest) + inner].view(np.int64)})

    return tiles.groupBy("tile").applyInArrow(run, "run bigint, head bigint, member bigint").distinct()


def bitmap(shingles: np.ndarray, spread: int = 4) -> np.ndarray:
    """A bit for every shingle, in a width of the power of two from `spread` times the set's size."""
    width = 1 << max(6, (spread * len(shingles) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(shingles % U64(width)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap at a smaller width, as 64-bit words."""
    return np.bitwise_or.reduce(bits.view(U64).reshape(-1, width // 64), axis=0)


def needed(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of these sizes: 100 * i >= percent * (x + y - i)."""
    return -(-percent * (x + y) // (100 + percent))


def may_link(n_a, bits_a, n_b, bits_b, percent: int) -> np.ndarray:
    """Pairs of two lists whose sizes and bitmaps allow the asked overlap, as a matrix.

    A bit that only one set has stands for a shingle that only it has, so that the overlap is at most
    the size less the number of those bits, for either set.
    """
    n_a, n_b = np.asarray(n_a, np.int64)[:, None], np.asarray(n_b, np.int64)[None, :]
    least = needed(n_a, n_b, percent)
    ok = np.minimum(n_a, n_b) >= least
    if not ok.any():
        return ok
    # Partners differ little in size: every width is compared with those near it, never at that of a square's smallest set.
    wide_a, wide_b = np.array([8 * len(x) for x in bits_a]), np.array([8 * len(x) for x in bits_b])
    for u in np.unique(wide_a):
        for v in np.unique(wide_b):
            # A quarter of the width tells most pairs apart, at a quarter of the work.
            for width in sorted({max(min(u, v) // 4, 64), min(u, v)}):
                rows, columns = np.flatnonzero(wide_a == u), np.flatnonzero(wide_b == v)
                some = ok[np.ix_(rows, columns)]
                if not some.any():
                    break
                rows, columns = rows[some.any(axis=1)], columns[some.any(axis=0)]
                a, b = (np.stack([folded(bits[r], width) for r in at]) for bits, at in ((bits_a, rows), (bits_b, columns)))
                set_a, set_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
                for i, r in enumerate(rows):
                    j = np.flatnonzero(ok[r, columns])
                    c = columns[j]
                    both = np.bitwise_count(a[i] & b[j]).sum(axis=1, dtype=np.int64)
                    ok[r, c] = np.minimum(n_a[r] - set_a[i], n_b[0, c] - set_b[j]) + both >= least[r, c]
    return ok


def read_sets(wanted: DataFrame, sets: DataFrame, docs: DataFrame, k: int, clashing: frozenset[int], key_bits: int) -> DataFrame:
    """set_key and shingles (sorted, 8 bytes each) of the sets in `wanted`, read again from one document each."""
    holders = stored(sets.select("set_key", "least").join(wanted.select("set_key").distinct(), "set_key", "left_semi").select("least").distinct(), "holders")
    texts = docs.join(sent_if_small(holders), docs["doc_id"].eqNullSafe(F.col("least")), "left_semi").select("text")

    def read(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            found = [s for s in row_sets(batch.column("text"), k) if len(s)]
            keys = np.array([named(s, clashing, key_bits) for s in found], U64).view(np.int64)
            yield pa.record_batch([pa.array(keys), pa.array([s.tobytes() for s in found], pa.binary())], names=["set_key", "shingles"])

    return texts.mapInArrow(read, "set_key bigint, shingles binary").dropDuplicates(["set_key"])


TILE_ROWS = "run bigint, lo bigint, hi bigint, own bigint, set_key bigint, root bigint, weight bigint"


def tiles_of(table: pa.Table):
    """The rows of the two sides of every tile (run, lo, hi); both sides are the same rows where lo = hi."""
    run, lo, hi, own = (table.column(c).to_numpy() for c in ("run", "lo", "hi", "own"))
    order = np.lexsort((hi, lo, run))
    cuts = np.flatnonzero((np.diff(run[order]) != 0) | (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)) + 1
    for part in np.split(order, cuts):
        x, y = lo[part[0]], hi[part[0]]
        yield (part, part) if x == y else (part[own[part] == x], part[own[part] == y])


def near_pairs(left: np.ndarray, right: np.ndarray, n: np.ndarray, bits: list, root: np.ndarray, percent: int):
    """Pairs of two sides that lie in different components and that sizes and bitmaps allow, in squares of similar size.

    `root` may change between two squares.
    """
    within = left is right
    left = left[np.argsort(n[left], kind="stable")]
    right = left if within else right[np.argsort(n[right], kind="stable")]
    for p in range(0, len(left), SIDE):
        a = left[p : p + SIDE]
        for q in range(p if within else 0, len(right), SIDE):
            b = right[q : q + SIDE]
            if n[a[-1]] * 100 < n[b[0]] * percent:
                break
            if n[b[-1]] * 100 < n[a[0]] * percent:
                continue
            differ = root[a][:, None] != root[b][None, :]
            if within and p == q:
                differ = np.triu(differ, 1)
            if differ.any():
                x, y = np.nonzero(differ & may_link(n[a], [bits[r] for r in a], n[b], [bits[r] for r in b], percent))
                if len(x):
                    yield a[x], b[y]


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of a sorted set with others."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    ends = np.cumsum([len(s) for s in others])
    return np.add.reduceat((one[at] == flat).astype(np.int64), np.r_[0, ends[:-1]])


def takes_part(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of `tiles` that have a partner by size and bitmap, with a `leader`: one set for all that are connected by such pairs.

    No pair leaves its task.
    """

    def run(table: pa.Table) -> pa.Table:
        n, root, key = (table.column(c).to_numpy() for c in ("n", "root", "set_key"))
        bits = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bits")]
        lead = np.arange(len(n))
        some = np.zeros(len(n), bool)
        for left, right in tiles_of(table):
            x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in near_pairs(left, right, n, bits, root, percent):
                # Of a square's pairs only a forest is kept.
                nodes, at = np.unique(np.r_[a, b], return_inverse=True)
                top = forest(at[: len(a)], at[len(a) :], len(nodes))
                x.append(nodes)
                y.append(nodes[top])
            x, y = np.concatenate(x), np.concatenate(y)
            nodes, at = np.unique(np.r_[x, y], return_inverse=True)
            some[nodes] = True
            lead[nodes] = nodes[forest(at[: len(x)], at[len(x) :], len(nodes))]
        return table.drop_columns(["n", "bits"]).append_column("leader", pa.array(key[lead])).filter(pa.array(some))

    return tiles.join(sets.select("set_key", "n", "bits"), "set_key").select(*tiles.columns, "n", "bits").groupBy("group").applyInArrow(run, f"{TILE_ROWS}, group bigint, leader bigint")


def merged(rows: DataFrame, name: str) -> DataFrame:
    """The rows of `takes_part` as tiles of whole groups of possible partners: a set that meets the same others in many tiles is sent once.

    Groups heavier than `WHOLE` blocks stay in the tiles they come from.
    """
    groups = components(rows.select(F.col("set_key").alias("a"), F.col("leader").alias("b")), f"{name}-partners")
    rows = stored(rows.drop("group", "leader").join(groups.select(F.col("node").alias("set_key"), F.col("root").alias("partners")), "set_key"), f"{name}-grouped")
    once = rows.groupBy("partners", "set_key").agg(F.min("root").alias("root"), F.min("weight").alias("weight"))
    light = once.groupBy("partners").agg(F.sum("weight").alias("all")).where(F.col("all") <= WHOLE * BLOCK).select("partners")
    # Tiles of both kinds stay apart even where a run has the number of a group: -2 names no side.
    whole = once.join(light, "partners").withColumn("run", F.col("partners")).withColumns({c: F.lit(-2).cast("bigint") for c in ("lo", "hi", "own")})
    heavy = rows.join(light, "partners", "left_anti")
    columns = [x.split()[0] for x in TILE_ROWS.split(", ")]
    return whole.select(columns).unionByName(heavy.select(columns))


def decided(tiles: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join what is linked within the tiles, decided by the sorted sets: fewer than the tile has rows.

    Pairs that an earlier link of the same group of tiles has joined are skipped.
    """

    def run(table: pa.Table) -> pa.Table:
        key = table.column("set_key").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), U64) for x in table.column("shingles")]
        n = np.array([len(s) for s in sets], np.int64)
        bits = [bitmap(s, 16) for s in sets]
        root = np.unique(table.column("root").to_numpy(), return_inverse=True)[1]
        out_a, out_b = [], []
        for left, right in tiles_of(table):
            for a, b in near_pairs(left, right, n, bits, root, percent):
                for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1):
                    x, rest = a[part[0]], b[part]
                    while len(rest := rest[root[rest] != root[x]]):
                        some, rest = rest[:AT_ONCE], rest[AT_ONCE:]
                        both = overlaps(sets[x], [sets[y] for y in some])
                        for y in some[100 * both >= percent * (n[x] + n[some] - both)]:
                            if root[y] != root[x]:
                                root[root == root[y]] = root[x]
                                out_a.append(key[x])
                                out_b.append(key[y])
        a, b = np.array(out_a, np.int64), np.array(out_b, np.int64)
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return tiles.join(whole, "set_key").select(*tiles.columns, "shingles").groupBy("group").applyInArrow(run, "a bigint, b bigint")


def grouped(tiles: DataFrame, name: str) -> DataFrame:
    """The tiles as a table, dealt to groups of about `BLOCK` in weight."""
    tiles = stored(tiles, name)
    groups = partitions(tiles.sparkSession, tiles.agg(F.sum("weight")).first()[0] or 0, BLOCK)
    return tiles.withColumn("group", F.pmod(F.xxhash64("run", "lo", "hi"), F.lit(groups)).cast("bigint"))


def weight() -> Column:
    """What a set of n shingles counts in a block: longer ones more."""
    return F.expr(f"1 + n DIV {WEIGHT}")


def star_tiles(runs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Tiles of every head (side -1) with the members of all its runs, cut into sides of bounded weight."""
    size = lambda c: sets.select(F.col("set_key").alias(c), F.col("n").alias(f"n_{c}"))
    fits = (F.col("n_head") * percent <= F.col("n_member") * 100) & (F.col("n_member") * percent <= F.col("n_head") * 100)
    pairs = stored(runs.select("head", "member").distinct().join(size("head"), "head").join(size("member"), "member").where(fits), "star-pairs")
    pairs = pairs.withColumn("n", F.col("n_member")).withColumn("weight", weight())
    heads = pairs.groupBy("head").agg(F.first("n_head").alias("n"), F.ceil(F.sum("weight") / BLOCK).cast("bigint").alias("sides"))
    shared = [F.col("head").alias("run"), F.lit(-1).cast("bigint").alias("lo")]
    side = F.pmod(F.xxhash64("member"), "sides").cast("bigint")
    members = pairs.join(heads.select("head", "sides"), "head").select(*shared, side.alias("hi"), side.alias("own"), F.col("member").alias("set_key"), F.col("member").alias("root"), "weight")
    each = heads.withColumn("hi", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("sides") - 1))).withColumn("weight", weight())
    return members.unionByName(each.select(*shared, "hi", F.lit(-1).cast("bigint").alias("own"), F.col("head").alias("set_key"), F.col("head").alias("root"), "weight"))


def cross_tiles(runs: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Tiles of the members of every run that lie in different components so far.

    Runs whose members are all in one component are done, and so are pairs with a run's head. A run of bounded weight is one
    tile. A longer one is cut into sides by size band, by whether a set is in its head's component, and by hash; only
    sides of the same or adjacent bands meet, and those of the head's component don't meet each other.
    """
    root = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    labelled = runs.join(root("head"), "head", "left").join(root("member"), "member", "left").join(sets.select(F.col("set_key").alias("member"), "n"), "member")
    labelled = labelled.select("run", F.col("member").alias("set_key"), "n", F.coalesce("root_head", "head").alias("root_head"), F.coalesce("root_member", "member").alias("root"))
    labelled = labelled.withColumn("weight", weight())
    sizes = labelled.groupBy("run").agg(F.sum("weight").alias("all"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    rows = labelled.join(sizes.select("run", (F.col("all") > BLOCK).alias("long")), "run")
    # A little wider than the ratio of sizes, so that rounding never puts partners two bands apart.
    step = 1.001 * math.log(max(100 / percent, 1.01))
    band = F.when(F.col("long"), F.floor(F.log("n") / step)).otherwise(0).cast("bigint")
    rows = stored(rows.select("run", "set_key", "root", "weight", band.alias("band"), F.when(F.col("long") & (F.col("root") == F.col("root_head")), 1).otherwise(0).alias("main")), "open-runs")
    units = rows.groupBy("run", "band", "main").agg(F.ceil(F.sum("weight") / BLOCK).cast("bigint").alias("sides"))
    others = units.select("run", F.col("band").alias("band_2"), F.col("main").alias("main_2"), F.col("sides").alias("sides_2"))
    meets = units.join(others, "run").where("abs(band - band_2) <= 1 AND main + main_2 < 2")
    named_side = lambda band, main, side: (F.col(band) * 2 + F.col(main)) * F.lit(1 << 32) + side
    rows = rows.join(meets, ["run", "band", "main"]).withColumn("own", named_side("band", "main", F.pmod(F.xxhash64("set_key"), "sides")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("sides_2") - 1))).withColumn("other", named_side("band_2", "main_2", F.col("other")))
    return rows.select("run", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "set_key", "root", "weight")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, key_bits: int = 64) -> DataFrame:
    """Link documents whose sets of word shingles have a Jaccard similarity of at least percent / 100.

    Words are runs of anything but ASCII blanks, A-Z in lower case. A set holds the distinct runs of `k` words;
    with fewer words, the whole sequence as one. Returns one row per input row: doc_id, n_shingles,
    component_id (the smallest doc_id reachable by links, itself included). Texts without words have an empty
    set, no links, and their own doc_id as component. Equal sets link at once; repeated rows come out
    as often as they went in; rows without doc_id take part, but an id is reported where the component has any.
    Empty tables give empty results; other columns are ignored. No link between different sets is lost.

    Equal sets become one: they are told apart by 128 bits, and go by the first 64 unless two different sets share these (of n sets about
    n * n / 2**65 do, so that their list stays short; `key_bits` below 64 is there to test it). Every set sends its necessary prefix, rare
    shingles first, as packed arrays to tiles of shingles; sets that meet there form runs. A run's smallest set is first compared with all
    others (as many pairs as rows), which settles groups of copies; only sets of a run that are then still in different components
    are compared with each other. Both comparisons work on tiles of bounded weight. Sizes and hashed bitmaps, whose bit counts bound the
    overlap from above, leave the rows that have a possible partner. Those connected by possible partners become one tile, if its
    weight allows; to it the sorted sets are sent, once each, and intersected there. What leaves a tile is a forest of links, never the pairs.
    """
    spark = docs.sparkSession
    docs = taken(docs, doc_id=id_col, text=text_col)
    keyed = stored(keyed_rows(docs, k, key_bits), "sets")
    rows = keyed.where("token IS NULL").select("doc_id", "n", "set_key", "second", "bits")
    frequent = keyed.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(FREQUENT).select("token").toPandas()
    frequent = frequent["token"].to_numpy(np.int64)[::-1].copy().view(U64)
    sets = stored(distinct_sets(rows), "distinct-sets")
    shared = [r[0] for r in sets.where("mixed").select("set_key").collect()]
    if shared:
        rows = rows.withColumn("set_key", F.when(F.col("set_key").isin(shared), F.col("second")).otherwise(F.col("set_key")))
        sets = stored(distinct_sets(rows), "distinct-sets")
        if not sets.where("mixed").isEmpty():
            raise RuntimeError("different sets share both numbers")
    clashing = frozenset(x % (1 << 64) for x in shared)
    total = rows.agg(F.sum("n")).first()[0] or 0
    tiles = 4 * partitions(spark, math.ceil(total * (100 - percent) / 100), 4 * TILE)
    runs = stored(shared_runs(prefix_tiles(docs, k, percent, tiles, frequent, clashing, key_bits)), "runs")

    def links(tiles: DataFrame, name: str) -> DataFrame:
        left = stored(takes_part(grouped(tiles, f"{name}-tiles"), sets, percent), f"{name}-rows")
        left = grouped(merged(left, name), f"{name}-merged")
        return stored(decided(left, read_sets(left, sets, docs, k, clashing, key_bits), percent), f"{name}-links")

    star = links(star_tiles(runs, sets, percent), "star")
    found = components(star, "star")
    more = links(cross_tiles(runs, sets, found, percent), "cross")
    if not more.isEmpty():
        found = components(star.unionByName(more), "sets-linked")

    rooted = sets.select("set_key", "least").join(found.select(F.col("node").alias("set_key"), "root"), "set_key", "left").select("set_key", "least", F.coalesce("root", "set_key").alias("root"))
    rooted = stored(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    label = rooted.select("set_key", "root").join(least, "root").select("set_key", "component_id")
    return rows.join(label, "set_key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of `docs` per component, with all its columns: the one with the smallest doc_id, rows without one last.

    Rows are told apart by doc_id and two hashes of the text, so that rows of one doc_id are judged each by its own text. Rows that
    share both are exact repeats, of which one stays (by a hash of its columns). Texts without words link to nothing: all their rows stay.
    """
    id_, text = docs[f"`{id_col}`"], docs[f"`{text_col}`"]
    own, again, nth = unused(docs, "own_key", "again_key", "nth_row")
    key = F.struct(id_.isNull().alias("last"), id_.alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    keyed = docs.withColumn(own, key)
    # A table of its own: it is read twice.
    joined = stored(jaccard_join(keyed, id_col=own, text_col=text_col, **options), "row-components")
    gone = joined.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias(again)).distinct()
    same = F.col(own).eqNullSafe(F.col(again))
    left = keyed.join(gone, same, "left_anti")
    stands = joined.where((F.col("n_shingles") > 0) & F.col("component_id").eqNullSafe(F.col("doc_id")))
    repeats = stored(stands.groupBy(F.col("doc_id").alias(again)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(again), "repeated-rows")
    if repeats.isEmpty():
        return left.drop(own)
    order = F.row_number().over(W.partitionBy(own).orderBy(F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns])))
    one = left.join(repeats, same, "left_semi").withColumn(nth, order).where(F.col(nth) == 1).drop(nth)
    return left.join(repeats, same, "left_anti").unionByName(one).drop(own)


SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
    SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS s FROM w WHERE len(w) > 0
), shingles AS (
    SELECT DISTINCT doc_id, md5(array_to_string(w[s + 1 : s + 5], ' ')) AS h FROM starts
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)
), reach(a, b) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id
FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""
