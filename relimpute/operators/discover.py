"""Joinable-column discovery: which columns share their values.

All set sizes and intersections come from one exchange on the value: each value is reduced to
the set of columns that hold it (a bit per column, combined map-side), equal sets are
counted, and column pairs are formed from the few distinct sets instead of from the values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relimpute.functions.ranking import top_k
from relimpute.functions.text import is_value, short_key, texts
from relimpute.session import cut_lineage
from relimpute.sources.catalog import Catalog

PERMUTATIONS = 128
#: Bits of a value's hash, and those left when signature entries are added up.
HASH_DIGITS, SUMMED_BITS = 15, 40
#: Theta sketches keep up to 2 ** this hashes of a column, 8 bytes each.
THETA_LOG = 12
ROWS_PER_BAND = (8, 4, 2, 1)
#: Columns told apart by one whole number.
MASK_BITS = 63
RECALL = 0.95
INDEX_SCHEMA = "t1 string, c1 string, t2 string, c2 string, score double"


@dataclass(frozen=True)
class ColumnRef:
    id: int
    table: str
    col: str
    is_key: bool


def column_refs(catalog: Catalog, tables: Sequence[str] | None = None) -> list[ColumnRef]:
    """Number the columns of the tables; list- and struct-typed columns hold no cell values."""
    refs = []
    for name in tables or catalog.names:
        keys = catalog.key_columns(name)
        for f in catalog.table(name).schema.fields:
            if is_value(f.dataType):
                refs.append(ColumnRef(len(refs), name, f.name, f.name in keys))
    return refs


def refs_table(catalog: Catalog, refs: list[ColumnRef]) -> DataFrame:
    rows = [(r.id, r.table, r.col, r.is_key) for r in refs]
    return catalog.spark.createDataFrame(rows, "id int, table string, col string, is_key boolean")


def cell_values(catalog: Catalog, refs: list[ColumnRef]) -> DataFrame:
    """(id, value) of every non-null cell; long text is met by its digest."""
    parts = None
    for name in dict.fromkeys(r.table for r in refs):
        own = {r.col: str(r.id) for r in refs if r.table == name}
        wide = texts(catalog.table(name), list(own)).toDF(*own.values())
        long = wide.unpivot([], list(own.values()), "id", "value").where(F.col("value").isNotNull())
        part = long.select(F.col("id").cast("int").alias("id"), short_key(F.col("value")).alias("value"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def column_values(catalog: Catalog, tables: Sequence[str] | None = None) -> DataFrame:
    """Distinct (table, col, value)."""
    parts = None
    for name in tables or catalog.names:
        columns = [r.col for r in column_refs(catalog, [name])]
        long = texts(catalog.table(name), columns).unpivot([], columns, "col", "value")
        part = long.where(F.col("value").isNotNull()).distinct().select(F.lit(name).alias("table"), "col", "value")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def overlaps(catalog: Catalog, refs: list[ColumnRef]) -> DataFrame:
    """(a, b, common, na, nb) for every pair of columns with a common value, a = b included.

    The set of columns that hold a value is a bit per column, so it is added up in place and takes no list per value.
    """
    words = [f"_w{w}" for w in range(max(r.id for r in refs) // MASK_BITS + 1)]
    masks = [
        F.bit_or(F.expr(f"CASE WHEN id BETWEEN {w * MASK_BITS} AND {w * MASK_BITS + MASK_BITS - 1} THEN shiftleft(1L, id - {w * MASK_BITS}) ELSE 0L END")).alias(name)
        for w, name in enumerate(words)
    ]
    sets = cell_values(catalog, refs).groupBy("value").agg(*masks).groupBy(*words).agg(F.count(F.lit(1)).alias("n"))
    held = [F.when(F.getbit(words[r.id // MASK_BITS], F.lit(r.id % MASK_BITS)) == 1, F.lit(r.id)) for r in refs]
    sets = sets.select(F.array_compact(F.array(*held)).alias("owners"), "n")
    pairs = sets.select(F.explode("owners").alias("a"), "owners", "n").select("a", F.explode("owners").alias("b"), "n")
    common = pairs.groupBy("a", "b").agg(F.sum("n").alias("common"))
    size = F.when(F.col("a") == F.col("b"), F.col("common"))
    # at most one row per column enters either window
    return common.withColumn("na", F.max(size).over(W.partitionBy("a"))).withColumn(
        "nb", F.max(size).over(W.partitionBy("b"))
    )


def named_overlaps(catalog: Catalog, refs: list[ColumnRef]) -> DataFrame:
    """`overlaps` of columns of different tables, by name."""
    names = refs_table(catalog, refs)
    one = names.select(F.col("id").alias("a"), F.col("table").alias("t1"), F.col("col").alias("c1"), F.col("is_key").alias("k1"))
    two = names.select(F.col("id").alias("b"), F.col("table").alias("t2"), F.col("col").alias("c2"), F.col("is_key").alias("k2"))
    # one row per column on the broadcast sides
    joined = overlaps(catalog, refs).join(F.broadcast(one), "a").join(F.broadcast(two), "b")
    return joined.where(F.col("t1") != F.col("t2"))


def containment_index(catalog: Catalog, tables: Sequence[str] | None = None, refs: list[ColumnRef] | None = None) -> DataFrame:
    """Share of the values of a non-key column found in a column of another table (exact)."""
    refs = refs or column_refs(catalog, tables)
    found = named_overlaps(catalog, refs).where(~F.col("k1"))
    return found.select("t1", "c1", "t2", "c2", (F.col("common") / F.col("na")).alias("score"))


def all_pairs_index(catalog: Catalog, tables: Sequence[str] | None = None) -> DataFrame:
    """Containment of every pair of non-key columns of two tables, zero scores included."""
    refs = column_refs(catalog, tables)
    own = [r for r in refs if not r.is_key]
    pairs = [(p.table, p.col, q.table, q.col) for p in own for q in own if p.table < q.table]
    listed = catalog.spark.createDataFrame(pairs, "t1 string, c1 string, t2 string, c2 string")
    found = containment_index(catalog, refs=own)
    return listed.join(found, ["t1", "c1", "t2", "c2"], "left").select(
        "t1", "c1", "t2", "c2", F.coalesce("score", F.lit(0.0)).alias("score")
    )


def value_hash(value: Column) -> Column:
    """60 bits of the value's md5, the same on every engine."""
    return F.conv(F.substring(F.md5(value), 1, HASH_DIGITS), 16, 10).cast("bigint")


def hash_mask(i: int) -> int:
    return int(md5(str(i).encode()).hexdigest()[:HASH_DIGITS], 16)


def minhash(catalog: Catalog, tables: Sequence[str] | None = None, permutations: int = PERMUTATIONS, sketch: bool = False) -> DataFrame:
    """(id, n, signature) per column, and on request its theta sketch. Only per-task minima and sketches are exchanged, never values.

    A value is hashed once. An entry of the signature is the least hash after a mask has flipped some of its bits: of the values
    of two columns each is as likely as any other to have it, so that entries agree with the probability of the Jaccard
    similarity. `n` estimates the number of values from how close the entries come to zero (by about a tenth); it steers the choice of bands only.
    """
    values = cell_values(catalog, column_refs(catalog, tables)).select("id", value_hash(F.col("value")).alias("h"))
    lows = F.array(*[F.min(F.col("h").bitwiseXOR(F.lit(hash_mask(i)))) for i in range(permutations)])
    more = [F.theta_sketch_agg("h", THETA_LOG).alias("sketch")] if sketch else []
    kept = values.groupBy("id").agg(lows.alias("signature"), *more)
    near = F.aggregate("signature", F.lit(0).cast("bigint"), lambda acc, x: acc + F.shiftright(x, 4 * HASH_DIGITS - SUMMED_BITS))
    n = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit((1 << SUMMED_BITS) * permutations) / F.greatest(near, F.lit(1).cast("bigint"))) - 1)
    return kept.select("id", n.cast("bigint").alias("n"), "signature", *[c for c in kept.columns if c == "sketch"])


def band_keys(r: int) -> Column:
    """One number per band of `r` entries of the signature."""
    return F.transform(F.sequence(F.lit(0), F.lit(PERMUTATIONS // r - 1)), lambda i: F.xxhash64(F.slice("signature", i * r + 1, r)))


def lsh_candidates(
    catalog: Catalog, tables: Sequence[str] | None = None, threshold: float = 0.3, partitions: int = 32, signatures: DataFrame | None = None
) -> DataFrame:
    """Candidate pairs (a, b): columns that agree on a band in a size partition of the index.

    Within a partition of columns no larger than `u`, a containment of `t` of a query of size `q`
    means a Jaccard similarity of at least t / (1 + u/q - t); the widest band that still finds such a
    pair with the wanted probability is used. All inputs here have one row per column.
    """
    # written once: one row per column, read by every step below
    signatures = cut_lineage(minhash(catalog, tables)) if signatures is None else signatures
    names = refs_table(catalog, column_refs(catalog, tables)).select("id", "table", "col")
    banded = None
    for r in ROWS_PER_BAND:
        part = signatures.select("id", F.lit(r).alias("r"), F.posexplode(band_keys(r)).alias("band", "h"))
        banded = part if banded is None else banded.unionByName(part)
    sized = signatures.join(F.broadcast(names), "id").select("id", "n", F.ntile(partitions).over(W.orderBy("n", "table", "col")).alias("part"))
    uppers = sized.groupBy("part").agg(F.max("n").alias("u"))
    queries = signatures.select(F.col("id").alias("a"), F.col("n").alias("q"))
    queries = queries.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(partitions)))).join(uppers, "part")
    similarity = F.least(F.lit(1.0), threshold / (1 + F.col("u") / F.col("q") - threshold))
    rows = F.lit(1)
    for r in sorted(ROWS_PER_BAND):
        found = 1 - F.pow(1 - F.pow(similarity, F.lit(r)), F.lit(PERMUTATIONS // r))
        rows = F.when(found >= RECALL, r).otherwise(rows)
    queries = queries.withColumn("r", rows)
    asked = queries.join(banded.select(F.col("id").alias("a"), "r", "band", "h"), ["a", "r"])
    held = banded.join(sized.select("id", "part"), "id").select(F.col("id").alias("b"), "part", "r", "band", "h")
    hits = asked.join(held, ["part", "r", "band", "h"]).where(F.col("a") != F.col("b"))
    return hits.select("a", "b").distinct()


def lsh_index(
    catalog: Catalog, tables: Sequence[str] | None = None, threshold: float = 0.3, partitions: int = 32
) -> DataFrame:
    """The exact index restricted to LSH candidates; values of columns in no pair are not read.

    The candidate pairs, two column ids each, are schema-sized and steer the second pass.
    """
    refs = column_refs(catalog, tables)
    by_id = {r.id: r for r in refs}
    pairs = [
        (by_id[p["a"]], by_id[p["b"]]) for p in lsh_candidates(catalog, tables, threshold, partitions).collect()
    ]
    pairs = [(p, q) for p, q in pairs if p.table != q.table and not p.is_key]
    if not pairs:
        return catalog.spark.createDataFrame([], INDEX_SCHEMA)
    used = {r.id for pair in pairs for r in pair}
    listed = catalog.spark.createDataFrame(
        [(p.table, p.col, q.table, q.col) for p, q in pairs], "t1 string, c1 string, t2 string, c2 string"
    )
    exact = containment_index(catalog, refs=[r for r in refs if r.id in used])
    return exact.join(listed, ["t1", "c1", "t2", "c2"], "left_semi")


def sketched_index(
    catalog: Catalog, tables: Sequence[str] | None = None, threshold: float = 0.3, partitions: int = 32
) -> DataFrame:
    """Estimated containment of the LSH candidates, with `error`; the values are read once and none is exchanged.

    Theta sketches of two columns intersect and unite. Both columns below 2 ** THETA_LOG values give the exact score and no error;
    else `error` is two standard errors of the estimated intersection and of the estimated size.
    """
    # one row per column
    signatures = cut_lineage(minhash(catalog, tables, sketch=True))
    pairs = lsh_candidates(catalog, tables, threshold, partitions, signatures)
    side = lambda c, sketch: signatures.select(F.col("id").alias(c), F.col("sketch").alias(sketch))
    names = refs_table(catalog, column_refs(catalog, tables))
    one = names.select(F.col("id").alias("a"), F.col("table").alias("t1"), F.col("col").alias("c1"), F.col("is_key").alias("k1"))
    two = names.select(F.col("id").alias("b"), F.col("table").alias("t2"), F.col("col").alias("c2"))
    met = pairs.join(F.broadcast(one), "a").join(F.broadcast(two), "b").where((F.col("t1") != F.col("t2")) & ~F.col("k1"))
    met = met.join(side("a", "x"), "a").join(side("b", "y"), "b")
    met = met.select(
        "t1", "c1", "t2", "c2",
        F.theta_sketch_estimate("x").alias("size"),
        F.theta_sketch_estimate(F.theta_union("x", "y", THETA_LOG)).alias("union"),
        F.theta_sketch_estimate(F.theta_intersection("x", "y")).alias("common"),
    )
    k = 2.0**THETA_LOG
    share = F.col("common") / F.col("union")
    spread = F.col("union") * F.sqrt(F.greatest(share * (1 - share), F.lit(1 / k)) / k) / F.col("size")
    score = F.least(F.lit(1.0), F.col("common") / F.col("size"))
    error = F.when(F.col("union") < k, 0.0).otherwise(2 * (spread + score / math.sqrt(k)))
    return met.where("common > 0").select("t1", "c1", "t2", "c2", score.alias("score"), error.alias("error"))


def compatible_columns(index: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs above the threshold, registered for both tables with the better score of the two."""
    kept = index.where(F.col("score") > threshold)
    forward = kept.withColumn("direction", F.lit("forward"))
    backward = kept.select(
        F.col("t2").alias("t1"), F.col("c2").alias("c1"), F.col("t1").alias("t2"), F.col("c1").alias("c2"), "score"
    ).withColumn("direction", F.lit("backward"))
    both = forward.unionByName(backward)
    best = F.max(F.struct("score", "direction"))
    return both.groupBy("t1", "c1", "t2", "c2").agg(best.alias("_b")).select("t1", "c1", "t2", "c2", "_b.score", "_b.direction")


def joinable_topk(index: DataFrame, k: int) -> DataFrame:
    return top_k(index, ["t1", "c1"], [F.desc("score"), F.col("t2"), F.col("c2")], k)


def jaccard_index(catalog: Catalog, tables: Sequence[str] | None = None) -> DataFrame:
    """Jaccard similarity of non-key columns of different tables, pairs with a common value."""
    found = named_overlaps(catalog, [r for r in column_refs(catalog, tables) if not r.is_key])
    score = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    return found.select("t1", "c1", "t2", "c2", score.alias("score"))


def jaccard(n1: int, n2: int, common: int) -> float:
    """Two empty sets are equal."""
    union = n1 + n2 - common
    return common / union if union else 1.0


def valid_query_columns(index: DataFrame, table: str, threshold: float = 0.8) -> DataFrame:
    """Descriptors of the query table with a near-equal column elsewhere."""
    hits = index.where((F.col("t1") == table) & (F.col("score") > threshold))
    return hits.groupBy(F.col("c1").alias("col")).agg(F.max("score").alias("score"))


def related_columns(compatible: DataFrame, table: str) -> DataFrame:
    """(attr, tables): per attribute of the query table a map related table -> best column."""
    own = compatible.where(F.col("t1") == table)
    best = own.groupBy(F.col("c1").alias("attr"), "t2").agg(F.min_by("c2", F.struct(-F.col("score"), F.col("c2"))).alias("c2"))
    return best.groupBy("attr").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("t2", "c2")))).alias("tables"))
