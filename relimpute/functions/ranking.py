"""Ranks and quantiles that never pass a whole group through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relimpute.session import cut_lineage


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first `k` rows of every group.

    The rank filter sits directly on the window, so Spark keeps `k` rows per group and task
    before the exchange; a hot group reaches its reducer already cut down.
    """
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def hash_first_n(df: DataFrame, by: Sequence[str], hashed: str, n: Column) -> DataFrame:
    """The `n` rows with the lowest hash in every group, for any `n` up to the group size.

    Hashes are uniform, so counts per four-digit prefix find the one prefix the cut falls in:
    rows above it are dropped where they are read, and ranks are taken inside single prefixes. `n`
    may use the columns `by` and `rows` (the group size). Groups are attributes, so few.
    """
    by = list(by)
    prefixed = df.withColumn("_prefix", F.substring(hashed, 1, 4))
    counts = prefixed.groupBy(*by, "_prefix").agg(F.count(F.lit(1)).alias("_c"))
    sizes = counts.groupBy(*by).agg(F.sum("_c").alias("rows")).withColumn("_n", n.cast("bigint"))
    running = F.sum("_c").over(W.partitionBy(*by).orderBy("_prefix"))
    # at most 65,536 prefixes per group enter this window
    upto = counts.withColumn("_upto", running)
    cut = _join_on(upto, sizes, by).groupBy(*by).agg(
        F.first("_n").alias("_n"),
        F.coalesce(F.min(F.when(F.col("_upto") >= F.col("_n"), F.col("_prefix"))), F.lit("g")).alias("_cut"),
        F.coalesce(F.max(F.when(F.col("_upto") < F.col("_n"), F.col("_upto"))), F.lit(0)).alias("_below"),
    )
    near = _join_on(prefixed, cut, by).where(F.col("_prefix") <= F.col("_cut"))
    keys = [F.col(hashed)] + [F.col(c) for c in df.columns if c != hashed and c not in by and _orderable(df, c)]
    near = near.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_prefix").orderBy(*keys)))
    kept = (F.col("_prefix") < F.col("_cut")) | (F.col("_r") <= F.col("_n") - F.col("_below"))
    return near.where(kept).select(df.columns)


def _orderable(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() not in ("map", "variant")


def _join_on(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Equi-join with a table of one or a few rows per group; no groups at all means one group.

    Groups here are attributes, methods and measures, names that come from a schema, so `right`
    is broadcast: a shuffle by group would put most of `left` on one task.
    """
    if by:
        return left.join(F.broadcast(right), by)
    return left.withColumn("_one", F.lit(1)).join(F.broadcast(right.withColumn("_one", F.lit(1))), "_one").drop("_one")


def positions(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Exact 1-based position of every row in the global order, without a single-task sort.

    One range exchange sorts the rows over many tasks; the sorted rows are written once, so their
    partition numbers stay fixed; offsets come from one count per partition.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut_lineage(rows.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(F.col("_id"), 33)
    within = F.col("_id").bitwiseAND(F.lit(2**33 - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # one row per partition of the sort
    before = F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).select("_part", "_before")
    numbered = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_before") + within + 1).drop("_part", "_before", "_id")


def hashed_ids(df: DataFrame, key: Sequence[str], name: str = "id") -> DataFrame:
    """Dense 0-based ids over distinct rows, ordered by the md5 of `key`.

    Ranks are taken inside each of 65,536 hash prefixes, so no task sorts more than its share.
    """
    hashed = df.withColumn("_h", F.md5(F.to_json(F.array(*[F.col(c).cast("string") for c in key]))))
    hashed = hashed.withColumn("_prefix", F.substring("_h", 1, 4))
    sizes = hashed.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(W.orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_size")
    within = F.row_number().over(W.partitionBy("_prefix").orderBy("_h", *key))
    numbered = hashed.withColumn("_within", within).join(F.broadcast(offsets), "_prefix")
    return numbered.withColumn(name, F.col("_before") + F.col("_within") - 1).drop("_h", "_prefix", "_within", "_before")


#: Bits of a digit of the radix selection: a group has at most 65,536 counts per pass.
DIGIT = 16


def ordered_bits(number: Column) -> Column:
    """A double as a bigint of the same order: its IEEE bits, negated for negative numbers; both zeros are 0, NaN is last.

    Exponent and fraction come from scaling by powers of two, which is exact.
    """
    size = F.abs(number)
    guess = F.floor(F.log2(size))
    exponent = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess)
    exponent = F.greatest(exponent, F.lit(-1022))
    fraction = size / F.pow(F.lit(2.0), exponent)
    bits = (exponent + 1022) * F.lit(2**52) + (fraction * float(2**52)).cast("bigint")
    bits = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(2047 * 2**52)).otherwise(bits).cast("bigint")
    return F.when(F.isnan(number), F.lit(2**63 - 1)).when(number < 0, -bits).otherwise(bits)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], derived: bool = True, times: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles as rows (`by`, p, n, quantile), exact at any group size.

    Groups are attributes, methods or measures, so few however large each is.

    Radix selection over the bits of the values: a pass counts the next 16 bits of what still may hold the wanted
    ranks, combined map-side, and keeps one digit per rank. Four passes read the counted distinct values, which
    are written once; no window sees more than 65,536 counts of a group and rank, whatever the values are.
    `derived` is kept for callers that say whether the values are a scan or the result of joins; both are read once.
    With `times` a row counts as often as that column says.
    """
    by = list(by)
    data = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), (F.col(times) if times else F.lit(1)).alias("_n"))
    counts = data.groupBy(*by, "_v").agg(F.sum("_n").alias("_c"))
    counts = cut_lineage(counts.select(*by, "_v", "_c", ordered_bits(F.col("_v")).alias("_o")))
    shift = 64 - DIGIT
    first = counts.groupBy(*by, F.shiftright("_o", shift).alias("_at")).agg(F.sum("_c").alias("_c"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    upto = F.sum("_c").over(group.orderBy("_at"))
    first = first.select(*by, "_at", "_c", upto.alias("_upto"), F.sum("_c").over(group).alias("n"))
    ranks = []
    for p in probs:
        place = (F.col("n") - 1) * F.lit(float(p))
        ranks += [F.struct(F.lit(float(p)).alias("p"), F.lit(side).alias("side"), (end(place) + 1).cast("bigint").alias("rank")) for side, end in ((0, F.floor), (1, F.ceil))]
    inside = (F.col("rank") > F.col("_upto") - F.col("_c")) & (F.col("rank") <= F.col("_upto"))
    found = first.select(*by, "n", "_at", "_c", "_upto", F.explode(F.array(*ranks)).alias("_r")).select(*by, "n", "_at", "_c", "_upto", "_r.*").where(inside)
    key = [*by, "n", "p", "side"]
    found = found.select(*key, F.col("_at").alias("_pre"), (F.col("rank") - F.col("_upto") + F.col("_c")).alias("rank"))
    while shift:
        # a row per group, quantile and side
        picked = found.select(*[F.col(c).alias(f"_g_{c}") for c in by], "n", "p", "side", "_pre", "rank")
        same = F.shiftright("_o", shift) == F.col("_pre")
        for c in by:
            same = same & (F.col(c) == F.col(f"_g_{c}"))
        shift -= DIGIT
        left = counts.join(F.broadcast(picked), same)
        digits = left.groupBy(*key, "rank", F.shiftright("_o", shift).alias("_at")).agg(F.sum("_c").alias("_c"), F.max("_v").alias("_v"))
        digits = digits.withColumn("_upto", F.sum("_c").over(W.partitionBy(*key).orderBy("_at"))).where(inside)
        found = digits.select(*key, F.col("_at").alias("_pre"), (F.col("rank") - F.col("_upto") + F.col("_c")).alias("rank"), "_v")
    ends = found.groupBy(*by, "n", "p").agg(*[F.max(F.when(F.col("side") == side, F.col("_v"))).alias(name) for side, name in ((0, "_x"), (1, "_y"))])
    place = (F.col("n") - 1) * F.col("p")
    share = place - F.floor(place)
    return ends.select(*by, "p", "n", F.when(share == 0, F.col("_x")).otherwise(F.col("_x") + (F.col("_y") - F.col("_x")) * share).alias("quantile"))


def quantile_columns(df: DataFrame, by: Sequence[str], value: str, named: dict[str, float], derived: bool = True) -> DataFrame:
    """`exact_quantiles` with one column per name."""
    by = list(by)
    rows = exact_quantiles(df, by, value, list(dict.fromkeys(named.values())), derived)
    picks = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("quantile"))).alias(name) for name, p in named.items()]
    return rows.groupBy(*by).agg(*picks)
