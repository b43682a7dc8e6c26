"""Connected groups of rows by contraction: the rounds grow with the logarithm of the longest chain, the links shrink from round to round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relimpute.session import cut_lineage


def _pairs(links: DataFrame, a: Column, b: Column) -> DataFrame:
    """Distinct links without direction and loops."""
    ends = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return ends.where("a <> b").distinct()


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of `links` (a, b: strings) one node of its connected group, the same for all of it.

    Each round every node follows the one with the lowest hash among itself and its neighbours, and links are
    drawn between the followed ones. Hashes differ by round, so a chain or a star loses a constant share of its
    nodes whatever their order. Lowest hashes are combined before the exchange; a hub is a key of plain
    equi-joins with one row per node on the other side, which the adaptive skew join splits. Every round is
    written once; the answers compose the rounds, of which the later ones are small.
    """
    links = cut_lineage(_pairs(links, F.col("a"), F.col("b")))
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("root"))
    rounds = []
    while not links.isEmpty():
        if len(rounds) == max_rounds:
            raise RuntimeError("groups did not settle; raise max_rounds")
        number = F.lit(len(rounds))
        both = links.union(links.select("b", "a"))
        lowest = F.min(F.struct(F.xxhash64(number, "b").alias("h"), F.col("b").alias("at")))
        own = F.struct(F.xxhash64(number, "a").alias("h"), F.col("a").alias("at"))
        followed = both.groupBy("a").agg(lowest.alias("low")).select(F.col("a").alias("node"), F.least("low", own)["at"].alias("to"))
        followed = cut_lineage(followed)
        rounds.append(followed.where("node <> to"))
        left = links.join(followed.withColumnRenamed("to", "ta"), F.col("a") == F.col("node")).drop("node")
        both_ends = left.join(followed.withColumnRenamed("to", "tb"), F.col("b") == F.col("node"))
        links = cut_lineage(_pairs(both_ends, F.col("ta"), F.col("tb")))
    for step in rounds:
        moved = step.select(F.col("node").alias("root"), "to")
        nodes = nodes.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return nodes


def reached(links: DataFrame, start: DataFrame) -> DataFrame:
    """(node) of all nodes connected to those of `start` (node), themselves included though they have no link."""
    groups = cut_lineage(connected(links))
    hit = groups.join(start.select("node"), "node", "left_semi").select("root").distinct()
    return groups.join(hit, "root", "left_semi").select("node").union(start.select("node")).distinct()
