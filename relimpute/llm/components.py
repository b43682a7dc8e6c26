"""Connected components of a link table."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relimpute.llm.tables import stored

#: Links that one task reduces to a forest: 16 bytes each.
TOGETHER = 1 << 20


def forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one reachable by the links x-y."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == before).all():
            return label


def reduced(edges: DataFrame) -> DataFrame:
    """The links of each partition as a forest of the same components: every node with the smallest one."""

    def run(batches):
        tables = list(batches)
        if not tables:
            return
        a, b = (np.concatenate([t.column(c).to_numpy() for t in tables]) for c in ("a", "b"))
        nodes, at = np.unique(np.r_[a, b], return_inverse=True)
        root = forest(at[: len(a)], at[len(a) :], len(nodes))
        under = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.record_batch([pa.array(nodes[under]), pa.array(nodes[root[under]])], names=["a", "b"])

    return edges.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, name: str = "links", max_rounds: int = 64) -> DataFrame:
    """node and root (the smallest node of its component) for every node of `edges` (a, b: one bigint each).

    First every partition of up to about a million links becomes a forest where it lies, in memory of that bound. If there are
    several, large-star and small-star rounds follow: every round hangs each node's neighbours under the smallest
    node near it, and the number of rounds grows with the logarithm of the longest path. Minima are
    combined before the exchange; the joins are plain equi-joins on a node, so that Spark can split a
    hub. Every round is a written table. Loops and repeated links do no harm; no links give no rows.
    """
    tree = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), name)
    parts = max(1, math.ceil(tree.count() / TOGETHER))
    tree = stored(reduced(tree.coalesce(parts)), name)
    before = None
    for _ in range(max_rounds if parts > 1 else 0):
        both = tree.unionByName(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Rows of `large` point down already: a > b.
        large = stored(large.where("a <> b").distinct(), name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        tree = stored(small.where("a <> b").distinct(), name)
        now = tree.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        if parts > 1:
            raise RuntimeError(f"{name}: links are not settled after {max_rounds} rounds")
    return tree.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(tree.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
