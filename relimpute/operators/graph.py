"""Meta-paths: bounded simple paths over the key graph."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relimpute.session import cut_lineage
from relimpute.sources.catalog import Catalog


@dataclass(frozen=True)
class Edge:
    src_table: str
    src_col: str
    dst_col: str
    dst_table: str
    unique: bool = False  # at most one dst row per src row


@dataclass(frozen=True)
class MetaPath:
    """A chain of key joins from the query table."""

    edges: tuple[Edge, ...]

    @property
    def label(self) -> str:
        hops = "".join(f">({e.src_col},{e.dst_col})>{e.dst_table}" for e in self.edges)
        return self.edges[0].src_table + hops

    @property
    def path_id(self) -> str:
        return md5(self.label.encode()).hexdigest()[:8]

    @property
    def goal(self) -> str:
        return self.edges[-1].dst_table

    @property
    def single_valued(self) -> bool:
        """One candidate per query row at most, since every hop goes to a key."""
        return all(e.unique for e in self.edges)


def both_ways(edges: DataFrame) -> DataFrame:
    """Every foreign key forwards (fk to pk) and backwards, as a multigraph."""
    back = edges.select(
        F.col("dst_table").alias("src_table"), F.col("dst_col").alias("src_col"),
        F.col("src_table").alias("dst_table"), F.col("src_col").alias("dst_col"),
    )
    forward = edges.select("src_table", "src_col", "dst_table", "dst_col").withColumn("forward", F.lit(True))
    return forward.unionByName(back.withColumn("forward", F.lit(False)))


def path_id(label: Column) -> Column:
    return F.substring(F.md5(label), 1, 8)


def enumerate_paths(edges: DataFrame, start: str, max_hops: int = 10, per_goal: int = 3) -> DataFrame:
    """(goal, path_id, label, hops, edges): the `per_goal` shortest simple paths to every table.

    Breadth first, one equi-join with the edges per level. The search stops as soon as every
    table that can be reached has its paths, which keeps dense key graphs from being walked to
    full depth.
    """
    steps = cut_lineage(both_ways(edges))
    # one row per key of the schema
    steps = F.broadcast(steps)
    goals = steps.select("dst_table").where(F.col("dst_table") != start).distinct().count()
    frontier = edges.sparkSession.createDataFrame([(start,)], "at string").select(
        "at", F.array("at").alias("seen"), F.col("at").alias("label"),
        F.array().cast("array<struct<src_table:string,src_col:string,dst_col:string,dst_table:string,forward:boolean>>").alias("edges"),
    )
    levels = None
    for level in range(max_hops):
        grown = frontier.join(steps, F.col("at") == F.col("src_table")).where(~F.array_contains("seen", F.col("dst_table")))
        hop = F.struct("src_table", "src_col", "dst_col", "dst_table", "forward")
        frontier = cut_lineage(
            grown.select(
                F.col("dst_table").alias("at"),
                F.concat("seen", F.array("dst_table")).alias("seen"),
                F.concat("label", F.lit(">("), "src_col", F.lit(","), "dst_col", F.lit(")>"), "dst_table").alias("label"),
                F.concat("edges", F.array(hop)).alias("edges"),
            )
        )
        levels = frontier if levels is None else levels.unionByName(frontier)
        per_table = levels.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("edges")).alias("deepest"))
        state = per_table.agg(F.count_if(F.col("n") >= per_goal).alias("done"), F.max("deepest").alias("deepest")).first()
        if state["done"] == goals or (state["deepest"] or 0) <= level:
            break
    found = levels.select(F.col("at").alias("goal"), path_id(F.col("label")).alias("path_id"), "label", F.size("edges").alias("hops"), "edges")
    ranked = found.withColumn("_r", F.row_number().over(W.partitionBy("goal").orderBy("hops", "label")))
    return ranked.where(F.col("_r") <= per_goal).drop("_r")


def paths_by_attribute(
    compatible: DataFrame, paths: DataFrame, table: str, attributes: list[str], limit: int = 10
) -> DataFrame:
    """(attr, path_id, label, hops, edges): shortest paths to the tables that share an attribute's values."""
    goals = compatible.where((F.col("t1") == table) & (F.col("t2") != table) & F.col("c1").isin(*attributes))
    goals = goals.select(F.col("c1").alias("attr"), F.col("t2").alias("goal")).distinct()
    joined = goals.join(paths, "goal").select("attr", "path_id", "label", "hops", "edges").dropDuplicates(["attr", "path_id"])
    ranked = joined.withColumn("_r", F.row_number().over(W.partitionBy("attr").orderBy("hops", "label")))
    return ranked.where(F.col("_r") <= limit).drop("_r")


def fallback_tables(
    compatible: DataFrame, by_attribute: DataFrame, table: str, attributes: list[str], limit: int = 10
) -> DataFrame:
    """(attr, related, n, rank): for attributes without a path, related tables by match frequency."""
    own = compatible.where((F.col("t1") == table) & (F.col("t2") != table) & F.col("c1").isin(*attributes))
    own = own.withColumnRenamed("c1", "attr")
    left = own.join(by_attribute.select("attr").distinct(), "attr", "left_anti")
    counted = left.groupBy("attr", F.col("t2").alias("related")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("attr").orderBy(F.desc("n"), "related"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= limit)


def collect_paths(paths: DataFrame) -> list[MetaPath]:
    """Chosen paths as plan-building objects; paths are schema-sized."""
    rows = paths.select("label", "hops", "edges").dropDuplicates(["label"]).orderBy("hops", "label").collect()
    return [
        MetaPath(tuple(Edge(e["src_table"], e["src_col"], e["dst_col"], e["dst_table"], e["forward"]) for e in r["edges"]))
        for r in rows
    ]


def parse_path(catalog: Catalog, label: str) -> MetaPath:
    """The path a label spells: `orders>(o_custkey,c_custkey)>customer`."""
    parts = label.split(">")
    keys = set(catalog.edges())
    edges = []
    for i in range(0, len(parts) - 2, 2):
        a, b = parts[i + 1].strip("()").split(",")
        edges.append(Edge(parts[i], a, b, parts[i + 2], (parts[i], a, parts[i + 2], b) in keys))
    return MetaPath(tuple(edges))
