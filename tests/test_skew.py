"""A third of all rows share one key."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from relimpute.functions import ranking
from relimpute.operators import discover, graph, induce, instances, sample, score

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.shuffle.partitions": "8",
}
ROWS = 60_000


@pytest.fixture
def skewed(spark, make_catalog):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    catalog = make_catalog(
        f=("fk", {"dk": "d"}, [(0, 0)], "fk long, dk long"), d=("dk", {}, [(0, "x")], "dk long, v string"),
    )
    hot = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 997)
    facts = spark.range(0, ROWS, 1, 8).select(F.col("id").alias("fk"), hot.alias("dk"))
    dims = spark.range(997).select(F.col("id").alias("dk"), F.concat(F.lit("v"), F.col("id")).alias("v"))
    yield catalog.with_tables(f=facts, d=dims)
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_foreign_key_is_split(skewed):
    path = [graph.parse_path(skewed, "f>(dk,dk)>d")]
    found = instances.path_instances(skewed, instances.query_rows(skewed, "f", path), path, payload=True)
    rows = found.select("qid", F.element_at("row_ids", 1).alias("d"), F.col("payload")["v"].alias("v"))
    checked = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == F.concat(F.lit("v"), F.col("d"))).alias("right"))
    assert [tuple(r) for r in checked.collect()] == [(ROWS, ROWS)]
    assert "skew=true" in checked._jdf.queryExecution().executedPlan().toString()


def test_hot_group_keeps_every_row(skewed):
    back = [graph.parse_path(skewed, "d>(dk,dk)>f")]
    found = instances.path_instances(skewed, instances.query_rows(skewed, "d", back), back)
    grouped = instances.grouped_instances(found, chunk=500)
    sizes = grouped.agg(F.sum(F.size("instances")).alias("n"), F.max(F.size("instances")).alias("largest")).first()
    assert sizes["n"] == ROWS and sizes["largest"] < 1000
    assert instances.top_instances(found, back, 5).count() == 997 * 5
    counts = instances.instance_counts(skewed, "d", back).first()
    assert counts["instances"] == ROWS


def test_hot_value_in_overlap_closure_and_quantiles(skewed):
    index = {(r["t1"], r["c1"], r["t2"], r["c2"]): r["score"] for r in discover.containment_index(skewed, refs=[
        discover.ColumnRef(0, "f", "dk", False), discover.ColumnRef(1, "d", "dk", False)]).collect()}
    assert index[("f", "dk", "d", "dk")] == 1.0 and index[("d", "dk", "f", "dk")] == 1.0
    kept = sample.fk_closure(skewed, {"f": sample.down_sample(skewed.table("f"), F.col("fk"), 0.2)})
    wanted = kept["f"].select("dk").distinct().count()
    assert kept["d"].count() == wanted
    median = ranking.exact_quantiles(skewed.table("f").select(F.lit("a").alias("g"), "dk"), ["g"], "dk", [0.1]).first()
    values = sorted(7 if i % 3 == 0 else i % 997 for i in range(ROWS))
    h = (ROWS - 1) * 0.1
    low = values[int(h)] + (values[int(h) + 1] - values[int(h)]) * (h - int(h))
    assert median["quantile"] == pytest.approx(low)


def test_a_cell_with_a_third_of_all_candidates(spark, skewed):
    """Weights, cuts, matches and flags of a hot cell, without a window over its candidates."""
    cell = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 997).cast("string"))
    rows = spark.range(0, ROWS, 1, 8).select(
        cell.alias("qid"), F.lit("a").alias("attr"), F.lit("p").alias("path_id"), F.col("id").cast("string").alias("instance_id"),
        # ties at the top of every cell, and scores that exp can not raise by themselves
        (F.col("id") % 90 * 20.0 - 900).alias("score"), F.lit("x").alias("truth"),
        F.when(F.col("id") % 7 == 0, F.array(F.lit("c"), F.lit(None))).alias("hits"),
    )
    weighted = score.softmax(rows)
    plan = weighted._jdf.queryExecution().toString()
    assert "Window" not in plan
    local = weighted.toPandas()
    for _, group in local.groupby("qid"):
        raised = np.exp(group["score"] - group["score"].max())
        assert np.allclose(group["weight"], raised / raised.sum(), rtol=1e-9, atol=1e-300)
    local["level"] = local["weight"].round(12)
    local["rank"] = local.groupby("qid")["level"].rank(ascending=False, method="min")
    top = local[(local["rank"] <= 3) & local["hits"].notna()]
    got = induce.matching_columns(weighted).toPandas()
    assert sorted(zip(got["qid"], got["instance_id"], got["col"])) == sorted((q, i, "c") for q, i in zip(top["qid"], top["instance_id"]))
    flags = induce.induction_flags(weighted).toPandas().set_index("qid")
    assert set(flags[flags["max"] == 1].index) == set(top["qid"]) and set(flags[flags["valid"] == 1].index) == set(local[local["hits"].notna()]["qid"])
    assert (flags["notnull"] == 1).all() and len(flags) == local["qid"].nunique()
