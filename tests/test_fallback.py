"""Additive embeddings, attributes without a path, approximate neighbours."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from conftest import tuples
from pyspark.sql import functions as F

from relimpute.operators import embed, fallback, instances, vectors
from relimpute.plans import flows


def slots(values, dimension=64):
    """Plain form of the hashed parts of a row."""
    out = np.zeros(dimension)
    for v in values:
        tokens = [] if v is None else [(str(v), 1.0)]
        if isinstance(v, (int, float)):
            tokens.append((f"#{'-' if v < 0 else ''}{len(str(abs(int(v))))}", 0.5))
        for token, w in tokens:
            h = hashlib.md5(token.encode()).hexdigest()
            out[int(h[:8], 16) % dimension] += w if h[8] < "8" else -w
    norm = np.linalg.norm(out)
    return out / norm if norm else out


@pytest.fixture
def shop(make_catalog):
    """Sales that carry a copied city, and shops that hold it; no key ties the two."""
    cities = ["Aachen", "Bonn", "Celle", "Duisburg", "Essen"]
    shops = [(i, cities[i % 5], 100 + i) for i in range(40)]
    sales = [(i, 100 + i % 40, None if i % 4 == 0 else cities[i % 40 % 5], None if i % 7 == 0 else -float(i)) for i in range(400)]
    return make_catalog(
        sale=("id", {}, sales, "id bigint, phone bigint, city string, amount double"),
        shop=("sid", {}, shops, "sid bigint, town string, phone bigint"),
        empty=("eid", {}, [], "eid bigint, town string"),
    )


def test_rows_are_sums_of_their_values(shop):
    got = {r["row_id"]: r["embedding"] for r in embed.row_vectors(shop, "shop", keys=True).collect()}
    for i, town, phone in shop.table("shop").collect():
        assert got[str(i)] == pytest.approx(slots([i, town, phone]).tolist(), abs=1e-12)
    asked = instances.missing(["city", "amount"])
    found = {(r["qid"], r["attr"]): r["embedding"] for r in embed.query_vectors(shop, "sale", asked).collect()}
    rows = {r["id"]: r for r in shop.table("sale").collect()}
    assert len(found) == 100 + 58
    for (qid, attr), vector in found.items():
        r = rows[int(qid)]
        amount = None if r["amount"] is None else int(r["amount"])
        assert vector == pytest.approx(slots([r["phone"], r["city"] if attr != "city" else None, amount if attr != "amount" else None]).tolist(), abs=1e-12)
    assert embed.row_vectors(shop, "empty").count() == 0


def test_a_known_value_leaves_its_own_query_vector(shop):
    asked = instances.known(shop, "sale", ["city", "phone", "amount"])
    found = embed.query_vectors(shop, "sale", asked)
    r = found.where("qid = '5' AND attr = 'city'").first()
    assert r["truth"] == "Aachen" and r["embedding"] == pytest.approx(slots([105, -5]).tolist(), abs=1e-12)


def test_attributes_without_a_path_are_filled_from_near_rows(shop):
    sources = flows.discover_sources(shop, "sale", shop.names, ["city", "amount"])
    assert sources.paths == {} and sources.related == {"city": ["shop"]}
    summary = flows.induced_summary(shop, "sale", sources.paths, related=sources.related, related_n=0)
    assert [(r["attr"], r["path_id"], r["col"]) for r in summary.collect()] == [("city", "shop", "town")]
    filled, voted = flows.impute(shop, "sale", sources.paths, summary, related=sources.related)
    cities = ["Aachen", "Bonn", "Celle", "Duisburg", "Essen"]
    right = [r["city"] == cities[r["id"] % 40 % 5] for r in filled.collect()]
    # 300 are known; of the others only the shared phone number tells, and some hashes share one of 64 slots
    assert sum(right) >= 300 + 75
    # what is not asked for, or can not be found, stays
    assert filled.where("amount IS NULL").count() == 58 and filled.columns == shop.table("sale").columns
    assert voted.groupBy("qid").agg(F.sum("w").alias("w")).where("abs(w - 1) > 1e-9").isEmpty()


def test_paths_and_related_tables_vote_together(shop, spark):
    """An attribute along a path and one from a related table, in one call."""
    linked = flows.Catalog(spark, {**shop.specs}, dict(shop.tables))
    tagged = shop.table("sale").withColumn("tag", F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("phone") % 10)))
    from relimpute.sources.catalog import TableSpec

    tags = spark.createDataFrame([(100 + i, f"t{i % 10}") for i in range(40)], "tid bigint, tag string")
    linked.specs.update(sale=TableSpec("sale", ("id",), (("phone", "tags"),)), tags=TableSpec("tags", ("tid",), ()))
    linked.tables.update(sale=tagged, tags=tags)
    sources = flows.discover_sources(linked, "sale", linked.names, ["city", "tag"])
    assert set(sources.paths) == {"tag"} and sources.related == {"city": ["shop"]}
    summary = flows.induced_summary(linked, "sale", sources.paths, related=sources.related)
    filled, _ = flows.impute(linked, "sale", sources.paths, summary, related=sources.related)
    assert filled.where("tag <> concat('t', phone % 10) OR tag IS NULL OR city IS NULL").isEmpty()


def test_neighbours_of_cells_match_brute_force(shop):
    got = {}
    for r in fallback.candidates(shop, "sale", {"city": ["shop", "empty"]}, k=3).collect():
        got.setdefault(r["qid"], []).append((-r["near"], r["row_ids"][0], r["payload"]["town"]))
    shops = [(str(i), slots([i, town, phone]), town) for i, town, phone in shop.table("shop").collect()]
    for r in shop.table("sale").where("city IS NULL").collect():
        q = slots([r["phone"], None, None if r["amount"] is None else int(r["amount"])])
        order = sorted(shops, key=lambda s: (round(float(np.linalg.norm(q - s[1])), 9), s[0]))[:3]
        assert sorted(got[str(r["id"])])[0][1:] == (order[0][0], order[0][2]) and {x[1] for x in got[str(r["id"])]} == {s[0] for s in order}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_bucketed_neighbours_recall_and_share_of_pairs(spark, metric):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(100, 32))
    data = centres[rng.integers(0, 100, 2000)] + 0.15 * rng.normal(size=(2000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, vec array<double>").repartition(3)
    exact = {}
    unit = data / np.linalg.norm(data, axis=1, keepdims=True) if metric == "cosine" else data
    far = (unit**2).sum(1)[:, None] + (unit**2).sum(1)[None, :] - 2 * unit @ unit.T
    for i, row in enumerate(np.argsort(far, axis=1)[:, :6]):
        exact[i] = set(row.tolist())
    got = {}
    for r in vectors.bucketed_knn(df, df, 6, metric).collect():
        got.setdefault(r["query_id"], set()).add(r["target_id"])
        want = 1 - unit[r["query_id"]] @ unit[r["target_id"]] if metric == "cosine" else np.linalg.norm(unit[r["query_id"]] - unit[r["target_id"]])
        assert r["distance"] == pytest.approx(want, abs=1e-7)
    recall = sum(len(exact[i] & got.get(i, set())) for i in exact) / (6 * len(exact))
    assert recall >= 0.9
    asked, held = vectors.bucketed_sides(df, df, 6, metric)
    pairs = asked.groupBy("tab", "cell").count().join(held.groupBy("tab", "cell").agg(F.count(F.lit(1)).alias("n")), ["tab", "cell"])
    share = pairs.agg(F.sum(F.col("count") * F.col("n"))).first()[0] / 2000**2
    print(metric, "recall", recall, "share", share)
    assert share <= 0.1


def test_bucketed_neighbours_of_copies_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(100, [50.0, 0.0]), (101, [50.0, 0.01])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = tuples(vectors.bucketed_knn(df, df, 2, width=1.0), "query_id", "target_id", "rank")
    assert [x for x in got if x[0] == 7] == [(7, 0, 1), (7, 1, 2)] and (100, 101, 2) in got
    assert vectors.bucketed_knn(df, df.limit(0), 2).count() == 0 and vectors.bucketed_knn(df.limit(0), df, 2).count() == 0


def test_vectors_are_summed_by_batches(shop):
    """One summing of a batch, not a list rebuilt for every part of every row."""
    plan = embed.row_vectors(shop, "shop", keys=True)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
    (row,) = embed.row_vectors(shop, "shop", 7, keys=True).where("row_id = '3'").collect()
    assert row["embedding"] == pytest.approx(slots([3, "Duisburg", 103], 7).tolist(), abs=1e-12)


def test_vectors_are_summed_once_though_they_are_opened(shop):
    opened = embed.row_vectors(shop, "shop", keys=True).select("row_id", F.posexplode("embedding").alias("slot", "value")).where(F.col("value") != 0)
    assert opened._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r["row_id"] for r in opened.collect()} == {str(i) for i in range(40)}


def test_related_tables_are_tried_on_every_known_cell(make_catalog):
    """More known cells than the 800 that were sampled before; each of them counts."""
    sales = [(i, 5000 + i % 40, f"city {i % 40}" if i % 5 else None) for i in range(1500)]
    catalog = make_catalog(
        sale=("id", {}, sales, "id bigint, phone bigint, city string"),
        shop=("sid", {}, [(i, f"city {i}", 5000 + i) for i in range(40)], "sid bigint, town string, phone bigint"),
    )
    (row,) = flows.induced_summary(catalog, "sale", {}, related={"city": ["shop"]}).collect()
    near = {r["qid"]: r for r in fallback.candidates(catalog, "sale", {"city": ["shop"]}, True, 0, k=1).collect()}
    assert len(near) == 1200 and (row["col"], row["ratio"]) == ("town", 1.0) and row["n"] > 800
