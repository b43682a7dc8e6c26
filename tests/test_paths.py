from __future__ import annotations

import random
import re

import numpy as np
import pytest
from conftest import tuples
from pyspark.sql import functions as F

from relimpute.functions import ranking
from relimpute.operators import contract, discover, entity, graph, induce, instances, sample, score, vectors
from relimpute.plans import flows
from relimpute.session import cut_lineage


def test_containment_and_jaccard(make_catalog):
    catalog = make_catalog(
        q=("k", {}, [(f"q{i}", v) for i, v in enumerate(["1", "2", "3", "4"])], "k string, v string"),
        t=("k", {}, [(f"t{i}", v) for i, v in enumerate([2, 3, 9])], "k string, v int"),
    )
    index = {(r["t1"], r["t2"]): r["score"] for r in discover.containment_index(catalog).collect()}
    assert index[("q", "t")] == 0.5 and index[("t", "q")] == pytest.approx(2 / 3)
    assert discover.jaccard_index(catalog).where("t1 = 'q'").first()["score"] == pytest.approx(0.4)
    assert discover.jaccard(0, 0, 0) == 1.0
    both = discover.compatible_columns(discover.containment_index(catalog), 0.6).collect()
    assert {(r["t1"], r["direction"]) for r in both} == {("q", "backward"), ("t", "forward")}


def test_exact_pairs_keep_zero_scores(make_catalog):
    catalog = make_catalog(
        a=("k", {}, [(1, "x")], "k int, v string"), b=("k", {}, [(1, "y")], "k int, w string"),
    )
    assert tuples(discover.all_pairs_index(catalog)) == [("a", "v", "b", "w", 0.0)]


def test_lsh_finds_contained_columns_and_nothing_else(make_catalog):
    tables = {
        f"t{n}": ("k", {}, [(f"{n}-{i}", f"v{i}") for i in range(60 * (n + 1))], "k string, v string") for n in range(4)
    }
    tables["far"] = ("k", {}, [(f"f{i}", f"w{i}") for i in range(200)], "k string, v string")
    catalog = make_catalog(**tables)
    exact = set(tuples(discover.containment_index(catalog), "t1", "c1", "t2", "c2"))
    found = set(tuples(discover.lsh_index(catalog, threshold=0.3, partitions=4), "t1", "c1", "t2", "c2"))
    assert found <= exact
    close = set(tuples(discover.containment_index(catalog).where("score >= 0.9"), "t1", "c1", "t2", "c2"))
    assert len(found & close) >= 0.9 * len(close)


def test_sketches_estimate_sizes_and_containment(make_catalog):
    sizes = {"one": 1, "few": 250, "some": 300, "many": 6000, "most": 20000}
    tables = {t: ("k", {}, [(f"{t}-{i}", f"v{i % n}") for i in range(max(n, 2))], "k string, v string") for t, n in sizes.items()}
    tables["none"] = ("k", {}, [("x", None)], "k string, v string")
    catalog = make_catalog(**tables)
    refs = {r.id: (r.table, r.col) for r in discover.column_refs(catalog)}
    found = {refs[i]: n for i, n in tuples(discover.minhash(catalog), "id", "n")}
    assert ("none", "v") not in found and found[("one", "v")] == 1
    assert all(abs(found[(t, "v")] / n - 1) < 0.4 for t, n in sizes.items())
    exact = {r[:4]: r[4] for r in tuples(discover.containment_index(catalog), "t1", "c1", "t2", "c2", "score")}
    guessed = {r[:4]: r[4:] for r in tuples(discover.sketched_index(catalog, partitions=4), "t1", "c1", "t2", "c2", "score", "error")}
    # Columns of very different size share too little for any band: one value among thousands is not looked for.
    assert {(a, "v", b, "v") for a, b in (("few", "some"), ("some", "many"), ("many", "most"))} <= set(guessed) <= set(exact)
    assert all(abs(score - exact[p]) <= error + 1e-12 for p, (score, error) in guessed.items())
    assert guessed[("some", "v", "few", "v")] == (250 / 300, 0.0)
    assert any(error > 0 for _, error in guessed.values()) and any(error == 0 for _, error in guessed.values())


def test_paths_keep_parallel_edges(spark):
    edges = spark.createDataFrame([("t", "a", "d", "k"), ("t", "b", "d", "k"), ("d", "r", "e", "k")], "src_table string, src_col string, dst_table string, dst_col string")
    paths = tuples(graph.enumerate_paths(edges, "t"), "goal", "hops", "label")
    assert paths == [("d", 1, "t>(a,k)>d"), ("d", 1, "t>(b,k)>d"), ("e", 2, "t>(a,k)>d>(r,k)>e"), ("e", 2, "t>(b,k)>d>(r,k)>e")]
    assert len(tuples(graph.enumerate_paths(edges, "t", per_goal=1))) == 2
    assert len(tuples(graph.enumerate_paths(edges, "t", max_hops=1))) == 2


def small(make_catalog):
    return make_catalog(
        q=("k", {"f": "p"}, [("q1", 1), ("q2", 1), ("q3", None), ("q4", 2)], "k string, f int"),
        p=("f", {"g": "r"}, [(1, "x"), (2, "y")], "f bigint, g string"),
        r=("g", {}, [("x", 1.0), ("y", 2.5)], "g string, v double"),
    )


def test_instances_follow_keys(make_catalog):
    catalog = small(make_catalog)
    paths = [graph.parse_path(catalog, label) for label in ("q>(f,f)>p", "q>(f,f)>p>(g,g)>r")]
    rows = instances.query_rows(catalog, "q", paths)
    found = instances.path_instances(catalog, rows, paths, payload=True)
    listed = tuples(found.select("qid", F.concat_ws(">", "row_ids"), F.to_json("payload")))
    # the null key finds nothing; two rows with one key both find their candidate
    assert listed == [
        ("q1", "1", "{}"), ("q1", "1>x", '{"v":"1"}'), ("q2", "1", "{}"), ("q2", "1>x", '{"v":"1"}'),
        ("q4", "2", "{}"), ("q4", "2>y", '{"v":"2.5"}'),
    ]
    one = instances.path_instances(catalog, rows, paths[:1], dedup="join_key")
    assert tuples(one, "qid") == [("q1",), ("q4",)]
    assert all(p.single_valued for p in paths)
    back = graph.parse_path(catalog, "p>(f,f)>q")
    assert not back.single_valued
    counts = instances.guarded(instances.instance_counts(catalog, "p", [back]), factor=1).first()
    assert (counts["instances"], counts["query_rows"], counts["kept"]) == (3, 2, False)
    assert instances.guard_paths(catalog, "p", [back], factor=1) == []


def test_grouped_instances_lose_nothing(make_catalog):
    catalog = make_catalog(
        q=("k", {}, [(1,), (2,)], "k int"), c=("id", {"k": "q"}, [(i, 1 if i % 10 else 2) for i in range(100)], "id int, k int"),
    )
    path = [graph.parse_path(catalog, "q>(k,k)>c")]
    grouped = instances.grouped_instances(instances.path_instances(catalog, instances.query_rows(catalog, "q", path), path), chunk=8)
    assert grouped.agg(F.sum(F.size("instances"))).first()[0] == 100
    assert grouped.where("qid = '1'").count() > 5


def test_closure_is_complete_and_a_fixpoint(make_catalog):
    catalog = make_catalog(
        l=("lk", {"ok": "o"}, [(i, i) for i in range(4)], "lk int, ok int"), o=("ok", {"ck": "c"}, [(i, i) for i in range(4)], "ok int, ck int"),
        c=("ck", {"nk": "n"}, [(i, i // 2) for i in range(4)], "ck int, nk int"), n=("nk", {}, [(0,), (1,)], "nk int"),
    )
    kept = sample.fk_closure(catalog, {"l": catalog.table("l").where("lk = 1")})
    assert tuples(sample.kept_rows(catalog, kept)) == [("c", "1"), ("l", "1"), ("n", "0"), ("o", "1")]
    again = sample.fk_closure(catalog.with_tables(**kept), {"l": kept["l"]})
    assert tuples(sample.kept_rows(catalog, again)) == tuples(sample.kept_rows(catalog, kept))


def test_closure_of_a_cycle(make_catalog):
    catalog = make_catalog(e=("id", {"boss": "e"}, [(1, None), (2, 1), (3, 2), (4, 3), (5, 1)], "id int, boss int"))
    kept = sample.fk_closure(catalog, {"e": catalog.table("e").where("id = 4")})
    assert tuples(kept["e"], "id") == [(1,), (2,), (3,), (4,)]


def test_reachable_rows_match_a_search(make_catalog):
    rng = random.Random(3)
    orders = [(i, rng.choice([None, *range(40)])) for i in range(60)]
    catalog = make_catalog(o=("ok", {"ck": "c"}, orders, "ok int, ck int"), c=("ck", {"nk": "n"}, [(i, i % 17) for i in range(40)], "ck int, nk int"), n=("nk", {}, [(i,) for i in range(17)], "nk int"))
    links = [(("o", str(o)), ("c", str(c))) for o, c in orders if c is not None] + [(("c", str(i)), ("n", str(i % 17))) for i in range(40)]
    seen, todo = {("o", "0"), ("o", "7")}, [("o", "0"), ("o", "7")]
    while todo:
        spot = todo.pop()
        for a, b in links:
            for x, y in ((a, b), (b, a)):
                if x == spot and y not in seen:
                    seen.add(y)
                    todo.append(y)
    start = catalog.spark.createDataFrame([("o", "0"), ("o", "7")], "table string, row_id string")
    assert tuples(sample.reachable_rows(catalog, start)) == sorted(seen, key=repr)


def test_closure_follows_cycles_from_the_newest_keys(make_catalog):
    """Employees name a boss and a team, teams name a lead; a fact names employees."""
    people = [(i, i // 2 if i > 1 else None, i % 7) for i in range(1, 200)]
    teams = [(t, 100 + t) for t in range(7)]
    catalog = make_catalog(
        fact=("f", {"e": "emp"}, [(1, 190), (2, 999)], "f int, e int"), emp=("e", {"boss": "emp", "team": "team"}, people, "e int, boss int, team int"),
        team=("team", {"lead": "emp"}, teams, "team int, lead int"),
    )
    assert sample.fact_tables(catalog) == ["fact"]
    kept = {t: {r[0] for r in df.select(catalog.row_id(t)).collect()} for t, df in sample.fk_closure(catalog, sample.fact_samples(catalog, 1.0)).items()}
    want, todo = {("fact", 1), ("fact", 2), ("emp", 190)}, [("emp", 190)]
    rows = {("emp", e): [("emp", b), ("team", t)] for e, b, t in people} | {("team", t): [("emp", lead)] for t, lead in teams}
    while todo:
        for near in rows[todo.pop()]:
            if near in rows and near not in want:
                want.add(near)
                todo.append(near)
    assert kept == {t: {str(k) for n, k in want if n == t} for t in ("fact", "emp", "team")}


def test_a_long_chain_takes_few_rounds(make_catalog, monkeypatch):
    """2,000 rows that each name the one before, a hub of 500, and a row without links."""
    chain = [(i, i - 1 if i else None) for i in range(2000)] + [(3000 + i, 3000) for i in range(1, 500)] + [(3000, None), (9000, None), (9001, 12345)]
    catalog = make_catalog(t=("k", {"up": "t"}, chain, "k bigint, up bigint"))
    written = []
    monkeypatch.setattr(contract, "cut_lineage", lambda df: written.append(1) or cut_lineage(df))
    start = catalog.spark.createDataFrame([("t", "700"), ("t", "9000"), ("t", "9001")], "table string, row_id string")
    got = sample.reachable_rows(catalog, start)
    assert {r["row_id"] for r in got.collect()} == {str(i) for i in range(2000)} | {"9000", "9001"} and got.count() == 2002
    assert len(written) <= 2 * 20


def test_guard_sees_a_path_that_explodes_half_way(make_catalog):
    """10 rows meet 1 hub, the hub 500 rows, those 1 row at the end which only one of them names."""
    catalog = make_catalog(
        q=("k", {"h": "hub"}, [(i, 1) for i in range(10)], "k int, h int"), hub=("h", {}, [(1,)], "h int"),
        wide=("w", {"h": "hub", "e": "last"}, [(i, 1, 7 if i == 0 else None) for i in range(500)], "w int, h int, e int"), last=("e", {}, [(7,)], "e int"),
    )
    whole = graph.parse_path(catalog, "q>(h,h)>hub>(h,h)>wide>(e,e)>last")
    short = graph.parse_path(catalog, "q>(h,h)>hub")
    counted = {r["label"]: (r["hops"], r["instances"], r["kept"]) for r in instances.guarded(instances.prefix_counts(catalog, "q", [whole, short])).collect()}
    assert counted == {short.label: (1, 10, True), "q>(h,h)>hub>(h,h)>wide": (2, 5000, False), whole.label: (3, 10, True)}
    assert instances.guarded(instances.instance_counts(catalog, "q", [whole])).first()["kept"]
    assert instances.guard_paths(catalog, "q", [whole, short]) == [short]


def test_entity_graph(make_catalog):
    catalog = make_catalog(n=("nk", {}, [(1, "a")], "nk int, name string"), c=("ck", {"nk": "n"}, [(5, 1, "x"), (6, 2, None)], "ck int, nk int, v string"))
    known = entity.entities(catalog, ["n", "c"])
    assert tuples(known) == [("c", "ck", "5"), ("c", "nk", "1"), ("c", "v", "x"), ("n", "name", "a"), ("n", "nk", "1")]
    links = tuples(entity.link_triples(catalog, ["n", "c"]), "head_table", "relation", "tail_table", "value")
    assert links == [("c", "fk_pk", "n", "1"), ("n", "pk_fk", "c", "1")]
    ids = entity.entity_ids(known)
    assert sorted(r["id"] for r in ids.collect()) == list(range(5))
    assert entity.encoded_triples(catalog, ["n", "c"], ids).count() == 2 + 4 + 2


@pytest.mark.parametrize("values", [[float(i % 7) for i in range(999)] + [3.0] * 600, [1e9 + i * 1e-3 for i in range(500)], [5.0]])
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", None)], "g string, v double").repartition(5)
    probs = [0.25, 0.5, 0.9]
    found = {(r["g"], r["p"]): r["quantile"] for r in ranking.exact_quantiles(df, ["g"], "v", probs).collect()}
    for p in probs:
        assert found[("a", p)] == pytest.approx(np.quantile(values, p), abs=1e-6)
        assert found[("b", p)] == 1.0


def test_ordered_bits_are_the_bits(spark):
    rng = np.random.default_rng(4)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), float("-inf")]
    values += [s * 2.0**e for e in range(-1074, 1024) for s in (1, -1)] + [float(np.nextafter(2.0**e, 0)) for e in range(-1070, 1024)]
    values += [float(x) for x in rng.integers(0, 2**63, 3000, dtype=np.uint64).view(float) if np.isfinite(x)] + [float("nan")]
    got = [r["o"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", ranking.ordered_bits(F.col("v")).alias("o")).orderBy("i").collect()]
    for v, o in zip(values, got, strict=True):
        bits = int(np.array([abs(v)]).view(np.int64)[0])
        assert o == (2**63 - 1 if v != v else -bits if v < 0 else bits), v


def test_quantiles_of_wild_and_repeated_values(spark):
    rng = np.random.default_rng(8)
    groups = {
        "wild": (rng.normal(size=400) * 10.0 ** rng.integers(-300, 300, 400)).tolist(), "same": [2.5] * 700, "two": [-1.0, 3.0],
        "close": [1.0 + i * 2.0**-52 for i in range(300)], "signs": [-0.0, 0.0, -1e-320, 1e-320, -7.0],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("two", None), ("none", None)], "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = {(r["g"], r["p"]): (r["quantile"], r["n"]) for r in ranking.exact_quantiles(df, ["g"], "v", probs).collect()}
    assert len(found) == len(groups) * len(probs)
    for (g, p), (v, n) in found.items():
        assert n == len(groups[g]) and v == pytest.approx(np.quantile(groups[g], p), rel=1e-12, abs=0)
    whole = ranking.exact_quantiles(df.where("g = 'two'"), [], "v", [0.5]).first()
    assert (whole["n"], whole["quantile"]) == (2, 1.0)
    plan = ranking.exact_quantiles(df, ["g"], "v", [0.5])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_positions_and_hash_ranks(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v")).repartition(6)
    assert all(r["position"] == r["v"] + 1 for r in ranking.positions(df, ["v"]).collect())
    hashed = df.select(F.when(F.col("v") < 400, "big").otherwise("small").alias("g"), "v", F.md5(F.col("v").cast("string")).alias("h"))
    kept = ranking.hash_first_n(hashed, ["g"], "h", F.lit(150))
    rows = [tuple(r) for r in hashed.collect()]
    expected = sorted([r for r in rows if r[0] == "big"], key=lambda r: r[2])[:150] + [r for r in rows if r[0] == "small"]
    assert tuples(kept) == sorted(expected, key=repr)


def test_neighbour_blocks_are_few_and_ties_stay_bounded():
    rng = np.random.default_rng(3)
    blocks = vectors._blocks(rng.normal(size=(900, 8)), rng.integers(1, 2000, 900))
    # a query that no group can be ruled out for is sent to few blocks, not to 900 groups
    assert len(blocks) == 900 and blocks.min() == 0 and blocks.max() + 1 == len(set(blocks.tolist())) <= vectors.LARGE
    data = np.vstack([np.tile([1.0, 0.0], (300, 1)), rng.integers(0, 3, (200, 2)).astype(float), np.tile([-0.0, 1.0], (5, 1))])
    far = np.sqrt(((data[:, None] - data[None]) ** 2).sum(2)).round(9)
    for waiting in (7, 1 << 18):
        rows, places, distance = vectors._nearest(data, data, 4, "l2", 64, waiting)
        assert len(rows) == 4 * len(data)
        for i in range(len(data)):
            assert places[rows == i].tolist() == np.lexsort((np.arange(len(data)), far[i]))[:4].tolist()
            assert np.allclose(distance[rows == i], np.sort(far[i])[:4])


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_neighbours_match_brute_force(spark, metric, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(5)
    data = np.vstack([rng.normal(size=(80, 6)), rng.normal(size=(60, 6)) * 0.01 + 3, np.tile(rng.normal(size=6), (30, 1)), np.zeros((1, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, vec array<double>").repartition(3)
    got = {(r["query_id"], r["rank"]): (r["target_id"], r["distance"]) for r in vectors.knn_join(df, df, 4, metric).collect()}
    norms = np.linalg.norm(data, axis=1)
    for i in range(len(data)):
        if metric == "cosine":
            if norms[i] == 0:
                assert (i, 1) not in got
                continue
            with np.errstate(invalid="ignore", divide="ignore"):
                far = 1 - data @ data[i] / (norms * norms[i])
            far[norms == 0] = np.inf
        else:
            far = np.linalg.norm(data - data[i], axis=1)
        order = sorted(range(len(data)), key=lambda j: (round(far[j], 9), j))[:4]
        for rank, j in enumerate(order, 1):
            assert got[(i, rank)][0] == j and got[(i, rank)][1] == pytest.approx(far[j], abs=1e-7)


def test_cosine_of_a_zero_vector_is_null(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.0, 0.0]), ([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    found = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert found[0] is None and found[1] == pytest.approx(2**-0.5)


def test_top_k_limits_before_the_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    plan = ranking.top_k(df, ["g"], [F.col("id")], 3)._jdf.queryExecution().toString()
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def hubs(make_catalog):
    """Sixty rows of three hubs with twenty spokes each; keys that are null, unknown or come twice."""
    rows = [(i % 55, None if i == 7 else 9 if i == 8 else i % 3, "x" if i % 2 else None if i % 10 == 0 else "y") for i in range(60)]
    catalog = make_catalog(
        h=("h", {}, [(i,) for i in range(3)], "h int"),
        q=("k", {"h": "h"}, rows, "k int, h int, a string"),
        s=("s", {"h": "h"}, [(i, i % 3, "x" if i % 4 else "z") for i in range(60)], "s int, h int, v string"),
        o=("o", {"k": "q"}, [(i, i % 50, "y") for i in range(100)], "o int, k int, w string"),
    )
    return catalog, {"a": [graph.parse_path(catalog, p) for p in ("q>(h,h)>h", "q>(h,h)>h>(h,h)>s", "q>(k,k)>o")]}


def test_bundles_count_every_candidate_once(make_catalog, monkeypatch):
    catalog, by_attribute = hubs(make_catalog)
    plain = score.softmax(score.default_score(flows.known_candidates(catalog, "q", by_attribute)))
    found = flows.known_bundles(catalog, "q", by_attribute)
    counted = score.softmax(score.default_score(found.cells))
    # a row per cell, path and kind, however many spokes a hub has
    assert counted.count() < plain.count() / 5
    monkeypatch.setattr(instances, "OPENED", 50)
    columns = ("qid", "attr", "path_id", "instance_id", "truth", "hits", "w")
    rounded = [df.withColumn("w", F.round("weight", 9)) for df in (plain, instances.opened(counted, found.held))]
    assert tuples(rounded[1], *columns) == tuples(rounded[0], *columns)
    for measure in (
        lambda df: induce.path_summary(induce.matching_columns(df)), induce.induction_flags, instances.merge_paths, instances.path_complexity,
        lambda df: score.marginal_nll(score.label_candidates(df)).withColumn("loss", F.round("loss", 9)),
    ):
        assert tuples(measure(counted)) == tuples(measure(plain))


def test_shared_instances_are_those_of_every_row(make_catalog, monkeypatch):
    catalog, by_attribute = hubs(make_catalog)
    paths = by_attribute["a"]
    rows = instances.query_rows(catalog, "q", paths)
    shared = instances.shared_instances(catalog, rows, paths)
    assert shared.found.where(F.col("path_id") == paths[1].path_id).count() == 60
    monkeypatch.setattr(instances, "OPENED", 50)
    held = instances.of_members(shared, shared.found.select("qid", "path_id", "instance_id"))
    assert tuples(held, "qid", "path_id", "instance_id") == tuples(instances.path_instances(catalog, rows, paths), "qid", "path_id", "instance_id")


def test_rows_that_no_key_names_enter_no_round(make_catalog, monkeypatch):
    """A fact ties the rows it names, under a repeated key too; dangling and null keys tie nothing."""
    facts = [(1, 1, 5), (1, 2, None), (2, 3, 77), (3, None, 77), (4, 4, 6), (5, 1, None), (None, 6, 7)]
    catalog = make_catalog(
        f=("f", {"d": "d", "e": "e"}, facts, "f int, d int, e int"),
        d=("d", {}, [(i,) for i in range(8)], "d int"),
        e=("e", {}, [(i,) for i in range(5, 8)], "e int"),
    )
    entered = []
    reached = contract.reached
    monkeypatch.setattr(contract, "reached", lambda links, start: entered.extend(links.collect()) or reached(links, start))
    start = catalog.spark.createDataFrame([("d", "2"), ("f", "4"), ("f", "3")], '"table" string, row_id string'.replace('"', "`"))
    got = tuples(sample.reachable_rows(catalog, start))
    assert got == sorted([("d", "1"), ("d", "2"), ("d", "4"), ("e", "5"), ("e", "6"), ("f", "1"), ("f", "3"), ("f", "4"), ("f", "5")], key=repr)
    assert not [r for r in entered if r["a"].startswith("f:") or r["b"].startswith("f:")]


def test_owners_of_a_value_are_bits(make_catalog):
    """More columns than one number has bits, and no list per value."""
    wide = [f"c{i}" for i in range(70)]
    catalog = make_catalog(
        a=("k", {}, [("k0", *[f"v{i}" for i in range(70)]), ("k1", *[f"v{i}" if i % 2 else None for i in range(70)])], f"k string, {', '.join(f'{c} string' for c in wide)}"),
        b=("j", {}, [("j0", "v5"), ("j1", "v69"), ("j2", "v69")], "j string, x string"),
    )
    index = discover.containment_index(catalog)
    found = tuples(index.where("t1 = 'b'"), "c1", "t2", "c2", "score")
    assert found == [("x", "a", "c5", 0.5), ("x", "a", "c69", 0.5)]
    assert tuples(index.where("t1 = 'a'"), "c1", "score") == [("c5", 1.0), ("c69", 1.0)]
    assert "collect_set" not in index._jdf.queryExecution().optimizedPlan().toString()


def test_rows_hang_on_what_they_name(make_catalog):
    """Only labels of rows that name nothing enter the rounds, whatever the number of rows under them; repeated keys tie groups."""
    people = [(i, i % 4 if i % 10 else None) for i in range(400)] + [(11, 2), (12, None), (None, 3)]
    facts = [(i, i % 400, i % 4) for i in range(100, 300) if i % 4 < 2] + [(7, 3, 99), (7, None, 20), (8, 999, 21), (8, 998, 22)]
    catalog = make_catalog(
        f=("f", {"p": "p", "e": "e"}, facts, "f int, p int, e int"),
        p=("p", {"g": "g"}, people, "p int, g int"), g=("g", {}, [(i,) for i in range(4)], "g int"),
        e=("e", {}, [(i,) for i in range(25)], "e int"),
    )
    order, loops = sample._parents_first(catalog)
    assert order.index("g") < order.index("p") and not loops
    held = {t: catalog.table(t).select(catalog.row_id(t).alias("row_id"), F.concat(F.lit(f"{t}:"), F.col(t).cast("string")).alias("label")) for t in "ge"}
    hung = sample._hung(catalog, "p", held)
    assert {r["label"] for r in hung.where("size(refs) > 0").collect()} == {f"g:{i}" for i in range(4)} and hung.count() == 400
    links = [((("f", str(f)), (t, str(k)))) for f, p, e in facts for t, k, n in (("p", p, 400), ("e", e, 25)) if k is not None and k < n]
    links += [(("p", str(p)), ("g", str(g))) for p, g in people if p is not None and g is not None]
    for first in (("g", "1"), ("g", "3"), ("e", "21"), ("f", "7"), ("p", "20"), ("f", "12345")):
        seen, todo = {first}, [first]
        while todo:
            spot = todo.pop()
            for a, b in links:
                for x, y in ((a, b), (b, a)):
                    if x == spot and y not in seen:
                        seen.add(y)
                        todo.append(y)
        start = catalog.spark.createDataFrame([first], "table string, row_id string")
        assert tuples(sample.reachable_rows(catalog, start)) == sorted(seen, key=repr), first


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_single_precision_loses_no_neighbour(metric):
    """Half-integers with many ties, rows far from zero, rows of wild sizes, copies: single precision only preselects."""
    rng = np.random.default_rng(11)
    sparse = rng.integers(-2, 3, (3000, 24)) * (rng.random((3000, 24)) < 0.3) / 2.0 + (np.arange(24) == 0)
    data = {"sparse": sparse, "far": rng.normal(size=(1500, 24)) * 1e-4 + 1e3, "wild": rng.normal(size=(1500, 24)) * 10.0 ** rng.integers(-6, 7, (1500, 1)), "copies": np.repeat(sparse[:40], 40, 0)}
    for name, rows in data.items():
        rows = rows[rows.any(1)]
        b = rows / np.linalg.norm(rows, axis=1, keepdims=True) if metric == "cosine" else rows
        a = b[rng.integers(0, len(b), 70)] if name != "sparse" else np.roll(b[:70], 3, 1)
        found, places, distance = vectors._nearest(a, b, 5, metric, 1024, 1 << 18)
        for i in range(len(a)):
            far = 1.0 - np.einsum("ij,j->i", b, a[i]) if metric == "cosine" else np.sqrt(((b - a[i]) ** 2).sum(1))
            assert places[found == i].tolist() == np.lexsort((np.arange(len(b)), far.round(9)))[:5].tolist() or np.allclose(np.sort(far.round(9))[:5], distance[found == i], atol=2e-9, rtol=0)
