from __future__ import annotations

import pytest
from conftest import tuples
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relimpute.functions import text
from relimpute.functions.hashing import draw
from relimpute.operators import embed, induce, instances, metrics, sample, score, vote
from relimpute.operators.graph import parse_path
from relimpute.plans import flows, suites
from relimpute.plans.star import star_catalog
from relimpute.plans.suite_tables import ORDER_SOURCES

FOLDER = "/root/testdata/sf0.001"


def weighted(spark, rows):
    return spark.createDataFrame(rows, "qid string, attr string, path_id string, instance_id string, score double, truth string, hits array<string>")


def test_softmax_and_loss(spark):
    rows = [("1", "a", "p", "i1", 1.0, "x", ["c"]), ("1", "a", "p", "i2", 2.0, "x", ["c"]), ("1", "a", "q", "i3", 0.0, "x", None)]
    found = score.label_candidates(score.softmax(weighted(spark, rows)))
    assert [round(r["weight"], 6) for r in found.orderBy("instance_id").collect()] == [0.244728, 0.665241, 0.090031]
    loss = score.marginal_nll(found).first()
    assert loss["cells"] == 1 and round(loss["loss"], 6) == 0.094344
    assert score.marginal_nll(found.withColumn("label", F.lit(0))).first()["loss"] == 0.0


def test_path_summary_ratios(spark):
    pairs = [("p1", "c1")] * 3 + [("p1", "c2"), ("p2", "c1")]
    matches = spark.createDataFrame([("a", p, c) for p, c in pairs], "attr string, path_id string, col string")
    assert tuples(induce.path_summary(matches, 2)) == [("a", "p1", "c1", 3, 0.6), ("a", "p1", "c2", 1, 0.2)]


def test_induction_flags(spark):
    rows = [("1", "a", "p", f"i{i}", -float(i), "x", ["c"] if i == 4 else None) for i in range(5)]
    rows += [("2", "a", "p", "i0", 0.0, "nan", None), ("3", "a", "p", "i0", 0.0, "y", ["c"])]
    flags = induce.induction_flags(score.softmax(weighted(spark, rows)))
    assert tuples(flags) == [("1", "a", 1, 1, 0), ("2", "a", 0, 0, 0), ("3", "a", 1, 1, 1)]
    assert tuples(induce.coverage(flags)) == [("a", 2, 1.0, 0.5)]
    assert induce.valid_attributes(flags, 0.5).count() == 0 and induce.covered_attributes(flags).count() == 1
    # Candidates of one weight share a rank: none is left out for its name.
    tied = [("1", "a", "p", f"i{i}", 0.0, "x", ["c"] if i == 4 else None) for i in range(5)]
    assert tuples(induce.induction_flags(score.softmax(weighted(spark, tied)))) == [("1", "a", 1, 1, 1)]


def test_vote_breaks_ties_by_ratio_then_value(spark):
    rows = [
        ("1", "a", "p", 0.3, {"c": "x"}), ("1", "a", "p", 0.2, {"c": "x"}), ("1", "a", "q", 0.5, {"d": "y"}), ("2", "a", "p", 0.5, {"c": "n"}),
        ("2", "a", "p", 0.5, {"c": "m"}), ("3", "a", "p", 1.0, {"c": None}),
    ]
    candidates = spark.createDataFrame(rows, "qid string, attr string, path_id string, weight double, payload map<string,string>")
    summary = spark.createDataFrame([("a", "p", "c", 1, 0.25), ("a", "q", "d", 1, 0.6)], induce.PATH_SUMMARY)
    voted = vote.votes(candidates, summary)
    assert tuples(vote.answers(voted), "qid", "value") == [("1", "y"), ("2", "m")]
    ranked = tuples(vote.value_ranking(voted), "qid", "value", "score")
    assert ranked == [("1", "x", 1.0), ("1", "y", 2.0), ("2", "m", 2.0), ("2", "n", 1.0)]


def test_write_back_changes_null_cells_only(make_catalog):
    catalog = make_catalog(t=("k", {}, [(1, None, 5), (2, "b", None), (3, None, None)], "k int, s string, n int"))
    found = catalog.spark.createDataFrame([("1", "s", "a"), ("2", "s", "z"), ("2", "n", "7"), ("3", "n", "1.5")], "qid string, attr string, value string")
    assert tuples(vote.write_back(catalog, "t", found, ["s", "n"])) == [(1, "a", 5), (2, "b", 7), (3, None, None)]
    wide = catalog.with_tables(t=vote.widened(catalog.table("t"), found))
    assert tuples(vote.write_back(wide, "t", found, ["s", "n"])) == [(1, "a", 5.0), (2, "b", 7.0), (3, None, 1.5)]
    fits = vote.typed_answers(found, {"s": T.StringType(), "n": T.IntegerType()})
    assert [r["fits"] for r in fits.orderBy("qid", "attr").collect()] == [True, True, True, False]


def test_q_errors(spark):
    truth, pred = (10, 0, 0, 4, -2, 5), (20, 0, 3, 0, 2, 5)
    df = spark.createDataFrame([("m", "a", float(t), float(p)) for t, p in zip(truth, pred)], "method string, attr string, t double, p double")
    errors = [r[0] for r in df.select(metrics.q_error(F.col("t"), F.col("p"))).collect()]
    assert errors == [2, 1, 30, 40, None, 1]
    row = metrics.q_error_quantiles(df).first()
    assert [row[c] for c in ("q25", "q50", "q75", "q90", "q_count")] == [1, 2, 30, 36, 5]


def test_js_distance(spark):
    df = spark.createDataFrame([("m", "a", float(t), float(p)) for t, p in zip((0, 5, 10, 20), (0, 5, 5, 25))], "method string, attr string, t double, p double")
    assert round(metrics.js_distance(df).first()["js"], 6) == 0.474767


def test_rank_metrics(spark):
    run = [("1", "a", v, s) for v, s in (("t", 3.0), ("u", 5.0), ("v", 4.0))] + [("2", "a", v, float(s)) for s, v in enumerate("tuvwx")]
    run += [("3", "a", "u", 1.0), ("4", "a", "t", 1.0), ("4", "a", "u", 1.0)]
    df = spark.createDataFrame(run, "qid string, attr string, value string, score double")
    truths = spark.createDataFrame([(str(i), "a", "t") for i in range(1, 6)], "qid string, attr string, value string")
    got = {r["qid"]: tuple(round(r[c], 6) for c in ("recip_rank", "ndcg_cut_1", "ndcg_cut_3", "ndcg_cut_5", "success_1")) for r in metrics.rank_metrics(truths, df).collect()}
    assert got == {"1": (0.333333, 0, 0.5, 0.5, 0), "2": (0.2, 0, 0, 0.386853, 0), "3": (0, 0, 0, 0, 0), "4": (0.5, 0, 0.63093, 0.63093, 0)}


def test_judged_counts_fallbacks_and_mismatches(spark):
    cells = spark.createDataFrame([("1", "n", "4"), ("2", "n", "6"), ("3", "n", "8"), ("1", "c", "x"), ("2", "c", "y")], "qid string, attr string, truth string")
    runs = spark.createDataFrame([("m", "1", "n", "4"), ("m", "2", "n", None), ("m", "3", "n", "abc"), ("m", "1", "c", "x"), ("m", "2", "c", "7")], "method string, qid string, attr string, value string")
    stats = spark.createDataFrame([("n", 8.0, 4.0, 5.0)], "attr string, max double, min double, median double")
    rows = {(r["attr"], r["qid"]): r for r in metrics.judged(cells, runs, {"n": "num", "c": "cat"}, stats).collect()}
    assert [rows[("n", k)]["not_added"] for k in "123"] == [False, True, True]
    assert rows[("n", "2")]["p"] == 5.0 and not rows[("n", "3")]["used"] and not rows[("c", "2")]["used"]
    report = {r["attr"]: r for r in metrics.eval_report(metrics.judged(cells, runs, {"n": "num", "c": "cat"}, stats)).where("class = 'num'").collect()}
    assert (report["n"]["missing_cnt"], report["all"]["missing_cnt"], report["n"]["count_not_added"]) == (3, 2, 2)
    assert report["n"]["mae"] == pytest.approx((0 + 0.25) / 2)


def test_attribute_classes(spark):
    df = spark.createDataFrame([("a", 1, 2, 3.0)], "s string, x_id int, ca_zip int, price double")
    assert metrics.attribute_classes(df, df.columns) == {"s": "cat", "x_id": "cat", "ca_zip": "cat", "price": "num"}


def test_known_cells_and_splits(spark):
    catalog = star_catalog(spark, FOLDER)
    cells = sample.known_cells(catalog, "orders", ["o_orderstatus", "o_totalprice"], 50)
    assert {r["attr"]: r["count"] for r in cells.groupBy("attr").count().collect()} == {"o_orderstatus": 50, "o_totalprice": 50}
    split = catalog.table("orders").groupBy(sample.split_of(F.col("o_orderkey"), sample.SAMPLE_SPLIT).alias("s")).count()
    shares = {r["s"]: r["count"] / 1500 for r in split.collect()}
    assert shares["train"] == pytest.approx(0.6, abs=0.05) and shares["test"] == pytest.approx(0.2, abs=0.05)
    assert len(spark.range(1).select(draw(F.col("id"), "x", 1)).first()[0]) == 32


def test_round_trip_recovers_copied_attributes(spark):
    data = flows.make_dirty(star_catalog(spark, FOLDER), "orders", min_refs=1)
    found = flows.discover_paths(data.dirty, "orders", ORDER_SOURCES, data.attributes)
    copied = ["o_custkey_c_acctbal", "o_custkey_c_name"]
    assert [found[a][0].label for a in copied] == ["orders>(o_custkey,c_custkey)>customer"] * 2
    summary = flows.induced_summary(data.dirty, "orders", found)
    imputed, _ = flows.impute(data.dirty, "orders", found, summary)
    report = {r["attr"]: r for r in flows.report(data, imputed, "vote", copied).collect()}
    for a in copied:
        assert report[a]["accuracy"] == 1.0 and report[a]["count_not_added"] == 0
    before, after = data.dirty.table("orders"), imputed
    assert after.count() == before.count()
    untouched = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]
    assert tuples(after.select(untouched)) == tuples(before.select(untouched))


def test_weights_sum_to_one_along_all_paths(spark):
    catalog = star_catalog(spark, FOLDER)
    paths = [parse_path(catalog, label) for label in ("customer>(c_custkey,o_custkey)>orders", "customer>(c_nationkey,n_nationkey)>nation")]
    found = flows.known_candidates(catalog, "customer", {"c_mktsegment": paths})
    sums = score.softmax(score.default_score(found)).groupBy("qid", "attr").agg(F.sum("weight").alias("s"), F.count(F.lit(1)).alias("n"))
    assert sums.where(F.abs(F.col("s") - 1) > 1e-9).isEmpty()
    assert sums.agg(F.max("n")).first()[0] > 6 and instances.top_instances(found, paths, 5).count() < found.count()


def test_fitted_scorer_prefers_rows_that_hold_the_truth(spark):
    data = flows.make_dirty(star_catalog(spark, FOLDER), "customer", min_refs=1, also=["supplier"])
    labels = ("customer>(c_nationkey,n_nationkey)>nation", "customer>(c_custkey,o_custkey)>orders")
    by_attribute = {"c_nationkey_n_name": [parse_path(data.dirty, label) for label in labels]}
    stored = embed.database_vectors(data.dirty, "customer", ["nation", "orders"])
    assert stored.where("table = 'customer'").isEmpty()
    scorer = flows.train_scorer(data.dirty, "customer", by_attribute, n=0, embeddings=stored)
    summary = spark.createDataFrame([("c_nationkey_n_name", by_attribute["c_nationkey_n_name"][0].path_id, "n_name", 1, 1.0)], induce.PATH_SUMMARY)
    found = flows.known_candidates(data.dirty, "customer", by_attribute, embeddings=stored)
    weighted_ = score.softmax(flows.scored(found, by_attribute, None, scorer))
    means = {r["held"]: r["w"] for r in weighted_.groupBy(F.col("hits").isNotNull().alias("held")).agg(F.avg("weight").alias("w")).collect()}
    assert means[True] > means[False]
    imputed, _ = flows.impute(data.dirty, "customer", by_attribute, summary, stored, scorer)
    report = flows.report(data, imputed, "scored", list(by_attribute)).where("attr <> 'all'").first()
    assert report["accuracy"] == 1.0


def test_registry_is_consistent():
    names = set(suites.all_queries())
    assert set(suites.all_sql()) <= names
    assert names - set(suites.all_sql()) == {"row_embeddings", "scorer_fit"}


ORACLE = [
    "fk_edges_hubs", "inject_report", "composite_key", "containment_index", "minhash_columns", "lsh_containment", "path_2hop", "path_fanout_guard", "sample_known_cells",
    "fk_closure", "entity_ids", "numeric_prep", "path_topk", "candidate_softmax", "impute_top1", "eval_report",
]


@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations"):
        con.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = suites.all_queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    answer = con.sql(suites.all_sql()[name])
    assert sorted(answer.columns) == columns
    places = [answer.columns.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in places) for r in answer.fetchall()), key=repr)
    assert ours == theirs


def test_every_candidate_of_a_cell_counts_and_text_is_written_as_found(spark, make_catalog):
    hubs = [(str(9007199254740993 + i), "00501" if i < 400 else "501" if i < 700 else "1E5", 1) for i in range(1000)]
    catalog = make_catalog(
        q=("k", {}, [(1, None), (2, "x")], "k bigint, zip string"),
        h=("id", {"q": "q"}, hubs, "id string, code string, q bigint"),
    )
    path = parse_path(catalog, "q>(k,q)>h")
    summary = spark.createDataFrame([("zip", path.path_id, "code", 1, 1.0)], induce.PATH_SUMMARY)
    imputed, voted = flows.impute(catalog, "q", {"zip": [path]}, summary)
    voted = voted.withColumn("w", F.round("w", 9))
    assert tuples(voted, "value", "text", "w", "r") == [("100000", "1E5", 0.3, 300.0), ("501", "00501", 0.7, 700.0)]
    assert tuples(imputed, "k", "zip") == [(1, "00501"), (2, "x")]


def test_canonical_numbers_keep_every_digit(spark):
    rows = [("9007199254740993",), (" +009007199254740993.00",), ("-0",), ("00.0",), ("12345678901234567890",), ("1E5",), ("0.50",), ("5f",), ("x",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    got = [r[0] for r in df.select(text.normalize_value(F.col("s"))).collect()]
    assert got == ["9007199254740993", "9007199254740993", "0", "0", "12345678901234567890", "100000", "0.5", "5f", "x", None]
    wide = spark.sql("SELECT 9007199254740993L AS b, CAST('9007199254740993' AS DECIMAL(20,0)) AS d, CAST('9007199254740993.00' AS DECIMAL(20,2)) AS e, 1e15D AS f")
    types = {f.name: f.dataType for f in wide.schema.fields}
    assert list(wide.select(*[text.canonical_text(F.col(c), t) for c, t in types.items()]).first()) == ["9007199254740993"] * 3 + ["1000000000000000"]


def test_summary_sees_candidates_of_a_kind_once(make_catalog, monkeypatch):
    """A row of 60 lines, 20 of which hold its state, is two rows to the weights, and the summary counts what it did."""
    lines = [(i, i % 3, "open" if i % 9 == 0 else "shut") for i in range(180)]
    catalog = make_catalog(
        o=("k", {}, [(0, "open"), (1, "shut"), (2, None), (2, "shut")], "k bigint, state string"), l=("lk", {"k": "o"}, lines, "lk bigint, k bigint, mark string"),
    )
    seen = []
    whole = flows.score.softmax
    monkeypatch.setattr(flows.score, "softmax", lambda found: seen.append(found) or whole(found))
    paths = {"state": [parse_path(catalog, "o>(k,k)>l")]}
    summary = flows.induced_summary(catalog, "o", paths)
    assert tuples(summary, "col", "n", "ratio") == [("mark", 20 + 60 + 60, 1.0)]
    assert sorted(r["copies"] for r in seen[0].collect()) == [20, 40, 60, 60]
    assert not {"instance_id", "row_ids"} & set(seen[0].columns)


def test_steps_of_a_cell_share_its_highest_one(spark):
    found = spark.createDataFrame([("a", "x", 1200.0), ("a", "x", 499.0), ("a", "x", 1200.0), ("b", "x", -700.0), ("b", "x", None)], "qid string, attr string, score double")
    weights = sorted((r["qid"], r["weight"]) for r in score.softmax(found).collect() if r["weight"] is not None)
    assert weights == [("a", pytest.approx(0.0, abs=1e-200)), ("a", 0.5), ("a", 0.5), ("b", 1.0)]


@pytest.mark.parametrize("width", [40])
def test_hits_of_a_wide_row_are_short_code(spark, make_catalog, width):
    """The code that compares a row with the truth does not grow by a test per column."""
    names = [f"c{i}" for i in range(width)]
    catalog = make_catalog(
        q=("k", {}, [(1, "v7")], "k int, a string"), t=("tk", {"k": "q"}, [(5, 1, *[f"v{i % 8}" for i in range(width)])], f"tk int, k int, {', '.join(f'{c} string' for c in names)}"),
    )
    found = flows.known_candidates(catalog, "q", {"a": [parse_path(catalog, "q>(k,k)>t")]})
    assert [c for c in found.first()["hits"] if c] == [c for i, c in enumerate(names) if i % 8 == 7]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" in plan and plan.count("Unknown") <= 4


def test_similarities_behind_a_hub_are_those_of_each_pair(make_catalog, monkeypatch):
    """Blocks give every candidate the similarities that joining the two vectors gives it; nulls, zeros and rows without a vector too."""
    from relimpute.operators import vectors

    monkeypatch.setattr(vectors, "PAIRS", 40)
    spots = [f"n{i % 3}" if i % 5 else None for i in range(60)]
    catalog = make_catalog(
        q=("k", {"h": "h"}, [(i, i % 4 if i % 9 else None, spots[i], "red" if i % 2 else None) for i in range(60)] + [(7, 1, "n1", "red")], "k int, h int, a string, b string"),
        h=("h", {}, [(i,) for i in range(4)], "h int"), s=("sk", {"h": "h"}, [(i, i % 4, f"n{i % 3}", None if i % 7 == 0 else "red") for i in range(40)], "sk int, h int, a string, c string"),
    )
    path = parse_path(catalog, "q>(h,h)>h>(h,h)>s")
    stored = embed.database_vectors(catalog, "q", ["s", "h"]).where("row_id <> '3'")
    stored = stored.withColumn("embedding", F.when(F.col("row_id") == "8", F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    for found in (flows.known_candidates(catalog, "q", {"a": [path]}, embeddings=stored), flows.missing_candidates(catalog, "q", {"a": [path]}, embeddings=stored)):
        assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
        known = "truth" in found.columns
        rows = instances.query_rows(catalog, "q", [path], instances.known(catalog, "q", ["a"]) if known else instances.missing(["a"]))
        each = instances.path_instances(catalog, rows, [path], payload=True, attrs={path.path_id: ["a"]}, match=known)
        each = instances.assemble(vectors.path_similarity(each, [path], stored), instances.attribute_paths(catalog.spark, {"a": [path]}))
        want = vectors.asked_similarity(each, {path.path_id: "s"}, flows.asked_vectors(catalog, "q", ["a"], known, stored), stored)
        columns = ["qid", "attr", "path_id", "instance_id", F.round("sim", 9), F.round("query_sim", 9), F.to_json("row_ids"), *([F.to_json("hits"), "truth"] if known else [F.to_json("payload")])]
        got = tuples(found, *columns)
        assert got == tuples(want, *columns) and len(got) >= 100 and found.where("query_sim IS NULL").count() > 0
