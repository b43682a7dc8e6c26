from __future__ import annotations

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from relimpute.functions.text import normalize_value, values_equal
from relimpute.operators import denorm, features, inject, profile
from relimpute.operators.denorm import Hub
from relimpute.plans import flows
from relimpute.plans.star import star_catalog
from relimpute.sources import catalog as keys
from relimpute.sources import io
from relimpute.sources.catalog import Catalog, TableSpec, parse_schema


def test_schema_splits_composite_keys():
    specs = parse_schema('{"T": {"pkey_col": "A , b", "fkey_col_to_pkey_table": {"A": "p"}}}')
    assert specs["T"].pk == ("a", "b") and specs["T"].key == "a__b" and specs["T"].fks == (("a", "p"),)


def test_composite_key_keeps_foreign_parts_and_splits_back(spark):
    spec = TableSpec("t", ("a", "b"), (("a", "p"),))
    df = keys.normalize_key(spark.createDataFrame([(1, 7, "x"), (2, None, "y")], "a int, b int, c string"), spec)
    assert sorted(df.columns) == ["a", "a__b", "c"]
    assert [r["a__b"] for r in df.orderBy("a").collect()] == ["1__7", "2__nan"]
    assert tuples(keys.split_key(df, spec).where("c = 'x'"), "a", "b") == [(1, 7)]


def test_narrowing_keeps_fractions(spark):
    df = spark.createDataFrame([(1.0, 1.5, None), (None, 2.0, None), (3.0, None, None)], "a double, b double, c double")
    out = keys.narrow_whole_numbers(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "double", "bigint"]
    assert [r["a"] for r in out.collect()] == [1, None, 3]


def test_csv_database_with_override_and_null_flag(spark, tmp_path):
    (tmp_path / "t.csv").write_text("ID,V\n1,a\n2,b\n")
    (tmp_path / "dirty.csv").write_text("ID,V\n1,?\n2,b\n")
    catalog = Catalog.from_json(spark, '{"t": {"pkey_col": "id", "fkey_col_to_pkey_table": {}}}')
    plain = catalog.load(str(tmp_path)).table("t")
    assert plain.columns == ["id", "v"] and tuples(plain) == [(1, "a"), (2, "b")]
    dirty = catalog.load(str(tmp_path), overrides={"t": str(tmp_path / "dirty.csv")}, null_flag="?").table("t")
    assert tuples(dirty) == [(1, None), (2, "b")]


def test_runs_rankings_embeddings_and_reuse(spark, tmp_path):
    for name, value in (("orders_s_vote_10_3.csv", "a"), ("orders_s_mean_1_2.5.csv", "b")):
        (tmp_path / name).write_text(f"id,v\n1,{value}\n")
    runs = io.read_runs(spark, str(tmp_path / "orders_*.csv"))
    assert tuples(runs, "method", "train_time", "test_time", "v") == [("mean", 1.0, 2.5, "b"), ("vote", 10.0, 3.0, "a")]
    ranked = spark.createDataFrame([("1", "x_y", "A", 2.0), ("1", "x_y", "B", 1.0), ("2", "x_y", "A", 1.0)], io.RANKING_SCHEMA)
    io.write_rankings(ranked, str(tmp_path / "rank"))
    assert tuples(io.read_rankings(spark, str(tmp_path / "rank"))) == tuples(ranked)
    assert io.read_embeddings(spark, str(tmp_path / "none")).count() == 0
    stored = spark.createDataFrame([("t", "1", [0.5, 1.0])], io.EMBEDDING_SCHEMA)
    io.write_embeddings(stored, str(tmp_path / "emb"))
    assert tuples(io.read_embeddings(spark, str(tmp_path / "emb"))) == tuples(stored)
    io.write_table(ranked, str(tmp_path / io.dirty_name("t", 0.2)))
    assert spark.read.option("header", True).csv(str(tmp_path / "t_all_columns_20")).count() == 3


def test_nested_rankings_of_merged_keys(spark, tmp_path):
    ranked = spark.createDataFrame([("5__9", "a__b", "A", 2.0), ("5__9", "c", "B", 1.0)], io.RANKING_SCHEMA)
    io.write_rankings(ranked, str(tmp_path / "rank"))
    assert tuples(io.read_rankings(spark, str(tmp_path / "rank"))) == tuples(ranked)
    # lines that only have the name
    (tmp_path / "other.json").write_text('{"query": "q__5__9__c", "docs": {"B": 1.0}}')
    assert tuples(io.read_rankings(spark, str(tmp_path / "other.json"))) == [("5__9", "c", "B", 1.0)]


def test_reuse_follows_plan_inputs_and_whole_writes(spark, tmp_path):
    source, kept = str(tmp_path / "source"), str(tmp_path / "kept")
    spark.range(10).write.parquet(source)

    def sums(n):
        return io.reuse(spark, kept, lambda: spark.read.parquet(source).where(F.col("id") < n).agg(F.sum("id").alias("s")))

    def folders():
        return sorted(p for p in (tmp_path / "kept").iterdir())

    assert sums(5).first()["s"] == 10 and len(folders()) == 1
    # the same again is read, not computed: a changed stored value shows
    spark.createDataFrame([(99,)], "s bigint").write.mode("overwrite").parquet(str(folders()[0]))
    assert sums(5).first()["s"] == 99
    assert sums(6).first()["s"] == 15 and len(folders()) == 2
    # a broken write is written anew
    (folders()[0] / "_SUCCESS").unlink()
    (folders()[1] / "_SUCCESS").unlink()
    assert sums(5).first()["s"] == 10 and sums(6).first()["s"] == 15 and len(folders()) == 2
    # other input files, other result
    spark.range(3, 4).write.mode("append").parquet(source)
    assert sums(5).first()["s"] == 13 and len(folders()) == 3


def test_folder_of_runs_to_report(spark, make_catalog, tmp_path):
    """Three methods: merged keys, key parts apart with `_imputed` columns, and one that is left out."""
    rows = [(i, i % 2, float(i), "ab"[i % 2], 0.0 if i < 4 else 2.0) for i in range(8)]
    types = "a bigint, b bigint, v double, s string, z double"
    catalog = make_catalog(t=("a, b", {}, rows, types))
    holes = spark.createDataFrame([(a, b, None if a < 4 else v, None if a < 2 else s, None if a == 1 or a == 5 else z) for a, b, v, s, z in rows], types)
    data = flows.Redundant(catalog, catalog.with_tables(t=holes), "t", ["v", "s", "z"])
    (tmp_path / "t_x_vote_10_2.5.csv").write_text("a__b,V,s,z\n" + "\n".join(f"{a}__{b},{v},{s},{z + 1}" for a, b, v, s, z in rows))
    (tmp_path / "t_x_mean_1_n.csv").write_text("a,b,v,v_imputed\n" + "\n".join(f"{a}.0,{b},,{v + 7}" for a, b, v, s, z in rows))
    (tmp_path / "t_x_bad_1_1.csv").write_text("nothing\n1\n")
    coverage = spark.createDataFrame([("v", 0.75)], "attr string, valid_rate double")
    report = {(r["method"], r["attr"]): r for r in flows.report_runs(data, str(tmp_path / "t_x_*.csv"), ["v", "s", "z"], exclude=["bad"], coverage=coverage).collect()}
    assert {k for k in report if k[1] != "all"} == {("vote", "v"), ("vote", "s"), ("vote", "z"), ("mean", "v")}
    r = report["vote", "v"]
    assert (r["missing_cnt"], r["accuracy"], r["mae"], r["train_time"], r["test_time"], r["max_value"], r["min_value"], r["unique_cnt"], r["redundancy"], r["zero_truths"]) == (4, 1.0, 0.0, 10.0, 2.5, 7.0, 0.0, 8, 0.75, 1)
    assert report["mean", "v"]["mae"] == pytest.approx(1.0) and report["mean", "v"]["test_time"] is None and report["mean", "v"]["accuracy"] == 0.0
    assert report["vote", "s"]["accuracy"] == 1.0 and report["vote", "s"]["redundancy"] == -1.0 and report["vote", "s"]["max_value"] is None
    assert report["vote", "z"]["zero_truths"] == 1 and report["vote", "z"]["missing_cnt"] == 2
    with pytest.raises(ValueError, match="no key"):
        flows.report_runs(data, str(tmp_path / "t_x_bad*.csv"), ["v"])
    with pytest.raises(ValueError, match="no runs"):
        flows.report_runs(data, str(tmp_path / "none*.csv"), ["v"])


def test_informative_columns_are_strict(make_catalog):
    rows = [(i, str(i % 5), None if i == 0 else str(i % 5), str(i), None if i < 2 else str(i)) for i in range(10)]
    catalog = make_catalog(h=("id", {}, rows, "id int, five string, five_and_null string, good string, gaps string"))
    kept = denorm.informative_columns(profile.column_profile(catalog, "h"))
    # five distinct values are too few, a null makes them six; eight of ten filled is not more than 0.8
    assert {r["col"] for r in kept.collect()} == {"five_and_null", "good"}


def test_denormalize_keeps_foreign_key_of_the_same_name_and_row_count(make_catalog):
    catalog = make_catalog(
        hub=("id", {}, [(1, "a"), (2, None)], "id int, v string"),
        t=("tid", {"id": "hub", "other": "hub"}, [(10, 1, 2), (11, None, 1), (12, 2, 1)], "tid int, id int, other int"),
    )
    out = denorm.denormalize(catalog, "t", [Hub("hub", ("v",))], verify=True)
    assert out.columns == ["tid", "id", "other", "id_v", "other_v"]
    assert tuples(out) == [(10, 1, 2, "a", None), (11, None, 1, None, "a"), (12, 2, 1, None, "a")]


def test_denormalize_composite_hub_and_repeated_key(make_catalog):
    catalog = make_catalog(
        hub=("a, b", {}, [(1, 2, "x"), (1, 3, "y")], "a int, b int, v string"),
        t=("tid", {"h": "hub"}, [(1, "1__3")], "tid int, h string"),
        bad=("k", {}, [(1, "x"), (1, "y")], "k int, v string"),
        u=("uid", {"k": "bad"}, [(1, 1)], "uid int, k int"),
    )
    assert tuples(denorm.denormalize(catalog, "t", [Hub("hub", ("v",))])) == [(1, "1__3", "y")]
    with pytest.raises(ValueError):
        denorm.denormalize(catalog, "u", [Hub("bad", ("v",))], verify=True)


def test_injection_is_repeatable_and_spares_keys(spark):
    df = spark.range(2000).select("id", F.lit("x").alias("v"), F.lit(1.0).alias("w"))
    one = inject.inject_missing(df, F.col("id"), ["v", "w"], 0.2)
    two = inject.inject_missing(df.repartition(7), F.col("id"), ["v", "w"], 0.2)
    assert tuples(one) == tuples(two)
    nulls = one.agg(F.count_if(F.col("v").isNull()), F.count_if(F.col("id").isNull())).first()
    assert 320 < nulls[0] < 480 and nulls[1] == 0
    everything = inject.inject_missing(df, F.col("id"), ["v"], 1.0)
    assert everything.where("v is not null").count() == 0
    exact = inject.inject_missing_exact(df, "id", "w", 0.2)
    assert exact.where("w is null").count() == 400 and exact.count() == 2000


def test_value_map_and_codes(spark):
    df = spark.createDataFrame([(1, "O"), (2, "F"), (3, "P"), (4, None), (5, "O")], "k int, s string")
    mapped = inject.map_values(df, "s", {"O": "open", "F": ""})
    assert [r["s"] for r in mapped.orderBy("k").collect()] == ["open", None, "", None, "open"]
    assert tuples(inject.unmapped_values(df, "s", {"O": "open", "F": ""})) == [("P", 1)]
    dirty = spark.createDataFrame([(1, None), (2, "F"), (3, "O")], "k int, s string")
    coded = inject.encode_strings(df, dirty, ["s"], "k")
    assert [r["s"] for r in coded.orderBy("k").collect()] == [None, 1, 0]


@pytest.mark.parametrize(
    ("values", "kind", "expected"),
    [
        ([1] * 5 + [2] * 6, "int", "cat"),
        ([1] * 4 + [2] * 6, "int", "num"),
        ([1.0, None, 2.0], "double", "num"),
        ([1.0, None] + [1.0] * 5, "double", "cat"),
        ([1.0, 2.0], "double", "num"),
        ([None, None], "double", None),
        (["a", "b"], "string", "cat"),
    ],
)
def test_semantic_types(make_catalog, values, kind, expected):
    catalog = make_catalog(t=("id", {}, list(enumerate(values)), f"id int, v {kind}"))
    found = {r["col"]: r["stype"] for r in profile.column_profile(catalog, "t").collect()}
    assert found["v"] == expected


def test_list_types(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1], ["a"], [1.0, float("nan")]), ([3.0, 4.0], [1, 2], ["b"], [1.0, 2.0])], "e array<double>, n array<int>, s array<string>, bad array<double>")
    assert dict(tuples(profile.list_types(df, ["e", "n", "s", "bad"]))) == {
        "e": "embedding", "n": "sequence_numerical", "s": "multicategorical", "bad": "sequence_numerical",
    }


def test_feature_preparation(spark):
    df = spark.createDataFrame([(1, "2", "b", "Yes"), (2, None, "a", None), (3, "2", None, "yes"), (4, "6", "b", "no")], "k int, n string, c string, b string")
    out = features.binary_prep(features.categorical_prep(features.numeric_prep(df, ["n"]), ["c"]), ["b"])
    # the tie of Yes, yes and no goes to the lowest text
    assert tuples(out) == [(1, 0.0, 1, 1), (2, 0.0, 0, 1), (3, 0.0, 1, 1), (4, 1.0, 1, 0)]
    strings = features.categorical_prep(df, ["c"], encode=False)
    assert [r["c"] for r in strings.orderBy("k").collect()] == ["b", "a", "b", "b"]


@pytest.mark.parametrize(
    ("a", "b", "equal"),
    [("1", "1.0", True), ("a", "a", True), ("1", "a", False), ("nan", "nan", False), ("1d", "1", False), ("1e2", "100", True), (" 2 ", "2", True)],
)
def test_numeric_aware_equality(spark, a, b, equal):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(values_equal(F.col("a"), F.col("b"))).first()[0] is equal


def test_normal_form(spark):
    texts = ["1.0", "01", "1.50", "1d", "abc", None, "1e20"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert [r[0] for r in df.select(normalize_value(F.col("v"))).collect()] == ["1", "1", "1.5", "1d", "abc", None, "1.0E20"]


def test_row_lookup_and_clean_stats(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", None), (3, "b", 6.0), (4, "b", 7.0)], "k int, s string, x double")
    assert tuples(io.find_rows(df, {"s": "b", "x": 6}), "k") == [(3,)]
    row = profile.clean_stats(df, ["x"]).first()
    assert (row["min"], row["max"], row["median"], row["ndv"]) == (2.0, 7.0, 6.0, 4)


def test_dimension_tables_are_dealt_over_the_cores(spark):
    """One file of one row group would be one task, whatever is computed per row."""
    catalog = star_catalog(spark, "/root/testdata/sf0.001")
    cores = spark.sparkContext.defaultParallelism
    for table in ("customer", "supplier", "part"):
        assert catalog.table(table).rdd.getNumPartitions() >= cores
