"""Evaluation of imputed runs: error metrics per attribute and overall, and ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relimpute.functions.ranking import exact_quantiles
from relimpute.functions.text import as_double, canonical_text, normalize_value
from relimpute.operators.profile import clean_stats
from relimpute.session import cut_lineage
from relimpute.sources.catalog import Catalog

BINS = 20
EPSILON = 0.1
# fixed values: suffixes of numeric columns that hold codes
CODE_SUFFIXES = ("_id", "_zip", "street_number")
Q_NAMES = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}
RANK_CUTS = (1, 3, 5)


def attribute_classes(df: DataFrame, attributes: Sequence[str], code_suffixes: Sequence[str] = CODE_SUFFIXES) -> dict[str, str]:
    """`cat` for strings and code-like names, else `num`."""
    classes = {}
    for a in attributes:
        numeric = isinstance(df.schema[a].dataType, T.NumericType)
        classes[a] = "num" if numeric and not a.endswith(tuple(code_suffixes)) else "cat"
    return classes


def class_table(df: DataFrame, attributes: Sequence[str], code_suffixes: Sequence[str] = CODE_SUFFIXES) -> DataFrame:
    rows = list(attribute_classes(df, attributes, code_suffixes).items())
    return df.sparkSession.createDataFrame(rows, "attr string, class string")


def class_column(classes: dict[str, str]) -> Column:
    pairs = [x for pair in classes.items() for x in (F.lit(pair[0]), F.lit(pair[1]))]
    return F.element_at(F.create_map(*pairs), F.col("attr"))


def long_cells(catalog: Catalog, table: str, attributes: Sequence[str], name: str = "value") -> DataFrame:
    """(qid, attr, value) of a table in canonical text, null cells included."""
    df = catalog.table(table)
    wide = df.select(
        catalog.row_id(table).alias("qid"), *[canonical_text(F.col(a), df.schema[a].dataType).alias(a) for a in attributes]
    )
    return wide.unpivot(["qid"], list(attributes), "attr", name)


def _asked_rows(dirty: Catalog, clean: Catalog, table: str, attributes: Sequence[str]) -> DataFrame:
    """(qid, _gaps, _known): rows with null cells, which those are, and the clean texts of the row."""
    df, truth = dirty.table(table), clean.table(table)
    gaps = F.array_compact(F.array(*[F.when(F.col(a).isNull(), F.lit(a)) for a in attributes]))
    asked = df.select(dirty.row_id(table).alias("qid"), gaps.alias("_gaps")).where(F.size("_gaps") > 0)
    texts = [x for a in attributes for x in (F.lit(a), canonical_text(F.col(a), truth.schema[a].dataType))]
    known = truth.select(clean.row_id(table).alias("qid"), F.create_map(*texts).alias("_known"))
    return asked.join(known, "qid")


def eval_cells(dirty: Catalog, clean: Catalog, table: str, attributes: Sequence[str], keys: DataFrame | None = None) -> DataFrame:
    """(qid, attr, truth): null in the dirty table, known in the clean one, key among `keys` (qid).

    Dirty and clean rows meet once per row; cells are opened after the join.
    """
    joined = _asked_rows(dirty, clean, table, attributes)
    if keys is not None:
        joined = joined.join(keys.select("qid"), "qid", "left_semi")
    opened = joined.select("qid", F.explode("_gaps").alias("attr"), "_known")
    return opened.select("qid", "attr", F.element_at("_known", F.col("attr")).alias("truth")).where(F.col("truth").isNotNull())


def wide_run(catalog: Catalog, table: str, method: str, attributes: Sequence[str]) -> DataFrame:
    """An imputed table as a long run (method, qid, attr, value)."""
    return long_cells(catalog, table, attributes).select(F.lit(method).alias("method"), "qid", "attr", "value")


def union_runs(runs: Sequence[DataFrame], include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """All runs together; a run may lack columns, and methods can be picked or left out."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run, allowMissingColumns=True)
    if include:
        out = out.where(F.col("method").isin(*include))
    return out.where(~F.col("method").isin(*exclude)) if exclude else out


def judged(cells: DataFrame, runs: DataFrame, classes: dict[str, str], stats: DataFrame) -> DataFrame:
    """Every evaluable cell of every method with its prediction, and what became of it.

    A missing prediction of a numeric cell reads the clean median; it counts as `not_added`, as
    does a prediction of the wrong class, which takes no further part (`used` is false). Truth and
    prediction come in canonical text, where numeric-aware equality is plain equality.
    """
    predicted = runs.select("method", "qid", "attr", F.col("value").alias("pred"))
    return _judge(cells.join(predicted, ["qid", "attr"]), classes, stats)


def judged_tables(
    dirty: Catalog, clean: Catalog, table: str, attributes: Sequence[str], runs: dict[str, DataFrame], classes: dict[str, str], stats: DataFrame,
) -> DataFrame:
    """`judged` for imputed tables (method -> table): rows meet on their key, and only the null cells are opened after that.

    The wanted cells of a row travel as one array, so neither the known cells nor the long form of a run is exchanged.
    """
    asked = _asked_rows(dirty, clean, table, attributes)
    parts = None
    for method, df in runs.items():
        own = clean.with_tables(**{table: df})
        texts = [x for a in attributes if a in df.columns for x in (F.lit(a), canonical_text(F.col(a), df.schema[a].dataType))]
        texts = F.create_map(*texts) if texts else F.create_map().cast("map<string,string>")
        answers = df.select(own.row_id(table).alias("qid"), texts.alias("_pred"))
        # a run may hold part of the attributes only
        answered = F.array_intersect("_gaps", F.array(*[F.lit(a) for a in attributes if a in df.columns]).cast("array<string>"))
        part = asked.withColumn("_gaps", answered).join(answers, "qid").select(F.lit(method).alias("method"), "qid", F.explode("_gaps").alias("attr"), "_known", "_pred")
        part = part.select("method", "qid", "attr", F.element_at("_known", F.col("attr")).alias("truth"), F.element_at("_pred", F.col("attr")).alias("pred"))
        parts = part if parts is None else parts.unionByName(part)
    return _judge(parts.where(F.col("truth").isNotNull()), classes, stats)


def _judge(joined: DataFrame, classes: dict[str, str], stats: DataFrame) -> DataFrame:
    """Classes, statistics and errors of (method, qid, attr, truth, pred)."""
    joined = joined.withColumn("class", class_column(classes))
    # one row per attribute
    joined = joined.join(F.broadcast(stats), "attr", "left")
    number = F.col("class") == "num"
    told = as_double(F.col("pred")).isNotNull()
    base = joined.select(
        "method", "class", "attr", "qid", "truth", "pred", "min", "max",
        F.when(number, F.col("pred").isNull() | told).otherwise(~F.coalesce(told, F.lit(False))).alias("used"),
        F.when(number, as_double(F.col("truth"))).alias("t"),
        F.when(number, F.when(F.col("pred").isNull(), F.col("median")).otherwise(as_double(F.col("pred")))).alias("p"),
    )
    spread = F.nullif(F.col("max") - F.col("min"), F.lit(0.0))
    same = F.when(F.col("class") == "num", F.col("t") == F.col("p")).otherwise(F.col("truth") == F.col("pred"))
    return base.select(
        "method", "class", "attr", "qid", "truth", "pred", "used",
        (F.col("pred").isNull() | ~F.col("used")).alias("not_added"), "t", "p",
        ((F.col("t") - F.col("min")) / spread).alias("ts"), ((F.col("p") - F.col("min")) / spread).alias("ps"),
        F.coalesce(same, F.lit(False)).cast("int").alias("hit"),
    )


def q_error(t: Column, p: Column, epsilon: float = EPSILON) -> Column:
    """max(p/t, t/p) rounded to four digits; zeros read ±epsilon, opposite signs give NULL."""
    p1 = F.when(p == 0, F.when(t > 0, epsilon).otherwise(-epsilon)).otherwise(p)
    t1 = F.when(t == 0, F.when(p1 > 0, epsilon).otherwise(-epsilon)).otherwise(t)
    return F.when(p * t >= 0, F.round(F.greatest(p1 / t1, t1 / p1), 4))


def accuracy(judged_cells: DataFrame, by: Sequence[str] = ("method", "attr")) -> DataFrame:
    return judged_cells.where("used").groupBy(*by).agg(F.avg("hit").alias("accuracy"))


def absolute_errors(judged_cells: DataFrame, t: str = "ts", p: str = "ps", by: Sequence[str] = ("method", "attr")) -> DataFrame:
    """MAE and RMSE, on min-max scaled values unless raw columns are named."""
    d = F.col(p) - F.col(t)
    return judged_cells.where(F.col(p).isNotNull()).groupBy(*by).agg(
        F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse")
    )


def mape(judged_cells: DataFrame, by: Sequence[str] = ("method", "attr")) -> DataFrame:
    """Mean absolute percentage error on raw values; zero truths are counted, not averaged."""
    share = F.abs((F.col("t") - F.col("p")) / F.nullif(F.col("t"), F.lit(0.0)))
    return judged_cells.where(F.col("p").isNotNull()).groupBy(*by).agg(
        (F.avg(share) * 100).alias("mape"), F.count_if(F.col("t") == 0).alias("zero_truths")
    )


def js_distance(judged_cells: DataFrame, by: Sequence[str] = ("method", "attr"), t: str = "t", p: str = "p", bins: int = BINS) -> DataFrame:
    """Jensen-Shannon distance between the histograms of truth and prediction.

    Equal-width bins over the truth; predictions outside take no part. Counts per bin are combined
    map-side, the distance is formed from at most `bins` rows per group.
    """
    by = list(by)
    values = judged_cells.where(F.col(p).isNotNull()).select(*by, F.col(t).alias("_t"), F.col(p).alias("_p"))
    ends = values.groupBy(*by).agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"))
    flat = F.col("_a") == F.col("_b")
    ends = ends.select(*by, F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_lo"), F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_hi"))

    def bin_of(x: Column) -> Column:
        place = F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
        return F.when(x.between(F.col("_lo"), F.col("_hi")), F.least(place, F.lit(bins - 1)))

    sides = F.array(F.struct(bin_of(F.col("_t")).alias("bin"), F.lit(1).alias("a"), F.lit(0).alias("b")),
                    F.struct(bin_of(F.col("_p")).alias("bin"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    # one row per method and attribute
    opened = values.join(F.broadcast(ends), by).select(*by, F.explode(sides).alias("s")).where(F.col("s.bin").isNotNull())
    counted = opened.groupBy(*by, "s.bin").agg(F.sum("s.a").alias("a"), F.sum("s.b").alias("b"))
    totals = counted.groupBy(*by).agg(F.sum("a").alias("_ta"), F.sum("b").alias("_tb"))
    x, y = F.col("a") / F.col("_ta"), F.col("b") / F.nullif(F.col("_tb"), F.lit(0))
    m = (x + y) / 2

    def part(v: Column) -> Column:
        return F.when(v > 0, v * F.log(v / m)).otherwise(F.when(v == 0, F.lit(0.0)))

    summed = counted.join(totals, by).groupBy(*by).agg((F.sum(part(x)) / 2 + F.sum(part(y)) / 2).alias("_js"))
    return summed.select(*by, F.sqrt(F.greatest(F.col("_js"), F.lit(0.0))).alias("js"))


def q_error_quantiles(judged_cells: DataFrame, by: Sequence[str] = ("method", "attr")) -> DataFrame:
    """q25, q50, q75, q90 and the number of usable pairs."""
    by = list(by)
    errors = judged_cells.select(*by, q_error(F.col("t"), F.col("p")).alias("q"))
    rows = exact_quantiles(errors, by, "q", list(Q_NAMES.values()))
    picks = [F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(name) for name, p in Q_NAMES.items()]
    return rows.groupBy(*by).agg(*picks, F.max("n").alias("q_count"))


def with_totals(judged_cells: DataFrame) -> DataFrame:
    """Every cell once for its attribute and once for the `all` row of its class."""
    return judged_cells.withColumn("attr", F.explode(F.array("attr", F.lit("all"))))


def eval_report(judged_cells: DataFrame) -> DataFrame:
    """One row per (method, class, attribute) and one `all` row per (method, class).

    The judged cells are written once, since sums, histograms and quantiles each read them. All
    three combine map-side, so an attribute with most of the cells is no hot spot.
    """
    by = ["method", "class", "attr"]
    rows = with_totals(cut_lineage(judged_cells.drop("qid", "truth", "pred")))
    d = F.when(F.col("used"), F.col("ps") - F.col("ts"))
    share = F.abs((F.col("t") - F.col("p")) / F.nullif(F.col("t"), F.lit(0.0)))
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_cells"),
        F.count_if("used").alias("_used"),
        F.count_if("not_added").alias("count_not_added"),
        F.avg(F.when(F.col("used"), F.col("hit"))).alias("accuracy"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(F.abs(d)).alias("mae"),
        (F.avg(share) * 100).alias("mape"),
    )
    # the overall row counts the predictions that took part, an attribute row all its cells
    base = base.withColumns(
        {
            "missing_cnt": F.when(F.col("attr") == "all", F.col("_used")).otherwise(F.col("_cells")),
            "ratio_not_added": F.col("count_not_added") / F.col("_cells"),
        }
    )
    numeric = rows.where(F.col("class") == "num")
    joined = base.join(js_distance(numeric, by, "ts", "ps"), by, "left").join(q_error_quantiles(numeric, by), by, "left")
    return joined.select(
        *by, "missing_cnt", "count_not_added", "ratio_not_added", "accuracy", "rmse", "mae", "mape", "js",
        *Q_NAMES, "q_count",
    )


def full_report(judged_cells: DataFrame, stats: DataFrame, distinct: DataFrame, times: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """`eval_report` with what a comparison of methods prints beside the errors.

    Adds train_time and test_time of the method; max and min of the clean column (`stats`), its number of distinct values
    (`distinct`: attr, ndv); zero_truths, which the percentage error leaves out; and redundancy, the share of cells
    whose truth some candidate holds (`coverage`: attr, valid_rate), -1 where it is not known. All of these have a
    row per attribute or method.
    """
    judged_cells = cut_lineage(judged_cells)
    by = ["method", "class", "attr"]
    zeros = with_totals(judged_cells.select(*by, "t")).groupBy(*by).agg(F.count_if(F.col("t") == 0).alias("zero_truths"))
    report = eval_report(judged_cells).join(zeros, by, "left").join(F.broadcast(times.select("method", "train_time", "test_time")), "method", "left")
    report = report.join(F.broadcast(stats.select("attr", F.col("max").alias("max_value"), F.col("min").alias("min_value"))), "attr", "left")
    report = report.join(F.broadcast(distinct.select("attr", F.col("ndv").alias("unique_cnt"))), "attr", "left")
    if coverage is None:
        return report.withColumn("redundancy", F.lit(-1.0))
    known = F.broadcast(coverage.select("attr", F.col("valid_rate").alias("redundancy")))
    return report.join(known, "attr", "left").withColumn("redundancy", F.coalesce("redundancy", F.lit(-1.0)))


def numeric_stats(clean: Catalog, table: str, attributes: Sequence[str]) -> DataFrame:
    return clean_stats(clean.table(table), list(attributes))


def default_rankings(truths: DataFrame, run: DataFrame, stats: DataFrame) -> DataFrame:
    """The run, with the clean median at score 1 for cells it does not answer."""
    answered = run.select("qid", "attr").distinct()
    open_cells = truths.select("qid", "attr").join(answered, ["qid", "attr"], "left_anti")
    median = normalize_value(F.col("median").cast("string"))
    filled = open_cells.join(F.broadcast(stats.select("attr", "median")), "attr").where(F.col("median").isNotNull())
    defaults = filled.select("qid", "attr", median.alias("value"), F.lit(1.0).alias("score"))
    return run.select("qid", "attr", "value", "score").unionByName(defaults)


def rank_metrics(truths: DataFrame, run: DataFrame) -> DataFrame:
    """Reciprocal rank, nDCG and success per query cell that has both a truth and a ranking.

    The rank of the truth is one plus the number of values ahead of it (score desc, value desc), a
    count that combines map-side, so no ranking is sorted however long it is.
    """
    truth = truths.select("qid", "attr", F.col("value").alias("truth"))
    # met once and written: the truth's own score is needed before anything can be ahead of it
    met = cut_lineage(run.join(truth, ["qid", "attr"]).select("qid", "attr", "value", "score", "truth"))
    own = met.where(F.col("value") == F.col("truth")).groupBy("qid", "attr").agg(F.max("score").alias("own"))
    met = met.join(own, ["qid", "attr"], "left")
    ahead = (F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("value") > F.col("truth")))
    placed = met.groupBy("qid", "attr").agg(F.max("own").alias("_own"), F.count_if(ahead).alias("_ahead"))
    rank = F.when(F.col("_own").isNotNull(), F.col("_ahead") + 1)
    gains = [
        F.when(rank <= k, 1 / F.log2(rank + 1)).otherwise(0.0).alias(f"ndcg_cut_{k}") for k in RANK_CUTS
    ]
    return placed.select(
        "qid", "attr", F.coalesce(1 / rank, F.lit(0.0)).alias("recip_rank"), *gains,
        F.when(rank == 1, 1.0).otherwise(0.0).alias("success_1"),
    )


def rank_metrics_grouped(metrics: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Means per group: `all`, `num`, `cat` and every attribute."""
    groups = F.array(F.lit("all"), class_column(classes), F.col("attr"))
    names = ["recip_rank", *[f"ndcg_cut_{k}" for k in RANK_CUTS], "success_1"]
    opened = metrics.withColumn("group_name", F.explode(groups))
    return opened.groupBy("group_name").agg(F.count(F.lit(1)).alias("group_count"), *[F.avg(n).alias(n) for n in names])


def imputed_counts(dirty: Catalog, table: str, runs: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(method, test_time, total_impute): dirty nulls that a run fills."""
    gaps = long_cells(dirty, table, attributes).where(F.col("value").isNull()).select("qid", "attr")
    filled = runs.where(F.col("value").isNotNull())
    times = [c for c in ("test_time",) if c in runs.columns]
    return filled.join(gaps, ["qid", "attr"], "left_semi").groupBy("method", *times).agg(F.count(F.lit(1)).alias("total_impute"))


