"""Queries over candidate weights, induction, voting, write-back and evaluation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relimpute.functions.text import normalize_value, values_equal
from relimpute.operators import embed, fallback, induce, metrics, profile, sample, score, vote
from relimpute.operators.graph import MetaPath
from relimpute.operators.instances import Bundles, opened
from relimpute.plans import flows
from relimpute.plans import sql as q
from relimpute.plans.registry import Registry
from relimpute.plans.star import star_catalog
from relimpute.plans.suite_paths import CUSTOMER_KNOWN, CUSTOMER_PATHS, HOME, NATION_NAME, TO_CUSTOMER, customer_paths, paths_of
from relimpute.plans.suite_tables import ORDER_SOURCES, clean, dirty, with_redundant_orders
from relimpute.session import cut_lineage
from relimpute.sources.catalog import Catalog

suite = Registry()

TO_ITEMS = "orders>(o_orderkey,l_orderkey)>lineitem"
HOPS = {q.path_id(label): (label.count(">") // 2) for label in CUSTOMER_PATHS}

# --- candidates of known customer cells -------------------------------------------------------

_CAND = (
    f"{CUSTOMER_KNOWN}, "
    "ca AS (SELECT qid, truth, path_id, instance_id, hops, name, CASE WHEN name = truth THEN 1 ELSE 0 END AS label FROM kn JOIN ci USING (qid)), "
    "rk AS (SELECT *, 1 AS rank FROM ca), "
    f"mt AS (SELECT *, CASE path_id WHEN '{q.path_id(HOME)}' THEN 'n_name' ELSE 's_nationkey_n_name' END AS col FROM rk WHERE rank <= 3 AND label = 1), "
    "sm AS (SELECT path_id, col, count(*) AS n, count(*) / sum(count(*)) OVER () AS ratio FROM mt GROUP BY 1, 2), "
    "sc AS (SELECT ca.*, coalesce(ratio, 0.0) AS score FROM ca LEFT JOIN sm USING (path_id)), "
    "mx AS (SELECT *, exp(score - max(score) OVER (PARTITION BY qid)) AS e FROM sc), "
    "wt AS (SELECT *, e / sum(e) OVER (PARTITION BY qid) AS weight FROM mx)"
)


def candidates(spark: SparkSession, folder: str) -> Bundles:
    catalog = dirty(clean(spark, folder), "customer")
    return flows.known_bundles(catalog, "customer", customer_paths(catalog))


def uniform(found: DataFrame) -> DataFrame:
    return score.softmax(score.default_score(found))


def weighted(found: Bundles) -> DataFrame:
    """Candidates weighed by the share of their path in the induced summary."""
    summary = induce.settle(induce.path_summary(induce.matching_columns(uniform(found.cells))))
    return score.softmax(score.default_score(found.cells, summary))


@suite.add("candidate_softmax", f"WITH {_CAND} SELECT qid, '{NATION_NAME}' AS attr, path_id, instance_id, round(score, 6) AS score, round(weight, 6) AS weight FROM wt")
def candidate_softmax(spark: SparkSession, folder: str) -> DataFrame:
    found = candidates(spark, folder)
    rounded = weighted(found).select("qid", "attr", "path_id", "bundle", "copies", F.round("score", 6).alias("score"), F.round("weight", 6).alias("weight"))
    return opened(rounded, found.held).select("qid", "attr", "path_id", "instance_id", "score", "weight")


@suite.add("truth_labels", f"WITH {_CAND} SELECT qid, '{NATION_NAME}' AS attr, path_id, instance_id, truth, CAST(label AS INTEGER) AS label FROM ca")
def truth_labels(spark: SparkSession, folder: str) -> DataFrame:
    found = candidates(spark, folder)
    labelled = score.label_candidates(found.cells).select("qid", "attr", "path_id", "bundle", "copies", "truth", "label")
    return opened(labelled, found.held).select("qid", "attr", "path_id", "instance_id", "truth", "label")


_LOSS = f"{_CAND}, ls AS (SELECT qid, -ln(sum(weight) + 1e-10) AS loss FROM wt WHERE label = 1 GROUP BY qid)"


@suite.add("marginal_nll", f"WITH {_LOSS} SELECT count(*) AS cells, round(coalesce(avg(loss), 0.0), 6) AS loss FROM ls")
def marginal_nll(spark: SparkSession, folder: str) -> DataFrame:
    return score.marginal_nll(score.label_candidates(weighted(candidates(spark, folder)))).withColumn("loss", F.round("loss", 6))


_SPLIT = f"substring({q.draw(f'qid || {NATION_NAME!r}', repr('split'))},1,8)"


@suite.add(
    "split_loss",
    f"WITH {_LOSS} SELECT CASE WHEN {_SPLIT} < '99999999' THEN 'train' WHEN {_SPLIT} < 'cccccccc' THEN 'valid' ELSE 'test' END AS split, count(*) AS cells, round(avg(loss), 6) AS loss FROM ls GROUP BY 1",
)
def split_loss(spark: SparkSession, folder: str) -> DataFrame:
    labelled = score.label_candidates(weighted(candidates(spark, folder)))
    cells = labelled.select("qid", "attr").distinct()
    splits = cells.withColumn("split", sample.split_of(F.concat("qid", "attr"), sample.SAMPLE_SPLIT))
    return score.split_loss(labelled, splits).withColumn("loss", F.round("loss", 6))


@suite.add("scorer_fit")
def scorer_fit(spark: SparkSession, folder: str) -> DataFrame:
    """A scorer fitted on the similarities of labelled candidates, and the weights it gives them."""
    catalog = dirty(clean(spark, folder), "customer")
    vectors_of = embed.database_vectors(catalog, "customer", ["nation", "supplier", "orders"])
    found = flows.known_candidates(catalog, "customer", customer_paths(catalog), embeddings=vectors_of)
    featured = cut_lineage(score.scorer_features(score.label_candidates(found), HOPS))
    scored = score.apply_scorer(score.fit_scorer(featured), featured)
    return score.softmax(scored).select("qid", "attr", "path_id", "instance_id", "label", F.round("weight", 4).alias("weight"))


# --- induction --------------------------------------------------------------------------------


@suite.add("induce_paths", f"WITH {_CAND} SELECT qid, '{NATION_NAME}' AS attr, path_id, instance_id, col FROM mt")
def induce_paths(spark: SparkSession, folder: str) -> DataFrame:
    found = candidates(spark, folder)
    return opened(induce.matching_columns(uniform(found.cells)), found.held).select("qid", "attr", "path_id", "instance_id", "col")


@suite.add("path_summary", f"WITH {_CAND} SELECT '{NATION_NAME}' AS attr, path_id, col, n, round(ratio, 6) AS ratio FROM sm")
def path_summary(spark: SparkSession, folder: str) -> DataFrame:
    return induce.path_summary(induce.matching_columns(uniform(candidates(spark, folder).cells))).withColumn("ratio", F.round("ratio", 6))


@suite.add("top_path", f"WITH {_CAND} SELECT '{NATION_NAME}' AS attr, path_id, col, n, round(ratio, 6) AS ratio FROM sm ORDER BY n DESC, path_id, col LIMIT 1")
def top_path(spark: SparkSession, folder: str) -> DataFrame:
    return induce.top_path(induce.matching_columns(uniform(candidates(spark, folder).cells))).withColumn("ratio", F.round("ratio", 6))


_FLAGS = (
    f"{_CAND}, fl AS (SELECT qid, '{NATION_NAME}' AS attr, CAST(1 AS INTEGER) AS \"notnull\", CAST(max(label) AS INTEGER) AS valid, "
    "CAST(max(CASE WHEN rank <= 3 THEN label ELSE 0 END) AS INTEGER) AS max FROM rk GROUP BY qid), "
    "cov AS (SELECT attr, CAST(sum(\"notnull\") AS BIGINT) AS cells, round(sum(valid) / sum(\"notnull\"), 6) AS valid_rate, round(sum(max) / sum(\"notnull\"), 6) AS max_rate FROM fl GROUP BY attr)"
)


def flags(spark: SparkSession, folder: str) -> DataFrame:
    return induce.induction_flags(uniform(candidates(spark, folder).cells))


def rates(found: DataFrame) -> DataFrame:
    return found.withColumns({"valid_rate": F.round("valid_rate", 6), "max_rate": F.round("max_rate", 6)})


@suite.add("induction_flags", f"WITH {_FLAGS} SELECT * FROM fl")
def induction_flags(spark: SparkSession, folder: str) -> DataFrame:
    return flags(spark, folder)


@suite.add("coverage", f"WITH {_FLAGS} SELECT * FROM cov")
def coverage(spark: SparkSession, folder: str) -> DataFrame:
    return rates(induce.coverage(flags(spark, folder)))


@suite.add("valid_attrs", f"WITH {_FLAGS} SELECT * FROM cov WHERE max_rate > 0.8")
def valid_attrs(spark: SparkSession, folder: str) -> DataFrame:
    return rates(induce.valid_attributes(flags(spark, folder)))


@suite.add("covered_attrs", f"WITH {_FLAGS} SELECT * FROM cov WHERE valid_rate > 0.95")
def covered_attrs(spark: SparkSession, folder: str) -> DataFrame:
    return rates(induce.covered_attributes(flags(spark, folder)))


# --- votes on orders --------------------------------------------------------------------------

_COPIES = {"o_custkey_c_name": ("c_name", "s"), "o_custkey_c_acctbal": ("c_acctbal", "d")}


def order_paths(catalog: Catalog) -> dict[str, list[MetaPath]]:
    to_customer, to_items = paths_of(catalog, TO_CUSTOMER), paths_of(catalog, TO_ITEMS)
    return {"o_orderstatus": to_items, **{a: to_customer for a in _COPIES}}


_ITEMS = (
    f"{q.ORD_X}, {q.LI}, it AS (SELECT l_orderkey, l_linestatus, md5(row_id) AS instance_id FROM li)"
)
_VOTES = (
    f"{_ITEMS}, vo AS (SELECT CAST(o_orderkey AS VARCHAR) AS qid, 'o_orderstatus' AS attr, l_linestatus AS value, sum(wt) AS w, CAST(count(*) AS DOUBLE) AS r FROM "
    "(SELECT o_orderkey, l_linestatus, 1.0::DOUBLE / count(*) OVER (PARTITION BY o_orderkey) AS wt FROM ord_x JOIN it ON o_orderkey = l_orderkey WHERE o_orderstatus IS NULL) GROUP BY 1, 2, 3 UNION ALL "
    + " UNION ALL ".join(
        f"SELECT CAST(o_orderkey AS VARCHAR), '{a}', {q.text(c, k)}, 1.0, 1.0 FROM ord_x JOIN customer ON o_custkey = c_custkey WHERE {a} IS NULL" for a, (c, k) in _COPIES.items()
    )
    + "), an AS (SELECT qid, attr, value, w, r FROM (SELECT *, row_number() OVER (PARTITION BY qid, attr ORDER BY round(w, 9) DESC, r DESC, value) AS p FROM vo) WHERE p = 1), "
    "ru AS (SELECT qid, attr, value, CAST(row_number() OVER (PARTITION BY qid, attr ORDER BY round(w, 9), r, value DESC) AS DOUBLE) AS score FROM vo)"
)
_QRELS = (
    "qr AS (SELECT qid, attr, value, CAST(1 AS INTEGER) AS rel FROM ("
    + " UNION ALL ".join(
        f"SELECT CAST(d.o_orderkey AS VARCHAR) AS qid, '{a}' AS attr, {q.text('d.' + a, k)} AS value FROM ord_d d"
        for a, k in (("o_orderstatus", "s"), *[(a, k) for a, (_, k) in _COPIES.items()])
    )
    + ") JOIN (SELECT qid, attr FROM an) USING (qid, attr))"
)


def orders_summary_of(catalog: Catalog) -> DataFrame:
    return flows.induced_summary(catalog, "orders", order_paths(catalog), n=0)


def order_votes(spark: SparkSession, folder: str) -> tuple[Catalog, Catalog, DataFrame]:
    """Clean and dirty catalog and the votes on every null cell of orders."""
    tidy = with_redundant_orders(spark, folder)
    catalog = dirty(tidy, "orders")
    _, voted = flows.impute(catalog, "orders", order_paths(catalog), orders_summary_of(catalog))
    # written once: answers, rankings and truths all come from it
    return tidy, catalog, cut_lineage(voted.drop("text"))


@suite.add(
    "orders_summary",
    f"WITH {_ITEMS}, kn AS (SELECT o_orderkey, o_orderstatus AS truth FROM ord_x WHERE o_orderstatus IS NOT NULL), "
    "mt AS (SELECT 1 FROM kn JOIN it ON o_orderkey = l_orderkey WHERE l_linestatus = truth) "
    f"SELECT 'o_orderstatus' AS attr, '{q.path_id(TO_ITEMS)}' AS path_id, 'l_linestatus' AS col, count(*) AS n, 1.0::DOUBLE AS ratio FROM mt UNION ALL "
    + " UNION ALL ".join(f"SELECT '{a}', '{q.path_id(TO_CUSTOMER)}', '{c}', count({a}), 1.0 FROM ord_x" for a, (c, _) in _COPIES.items()),
)
def orders_summary(spark: SparkSession, folder: str) -> DataFrame:
    return orders_summary_of(dirty(with_redundant_orders(spark, folder), "orders"))


@suite.add("vote", f"WITH {_VOTES} SELECT qid, attr, value, round(w, 6) AS w, round(r, 6) AS r FROM vo")
def votes(spark: SparkSession, folder: str) -> DataFrame:
    voted = order_votes(spark, folder)[2]
    return voted.withColumns({"w": F.round("w", 6), "r": F.round("r", 6)})


@suite.add("impute_top1", f"WITH {_VOTES} SELECT qid, attr, value, round(w, 6) AS w, round(r, 6) AS r FROM an")
def impute_top1(spark: SparkSession, folder: str) -> DataFrame:
    best = vote.answers(order_votes(spark, folder)[2])
    return best.withColumns({"w": F.round("w", 6), "r": F.round("r", 6)})


@suite.add("value_ranking", f"WITH {_VOTES} SELECT * FROM ru")
def value_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return vote.value_ranking(order_votes(spark, folder)[2])


@suite.add("qrels", f"WITH {_VOTES}, {_QRELS} SELECT * FROM qr")
def qrels(spark: SparkSession, folder: str) -> DataFrame:
    tidy, _, voted = order_votes(spark, folder)
    return vote.qrels(vote.answers(voted), tidy, "orders")


# --- write-back -------------------------------------------------------------------------------

_FILLED = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, coalesce(o_custkey_c_name, c_name) AS o_custkey_c_name, coalesce(o_custkey_c_acctbal, c_acctbal) AS o_custkey_c_acctbal"


def imputed_orders(spark: SparkSession, folder: str) -> tuple[flows.Redundant, DataFrame]:
    """Paths found in the data, induced on known cells, voted on and written back."""
    data = flows.make_dirty(star_catalog(spark, folder), "orders", min_refs=1)
    found = flows.discover_paths(data.dirty, "orders", ORDER_SOURCES, data.attributes)
    summary = flows.induced_summary(data.dirty, "orders", found)
    return data, flows.impute(data.dirty, "orders", found, summary)[0]


@suite.add("impute_orders", f"WITH {q.ORD_X} SELECT {_FILLED} FROM ord_x LEFT JOIN customer ON o_custkey = c_custkey")
def impute_orders(spark: SparkSession, folder: str) -> DataFrame:
    return imputed_orders(spark, folder)[1]


def filled_orders(spark: SparkSession, folder: str) -> tuple[Catalog, Catalog, DataFrame]:
    """Clean and dirty catalog and orders with the copied attributes filled along the customer path."""
    tidy = with_redundant_orders(spark, folder)
    catalog = dirty(tidy, "orders")
    to_customer = paths_of(catalog, TO_CUSTOMER)
    pairs = [(a, to_customer[0].path_id, c, 1, 1.0) for a, (c, _) in _COPIES.items()]
    summary = spark.createDataFrame(pairs, induce.PATH_SUMMARY)
    return tidy, catalog, flows.impute(catalog, "orders", {a: to_customer for a in _COPIES}, summary)[0]


@suite.add(
    "impute_keys",
    f"WITH {q.ORD_X} SELECT {_FILLED} FROM ord_x LEFT JOIN customer ON o_custkey = c_custkey WHERE o_custkey_c_name IS NULL",
)
def impute_keys(spark: SparkSession, folder: str) -> DataFrame:
    _, catalog, filled = filled_orders(spark, folder)
    asked = catalog.table("orders").where(F.col("o_custkey_c_name").isNull())
    return vote.evaluated_rows(asked, filled, ["o_orderkey"])


@suite.add("typed_writeback", f"WITH {_VOTES} SELECT qid, attr, value, attr <> 'o_custkey_c_name' AS fits FROM an")
def typed_writeback(spark: SparkSession, folder: str) -> DataFrame:
    best = vote.answers(order_votes(spark, folder)[2])
    types = {"o_orderstatus": T.StringType(), "o_custkey_c_acctbal": T.DoubleType(), "o_custkey_c_name": T.DoubleType()}
    return vote.typed_answers(best, types).select("qid", "attr", "value", "fits")


# --- attributes without a path, and the fitted scorer --------------------------------------------

_RELATED = ["o_custkey_c_name", "o_custkey_c_acctbal"]


def unlinked(spark: SparkSession, folder: str) -> Catalog:
    """Dirty orders in a schema that does not name the keys of orders and customer: no path leads from one to the other."""
    catalog = dirty(with_redundant_orders(spark, folder), "orders")
    specs = {n: replace(s, fks=tuple(f for f in s.fks if f[0] not in ("o_custkey", "c_nationkey"))) for n, s in catalog.specs.items()}
    return replace(catalog, specs=specs)


def _near_sql(names: tuple[str, ...] = ("kn", "ms"), order: str = "ORDER BY {draw} LIMIT 800") -> str:
    """CTEs up to `kn` (known cells with truth, sampled unless `order` is empty) and `ms` (null cells), each with its five nearest customers."""
    asked = {
        "kc": " UNION ALL ".join(
            f"(SELECT CAST(o_orderkey AS VARCHAR) AS row_id, '{a}' AS asked, {q.text(a, _COPIES[a][1])} AS truth FROM ord_x WHERE {a} IS NOT NULL "
            + order.format(draw=q.draw("o_orderkey", repr(a))) + ")" for a in _RELATED
        ),
        "mc": " UNION ALL ".join(f"SELECT CAST(o_orderkey AS VARCHAR) AS row_id, '{a}' AS asked, NULL::VARCHAR AS truth FROM ord_x WHERE {a} IS NULL" for a in _RELATED),
    }
    out = [q.ORD_X, f"po AS MATERIALIZED ({q.value_parts('o_orderkey', q.COLUMNS['orders'][1:], 'ord_x')})", f"pc AS ({q.value_parts('c_custkey', q.COLUMNS['customer'], 'customer')})"]
    out.append(f"ec AS MATERIALIZED ({q.dense('pc', 'row_id')})")
    for cells, (name, sql) in zip(names, asked.items(), strict=False):
        out.append(f"{name} AS ({sql}), p_{name} AS (SELECT row_id, asked, slot, w FROM {name} JOIN po USING (row_id) WHERE attr <> asked), e_{name} AS MATERIALIZED ({q.dense(f'p_{name}', 'row_id, asked')})")
        out.append(
            f"{cells} AS MATERIALIZED (SELECT d.row_id AS qid, d.asked AS attr, {name}.truth, c.row_id AS target, d.d, c_name, {q.text('c_acctbal', 'd')} AS c_acctbal, round(1 - d * d / 2, 9) AS near FROM "
            f"(SELECT a.row_id, asked, c.row_id AS target, list_distance(a.e, c.e) AS d FROM e_{name} a CROSS JOIN ec c "
            "QUALIFY row_number() OVER (PARTITION BY a.row_id, asked ORDER BY round(d, 9), c.row_id) <= 5) d "
            f"JOIN {name} USING (row_id, asked) JOIN ec c ON c.row_id = d.target JOIN customer ON c.row_id = CAST(c_custkey AS VARCHAR))"
        )
    return ", ".join(out)


_MATCHED = (
    "rk AS (SELECT *, rank() OVER (PARTITION BY qid, attr ORDER BY near DESC) AS r FROM kn), "
    "mt AS (SELECT attr, 'c_name' AS col FROM rk WHERE r <= 3 AND c_name = truth UNION ALL SELECT attr, 'c_acctbal' FROM rk WHERE r <= 3 AND c_acctbal = truth), "
    "sm AS (SELECT attr, col, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY attr) AS ratio FROM mt GROUP BY 1, 2)"
)
_FALLBACK = f"{_near_sql()}, {_MATCHED}"
_NEAR_VOTES = (
    f"{_FALLBACK}, pr AS (SELECT attr, sum(ratio) AS prior FROM sm GROUP BY attr), sc AS (SELECT ms.*, exp(prior + 10.0::DOUBLE * near) AS e FROM ms JOIN pr USING (attr)), "
    "tt AS (SELECT qid, attr, sum(e) AS total FROM sc GROUP BY 1, 2), "
    "vo AS (SELECT qid, attr, value, sum(e) / any_value(total) AS w, sum(ratio) AS r FROM (SELECT qid, attr, e, ratio, CASE col WHEN 'c_name' THEN c_name ELSE c_acctbal END AS value "
    "FROM sc JOIN sm USING (attr)) JOIN tt USING (qid, attr) GROUP BY 1, 2, 3), "
    "an AS (SELECT * FROM vo QUALIFY row_number() OVER (PARTITION BY qid, attr ORDER BY round(w, 9) DESC, round(r, 9) DESC, value) = 1)"
)


@suite.add("fallback_candidates", f"WITH {_NEAR_VOTES} SELECT qid, attr, 'customer' AS path_id, target AS row_id, round(near, 6) AS near, c_name, c_acctbal FROM ms")
def fallback_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest customers of every null cell, with what they offer."""
    found = fallback.candidates(unlinked(spark, folder), "orders", {a: ["customer"] for a in _RELATED})
    offered = [F.element_at("payload", F.lit(c)).alias(c) for c in ("c_name", "c_acctbal")]
    return found.select("qid", "attr", "path_id", F.element_at("row_ids", 1).alias("row_id"), F.round("near", 6).alias("near"), *offered)


def related_summary(spark: SparkSession, folder: str, n: int = 0) -> tuple[Catalog, flows.Discovery, DataFrame]:
    """What the data offers for the two attributes: no path, one related table, and which of its columns reproduce known cells (all, or n sampled)."""
    catalog = unlinked(spark, folder)
    sources = flows.discover_sources(catalog, "orders", catalog.names, _RELATED)
    return catalog, sources, flows.induced_summary(catalog, "orders", sources.paths, related=sources.related, related_n=n)


@suite.add("fallback_summary", f"WITH {_near_sql(('kn',), '')}, {_MATCHED} SELECT attr, 'customer' AS path_id, col, n, round(ratio, 6) AS ratio FROM sm")
def fallback_summary(spark: SparkSession, folder: str) -> DataFrame:
    return related_summary(spark, folder)[2].withColumn("ratio", F.round("ratio", 6))


@suite.add(
    "impute_fallback",
    f"WITH {_NEAR_VOTES} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, coalesce(o_custkey_c_name, n.value) AS o_custkey_c_name, "
    "coalesce(o_custkey_c_acctbal, CAST(b.value AS DOUBLE)) AS o_custkey_c_acctbal FROM ord_x LEFT JOIN (SELECT * FROM an WHERE attr = 'o_custkey_c_name') n ON n.qid = CAST(o_orderkey AS VARCHAR) "
    "LEFT JOIN (SELECT * FROM an WHERE attr = 'o_custkey_c_acctbal') b ON b.qid = CAST(o_orderkey AS VARCHAR)",
)
def impute_fallback(spark: SparkSession, folder: str) -> DataFrame:
    catalog, sources, summary = related_summary(spark, folder, 800)
    return flows.impute(catalog, "orders", sources.paths, summary, related=sources.related)[0]


@suite.add("impute_scored", f"WITH {q.CUST_X} SELECT c_custkey, c_nationkey, c_name, c_acctbal, c_mktsegment, coalesce(c_nationkey_n_name, n_name) AS c_nationkey_n_name FROM cust_x JOIN nation ON c_nationkey = n_nationkey")
def impute_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates weighed by the fitted scorer over path similarity, query similarity, prior and length."""
    catalog = dirty(clean(spark, folder), "customer")
    by_attribute = customer_paths(catalog)
    stored = embed.database_vectors(catalog, "customer", ["nation", "supplier", "orders"])
    summary = flows.induced_summary(catalog, "customer", by_attribute)
    scorer = flows.train_scorer(catalog, "customer", by_attribute, summary, embeddings=stored)
    return flows.impute(catalog, "customer", by_attribute, summary, stored, scorer)[0]


# --- evaluation -------------------------------------------------------------------------------

_JUDGED_ATTRIBUTES = {"o_totalprice": "d", "o_custkey_c_acctbal": "d", "o_custkey_c_name": "s", "o_orderstatus": "s"}
_NUMERIC = [a for a, k in _JUDGED_ATTRIBUTES.items() if k == "d"]
_MEANS = (
    "gm AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) AS mean FROM ord_x WHERE o_totalprice IS NOT NULL GROUP BY 1), "
    "st AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS attr, max({a}) AS mx, min({a}) AS mn, avg({a}) AS mean, stddev_samp({a}) AS std, quantile_cont({a}, 0.5) AS median, count(DISTINCT {a}) AS ndv FROM ord_d" for a in _NUMERIC
    ) + ")"
)


def _judged_sql() -> str:
    predictions = {
        ("vote", "o_totalprice"): "NULL", ("vote", "o_custkey_c_acctbal"): "c_acctbal", ("vote", "o_custkey_c_name"): "c_name", ("vote", "o_orderstatus"): "NULL",
        ("mean", "o_totalprice"): "gm.mean", ("mean", "o_custkey_c_acctbal"): "NULL", ("mean", "o_custkey_c_name"): "NULL", ("mean", "o_orderstatus"): "NULL",
    }
    parts = []
    for (method, attr), pred in predictions.items():
        rows = (
            f"FROM ord_x x JOIN ord_d d ON x.o_orderkey = d.o_orderkey JOIN customer ON x.o_custkey = c_custkey LEFT JOIN gm ON x.o_custkey = gm.o_custkey"
        )
        if _JUDGED_ATTRIBUTES[attr] == "d":
            parts.append(
                f"SELECT '{method}' AS method, 'num' AS class, '{attr}' AS attr, CAST(x.o_orderkey AS VARCHAR) AS qid, true AS used, CAST({pred} AS DOUBLE) IS NULL AS not_added, d.{attr} AS t, "
                f"coalesce(CAST({pred} AS DOUBLE), median) AS p, mn, mx, CAST(coalesce(d.{attr} = coalesce(CAST({pred} AS DOUBLE), median), false) AS INTEGER) AS hit {rows} JOIN st ON st.attr = '{attr}' WHERE x.{attr} IS NULL"
            )
        else:
            parts.append(
                f"SELECT '{method}', 'cat', '{attr}', CAST(x.o_orderkey AS VARCHAR), true, {pred} IS NULL, NULL, NULL, NULL, NULL, CAST(coalesce(d.{attr} = {pred}, false) AS INTEGER) {rows} WHERE x.{attr} IS NULL"
            )
    return f"{q.ORD_X}, {_MEANS}, ju AS (SELECT *, (t - mn) / (mx - mn) AS ts, (p - mn) / (mx - mn) AS ps FROM ({' UNION ALL '.join(parts)}))"


_JUDGED = _judged_sql()
_GROUPS = "jg AS (SELECT method, class, unnest([attr, 'all']) AS attr, used, not_added, t, p, ts, ps, hit FROM ju)"
_Q = (
    "CASE WHEN p * t >= 0 THEN round(greatest(pp / tt, tt / pp), 4) END AS qe FROM (SELECT *, CASE WHEN t = 0 THEN CASE WHEN pp > 0 THEN 0.1 ELSE -0.1 END ELSE t END AS tt "
    "FROM (SELECT *, CASE WHEN p = 0 THEN CASE WHEN t > 0 THEN 0.1 ELSE -0.1 END ELSE p END AS pp FROM {source} WHERE class = 'num'))"
)
_QUANTILES = ", ".join(f"round(quantile_cont(qe, {p}), 6) AS {name}" for name, p in metrics.Q_NAMES.items())


def _js_sql(source: str, by: str, t: str, p: str, tag: str) -> str:
    """CTEs ending in `js_<tag>` with the distance per group."""
    both = ", ".join(f"{c}" for c in by.split(", "))
    return (
        f"en_{tag} AS (SELECT {both}, min({t}) AS lo, max({t}) AS hi FROM {source} WHERE {p} IS NOT NULL GROUP BY ALL), "
        f"bi_{tag} AS (SELECT {both}, CASE WHEN v BETWEEN lo AND hi THEN least(floor((v - lo) / (hi - lo) * 20), 19) END AS bin, a, b FROM "
        f"(SELECT {both}, {t} AS v, 1 AS a, 0 AS b FROM {source} WHERE {p} IS NOT NULL UNION ALL SELECT {both}, {p}, 0, 1 FROM {source} WHERE {p} IS NOT NULL) JOIN en_{tag} USING ({both})), "
        f"co_{tag} AS (SELECT {both}, bin, sum(a) AS a, sum(b) AS b FROM bi_{tag} WHERE bin IS NOT NULL GROUP BY ALL), "
        f"sh_{tag} AS (SELECT {both}, a / sum(a) OVER (PARTITION BY {both}) AS x, b / nullif(sum(b) OVER (PARTITION BY {both}), 0) AS y FROM co_{tag}), "
        f"js_{tag} AS (SELECT {both}, round(sqrt(greatest(0.0, sum(CASE WHEN x > 0 THEN x * ln(x / ((x + y) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN y > 0 THEN y * ln(y / ((x + y) / 2)) ELSE 0 END) / 2)), 6) AS js FROM sh_{tag} GROUP BY ALL)"
    )


def tables_of_runs(catalog: Catalog, filled: DataFrame) -> dict[str, DataFrame]:
    """Two methods: the vote along the customer path, and the mean price of a customer's other orders."""
    dirty_orders = catalog.table("orders")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    means = dirty_orders.where(F.col("o_totalprice").isNotNull()).groupBy("o_custkey")
    means = means.agg((F.sum(price).cast("double") / F.count("o_totalprice")).alias("_mean"))
    averaged = dirty_orders.join(means, "o_custkey", "left").withColumn("o_totalprice", F.coalesce("o_totalprice", "_mean"))
    return {"vote": filled, "mean": averaged.drop("_mean")}


def runs_of(tidy: Catalog, catalog: Catalog, filled: DataFrame) -> DataFrame:
    """The two methods as long runs."""
    runs = tables_of_runs(catalog, filled)
    return metrics.union_runs([metrics.wide_run(catalog.with_tables(orders=df), "orders", method, list(_JUDGED_ATTRIBUTES)) for method, df in runs.items()])


def judged_orders(spark: SparkSession, folder: str) -> DataFrame:
    tidy, catalog, filled = filled_orders(spark, folder)
    names = list(_JUDGED_ATTRIBUTES)
    classes = metrics.attribute_classes(tidy.table("orders"), names)
    stats = metrics.numeric_stats(tidy, "orders", _NUMERIC)
    return metrics.judged_tables(catalog, tidy, "orders", names, tables_of_runs(catalog, filled), classes, stats)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@suite.add(
    "attr_class",
    f"WITH {q.ORD_D} " + " UNION ALL ".join(
        f"SELECT '{a}' AS attr, '{'num' if k == 'd' else 'cat'}' AS class, count(DISTINCT {a}) AS ndv FROM ord_d" for a, k in q.COLUMNS["orders"][2:]
    ),
)
def attr_class(spark: SparkSession, folder: str) -> DataFrame:
    catalog = with_redundant_orders(spark, folder)
    names = catalog.descriptors("orders")
    values = profile.value_counts(catalog.table("orders"), names).groupBy(F.col("col").alias("attr")).agg(F.count("value").alias("ndv"))
    return metrics.class_table(catalog.table("orders"), names).join(values, "attr")


@suite.add(
    "eval_cells",
    f"WITH {q.ORD_X} " + " UNION ALL ".join(
        f"SELECT CAST(x.o_orderkey AS VARCHAR) AS qid, '{a}' AS attr, {q.text('d.' + a, k)} AS truth FROM ord_x x JOIN ord_d d ON x.o_orderkey = d.o_orderkey WHERE x.{a} IS NULL"
        for a, k in _JUDGED_ATTRIBUTES.items()
    ),
)
def eval_cells(spark: SparkSession, folder: str) -> DataFrame:
    tidy = with_redundant_orders(spark, folder)
    catalog = dirty(tidy, "orders")
    keys = tidy.table("orders").select(tidy.row_id("orders").alias("qid"))
    return metrics.eval_cells(catalog, tidy, "orders", list(_JUDGED_ATTRIBUTES), keys)


@suite.add(
    "clean_stats",
    f"WITH {q.ORD_X}, {_MEANS} SELECT attr, mx AS max, mn AS min, round(mean, 4) AS mean, round(std, 4) AS std, round(median, 6) AS median, ndv FROM st",
)
def clean_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = metrics.numeric_stats(with_redundant_orders(spark, folder), "orders", _NUMERIC)
    return stats.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4), "median": F.round("median", 6)})


@suite.add(
    "numeric_equality",
    "SELECT o_orderkey, true AS padded, false AS suffixed, o_orderpriority = '5-LOW' AS words, false AS mixed, false AS nans FROM orders",
)
def numeric_equality(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    return star_catalog(spark, folder).table("orders").select(
        "o_orderkey",
        values_equal(F.concat(key, F.lit(".00")), key).alias("padded"),
        values_equal(F.concat(key, F.lit("d")), key).alias("suffixed"),
        values_equal(F.col("o_orderpriority"), F.lit("5-LOW")).alias("words"),
        values_equal(key, F.col("o_orderstatus")).alias("mixed"),
        values_equal(F.lit("nan"), F.lit("nan")).alias("nans"),
    )


@suite.add(
    "normalize_value",
    "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS whole, o_orderpriority AS words, CAST(o_orderkey AS VARCHAR) || 'd' AS suffixed, "
    "CAST(o_orderkey AS VARCHAR) || '.5' AS fraction FROM orders",
)
def normalized_values(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    return star_catalog(spark, folder).table("orders").select(
        "o_orderkey",
        normalize_value(F.concat(F.lit(" +"), key, F.lit(".0 "))).alias("whole"),
        normalize_value(F.col("o_orderpriority")).alias("words"),
        normalize_value(F.concat(key, F.lit("d"))).alias("suffixed"),
        normalize_value(F.concat(key, F.lit(".50"))).alias("fraction"),
    )


@suite.add("median_fallback", f"WITH {_JUDGED} SELECT method, class, attr, qid, used, not_added, t, round(p, 6) AS p, hit FROM ju")
def median_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(judged_orders(spark, folder).select("method", "class", "attr", "qid", "used", "not_added", "t", "p", "hit"), "p")


@suite.add("accuracy", f"WITH {_JUDGED} SELECT method, attr, round(avg(hit), 6) AS accuracy FROM ju GROUP BY 1, 2")
def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.accuracy(judged_orders(spark, folder)), "accuracy")


@suite.add(
    "mae_rmse",
    f"WITH {_JUDGED} SELECT method, attr, round(avg(abs(p - t)), 4) AS mae, round(sqrt(avg((p - t) * (p - t))), 4) AS rmse FROM ju WHERE p IS NOT NULL GROUP BY 1, 2",
)
def mae_rmse(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.absolute_errors(judged_orders(spark, folder), "t", "p")
    return found.withColumns({"mae": F.round("mae", 4), "rmse": F.round("rmse", 4)})


@suite.add(
    "minmax_error",
    f"WITH {_JUDGED} SELECT method, attr, round(avg(abs(ps - ts)), 6) AS mae, round(sqrt(avg((ps - ts) * (ps - ts))), 6) AS rmse FROM ju WHERE ps IS NOT NULL GROUP BY 1, 2",
)
def minmax_error(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.absolute_errors(judged_orders(spark, folder)), "mae", "rmse")


@suite.add(
    "mape",
    f"WITH {_JUDGED} SELECT method, attr, round(avg(abs((t - p) / nullif(t, 0))) * 100, 4) AS mape, count(*) FILTER (t = 0) AS zero_truths FROM ju WHERE p IS NOT NULL GROUP BY 1, 2",
)
def mape(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.mape(judged_orders(spark, folder)).withColumn("mape", F.round("mape", 4))


@suite.add("js_distance", f"WITH {_JUDGED}, {_js_sql('ju', 'method, attr', 't', 'p', 'a')} SELECT * FROM js_a")
def js_distance(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.js_distance(judged_orders(spark, folder)), "js")


@suite.add("q_error", f"WITH {_JUDGED}, qs AS (SELECT method, attr, {_Q.format(source='ju')}) SELECT method, attr, {_QUANTILES}, count(qe) AS q_count FROM qs GROUP BY 1, 2")
def q_error(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.q_error_quantiles(judged_orders(spark, folder)), *metrics.Q_NAMES)


@suite.add(
    "eval_report",
    f"WITH {_JUDGED}, {_GROUPS}, ba AS (SELECT method, class, attr, count(*) AS missing_cnt, count(*) FILTER (not_added) AS count_not_added, "
    "round(count(*) FILTER (not_added) / count(*), 6) AS ratio_not_added, round(avg(hit), 6) AS accuracy, round(sqrt(avg((ps - ts) * (ps - ts))), 6) AS rmse, round(avg(abs(ps - ts)), 6) AS mae, "
    "round(avg(abs((t - p) / nullif(t, 0))) * 100, 4) AS mape FROM jg GROUP BY ALL), "
    f"nu AS (SELECT * FROM jg WHERE class = 'num'), {_js_sql('nu', 'method, class, attr', 'ts', 'ps', 'r')}, qs AS (SELECT method, class, attr, {_Q.format(source='jg')}), "
    f"qq AS (SELECT method, class, attr, {_QUANTILES}, count(qe) AS q_count FROM qs GROUP BY ALL) "
    "SELECT * FROM ba LEFT JOIN js_r USING (method, class, attr) LEFT JOIN qq USING (method, class, attr)",
)
def eval_report(spark: SparkSession, folder: str) -> DataFrame:
    report = metrics.eval_report(judged_orders(spark, folder))
    return rounded(report, "ratio_not_added", "accuracy", "rmse", "mae", "js", *metrics.Q_NAMES).withColumn("mape", F.round("mape", 4))


_PLACED = (
    "pl AS (SELECT r.qid, r.attr, max(CASE WHEN r.value = t.value THEN rk END) AS place FROM "
    "(SELECT *, row_number() OVER (PARTITION BY qid, attr ORDER BY score DESC, value DESC) AS rk FROM {run}) r JOIN qr t ON r.qid = t.qid AND r.attr = t.attr GROUP BY 1, 2), "
    "me AS (SELECT qid, attr, coalesce(1.0 / place, 0.0)::DOUBLE AS recip_rank, "
    + ", ".join(f"(CASE WHEN place <= {k} THEN 1 / log2(place + 1) ELSE 0.0 END)::DOUBLE AS ndcg_cut_{k}" for k in metrics.RANK_CUTS)
    + ", (CASE WHEN place = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS success_1 FROM pl)"
)
_RANK_NAMES = ["recip_rank", *[f"ndcg_cut_{k}" for k in metrics.RANK_CUTS], "success_1"]
_RANK_ROUNDED = ", ".join(f"round({n}, 6) AS {n}" for n in _RANK_NAMES)


def ranked_orders(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, Catalog]:
    tidy, _, voted = order_votes(spark, folder)
    return vote.qrels(vote.answers(voted), tidy, "orders"), vote.value_ranking(voted), tidy


@suite.add("rank_metrics", f"WITH {_VOTES}, {_QRELS}, {_PLACED.format(run='ru')} SELECT qid, attr, {_RANK_ROUNDED} FROM me")
def rank_metrics(spark: SparkSession, folder: str) -> DataFrame:
    truths, run, _ = ranked_orders(spark, folder)
    return rounded(metrics.rank_metrics(truths, run), *_RANK_NAMES)


@suite.add(
    "rank_metrics_grouped",
    f"WITH {_VOTES}, {_QRELS}, {_PLACED.format(run='ru')}, gr AS (SELECT *, unnest(['all', CASE WHEN attr = 'o_custkey_c_acctbal' THEN 'num' ELSE 'cat' END, attr]) AS group_name FROM me) "
    f"SELECT group_name, count(*) AS group_count, {', '.join(f'round(avg({n}), 6) AS {n}' for n in _RANK_NAMES)} FROM gr GROUP BY 1",
)
def rank_metrics_grouped(spark: SparkSession, folder: str) -> DataFrame:
    truths, run, tidy = ranked_orders(spark, folder)
    classes = metrics.attribute_classes(tidy.table("orders"), ["o_orderstatus", *_COPIES])
    return rounded(metrics.rank_metrics_grouped(metrics.rank_metrics(truths, run), classes), *_RANK_NAMES)


@suite.add(
    "rank_default",
    f"WITH {_VOTES} SELECT qid, attr, round(CAST(value AS DOUBLE), 6) AS value, score FROM ru WHERE attr = 'o_custkey_c_acctbal' UNION ALL "
    "SELECT CAST(o_orderkey AS VARCHAR), 'o_totalprice', round((SELECT quantile_cont(o_totalprice, 0.5) FROM ord_d), 6), 1.0 FROM ord_x WHERE o_totalprice IS NULL",
)
def rank_default(spark: SparkSession, folder: str) -> DataFrame:
    """Numeric cells only: those without an answer get the clean median."""
    tidy, catalog, voted = order_votes(spark, folder)
    truths = metrics.eval_cells(catalog, tidy, "orders", _NUMERIC)
    run = vote.value_ranking(voted).where(F.col("attr").isin(*_NUMERIC))
    ranked = metrics.default_rankings(truths, run, metrics.numeric_stats(tidy, "orders", _NUMERIC))
    return ranked.withColumn("value", F.round(F.col("value").cast("double"), 6))


@suite.add(
    "imputed_counts",
    f"WITH {_JUDGED} SELECT method, count(*) AS total_impute FROM ju WHERE NOT not_added GROUP BY 1",
)
def imputed_counts(spark: SparkSession, folder: str) -> DataFrame:
    tidy, catalog, filled = filled_orders(spark, folder)
    return metrics.imputed_counts(catalog, "orders", runs_of(tidy, catalog, filled), list(_JUDGED_ATTRIBUTES))


@suite.add("value_distribution", "SELECT o_orderpriority AS value, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def value_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.value_distribution(star_catalog(spark, folder).table("orders"), "o_orderpriority"), "share")


@suite.add(
    "union_runs",
    f"WITH {q.ORD_X} SELECT 'vote' AS method, CAST(o_orderkey AS VARCHAR) AS qid, 'o_custkey_c_name' AS attr, coalesce(o_custkey_c_name, c_name) AS value FROM ord_x JOIN customer ON o_custkey = c_custkey "
    "UNION ALL SELECT 'dirty', CAST(o_orderkey AS VARCHAR), 'o_custkey_c_name', o_custkey_c_name FROM ord_x",
)
def union_runs(spark: SparkSession, folder: str) -> DataFrame:
    tidy, catalog, filled = filled_orders(spark, folder)
    names = ["o_custkey_c_name"]
    runs = [
        metrics.wide_run(catalog.with_tables(orders=filled), "orders", "vote", names),
        metrics.wide_run(catalog, "orders", "dirty", names),
        metrics.wide_run(tidy, "orders", "clean", names),
    ]
    return metrics.union_runs(runs, exclude=["clean"])
