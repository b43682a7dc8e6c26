"""Queries over path instances, samples, closures and the entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relimpute.operators import discover, entity, graph, instances, profile, sample
from relimpute.operators.graph import MetaPath
from relimpute.plans import flows
from relimpute.plans import sql as q
from relimpute.plans.registry import Registry
from relimpute.plans.star import star_catalog
from relimpute.plans.suite_tables import clean, dirty, with_redundant_orders
from relimpute.sources.catalog import Catalog

suite = Registry()

TO_CUSTOMER = "orders>(o_custkey,c_custkey)>customer"
TO_NATION = TO_CUSTOMER + ">(c_nationkey,n_nationkey)>nation"
LINE_TO_REGION = "lineitem>(l_orderkey,o_orderkey)>orders>(o_custkey,c_custkey)>customer>(c_nationkey,n_nationkey)>nation>(n_regionkey,r_regionkey)>region"
TO_ORDERS = "customer>(c_custkey,o_custkey)>orders"
TO_LINES = TO_ORDERS + ">(o_orderkey,l_orderkey)>lineitem"
HOME = "customer>(c_nationkey,n_nationkey)>nation"
NEIGHBOURS = HOME + ">(n_nationkey,s_nationkey)>supplier"
CUSTOMER_PATHS = [HOME, NEIGHBOURS, TO_ORDERS]
NATION_NAME = "c_nationkey_n_name"


def paths_of(catalog: Catalog, *labels: str) -> list[MetaPath]:
    return [graph.parse_path(catalog, label) for label in labels]


def flat(found: DataFrame) -> DataFrame:
    """Row ids as one text, for comparison."""
    return found.withColumn("row_ids", F.concat_ws(">", "row_ids"))


def along(catalog: Catalog, *labels: str, **options) -> DataFrame:
    paths = paths_of(catalog, *labels)
    start = paths[0].edges[0].src_table
    return instances.path_instances(catalog, instances.query_rows(catalog, start, paths), paths, **options)


def customer_paths(catalog: Catalog) -> dict[str, list[MetaPath]]:
    return {NATION_NAME: paths_of(catalog, *CUSTOMER_PATHS)}


def _instances_sql(label: str, qid: str, ids: list[str], joins: str) -> str:
    row_ids = "concat_ws('>', " + ", ".join(f"CAST({i} AS VARCHAR)" for i in ids) + ")"
    return f"SELECT CAST({qid} AS VARCHAR) AS qid, '{q.path_id(label)}' AS path_id, md5({row_ids}) AS instance_id, {row_ids} AS row_ids FROM {joins}"


_ONE = _instances_sql(TO_CUSTOMER, "o_orderkey", ["c_custkey"], "orders JOIN customer ON o_custkey = c_custkey")
_TWO = _instances_sql(
    TO_NATION, "o_orderkey", ["c_custkey", "n_nationkey"], "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
)


@suite.add("path_1hop", _ONE)
def path_1hop(spark: SparkSession, folder: str) -> DataFrame:
    return flat(along(star_catalog(spark, folder), TO_CUSTOMER))


@suite.add("path_2hop", f"{_ONE} UNION ALL {_TWO}")
def path_2hop(spark: SparkSession, folder: str) -> DataFrame:
    """Both paths share their first hop, which is joined once."""
    return flat(along(star_catalog(spark, folder), TO_CUSTOMER, TO_NATION))


@suite.add(
    "path_4hop_lineitem_region",
    f"WITH {q.LI} "
    + _instances_sql(
        LINE_TO_REGION, "row_id", ["o_orderkey", "c_custkey", "n_nationkey", "r_regionkey"],
        "li JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
)
def path_4hop_lineitem_region(spark: SparkSession, folder: str) -> DataFrame:
    return flat(along(star_catalog(spark, folder), LINE_TO_REGION))


@suite.add("path_reverse_fanout", _instances_sql(TO_ORDERS, "c_custkey", ["o_orderkey"], "customer JOIN orders ON c_custkey = o_custkey"))
def path_reverse_fanout(spark: SparkSession, folder: str) -> DataFrame:
    return flat(along(star_catalog(spark, folder), TO_ORDERS))


@suite.add(
    "path_dedup_join_key",
    f"SELECT qid, path_id, instance_id, row_ids FROM (SELECT *, row_number() OVER (PARTITION BY row_ids ORDER BY qid) AS r FROM ({_ONE})) WHERE r = 1",
)
def path_dedup_join_key(spark: SparkSession, folder: str) -> DataFrame:
    return flat(along(star_catalog(spark, folder), TO_CUSTOMER, dedup="join_key"))


@suite.add(
    "path_fanout_guard",
    f"WITH n AS (SELECT count(*) AS query_rows FROM customer), c AS (SELECT '{q.path_id(TO_ORDERS)}' AS path_id, '{TO_ORDERS}' AS label, "
    "count(*) AS instances FROM customer JOIN orders ON c_custkey = o_custkey UNION ALL "
    f"SELECT '{q.path_id(TO_LINES)}', '{TO_LINES}', count(*) FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey UNION ALL "
    f"SELECT '{q.path_id(NEIGHBOURS)}', '{NEIGHBOURS}', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON n_nationkey = s_nationkey) "
    "SELECT path_id, label, instances, query_rows, instances <= 20 * query_rows AS kept FROM c, n",
)
def path_fanout_guard(spark: SparkSession, folder: str) -> DataFrame:
    catalog = star_catalog(spark, folder)
    return instances.guarded(instances.instance_counts(catalog, "customer", paths_of(catalog, TO_ORDERS, TO_LINES, NEIGHBOURS)))


_GUARDED = [TO_LINES, NEIGHBOURS + ">(s_suppkey,l_suppkey)>lineitem>(l_partkey,p_partkey)>part"]
_PREFIXES = {
    TO_ORDERS: "JOIN orders ON c_custkey = o_custkey",
    TO_LINES: "JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey",
    HOME: "JOIN nation ON c_nationkey = n_nationkey",
    NEIGHBOURS: "JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON n_nationkey = s_nationkey",
    NEIGHBOURS + ">(s_suppkey,l_suppkey)>lineitem": "JOIN supplier ON c_nationkey = s_nationkey JOIN lineitem ON s_suppkey = l_suppkey",
    _GUARDED[1]: "JOIN supplier ON c_nationkey = s_nationkey JOIN lineitem ON s_suppkey = l_suppkey JOIN part ON l_partkey = p_partkey",
}


@suite.add(
    "path_prefix_guard",
    "SELECT label, CAST(hops AS INTEGER) AS hops, instances, query_rows, instances <= 20 * query_rows AS kept FROM ("
    + " UNION ALL ".join(f"SELECT '{label}' AS label, {label.count('>(')} AS hops, count(*) AS instances FROM customer {joins}" for label, joins in _PREFIXES.items())
    + "), (SELECT count(*) AS query_rows FROM customer)",
)
def path_prefix_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every prefix: nearly all lines of a nation's suppliers are met by every customer of the nation."""
    catalog = star_catalog(spark, folder)
    return instances.guarded(instances.prefix_counts(catalog, "customer", paths_of(catalog, *_GUARDED)))


@suite.add(
    "path_instances_grouped",
    f"WITH i AS ({_instances_sql(TO_ORDERS, 'c_custkey', ['o_orderkey'], 'customer JOIN orders ON c_custkey = o_custkey')}), "
    "s AS (SELECT qid, path_id, CAST(ceil(count(*) / 4.0) AS BIGINT) AS parts FROM i GROUP BY 1, 2) "
    "SELECT qid, path_id, ('0x' || substring(instance_id,1,8))::BIGINT % parts AS chunk, count(*) AS n, "
    "string_agg(row_ids, ',' ORDER BY row_ids) AS row_ids FROM i JOIN s USING (qid, path_id) GROUP BY 1, 2, 3",
)
def path_instances_grouped(spark: SparkSession, folder: str) -> DataFrame:
    grouped = instances.grouped_instances(along(star_catalog(spark, folder), TO_ORDERS), chunk=4)
    ids = F.array_join(F.transform("instances", lambda i: F.concat_ws(">", i)), ",")
    return grouped.select("qid", "path_id", "chunk", F.size("instances").cast("bigint").alias("n"), ids.alias("row_ids"))


@suite.add(
    "path_instances_json",
    "SELECT CAST(o_orderkey AS VARCHAR) AS qid, "
    f"'{q.path_id(TO_NATION)}' AS path_id, md5(concat_ws('>', CAST(c_custkey AS VARCHAR), CAST(n_nationkey AS VARCHAR))) AS instance_id, "
    "'[{\"table\":\"customer\",\"index\":\"' || CAST(c_custkey AS VARCHAR) || '\"},{\"table\":\"nation\",\"index\":\"' || CAST(n_nationkey AS VARCHAR) || '\"}]' AS json "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
)
def path_instances_json(spark: SparkSession, folder: str) -> DataFrame:
    catalog = star_catalog(spark, folder)
    return instances.instances_json(along(catalog, TO_NATION), paths_of(catalog, TO_NATION))


_COPIED = ["o_custkey_c_name", "o_custkey_c_acctbal"]


@suite.add(
    "candidate_cells",
    f"WITH {q.ORD_X}, m AS ("
    + " UNION ALL ".join(f"SELECT o_orderkey, o_custkey, '{a}' AS attr FROM ord_x WHERE {a} IS NULL" for a in _COPIED)
    + "), j AS (SELECT * FROM m JOIN customer ON o_custkey = c_custkey) "
    + " UNION ALL ".join(
        f"SELECT CAST(o_orderkey AS VARCHAR) AS qid, attr, '{q.path_id(TO_CUSTOMER)}' AS path_id, md5(CAST(c_custkey AS VARCHAR)) AS instance_id, "
        f"'{c}' AS col, {q.text(c, k)} AS value FROM j"
        for c, k in (("c_name", "s"), ("c_acctbal", "d"), ("c_mktsegment", "s"))
    ),
)
def candidate_cells(spark: SparkSession, folder: str) -> DataFrame:
    catalog = dirty(with_redundant_orders(spark, folder), "orders")
    found = flows.missing_candidates(catalog, "orders", {a: paths_of(catalog, TO_CUSTOMER) for a in _COPIED})
    return instances.candidate_cells(found).drop("row_ids")


# every instance of the three customer paths, and the known cells they serve
CUSTOMER_INSTANCES = (
    f"ci AS (SELECT CAST(c_custkey AS VARCHAR) AS qid, '{q.path_id(HOME)}' AS path_id, md5(CAST(n_nationkey AS VARCHAR)) AS instance_id, 1 AS hops, n_name AS name "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL "
    f"SELECT CAST(c_custkey AS VARCHAR), '{q.path_id(NEIGHBOURS)}', md5(concat_ws('>', CAST(n_nationkey AS VARCHAR), CAST(s_suppkey AS VARCHAR))), 2, s_nationkey_n_name "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supp_d ON n_nationkey = s_nationkey UNION ALL "
    f"SELECT CAST(c_custkey AS VARCHAR), '{q.path_id(TO_ORDERS)}', md5(CAST(o_orderkey AS VARCHAR)), 1, NULL FROM customer JOIN orders ON c_custkey = o_custkey)"
)
CUSTOMER_KNOWN = (
    f"{q.CUST_X}, {q.SUPP_D}, {CUSTOMER_INSTANCES}, "
    f"kn AS (SELECT CAST(c_custkey AS VARCHAR) AS qid, {NATION_NAME} AS truth FROM cust_x WHERE {NATION_NAME} IS NOT NULL)"
)


def assembled(spark: SparkSession, folder: str) -> instances.Bundles:
    """All instances of the known cells, without the cut to the most similar ones."""
    catalog = dirty(clean(spark, folder), "customer")
    by_attribute = customer_paths(catalog)
    rows = flows.known_rows(catalog, "customer", by_attribute)
    shared = instances.shared_instances(catalog, rows, by_attribute[NATION_NAME], flows.served(by_attribute))
    return instances.bundled(shared, instances.attribute_paths(spark, by_attribute))


@suite.add("sample_assembly", f"WITH {CUSTOMER_KNOWN} SELECT qid, '{NATION_NAME}' AS attr, truth, path_id, instance_id FROM kn JOIN ci USING (qid)")
def sample_assembly(spark: SparkSession, folder: str) -> DataFrame:
    found = assembled(spark, folder)
    return instances.opened(found.cells, found.held).select("qid", "attr", "truth", "path_id", "instance_id")


@suite.add(
    "merge_paths",
    f"WITH {CUSTOMER_KNOWN} SELECT qid, '{NATION_NAME}' AS attr, count(DISTINCT path_id) AS paths, count(*) AS instances FROM kn JOIN ci USING (qid) GROUP BY qid",
)
def merge_paths(spark: SparkSession, folder: str) -> DataFrame:
    return instances.merge_paths(assembled(spark, folder).cells)


def _complexity_sql() -> str:
    parts = [
        f"SELECT '{m}' AS measure, CAST({p} AS DOUBLE) AS p, round(quantile_cont(CAST(v AS DOUBLE), {p}), 6) AS quantile FROM {source}"
        for m, source in (("paths", "mp"), ("instances", "mi"), ("nodes", "mn"))
        for p in (0.25, 0.5, 0.75, 0.9)
    ]
    return (
        f"WITH {CUSTOMER_KNOWN}, al AS (SELECT * FROM kn JOIN ci USING (qid)), mi AS (SELECT qid, path_id, count(*) AS v FROM al GROUP BY 1, 2), "
        f"mp AS (SELECT qid, count(*) AS v FROM mi GROUP BY 1), mn AS (SELECT hops + 1 AS v FROM al) {' UNION ALL '.join(parts)}"
    )


@suite.add("path_complexity", _complexity_sql())
def path_complexity(spark: SparkSession, folder: str) -> DataFrame:
    return instances.path_complexity(assembled(spark, folder).cells).withColumn("quantile", F.round("quantile", 6))


def _order_cells_sql(null: bool) -> str:
    kinds = dict(q.COLUMNS["orders"])
    return " UNION ALL ".join(
        f"SELECT CAST(o_orderkey AS VARCHAR) AS qid, '{a}' AS attr, {q.text(a, kinds[a])} AS truth FROM ord_x WHERE {a} IS {'' if null else 'NOT '}NULL"
        for a in q.ORDER_ATTRIBUTES
    )


@suite.add(
    "sample_known_cells",
    f"WITH {q.ORD_X}, k AS ({_order_cells_sql(False)}), r AS (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY {q.draw('qid', 'attr')}) AS rn FROM k) "
    "SELECT qid, attr, truth FROM r WHERE rn <= 800",
)
def sample_known_cells(spark: SparkSession, folder: str) -> DataFrame:
    catalog = dirty(with_redundant_orders(spark, folder), "orders")
    return sample.known_cells(catalog, "orders", catalog.descriptors("orders"), 800)


@suite.add("missing_cells", f"WITH {q.ORD_X} SELECT qid, attr FROM ({_order_cells_sql(True)})")
def missing_cells(spark: SparkSession, folder: str) -> DataFrame:
    catalog = dirty(with_redundant_orders(spark, folder), "orders")
    return sample.missing_cells(catalog, "orders", catalog.descriptors("orders"))


_ONE_PERCENT = "028f5c28"


@suite.add(
    "downsample_large",
    f"WITH {q.LI} SELECT * FROM li WHERE substring({q.draw('row_id', repr('row'), 10)},1,8) < '{_ONE_PERCENT}'",
)
def downsample_large(spark: SparkSession, folder: str) -> DataFrame:
    catalog = star_catalog(spark, folder)
    return sample.down_sample(catalog.table("lineitem"), catalog.row_id("lineitem"), 0.01)


@suite.add(
    "infer_subsample",
    f"WITH {q.ORD_X} SELECT qid, attr FROM ({_order_cells_sql(True)}) WHERE substring({q.draw('qid || attr', repr('row'), 10)},1,8) < '{_ONE_PERCENT}'",
)
def infer_subsample(spark: SparkSession, folder: str) -> DataFrame:
    catalog = dirty(with_redundant_orders(spark, folder), "orders")
    cells = sample.missing_cells(catalog, "orders", catalog.descriptors("orders"))
    return sample.down_sample(cells, F.concat("qid", "attr"), 0.01)


def _split_sql(key: str, first: str, second: str) -> str:
    h = f"substring({q.draw(key, repr('split'))},1,8)"
    return f"CASE WHEN {h} < '{first}' THEN 'train' WHEN {h} < '{second}' THEN 'valid' ELSE 'test' END AS split"


@suite.add("hash_split", f"WITH {q.ORD_X} SELECT qid, attr, {_split_sql('qid || attr', '99999999', 'cccccccc')} FROM ({_order_cells_sql(False)})")
def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    catalog = dirty(with_redundant_orders(spark, folder), "orders")
    cells = sample.known_cells(catalog, "orders", catalog.descriptors("orders"), 0)
    return cells.select("qid", "attr", sample.split_of(F.concat("qid", "attr"), sample.SAMPLE_SPLIT).alias("split"))


@suite.add("row_split", f"SELECT o_orderkey, {_split_sql('o_orderkey', 'b851eb85', 'cccccccc')} FROM orders")
def row_split(spark: SparkSession, folder: str) -> DataFrame:
    orders = star_catalog(spark, folder).table("orders")
    return orders.select("o_orderkey", sample.split_of(F.col("o_orderkey"), sample.ROW_SPLIT).alias("split"))


@suite.add(
    "table_size_filter",
    "SELECT *, rows > 100 AND rows <= 10000 AS fit FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in q.KEYS) + ")",
)
def table_size_filter(spark: SparkSession, folder: str) -> DataFrame:
    return profile.training_tables(star_catalog(spark, folder))


def _facts_sql() -> str:
    """CTEs `ls`, `es`, `bs` (sampled lines, events, labels) and what they refer to: o, s, c, n, with parts, regions and documents left to the query."""
    taken = {name: f"substring({q.draw(key, repr('row'), 10)},1,8) < '{q.BOUND_20}'" for name, key in (("ls", "row_id"), ("es", "event_id"), ("bs", "doc_id"))}
    return (
        f"{q.LI}, ls AS (SELECT * FROM li WHERE {taken['ls']}), es AS (SELECT * FROM events WHERE {taken['es']}), bs AS (SELECT * FROM labels WHERE {taken['bs']}), "
        "o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM ls)), s AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM ls))"
    )


_DIMS = (
    "n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c UNION SELECT s_nationkey FROM s)), "
    "k AS (SELECT 'lineitem' AS \"table\", row_id FROM ls UNION ALL SELECT 'events', CAST(event_id AS VARCHAR) FROM es UNION ALL SELECT 'labels', CAST(doc_id AS VARCHAR) FROM bs UNION ALL "
    "SELECT 'orders', CAST(o_orderkey AS VARCHAR) FROM o UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM c UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM s UNION ALL "
    "SELECT 'part', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey IN (SELECT l_partkey FROM ls) UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id IN (SELECT doc_id FROM bs) UNION ALL "
    "SELECT 'nation', CAST(n_nationkey AS VARCHAR) FROM n UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n))"
)


@suite.add(
    "fk_closure",
    f"WITH {_facts_sql()}, c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o UNION SELECT user_id FROM es)), {_DIMS} SELECT * FROM k",
)
def fk_closure(spark: SparkSession, folder: str) -> DataFrame:
    """A fifth of every fact table and all rows that they refer to."""
    catalog = star_catalog(spark, folder)
    return sample.kept_rows(catalog, sample.fk_closure(catalog, sample.fact_samples(catalog)))


@suite.add(
    "one_hop_dims",
    # customers are reached from the events directly, so those of the orders do not count
    f"WITH {_facts_sql()}, c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT user_id FROM es)), {_DIMS} SELECT \"table\", count(*) AS rows FROM k GROUP BY 1",
)
def one_hop_dims(spark: SparkSession, folder: str) -> DataFrame:
    catalog = star_catalog(spark, folder)
    kept = sample.kept_rows(catalog, sample.one_hop_dimensions(catalog, sample.fact_samples(catalog)))
    return kept.groupBy("table").agg(F.count(F.lit(1)).alias("rows"))


_TIES = " UNION ALL ".join(
    f"SELECT '{src}:' || CAST({'row_id' if src == 'lineitem' else q.KEYS[src][0]} AS VARCHAR) AS a, '{dst}:' || CAST({column} AS VARCHAR) AS b FROM {'li' if src == 'lineitem' else src} WHERE {column} IS NOT NULL"
    for src, (_, fks) in q.KEYS.items() for column, dst in fks.items()
)


@suite.add(
    "reachable_rows",
    f"WITH RECURSIVE {q.LI}, st AS (SELECT o_orderkey FROM orders WHERE substring({q.draw('o_orderkey', repr('row'), 10)},1,8) < '{_ONE_PERCENT}'), "
    f"t AS ({_TIES}), e AS MATERIALIZED (SELECT a, b FROM t UNION ALL SELECT b, a FROM t), "
    "r(x) AS (SELECT 'orders:' || o_orderkey FROM st UNION SELECT b FROM r JOIN e ON x = a) "
    "SELECT split_part(x, ':', 1) AS \"table\", split_part(x, ':', 2) AS row_id FROM r",
)
def reachable_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All tables with keys; nation and region tie nearly everything together."""
    catalog = star_catalog(spark, folder)
    start = sample.down_sample(catalog.table("orders"), catalog.row_id("orders"), 0.01)
    return sample.reachable_rows(catalog, start.select(F.lit("orders").alias("table"), catalog.row_id("orders").alias("row_id")))


GRAPH_TABLES = ["nation", "customer", "supplier"]


def _row_triples_sql() -> str:
    parts = []
    for t in GRAPH_TABLES:
        pk, fks = q.KEYS[t]
        for key, kind in [(pk, "pk"), *[(f, "fk") for f in fks]]:
            for c, k in q.COLUMNS[t]:
                if c == pk or c in fks:
                    continue
                both = f"FROM {t} WHERE {key} IS NOT NULL AND {c} IS NOT NULL"
                parts.append(
                    f"SELECT '{t}' AS \"table\", '{key}' AS head_col, CAST({key} AS VARCHAR) AS head, '{kind}_desc' AS relation, '{c}' AS tail_col, {q.text(c, k)} AS tail {both}"
                )
                parts.append(f"SELECT '{t}', '{c}', {q.text(c, k)}, 'desc_{kind}', '{key}', CAST({key} AS VARCHAR) {both}")
    return " UNION ALL ".join(parts)


_LINKS = (
    "SELECT 'customer' AS head_table, 'c_nationkey' AS head_col, 'nation' AS tail_table, 'n_nationkey' AS tail_col, 'fk_pk' AS relation, CAST(c_nationkey AS VARCHAR) AS value FROM customer "
    "UNION ALL SELECT 'nation', 'n_nationkey', 'customer', 'c_nationkey', 'pk_fk', CAST(c_nationkey AS VARCHAR) FROM customer "
    "UNION ALL SELECT 'supplier', 's_nationkey', 'nation', 'n_nationkey', 'fk_pk', CAST(s_nationkey AS VARCHAR) FROM supplier "
    "UNION ALL SELECT 'nation', 'n_nationkey', 'supplier', 's_nationkey', 'pk_fk', CAST(s_nationkey AS VARCHAR) FROM supplier"
)
_ENTITIES = f"rt AS ({_row_triples_sql()}), en AS (SELECT DISTINCT \"table\", head_col AS col, head AS value FROM rt)"
_IDS = (
    f"{_ENTITIES}, ids AS (SELECT *, row_number() OVER (ORDER BY md5('[\"' || \"table\" || '\",\"' || col || '\",\"' || value || '\"]')) - 1 AS id FROM en)"
)


@suite.add("entity_row_triples", _row_triples_sql())
def entity_row_triples(spark: SparkSession, folder: str) -> DataFrame:
    return entity.row_triples(star_catalog(spark, folder), GRAPH_TABLES)


@suite.add("entity_links", _LINKS)
def entity_links(spark: SparkSession, folder: str) -> DataFrame:
    return entity.link_triples(star_catalog(spark, folder), GRAPH_TABLES)


@suite.add("entity_ids", f"WITH {_IDS} SELECT * FROM ids")
def entity_ids(spark: SparkSession, folder: str) -> DataFrame:
    return entity.entity_ids(entity.entities(star_catalog(spark, folder), GRAPH_TABLES))


@suite.add(
    "entity_encoded",
    f"WITH {_IDS}, ln AS ({_LINKS}) SELECT h.id AS head_id, relation, t.id AS tail_id FROM rt JOIN ids h ON rt.\"table\" = h.\"table\" AND head_col = h.col AND head = h.value "
    "JOIN ids t ON rt.\"table\" = t.\"table\" AND tail_col = t.col AND tail = t.value UNION ALL "
    "SELECT h.id, relation, t.id FROM ln JOIN ids h ON head_table = h.\"table\" AND head_col = h.col AND ln.value = h.value "
    "JOIN ids t ON tail_table = t.\"table\" AND tail_col = t.col AND ln.value = t.value",
)
def entity_encoded(spark: SparkSession, folder: str) -> DataFrame:
    catalog = star_catalog(spark, folder)
    ids = entity.entity_ids(entity.entities(catalog, GRAPH_TABLES))
    return entity.encoded_triples(catalog, GRAPH_TABLES, ids)


@suite.add(
    "entity_valid_queries",
    f"WITH {q.ORD_D} SELECT DISTINCT 'orders' AS \"table\", 'o_custkey_c_name' AS col, o_custkey_c_name AS value FROM ord_d "
    f"UNION ALL SELECT DISTINCT 'orders', 'o_custkey_c_acctbal', {q.text('o_custkey_c_acctbal', 'd')} FROM ord_d",
)
def entity_valid_queries(spark: SparkSession, folder: str) -> DataFrame:
    catalog = with_redundant_orders(spark, folder)
    valid = discover.valid_query_columns(discover.jaccard_index(catalog, ["orders", "customer", "nation"]), "orders")
    return entity.query_entities(entity.entities(catalog, ["orders"]), valid, "orders")
