"""Queries over keys, redundancy, injection, discovery and meta-paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relimpute.operators import denorm, discover, graph, inject, profile
from relimpute.operators.denorm import Hub
from relimpute.plans import sql as q
from relimpute.plans.registry import Registry
from relimpute.plans.star import star_catalog
from relimpute.sources import catalog as keys
from relimpute.sources import io
from relimpute.sources.catalog import Catalog

suite = Registry()

# what the profile of the hub tables selects, for queries that are not about that choice
HUBS = [Hub("customer", ("c_name", "c_acctbal")), Hub("nation", ("n_name",))]
VALUE_TABLES = list(q.KEYS)
# where the imputation of orders searches: not among its own lines, whose dates and states would answer too
ORDER_SOURCES = ["orders", "customer", "nation", "supplier", "region", "part", "events"]


def clean(spark: SparkSession, folder: str) -> Catalog:
    """The star tables with the hub columns copied into orders, customer and supplier."""
    catalog = star_catalog(spark, folder)
    return catalog.with_tables(**{t: denorm.denormalize(catalog, t, HUBS) for t in ("orders", "customer", "supplier")})


def with_redundant_orders(spark: SparkSession, folder: str) -> Catalog:
    catalog = star_catalog(spark, folder)
    return catalog.with_tables(orders=denorm.denormalize(catalog, "orders", HUBS))


def dirty(catalog: Catalog, table: str) -> Catalog:
    """A fifth of every descriptor of the table nulled."""
    masked = inject.inject_missing(catalog.table(table), catalog.row_id(table), catalog.descriptors(table), 0.2)
    return catalog.with_tables(**{table: masked})


def _edge_usage_sql() -> str:
    parts = []
    for src, (_, fks) in q.KEYS.items():
        for column, dst in fks.items():
            key = q.KEYS[dst][0]
            parts.append(
                f"SELECT '{src}' AS src_table, '{column}' AS src_col, '{dst}' AS dst_table, '{key}' AS dst_col, count(*) AS rows, "
                f"count(DISTINCT p.{key}) AS parents, count(*) FILTER (p.{key} IS NULL) AS dangling "
                f"FROM {src} s LEFT JOIN {dst} p ON s.{column} = p.{key} WHERE s.{column} IS NOT NULL"
            )
    return (
        f"WITH e AS ({' UNION ALL '.join(parts)}), h AS (SELECT dst_table, count(DISTINCT src_table) AS referencing FROM e GROUP BY dst_table) "
        "SELECT e.*, referencing, referencing > 1 AS is_hub FROM e JOIN h USING (dst_table)"
    )


@suite.add("fk_edges_hubs", _edge_usage_sql())
def fk_edges_hubs(spark: SparkSession, folder: str) -> DataFrame:
    catalog = star_catalog(spark, folder)
    hubs = denorm.hub_tables(catalog, 0)
    return denorm.edge_usage(catalog).join(hubs, "dst_table").withColumn("is_hub", F.col("referencing") > 1)


def _profile_sql(table: str) -> str:
    pk, fks = q.KEYS[table]
    int_columns = {"c_nationkey", "p_size"}
    parts = []
    for c, kind in q.COLUMNS[table]:
        role = "pk" if c == pk else "fk" if c in fks else "desc"
        dtype = "int" if c in int_columns else q.DTYPES[kind]
        parts.append(
            f"SELECT '{table}' AS \"table\", '{c}' AS col, '{role}' AS role, '{dtype}' AS dtype, sum(n) AS rows, sum(n) FILTER (v IS NOT NULL) AS non_null, "
            f"count(v) AS ndv, min(n) FILTER (v IS NOT NULL) AS min_count, "
            f"coalesce(bool_and(try_cast(v AS DOUBLE) = floor(try_cast(v AS DOUBLE))), false) AS all_whole "
            f"FROM (SELECT {q.text(c, kind)} AS v, count(*) AS n FROM {table} GROUP BY 1)"
        )
    typed = (
        "CASE WHEN non_null = 0 THEN NULL WHEN dtype = 'double' AND NOT (non_null < rows AND all_whole) THEN 'num' "
        "WHEN dtype IN ('int','bigint','double') AND min_count > 4 THEN 'cat' WHEN dtype IN ('int','bigint','double') THEN 'num' ELSE 'cat' END AS stype"
    )
    return f"SELECT \"table\", col, role, dtype, CAST(rows AS BIGINT) AS rows, CAST(non_null AS BIGINT) AS non_null, ndv, min_count, all_whole, {typed} FROM ({' UNION ALL '.join(parts)})"


@suite.add("hub_column_profile", _profile_sql("customer") + " UNION ALL " + _profile_sql("part"))
def hub_column_profile(spark: SparkSession, folder: str) -> DataFrame:
    catalog = star_catalog(spark, folder)
    return profile.column_profile(catalog, "customer").unionByName(profile.column_profile(catalog, "part"))


@suite.add("denorm_orders", f"WITH {q.ORD_D} SELECT * FROM ord_d")
def denorm_orders(spark: SparkSession, folder: str) -> DataFrame:
    catalog = star_catalog(spark, folder)
    return denorm.denormalize(catalog, "orders", denorm.choose_hubs(catalog, min_refs=1), verify=True)


@suite.add("denorm_supplier", f"WITH {q.SUPP_D} SELECT * FROM supp_d")
def denorm_supplier(spark: SparkSession, folder: str) -> DataFrame:
    catalog = star_catalog(spark, folder)
    return denorm.denormalize(catalog, "supplier", denorm.choose_hubs(catalog, min_refs=1))


@suite.add(
    "denorm_row_count",
    "SELECT * FROM (SELECT 'orders' AS \"table\", count(*) AS rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer "
    "UNION ALL SELECT 'supplier', count(*) FROM supplier)",
)
def denorm_row_count(spark: SparkSession, folder: str) -> DataFrame:
    return profile.table_sizes(clean(spark, folder), ["orders", "customer", "supplier"])


@suite.add(
    "hub_repeated_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def hub_repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    return denorm.repeated_keys(star_catalog(spark, folder).table("lineitem"), ["l_orderkey", "l_linenumber"])


@suite.add("inject_orders", f"WITH {q.ORD_X} SELECT * FROM ord_x")
def inject_orders(spark: SparkSession, folder: str) -> DataFrame:
    return dirty(with_redundant_orders(spark, folder), "orders").table("orders")


def _report_sql() -> str:
    counts = [f"SELECT '{a}' AS col, count(*) FILTER ({a} IS NULL) AS nulls, count(*) AS cells FROM ord_x" for a in q.ORDER_ATTRIBUTES]
    total = f"SELECT 'all', CAST(sum(nulls) AS BIGINT), max(cells) * {len(q.ORDER_ATTRIBUTES) + 2} FROM c"
    return f"WITH {q.ORD_X}, c AS ({' UNION ALL '.join(counts)}) SELECT col, nulls, round(nulls / cells, 6) AS share FROM (SELECT * FROM c UNION ALL {total})"


@suite.add("inject_report", _report_sql())
def inject_report(spark: SparkSession, folder: str) -> DataFrame:
    catalog = dirty(with_redundant_orders(spark, folder), "orders")
    return profile.null_report(catalog.table("orders"), catalog.descriptors("orders")).withColumn("share", F.round("share", 6))


@suite.add(
    "dropna_rows",
    f"WITH {q.ORD_X} SELECT * FROM ord_x WHERE " + " AND ".join(f"{a} IS NOT NULL" for a in q.ORDER_ATTRIBUTES),
)
def dropna_rows(spark: SparkSession, folder: str) -> DataFrame:
    return inject.drop_incomplete(dirty(with_redundant_orders(spark, folder), "orders").table("orders"))


@suite.add(
    "inject_exact_fraction",
    f"WITH r AS (SELECT *, row_number() OVER (ORDER BY {q.draw('c_custkey', repr('c_acctbal'))}) AS rn, count(*) OVER () AS n FROM customer) "
    "SELECT c_custkey, c_name, c_nationkey, CASE WHEN rn <= round(n * 0.2) THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM r",
)
def inject_exact_fraction(spark: SparkSession, folder: str) -> DataFrame:
    return inject.inject_missing_exact(star_catalog(spark, folder).table("customer"), "c_custkey", "c_acctbal", 0.2)


STATUS_WORDS = {"O": "open", "F": ""}


@suite.add(
    "map_orderstatus",
    "SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN NULL ELSE '' END AS o_orderstatus, "
    "o_totalprice, o_orderdate, o_orderpriority FROM orders",
)
def map_orderstatus(spark: SparkSession, folder: str) -> DataFrame:
    return inject.map_values(star_catalog(spark, folder).table("orders"), "o_orderstatus", STATUS_WORDS)


@suite.add(
    "map_unmapped",
    "SELECT o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY 1",
)
def map_unmapped(spark: SparkSession, folder: str) -> DataFrame:
    return inject.unmapped_values(star_catalog(spark, folder).table("orders"), "o_orderstatus", STATUS_WORDS)


PART_STRINGS = ["p_name", "p_brand", "p_type"]


def _ordinal_sql() -> str:
    dictionaries = ", ".join(
        f"d_{c} AS (SELECT v, row_number() OVER (ORDER BY f, v) - 1 AS code FROM (SELECT {c} AS v, min(p_partkey) AS f FROM part GROUP BY 1))"
        for c in PART_STRINGS
    )
    masks = ", ".join(q.masked("p_partkey", c) for c in [*PART_STRINGS, "p_size", "p_retailprice"])
    joins = " ".join(f"LEFT JOIN d_{c} ON x.{c} = d_{c}.v" for c in PART_STRINGS)
    picks = ", ".join(f"d_{c}.code AS {c}" for c in PART_STRINGS)
    return f"WITH {dictionaries}, x AS (SELECT p_partkey, {masks} FROM part) SELECT p_partkey, {picks}, p_size, p_retailprice FROM x {joins}"


@suite.add("ordinal_first_seen", _ordinal_sql())
def ordinal_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    catalog = star_catalog(spark, folder)
    return inject.encode_strings(catalog.table("part"), dirty(catalog, "part").table("part"), PART_STRINGS, "p_partkey")


@suite.add(
    "dtype_descriptor",
    " UNION ALL ".join(
        [f"SELECT '{c}' AS col, 'categorical' AS kind, count(DISTINCT {c}) AS dim, CAST(count(DISTINCT {c}) AS VARCHAR) AS classes FROM part" for c in PART_STRINGS]
        + [f"SELECT '{c}', 'real', CAST(1 AS BIGINT), ''" for c in ("p_size", "p_retailprice")]
    ),
)
def dtype_descriptor(spark: SparkSession, folder: str) -> DataFrame:
    catalog = star_catalog(spark, folder)
    return profile.dtype_report(catalog.table("part"), catalog.descriptors("part"))


@suite.add("composite_key", "SELECT concat_ws('__', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)) AS conv_id__turn, role, text FROM conversations")
def composite_key(spark: SparkSession, folder: str) -> DataFrame:
    catalog = star_catalog(spark, folder)
    return keys.normalize_key(catalog.table("conversations"), catalog.specs["conversations"])


@suite.add(
    "split_key",
    "WITH k AS (SELECT concat_ws('__', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)) AS conv_id__turn, role FROM conversations) "
    "SELECT conv_id__turn, role, CAST(split_part(conv_id__turn, '__', 1) AS BIGINT) AS conv_id, CAST(split_part(conv_id__turn, '__', 2) AS BIGINT) AS turn FROM k",
)
def split_key(spark: SparkSession, folder: str) -> DataFrame:
    catalog = star_catalog(spark, folder)
    spec = catalog.specs["conversations"]
    return keys.split_key(keys.normalize_key(catalog.table("conversations"), spec).drop("text"), spec)


@suite.add("keys_to_string", "SELECT * REPLACE (CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey) FROM orders")
def keys_to_string(spark: SparkSession, folder: str) -> DataFrame:
    catalog = star_catalog(spark, folder)
    return keys.keys_to_string(catalog.table("orders"), catalog.specs["orders"])


@suite.add("narrow_whole_numbers", "SELECT * REPLACE (CAST(l_quantity AS BIGINT) AS l_quantity) FROM lineitem")
def narrow_whole_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return keys.narrow_whole_numbers(star_catalog(spark, folder).table("lineitem").drop("row_id"))


@suite.add(
    "row_lookup",
    f"WITH {q.LI} SELECT * FROM li WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber = 3",
)
def row_lookup(spark: SparkSession, folder: str) -> DataFrame:
    wanted = {"l_returnflag": "R", "l_linestatus": "O", "l_linenumber": 3}
    return io.find_rows(star_catalog(spark, folder).table("lineitem"), wanted)


@suite.add("column_values", f"WITH {q.ORD_D}, {q.LI} SELECT t AS \"table\", c AS col, v AS value FROM ({q.cell_values(VALUE_TABLES)})")
def column_values(spark: SparkSession, folder: str) -> DataFrame:
    return discover.column_values(with_redundant_orders(spark, folder), VALUE_TABLES)


@suite.add("containment_index", f"WITH {q.containment(VALUE_TABLES)} SELECT t1, c1, t2, c2, round(score, 6) AS score FROM idx")
def containment_index(spark: SparkSession, folder: str) -> DataFrame:
    index = discover.containment_index(with_redundant_orders(spark, folder), VALUE_TABLES)
    return index.withColumn("score", F.round("score", 6))


def _pairs_sql(tables: list[str]) -> str:
    own = [(t, c) for t in tables for c, _ in q.COLUMNS[t] if not q.is_key(t, c)]
    pairs = ", ".join(f"('{a}','{b}','{c}','{d}')" for a, b in own for c, d in own if a < c)
    return (
        f"WITH {q.containment(tables)}, p(t1, c1, t2, c2) AS (VALUES {pairs}) "
        "SELECT t1, c1, t2, c2, round(coalesce(score, 0.0), 6) AS score FROM p LEFT JOIN idx USING (t1, c1, t2, c2)"
    )


@suite.add("containment_exact_pairs", _pairs_sql(VALUE_TABLES))
def containment_exact_pairs(spark: SparkSession, folder: str) -> DataFrame:
    index = discover.all_pairs_index(with_redundant_orders(spark, folder), VALUE_TABLES)
    return index.withColumn("score", F.round("score", 6))


@suite.add("minhash_columns", f"WITH {q.signatures(VALUE_TABLES)} SELECT t AS \"table\", c AS col, n, signature FROM sg")
def minhash_columns(spark: SparkSession, folder: str) -> DataFrame:
    catalog = with_redundant_orders(spark, folder)
    refs = discover.refs_table(catalog, discover.column_refs(catalog, VALUE_TABLES))
    signatures = discover.minhash(catalog, VALUE_TABLES)
    return signatures.join(F.broadcast(refs), "id").select("table", "col", "n", "signature")


@suite.add(
    "lsh_containment",
    f"WITH {q.lsh(VALUE_TABLES)} SELECT t1, c1, t2, c2, round(score, 6) AS score FROM idx JOIN hits USING (t1, c1, t2, c2)",
)
def lsh_containment(spark: SparkSession, folder: str) -> DataFrame:
    return discover.lsh_index(with_redundant_orders(spark, folder), VALUE_TABLES).withColumn("score", F.round("score", 6))


@suite.add("joinable_threshold", f"WITH {q.containment(VALUE_TABLES)}, {q.COMPATIBLE} SELECT t1, c1, t2, c2, round(score, 6) AS score FROM comp")
def joinable_threshold(spark: SparkSession, folder: str) -> DataFrame:
    index = discover.containment_index(with_redundant_orders(spark, folder), VALUE_TABLES)
    return discover.compatible_columns(index, 0.9).select("t1", "c1", "t2", "c2", F.round("score", 6).alias("score"))


@suite.add(
    "joinable_topk",
    f"WITH {q.containment(VALUE_TABLES)} SELECT t1, c1, t2, c2, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER "
    "(PARTITION BY t1, c1 ORDER BY score DESC, t2, c2) AS INTEGER) AS rank FROM idx) WHERE rank <= 3",
)
def joinable_topk(spark: SparkSession, folder: str) -> DataFrame:
    index = discover.containment_index(with_redundant_orders(spark, folder), VALUE_TABLES)
    return discover.joinable_topk(index, 3).withColumn("score", F.round("score", 6))


_JACCARD = (
    f"WITH {q.containment(VALUE_TABLES)}, jac AS (SELECT t1, c1, t2, c2, CAST(common AS DOUBLE) / (x.n + y.n - common) AS score FROM pr "
    "JOIN nd x ON t1 = x.t AND c1 = x.c JOIN nd y ON t2 = y.t AND c2 = y.c WHERE NOT k1 AND NOT k2) "
)


@suite.add("jaccard_columns", _JACCARD + "SELECT t1, c1, t2, c2, round(score, 6) AS score FROM jac")
def jaccard_columns(spark: SparkSession, folder: str) -> DataFrame:
    return discover.jaccard_index(with_redundant_orders(spark, folder), VALUE_TABLES).withColumn("score", F.round("score", 6))


@suite.add(
    "valid_query_columns",
    _JACCARD + "SELECT c1 AS col, round(max(score), 6) AS score FROM jac WHERE t1 = 'orders' AND score > 0.8 GROUP BY c1",
)
def valid_query_columns(spark: SparkSession, folder: str) -> DataFrame:
    index = discover.jaccard_index(with_redundant_orders(spark, folder), VALUE_TABLES)
    return discover.valid_query_columns(index, "orders").withColumn("score", F.round("score", 6))


@suite.add(
    "related_columns",
    f"WITH {q.containment(VALUE_TABLES)}, {q.COMPATIBLE} SELECT c1 AS attr, t2 AS related, c2 AS col FROM (SELECT *, row_number() OVER "
    "(PARTITION BY c1, t2 ORDER BY score DESC, c2) AS r FROM comp WHERE t1 = 'part') WHERE r = 1",
)
def related_columns(spark: SparkSession, folder: str) -> DataFrame:
    index = discover.containment_index(with_redundant_orders(spark, folder), VALUE_TABLES)
    mapped = discover.related_columns(discover.compatible_columns(index, 0.9), "part")
    return mapped.select("attr", F.explode("tables").alias("related", "col"))


def _goal_sizes() -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS goal, count(*) AS goal_rows FROM {t}" for t in q.KEYS)


@suite.add(
    "meta_paths_bfs",
    f"WITH RECURSIVE {q.path_search('orders')}, sz AS ({_goal_sizes()}) "
    "SELECT goal, substring(md5(label),1,8) AS path_id, label, CAST(hops AS INTEGER) AS hops, goal_rows FROM pth JOIN sz USING (goal)",
)
def meta_paths_bfs(spark: SparkSession, folder: str) -> DataFrame:
    """Paths over the foreign keys that hold in the data, with the size of the table they lead to."""
    catalog = star_catalog(spark, folder)
    sound = denorm.edge_usage(catalog).where(F.col("dangling") == 0)
    paths = graph.enumerate_paths(sound, "orders").drop("edges")
    return paths.join(profile.table_sizes(catalog).withColumnsRenamed({"table": "goal", "rows": "goal_rows"}), "goal")


@suite.add(
    "meta_paths_by_attr",
    f"WITH RECURSIVE {q.path_search('orders', VALUE_TABLES)}, {q.containment(VALUE_TABLES)}, {q.COMPATIBLE}, "
    f"goals AS (SELECT DISTINCT c1 AS attr, t2 AS goal FROM comp WHERE t1 = 'orders' AND c1 IN ({', '.join(repr(a) for a in q.ORDER_ATTRIBUTES)})) "
    "SELECT attr, path_id, label, hops FROM (SELECT attr, substring(md5(label),1,8) AS path_id, label, CAST(hops AS INTEGER) AS hops, "
    "row_number() OVER (PARTITION BY attr ORDER BY hops, label) AS r FROM goals JOIN pth USING (goal)) WHERE r <= 10",
)
def meta_paths_by_attr(spark: SparkSession, folder: str) -> DataFrame:
    catalog = with_redundant_orders(spark, folder)
    compatible = discover.compatible_columns(discover.containment_index(catalog, VALUE_TABLES), 0.9)
    edges = catalog.fk_edges().where(F.col("src_table").isin(*VALUE_TABLES) & F.col("dst_table").isin(*VALUE_TABLES))
    paths = graph.enumerate_paths(edges, "orders")
    return graph.paths_by_attribute(compatible, paths, "orders", catalog.descriptors("orders")).drop("edges")


@suite.add(
    "fallback_tables",
    f"WITH {q.containment(VALUE_TABLES)}, {q.COMPATIBLE} SELECT attr, related, n, CAST(row_number() OVER (PARTITION BY attr ORDER BY n DESC, related) AS INTEGER) AS rank FROM "
    "(SELECT c1 AS attr, t2 AS related, count(*) AS n FROM comp WHERE t1 = 'labels' AND c1 IN ('quality', 'toxic') GROUP BY 1, 2) QUALIFY rank <= 10",
)
def fallback_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Without the one key that leads out of `labels`, its attributes fall back on tables that share their values."""
    catalog = with_redundant_orders(spark, folder)
    compatible = discover.compatible_columns(discover.containment_index(catalog, VALUE_TABLES), 0.9)
    attributes = catalog.descriptors("labels")
    edges = catalog.fk_edges().where(F.col("src_table") != "labels")
    found = graph.paths_by_attribute(compatible, graph.enumerate_paths(edges, "labels"), "labels", attributes)
    return graph.fallback_tables(compatible, found, "labels", attributes)
