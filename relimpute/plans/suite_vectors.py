"""Queries over column typing, feature preparation and row embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relimpute.operators import embed, features, instances, profile, vectors
from relimpute.plans import sql as q
from relimpute.plans.registry import Registry
from relimpute.plans.star import star_catalog
from relimpute.plans.suite_paths import HOME, NEIGHBOURS, paths_of
from relimpute.plans.suite_tables import dirty, with_redundant_orders
from relimpute.session import cut_lineage
from relimpute.sources.catalog import Catalog

suite = Registry()

LINE_KINDS = {
    "l_linenumber": "i", "l_quantity": "d", "l_extendedprice": "d", "l_discount": "d", "l_tax": "d", "l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "t",
}
LINE_TYPES = {"l_linenumber": "int", "l_shipdate": "timestamp"}


def _stype_sql() -> str:
    parts = []
    for c, kind in LINE_KINDS.items():
        dtype = LINE_TYPES.get(c, q.DTYPES[kind])
        counts = f"(SELECT {c} AS v, count(*) AS n FROM lineitem GROUP BY 1)"
        if kind == "d":
            rule = "CASE WHEN bool_or(v IS NULL) AND bool_and(v = floor(v)) THEN CASE WHEN min(n) FILTER (v IS NOT NULL) > 4 THEN 'cat' ELSE 'num' END ELSE 'num' END"
        elif kind == "i":
            rule = "CASE WHEN min(n) FILTER (v IS NOT NULL) > 4 THEN 'cat' ELSE 'num' END"
        else:
            rule = "CASE WHEN count(v) > 0 THEN 'cat' END"
        parts.append(f"SELECT 'lineitem' AS \"table\", '{c}' AS col, '{dtype}' AS dtype, {rule} AS stype FROM {counts}")
    return " UNION ALL ".join(parts)


@suite.add("stype_inference", _stype_sql())
def stype_inference(spark: SparkSession, folder: str) -> DataFrame:
    typed = profile.database_types(star_catalog(spark, folder), ["lineitem"])
    return typed.withColumn("dtype", F.regexp_replace("dtype", "_ntz$", ""))


@suite.add(
    "stype_lists",
    "WITH e AS (SELECT min(len(embedding)) AS lo, max(len(embedding)) AS hi, bool_and(len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0) AS sound FROM embeddings) "
    "SELECT 'embedding' AS col, CASE WHEN lo = hi AND sound THEN 'embedding' ELSE 'sequence_numerical' END AS stype FROM e "
    "UNION ALL SELECT 'ragged', 'sequence_numerical' UNION ALL SELECT 'words', 'multicategorical'",
)
def stype_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The stored vectors, vectors cut to a length that differs by row, and lists of words."""
    stored = spark.read.parquet(f"{folder}/embeddings.parquet")
    lists = stored.select(
        "embedding", F.slice("embedding", 1, (F.col("vec_id") % 3 + 1).cast("int")).alias("ragged"), F.array(F.col("label").cast("string")).alias("words")
    )
    return profile.list_types(lists, ["embedding", "ragged", "words"])


def _mode(table: str, column: str) -> str:
    return f"(SELECT {column} FROM (SELECT {column}, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1) ORDER BY n DESC, {column} LIMIT 1)"


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount"]
_LINE_X = f"{q.LI}, lx AS (SELECT row_id, {', '.join(q.masked('row_id', c) for c in _NUMERIC)} FROM li)"


@suite.add(
    "numeric_prep",
    f"WITH {_LINE_X} SELECT row_id, "
    + ", ".join(f"round((coalesce({c}, {_mode('lx', c)}) - (SELECT min({c}) FROM lx)) / (SELECT max({c}) - min({c}) FROM lx), 6) AS {c}" for c in _NUMERIC)
    + " FROM lx",
)
def numeric_prep(spark: SparkSession, folder: str) -> DataFrame:
    lines = dirty(star_catalog(spark, folder), "lineitem").table("lineitem").select("row_id", *_NUMERIC)
    return features.numeric_prep(lines, _NUMERIC).withColumns({c: F.round(c, 6) for c in _NUMERIC})


_CATEGORIES = ["p_brand", "p_type"]
_PART_X = f"px AS (SELECT p_partkey, {', '.join(q.masked('p_partkey', c) for c in _CATEGORIES)} FROM part)"


def _categorical_sql() -> str:
    filled = ", ".join(f"coalesce({c}, {_mode('px', c)}) AS {c}" for c in _CATEGORIES)
    codes = ", ".join(f"k_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM pf))" for c in _CATEGORIES)
    joins = " ".join(f"JOIN k_{c} ON pf.{c} = k_{c}.v" for c in _CATEGORIES)
    return f"WITH {_PART_X}, pf AS (SELECT p_partkey, {filled} FROM px), {codes} SELECT p_partkey, {', '.join(f'k_{c}.code AS {c}' for c in _CATEGORIES)} FROM pf {joins}"


@suite.add("categorical_prep", _categorical_sql())
def categorical_prep(spark: SparkSession, folder: str) -> DataFrame:
    parts = dirty(star_catalog(spark, folder), "part").table("part").select("p_partkey", *_CATEGORIES)
    return features.categorical_prep(parts, _CATEGORIES)


_LABEL_X = f"lx AS (SELECT doc_id, {q.masked('doc_id', 'quality')}, {q.masked('doc_id', 'toxic')} FROM labels)"


@suite.add(
    "binary_prep",
    f"WITH {_LABEL_X} SELECT doc_id, "
    + ", ".join(f"CAST(CAST(coalesce({c}, {_mode('lx', c)}) AS VARCHAR) IN ('yes','true','1','t') AS INTEGER) AS {c}" for c in ("quality", "toxic"))
    + " FROM lx",
)
def binary_prep(spark: SparkSession, folder: str) -> DataFrame:
    return features.binary_prep(dirty(star_catalog(spark, folder), "labels").table("labels"), ["quality", "toxic"])


@suite.add(
    "feature_table",
    "SELECT p_partkey, (p_size - (SELECT min(p_size) FROM part)) / (SELECT CAST(max(p_size) - min(p_size) AS DOUBLE) FROM part) AS p_size, "
    "round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part), 6) AS p_retailprice, p_brand, p_type FROM part",
)
def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    parts = star_catalog(spark, folder).table("part")
    prepared = features.feature_table(parts, ["p_partkey"], [], ["p_size", "p_retailprice"], ["p_brand", "p_type"])
    return prepared.withColumn("p_retailprice", F.round("p_retailprice", 6))


@suite.add("row_embeddings")
def row_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return features.row_embeddings(star_catalog(spark, folder), "customer")


def entries(found: DataFrame, *key: str) -> DataFrame:
    """The components of embeddings that are not zero, as rows."""
    opened = found.select(*key, F.posexplode("embedding").alias("slot", "value")).where(F.col("value") != 0)
    return opened.withColumn("value", F.round("value", 9))


_SLOTS = "CAST(unnest(range(64)) AS INTEGER) AS slot, round(unnest(e), 9) AS value"
_ALL_TABLES = ["region", "nation", "customer", "supplier", "part"]


@suite.add(
    "additive_embeddings",
    "WITH " + ", ".join(f"p_{t} AS ({q.value_parts(q.KEYS[t][0], q.COLUMNS[t], t)}), e_{t} AS ({q.dense(f'p_{t}', 'row_id')})" for t in _ALL_TABLES)
    + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", row_id, {_SLOTS} FROM e_{t}" for t in _ALL_TABLES) + ") WHERE value <> 0",
)
def additive_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the dimension tables, keys included."""
    return entries(embed.database_vectors(star_catalog(spark, folder), "orders", _ALL_TABLES, keys=True), "table", "row_id")


_ORDER_COLUMNS = [c for c in q.COLUMNS["orders"] if c[0] not in ("o_orderkey", "o_custkey")]
_ASKED = " UNION ALL ".join(f"SELECT CAST(o_orderkey AS VARCHAR) AS row_id, '{c}' AS asked FROM ord_x WHERE {c} IS NULL" for c, _ in _ORDER_COLUMNS)


@suite.add(
    "query_embeddings",
    f"WITH {q.ORD_X}, p AS ({q.value_parts('o_orderkey', _ORDER_COLUMNS, 'ord_x')}), ak AS ({_ASKED}), pa AS (SELECT row_id, asked, slot, w FROM ak JOIN p USING (row_id) WHERE attr <> asked), "
    f"en AS ({q.dense('pa', 'row_id, asked')}) SELECT qid, attr, slot, value FROM (SELECT row_id AS qid, asked AS attr, {_SLOTS} FROM en) WHERE value <> 0",
)
def query_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Every null cell of orders has a vector of its row, though every attribute is asked for."""
    catalog = dirty(with_redundant_orders(spark, folder), "orders")
    asked = instances.missing(catalog.descriptors("orders"))
    return entries(embed.query_vectors(catalog, "orders", asked), "qid", "attr")


def stored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def node_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """The stored vectors given to nations (by key) and suppliers (by key, after the nations)."""
    stored = stored_vectors(spark, folder)
    nations = stored.select(F.lit("nation").alias("table"), F.col("vec_id").cast("string").alias("row_id"), "embedding")
    suppliers = stored.where(F.col("vec_id") >= 25)
    suppliers = suppliers.select(F.lit("supplier").alias("table"), (F.col("vec_id") - 25).cast("string").alias("row_id"), "embedding")
    return nations.unionByName(suppliers)


@suite.add(
    "embedding_lookup",
    "SELECT CAST(doc_id AS VARCHAR) AS row_id, round(coalesce(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 0.0), 6) AS norm, "
    "CAST(coalesce(len(embedding), 64) AS INTEGER) AS size FROM documents LEFT JOIN embeddings ON doc_id = vec_id",
)
def embedding_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents met with the vectors of the same number; the others get zeros."""
    rows = star_catalog(spark, folder).table("documents").select(F.lit("documents").alias("table"), F.col("doc_id").cast("string").alias("row_id"))
    stored = stored_vectors(spark, folder).select(F.lit("documents").alias("table"), F.col("vec_id").cast("string").alias("row_id"), "embedding")
    found = vectors.lookup(rows, stored)
    norm = F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding")))
    return found.select("row_id", F.round(norm, 6).alias("norm"), F.size("embedding").alias("size"))


@suite.add(
    "cosine_pairs",
    "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    stored = stored_vectors(spark, folder)
    following = stored.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return stored.join(following, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cos"))


@suite.add(
    "cosine_topn",
    "SELECT query_id, target_id, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, target_id) AS rank "
    "FROM (SELECT a.vec_id AS query_id, b.vec_id AS target_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s "
    "FROM embeddings a CROSS JOIN embeddings b)) WHERE rank <= 5",
)
def cosine_topn(spark: SparkSession, folder: str) -> DataFrame:
    stored = stored_vectors(spark, folder)
    names = ("vec_id", "embedding")
    return vectors.cosine_top_n(stored, stored, 5, names, names).withColumn("similarity", F.round("similarity", 6))


@suite.add(
    "l2_knn",
    "SELECT query_id, target_id, round(d, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), target_id) AS rank "
    "FROM (SELECT a.vec_id AS query_id, b.vec_id AS target_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d "
    "FROM embeddings a CROSS JOIN embeddings b)) WHERE rank <= 5",
)
def l2_knn(spark: SparkSession, folder: str) -> DataFrame:
    stored = stored_vectors(spark, folder)
    names = ("vec_id", "embedding")
    return vectors.knn_join(stored, stored, 5, "l2", names, names).withColumn("distance", F.round("distance", 6))


@suite.add(
    "fallback_neighbours",
    "SELECT qid, 'embeddings' AS path_id, md5(CAST(vec_id AS VARCHAR)) AS instance_id, CAST(vec_id AS VARCHAR) AS row_ids, round(d, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), CAST(vec_id AS VARCHAR)) AS rank FROM (SELECT CAST(l.doc_id AS VARCHAR) AS qid, b.vec_id, "
    "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM labels l JOIN embeddings a ON l.doc_id = a.vec_id CROSS JOIN embeddings b)) WHERE rank <= 5",
)
def fallback_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Attributes of `labels` have no key path; their candidates are the nearest rows of a related table."""
    stored = stored_vectors(spark, folder)
    asked = star_catalog(spark, folder).table("labels").select(F.col("doc_id").alias("vec_id")).join(stored, "vec_id")
    asked = asked.select(F.col("vec_id").cast("string").alias("qid"), "embedding")
    held = stored.select(F.lit("embeddings").alias("table"), F.col("vec_id").cast("string").alias("row_id"), "embedding")
    near = vectors.neighbour_candidates(asked, "embeddings", held)
    return near.withColumns({"row_ids": F.concat_ws(">", "row_ids"), "distance": F.round("distance", 6)})


_SIM = (
    f"ps AS (SELECT CAST(c_custkey AS VARCHAR) AS qid, '{q.path_id(NEIGHBOURS)}' AS path_id, md5(concat_ws('>', CAST(n_nationkey AS VARCHAR), CAST(s_suppkey AS VARCHAR))) AS instance_id, "
    "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "JOIN supplier ON n_nationkey = s_nationkey LEFT JOIN embeddings a ON a.vec_id = n_nationkey LEFT JOIN embeddings b ON b.vec_id = s_suppkey + 25 UNION ALL "
    f"SELECT CAST(c_custkey AS VARCHAR), '{q.path_id(HOME)}', md5(CAST(n_nationkey AS VARCHAR)), NULL FROM customer JOIN nation ON c_nationkey = n_nationkey)"
)


def similar_instances(catalog: Catalog, spark: SparkSession, folder: str) -> tuple[instances.Shared, DataFrame]:
    """Instances shared by the customers of a nation, and these with their similarity."""
    paths = paths_of(catalog, HOME, NEIGHBOURS)
    shared = instances.shared_instances(catalog, instances.query_rows(catalog, "customer", paths), paths)
    found = vectors.path_similarity(cut_lineage(shared.found), paths, node_embeddings(spark, folder))
    return shared, cut_lineage(found.select("qid", "path_id", "instance_id", "sim"))


@suite.add("path_similarity", f"WITH {_SIM} SELECT qid, path_id, instance_id, round(sim, 6) AS sim FROM ps")
def path_similarity(spark: SparkSession, folder: str) -> DataFrame:
    shared, found = similar_instances(star_catalog(spark, folder), spark, folder)
    rounded = found.withColumn("sim", F.round("sim", 6))
    return instances.of_members(shared, rounded).select("qid", "path_id", "instance_id", "sim")


@suite.add(
    "path_topk",
    f"WITH {_SIM} SELECT qid, path_id, instance_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY qid, path_id ORDER BY sim DESC NULLS LAST, instance_id) AS r FROM ps) WHERE r <= 2",
)
def path_topk(spark: SparkSession, folder: str) -> DataFrame:
    catalog = star_catalog(spark, folder)
    paths = paths_of(catalog, HOME, NEIGHBOURS)
    shared, found = similar_instances(catalog, spark, folder)
    # the best of every ask, then of the rows that have one key
    few = instances.of_members(shared, instances.top_instances(found, paths, 2, "sim"))
    best = instances.top_instances(few, paths, 2, "sim")
    return best.select("qid", "path_id", "instance_id", F.round("sim", 6).alias("sim"))
