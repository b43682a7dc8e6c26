"""Readers and writers for runs, rankings, embeddings and reusable intermediates."""

from __future__ import annotations

import re
from collections.abc import Callable
from hashlib import md5

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relimpute.functions.hashing import bucket_of
from relimpute.functions.text import normalize_value
from relimpute.sources.catalog import TableSpec, lower_names, merge_key

EMBEDDING_SCHEMA = "table string, row_id string, embedding array<double>"
RANKING_SCHEMA = "qid string, attr string, value string, score double"
# fixed value: the last three `_` fields of a run file name are method, train time and test time
RUN_NAME = r"([^_/]+)_([^_/]+)_([^_/]+)\.csv$"
NESTED_CHUNK = 10_000


def write_table(df: DataFrame, path: str, fmt: str = "csv", **options) -> None:
    """Write a table as a folder of part files, one per partition."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.options(**options).save(path)


def dirty_name(table: str, fraction: float) -> str:
    return f"{table}_all_columns_{round(fraction * 100)}"


def read_runs(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """All result files of a glob with `method`, `train_time` and `test_time` from the file name.

    A run may be one file `..._<method>_<train>_<test>.csv` or a folder of that name.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = reader.csv(pattern)
    path = F.regexp_replace(F.col("_metadata.file_path"), r"\.csv/.*$", ".csv")
    return df.withColumns(
        {
            "method": F.regexp_extract(path, RUN_NAME, 1),
            "train_time": F.regexp_extract(path, RUN_NAME, 2).try_cast("double"),
            "test_time": F.regexp_extract(path, RUN_NAME, 3).try_cast("double"),
        }
    )


def run_files(spark: SparkSession, pattern: str) -> list[tuple[str, str, float | None, float | None]]:
    """(path, method, train_time, test_time) of the run files or folders that a glob names; one entry per run."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(conf).globStatus(path)
    out = []
    for status in found or []:
        name = status.getPath().getName()
        match = re.search(RUN_NAME, name)
        if match:
            times = [float(t) if re.fullmatch(r"\d+(\.\d*)?", t) else None for t in match.groups()[1:]]
            out.append((status.getPath().toString(), match.group(1), *times))
    return sorted(out)


def read_run(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """One imputed table as text columns under the names of the query table, whatever form the run has.

    Names are lower-cased, `<column>_imputed` stands for the column, key parts are merged if the run keeps them
    apart, and a key written as `5.0` reads `5`.
    """
    df = lower_names(spark.read.option("header", True).csv(path))
    imputed = {c.removesuffix("_imputed"): c for c in df.columns if c.endswith("_imputed")}
    df = df.select(*[F.col(imputed.get(c, c)).alias(c) for c in dict.fromkeys(c.removesuffix("_imputed") for c in df.columns)])
    parts = [c for c in spec.pk if c in df.columns]
    df = df.withColumns({c: normalize_value(F.col(c)) for c in parts})
    if spec.key not in df.columns and len(parts) == len(spec.pk):
        df = df.withColumn(spec.key, merge_key(spec))
    if spec.key not in df.columns:
        raise ValueError(f"{path} has no key {spec.key} of {spec.name}")
    return df


def write_rankings(rankings: DataFrame, path: str, score: str = "score", nested: bool = True) -> None:
    """Rankings as JSON lines.

    The nested form is `{"query": "q__<row>__<attr>", "qid": ..., "attr": ..., "docs": {value: score}}`; merged keys and
    attributes hold underscores themselves, so both stand beside the name. A query with very
    many values is spread over several lines, so no line grows without limit.
    """
    if not nested:
        rankings.write.mode("overwrite").json(path)
        return
    query = F.concat(F.lit("q__"), F.col("qid"), F.lit("__"), F.col("attr"))
    sizes = rankings.groupBy("qid", "attr").agg(F.ceil(F.count(F.lit(1)) / NESTED_CHUNK).alias("_parts"))
    parted = rankings.join(sizes, ["qid", "attr"]).withColumn("_part", bucket_of(F.md5("value"), F.col("_parts")))
    lines = parted.groupBy(query.alias("query"), "qid", "attr", "_part").agg(
        F.map_from_entries(F.collect_list(F.struct("value", F.col(score).cast("double").alias("score")))).alias("docs")
    )
    lines.drop("_part").write.mode("overwrite").json(path)


def read_rankings(spark: SparkSession, path: str, nested: bool = True) -> DataFrame:
    """Rankings in long form (qid, attr, value, score)."""
    if not nested:
        return spark.read.schema(RANKING_SCHEMA).json(path)
    lines = spark.read.schema("query string, qid string, attr string, docs map<string, double>").json(path)
    # files of others have the name only: then the attribute is what follows the last pair of underscores
    name = r"^q__(.*)__(.*)$"
    return lines.select(
        F.coalesce("qid", F.regexp_extract("query", name, 1)).alias("qid"),
        F.coalesce("attr", F.regexp_extract("query", name, 2)).alias("attr"),
        F.explode("docs").alias("value", "score"),
    )


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """The embedding table, or an empty one when none was stored."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], EMBEDDING_SCHEMA)
    return found.select("table", "row_id", F.col("embedding").cast("array<double>").alias("embedding"))


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    embeddings.write.mode("overwrite").partitionBy("table").parquet(path)


def input_key(df: DataFrame) -> str:
    """A name for what a DataFrame computes: its plan and the paths, sizes and times of the files it reads.

    File data come from a scan that lists the files and reads none.
    """
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    plan = re.sub(r"\[id=#?\d+\]|#\d+L?", "", plan)
    files = df.inputFiles()
    seen = ""
    if files:
        listed = df.sparkSession.read.format("binaryFile").load(sorted(files)).select("path", "length", "modificationTime")
        state = listed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h")).first()
        seen = f"{state['n']}:{state['h']}"
    return md5(f"{plan}|{seen}".encode()).hexdigest()


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def reuse(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored form of what `build` describes, computed only if it is not there yet.

    It lies in a folder under `path` that is named by plan and input files (`input_key`), so changed inputs or another
    computation never meet an old result; a folder without `_SUCCESS` is the rest of a broken write and is
    written anew. `build` returns a lazy DataFrame; nothing runs if the result is there.
    """
    df = build()
    folder = f"{path.rstrip('/')}/{input_key(df)}"
    if not _written(spark, folder):
        df.write.mode("overwrite").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def find_rows(df: DataFrame, attributes: dict[str, object]) -> DataFrame:
    """Rows in which every given attribute has the given value; a value asked of a number column is read as a whole number."""
    for name, value in attributes.items():
        numeric = df.schema[name].dataType.typeName() in ("integer", "long", "short", "byte", "double", "float")
        df = df.where(F.col(name) == F.lit(int(value) if numeric else value))
    return df
