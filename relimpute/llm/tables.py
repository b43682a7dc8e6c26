"""Tables in the shared folder, and the columns an operator takes from its input."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relimpute.session import ensure_checkpoint_dir

#: Rows of a narrow table up to which it is sent to every task.
SENT_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`; a private one only where it is unset on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        ensure_checkpoint_dir(spark)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that run, not the work before. The table
    stays until the shared folder is emptied, since the caller's plan reads it later.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def taken(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra columns can't clash."""
    return docs.select(*[docs[f"`{there}`"].alias(here) for here, there in columns.items()])


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as no column of `docs` has, whatever its case."""
    there, free = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in there:
            name += "_"
        free.append(name)
        there.add(name.lower())
    return free


def partitions(spark: SparkSession, rows: int, each: int) -> int:
    """Enough partitions for `each` rows per partition, at least as many as the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / each))


def sent_if_small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted rows (narrow ones) allow it; otherwise Spark joins as it sees fit."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def crc_fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; NULL keys count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")
