"""Vectors as rows: which take part, and arrays written to the shared folder."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from relimpute.llm import files
from relimpute.llm.tables import taken


def finite(vector: Column) -> Column:
    """True for an array that is there, has a component, and holds only finite numbers."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, number), F.lit(False))


def vector_rows(vectors: DataFrame, id_col: str, vec_col: str, zero: bool, **more: str) -> DataFrame:
    """vec_id, vec (array<float> as it came, else array<double>) and the columns of `more`, for rows with an id and a finite vector.

    All-zero ones only if `zero`.
    """
    rows = taken(vectors, vec_id=id_col, vec=vec_col, **more)
    if not isinstance(rows.schema["vec"].dataType, ArrayType) or not isinstance(rows.schema["vec"].dataType.elementType, FloatType):
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("vec")))
    return rows if zero else rows.where(F.exists("vec", lambda x: x != 0))


def matrices(table: pa.Table | pa.RecordBatch, column: str = "vec"):
    """(row numbers, matrix of doubles) per vector length of a batch."""
    lists = table.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    begin = np.cumsum(at) - at
    for size in np.unique(at):
        rows = np.flatnonzero(at == size)
        yield rows, flat[begin[rows][:, None] + np.arange(size)].astype(float)


def slabs(batches, rows: int):
    """The batches of a task as tables of `rows` rows, the last one shorter."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def write_table(folder: str, table: pa.Table) -> str:
    """A table as one file of the shared folder; a task that runs again writes its own."""
    uri = f"{folder}/{uuid.uuid4().hex}"
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    files.write_array(uri, np.frombuffer(sink.getvalue(), np.uint8))
    return uri


def read_table(uri: str) -> pa.Table:
    with pa.ipc.open_stream(pa.py_buffer(files.read_array(uri, np.uint8))) as source:
        return source.read_all()
