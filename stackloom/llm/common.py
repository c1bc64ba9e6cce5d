"""Shared helpers of the training-data operators: scratch tables, raw text buffers, label folds."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom import session
from stackloom.session import delete_on_exit, scratch_dir

def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and bound what an Arrow batch of whole documents holds."""
    session.ready(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/stackloom-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that no model may learn from: crc32(doc_id as text) mod 5 = 0; null ids count as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, n + 1 offsets) of a string or binary column without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: int, limit: int = 2 << 20):
    """Parts of a batch with about so many bytes of text each, one row at least: bounds the arrays made of a part."""
    _, ends = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit)))
        yield batch.slice(at, to - at)
        at = to


def rows_bytes(column: pa.Array) -> list[bytes]:
    """The rows of a string column as bytes; nulls are empty."""
    data, ends = utf8(column)
    whole = data.tobytes()
    return [whole[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]


def table(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of the given columns in the schema's order."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in schema for x in (columns[f.name],)], schema=schema)
