"""What the operators share: table reading, checked joins and Arrow batch helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import stored  # noqa: F401  the operators' way to cut lineage

#: Rows and stored bytes of a table that may be broadcast; every use counts them first.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Rows and bytes of text that Python holds at once from one Arrow batch.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20
#: Bytes of an Arrow batch at most, but for a single row; an executor holds some of them outside its heap for each task.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame) -> bool:
    """Whether df, a stored table or a selection from one, has few enough rows and bytes to be broadcast."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= BROADCAST_BYTES and df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that broadcasts the right side, a stored table, if its counted size allows, else shuffles both."""
    return left.join(F.broadcast(right) if small(right) else right, on, how)


def free_name(columns, name: str) -> str:
    """name, or name with underscores before it until no column is called so (case-insensitively)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batch in runs of few rows and bytes, so that long texts never stand in Python all at once."""
    col = batch.column(column)
    width = max(1, col.nbytes // max(1, batch.num_rows))
    step = max(1, min(SLICE_ROWS, SLICE_BYTES // width))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run) with batches of few bytes, and workers that give free Arrow memory back after each task.

    The session's bound on the bytes of a batch is lowered for that; a smaller one stays.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < most <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))

    def freeing(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(freeing, schema)


def map_text(df: DataFrame, key: str, text: str, fn: Callable[[list, list], list], schema: str, *, binary: bool = False) -> DataFrame:
    """One row (key, *fn's columns) for each row of df; fn takes lists of keys and texts (None: null), in bounded slices.

    schema: DDL of the columns that fn returns as lists or Arrow arrays. binary: texts come as UTF-8 bytes.
    """
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField("key", kind)] + list(T._parse_datatype_string(schema).fields))
    arrow = _arrow_schema(out)
    made = df.select(F.col(key).alias("key"), (F.encode(F.col(text), "UTF-8") if binary else F.col(text)).alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                cols = fn(part.column(0).to_pylist(), part.column(1).to_pylist())
                arrays = [part.column(0)] + [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, list(arrow)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

    return map_batches(made, run, out).withColumnRenamed("key", key)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
