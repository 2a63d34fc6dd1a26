"""Running a streaming plan over what is there and reading its last state as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import own_dir


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream; the path is a pattern, which may stand for one file or a folder."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")


def drained(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key that a stream gives in update mode, after all that is there now has been read.

    Batches are written to the shared folder with their number, so a batch that runs again after a failure is
    overwritten; state and progress are kept in a checkpoint beside them.
    """
    spark = stream.sparkSession
    root = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{root}/rows")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))
