"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files go when it ends, not only when the driver happens to collect garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scope: contextvars.ContextVar[str] = contextvars.ContextVar("scope", default="")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and the master is local (tests), a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
    return root.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, or that of the scope we are in."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}{_scope.get()}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: lineage ends here and a lost executor costs nothing. What was shuffled for it is deleted."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREED) if was is None else spark.conf.set(FREED, was)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that isn't needed any more, or those that a plan over one reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path, fs = _path(df.sparkSession, folder)
        fs.delete(path, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted at the end; results must have been written by then."""
    token = _scope.set(f"{_scope.get()}/scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        clean(spark)
        _scope.reset(token)


def clean(spark: SparkSession) -> None:
    """Delete what this application, or the scope we are in, has stored; to be called when its results have been written."""
    path, fs = _path(spark, own_dir(spark))
    fs.delete(path, True)


def _path(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cached(spark: SparkSession, path: str, make, fresh: bool = False) -> DataFrame:
    """The Parquet table at path; made and written first if it isn't there whole. Cache rows before fragments are merged, as merging twice differs."""
    done, fs = _path(spark, f"{path}/_SUCCESS")
    if fresh or not fs.exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
