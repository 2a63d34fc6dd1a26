"""Files with exact names, each made by one task and all of them seen at once or not at all.

Rows are written by Spark into a folder beside the target, one folder a name, so a task that fails or runs twice leaves
nothing behind; when the whole job has ended, its files are renamed. What was at the target before is replaced then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import _path


def write_named(rows: DataFrame, name: Column, path: str, kind: str, *, order: list | None = None, **options) -> list[str]:
    """rows as files path/<name>, those of a name in one file and in the given order; the sorted names.

    kind: csv, json or text. A file is one task's stream, whatever its length; names are spread over tasks. Names must be
    plain file names: an empty or null one, or one with a slash or a colon, is an error, and nothing is written. An
    empty table replaces the target by an empty folder.
    """
    spark, own = rows.sparkSession, "_file"
    if own in rows.columns:
        raise ValueError(f"the column {own} is the writer's own")
    named = rows.withColumn(own, name.cast("string"))
    bad = named.where(F.col(own).isNull() | F.col(own).rlike(r"[/:]") | (F.col(own) == "") | F.col(own).startswith(".") | F.col(own).startswith("_"))
    if not bad.isEmpty():
        raise ValueError(f"not a file name: {bad.first()[own]!r}")
    aside, fs = _path(spark, f"{path.rstrip('/')}-{uuid.uuid4().hex}")
    target, _ = _path(spark, path)
    try:
        named.repartition(own).sortWithinPartitions(own, *(order or [])).write.partitionBy(own).options(**options).format(kind).save(f"{aside}/rows")
        ready, _ = _path(spark, f"{aside}/ready")
        fs.mkdirs(ready)
        names = []
        for folder in fs.listStatus(_path(spark, f"{aside}/rows")[0]):  # a folder for each name
            if not folder.isDirectory():
                continue
            parts = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            if len(parts) != 1:
                raise RuntimeError(f"{len(parts)} parts of {folder.getPath()}")
            names.append(_plain(folder.getPath().getName().removeprefix(f"{own}=")))
            _moved(fs, parts[0], _path(spark, f"{aside}/ready/{names[-1]}")[0])
        fs.delete(target, True)
        _moved(fs, ready, target)
        return sorted(names)
    finally:
        fs.delete(aside, True)


def _plain(name: str) -> str:
    """A partition's folder name without its escapes."""
    from urllib.parse import unquote

    return unquote(name)


def _moved(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise RuntimeError(f"{source} can't be renamed to {target}")
