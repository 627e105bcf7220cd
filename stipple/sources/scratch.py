"""Tables in the folder that driver and executors share, for results that several later steps read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a new one where it is unset, on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="stipple-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Paths by application, for ``clear``.
_MADE: dict[str, list[str]] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/stipple-{uuid.uuid4().hex[:12]}-{name}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back: what comes after starts from the files, whichever executors are lost."""
    path = fresh_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> int:
    """Deletes what this module has written for the session, for callers who have read their results; returns how many tables."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    _delete(spark, made)
    return len(made)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end: results have to be read or written elsewhere by then."""
    made = _MADE.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    try:
        yield
    finally:
        _delete(spark, made[before:])
        del made[before:]
