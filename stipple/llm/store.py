"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own where it is unset, on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="stipple-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Paths of this module by application, in order.
_MADE: dict[str, list[str]] = {}


def made(spark: SparkSession) -> list[str]:
    return _MADE.setdefault(spark.sparkContext.applicationId, [])


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/stipple-{uuid.uuid4().hex[:12]}-{name}"
    made(spark).append(path)
    return path


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables and files that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        made(spark).remove(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and a lost executor loses none of it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows in a batch that goes to Python; whole texts can be long, and Spark's own 10,000 of them fill memory on both sides.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets ``BATCH_ROWS`` for the session unless it has a smaller figure."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """The number of partitions for exchanges by a key that this package places itself."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
