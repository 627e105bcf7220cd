"""Readers and writers of cell tables, matrices and region files."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prep import LEVELS

log = logging.getLogger(__name__)

_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()
CELLS = T.StructType([T.StructField(n, t) for n, t in (("cell_label", _S), ("brain_section_label", _S), ("cluster_alias", _I), ("x", _D), ("y", _D), ("z", _D), ("neurotransmitter", _S), ("class", _S), ("subclass", _S), ("supertype", _S), ("cluster", _S))])
COORDINATES = T.StructType([T.StructField(n, t) for n, t in (("cell_label", _S), ("x", _D), ("y", _D), ("z", _D), ("parcellation_index", _I))])
PARCELLATION = T.StructType([T.StructField("parcellation_index", _I), *[T.StructField(n, _S) for n in ("organ", "category", "division", "structure", "substructure")]])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with a header; columns by their names, so files may hold more or other orders. A malformed number is null. Without a schema types are inferred."""
    if schema is None:
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema if f.name in raw.columns])


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A CSV matrix with row labels in its first column, as (row, column, value)."""
    wide = spark.read.option("header", True).csv(path)
    first, *names = wide.columns
    values = wide.select(F.col(f"`{first}`").alias("row"), *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    return values.unpivot("row", names, "column", "value")


def write_matrix(wide: DataFrame, path: str) -> None:
    wide.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_region(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_region(cells: DataFrame, path: str) -> None:
    """Key, coordinates and those type levels that there are."""
    cols = [c for c in ("cell_label", "x", "y", "z", *LEVELS) if c in cells.columns]
    cells.select(*cols).write.mode("overwrite").parquet(path)


def read_regions_there(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The region files that exist; the others are named in the log."""
    out = {}
    for name, path in paths.items():
        if exists(spark, path):
            out[name] = read_region(spark, path)
        else:
            log.warning("no file for %s: %s", name, path)
    return out


def region_etl(cells: DataFrame, coordinates: DataFrame, parcellation: DataFrame, name: str) -> DataFrame:
    """Join, filter and project the cells of one region, ready for ``write_region``."""
    from ..operators import prep

    joined = prep.annotate(cells, prep.with_regions(coordinates, parcellation))
    return prep.region(joined, name)
