"""A store of regions: cells written once, partitioned by division and clustered by their key, read region by region.

A folder holds ``cells`` (a partition for each division, a fixed number of buckets by
cell_label in each, sorted), ``places`` (cell_label and parcellation_index, in the same
buckets), ``terms`` (the parcellation's names) and ``manifest``, one line for each
division: its rows and a checksum of them. A region is read by its partition alone, and
cells meet their places bucket by bucket, with no exchange.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prep
from ..operators.prep import DIVISIONS, LEVELS
from .tables import exists

CELL = ("x", "y", "z", *LEVELS)
TERMS = ("division", "structure", "substructure")


class RegionStore:
    """``path``: a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _name(self, table: str) -> str:
        return f"stipple_{table}_{hashlib.sha256(self.path.encode()).hexdigest()[:12]}"

    def _write(self, rows: DataFrame, table: str, by: list[str]) -> None:
        # dealt by bucket before, so that a partition has one file for each bucket and no more
        dealt = rows.repartition(self.buckets, "cell_label")
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(table)}")
        writer = dealt.write.mode("overwrite").format("parquet").bucketBy(self.buckets, "cell_label").sortBy("cell_label").option("path", f"{self.path}/{table}")
        (writer.partitionBy(*by) if by else writer).saveAsTable(self._name(table))

    def write(self, cells: DataFrame, coordinates: DataFrame, parcellation: DataFrame) -> RegionStore:
        """Cells of all divisions; what is there of ``CELL`` is kept, and cells without a division are in none of the regions."""
        regions = prep.with_regions(coordinates.select("cell_label", "parcellation_index"), parcellation)
        kept = prep.annotate(cells.select("cell_label", *[c for c in CELL if c in cells.columns]), regions, ("division",)).where("division is not null")
        self._write(kept, "cells", ["division"])
        self._write(coordinates.select("cell_label", "parcellation_index"), "places", [])
        parcellation.select("parcellation_index", *[c for c in TERMS if c in parcellation.columns]).write.mode("overwrite").parquet(f"{self.path}/terms")
        written = self._table("cells")
        sums = written.groupBy("division").agg(F.count("*").alias("n_cells"), F.sum(F.xxhash64(*[c for c in written.columns if c != "division"]).cast("decimal(20,0)")).cast("string").alias("checksum"))
        sums.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest")
        return self

    def _table(self, table: str) -> DataFrame:
        """The table with its buckets, which a session that has not written it learns anew from the files."""
        name = self._name(table)
        if not self.spark.catalog.tableExists(name):
            files = self.spark.read.parquet(f"{self.path}/{table}")
            cols = ", ".join(f"`{c}` {t}" for c, t in files.dtypes)
            by = "PARTITIONED BY (division) " if table == "cells" else ""
            self.spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet {by}CLUSTERED BY (cell_label) SORTED BY (cell_label) INTO {self._buckets(table)} BUCKETS LOCATION '{self.path}/{table}'")
            if by:
                self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return self.spark.table(name)

    def _buckets(self, table: str) -> int:
        """As many as the numbers in the names of the files."""
        found = [int(m[1]) for f in self.spark.read.parquet(f"{self.path}/{table}").inputFiles() if (m := re.search(r"_(\d{5})\.c\d+", f.rsplit("/", 1)[-1]))]
        return max([self.buckets, *[b + 1 for b in found]])

    def manifest(self) -> dict[str, dict]:
        """Division to n_cells and checksum; empty without a store."""
        if not exists(self.spark, f"{self.path}/manifest"):
            return {}
        rows = self.spark.read.schema("division string, n_cells long, checksum string").json(f"{self.path}/manifest").collect()
        return {r["division"]: {"n_cells": r["n_cells"], "checksum": r["checksum"]} for r in rows}

    def region(self, name: str) -> DataFrame:
        """The cells of a region by its name or division code: one partition of the files."""
        return self._table("cells").where(F.col("division") == DIVISIONS.get(name.lower(), name))

    def strata(self, name: str) -> DataFrame:
        """The cells of a region with structure and substructure, and what its strata are: ``layer`` in the isocortex, ``nucleus`` in the thalamus.

        Every cell comes back once; cells without a place, or whose place has no such
        term, have null.
        """
        return augmented(self.region(name), self._table("places"), self.spark.read.parquet(f"{self.path}/terms"), name)


#: Region to the name of its strata.
STRATA = {"isocortex": "layer", "thalamus": "nucleus"}


def augmented(cells: DataFrame, places: DataFrame, terms: DataFrame, region: str) -> DataFrame:
    """``cells`` with parcellation_index, structure, substructure and, where the region has strata, ``STRATA`` of it."""
    at = cells.drop("parcellation_index", "structure", "substructure").join(places.select("cell_label", "parcellation_index"), "cell_label", "left")
    out = at.join(terms.select("parcellation_index", "structure", "substructure"), "parcellation_index", "left")
    kind = STRATA.get(region.lower())
    if kind == "layer":
        return out.withColumn("layer", prep.cortical_layer(F.col("substructure")))
    return out.withColumn("nucleus", F.col("structure")) if kind == "nucleus" else out
