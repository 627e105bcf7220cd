"""From a region store to reports, one for each region and analysis; a run that was cut short goes on where it stopped.

A report is a folder of documents, written under a name of its own and then renamed, so
it is whole or not there. It holds a key, a hash of what it was made from: the region's
checksum, the analysis and its options. A report with the right key is not made again.
One that fails is named in the outcome, and the others are still made.

``python -m stipple.plans.runner --store FOLDER --results FOLDER`` makes them all.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import logging
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curves as cv
from ..functions.scales import Scales
from ..operators import grid, nulls, prep
from ..sources import reports
from ..sources.scratch import scope
from ..sources.store import STRATA, RegionStore
from . import analyses as an

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Options:
    n_mocks: int = 50
    min_cells: int = 50
    grid_size: int = 256
    type_level: str = "class"
    n_trials: int = 10
    n_boot: int = 200
    n_bins: int = 5


@dataclass(frozen=True)
class Outcome:
    region: str
    analysis: str
    state: str  # made, kept, skipped or failed
    message: str = ""


class Report:
    """Where an analysis puts its documents."""

    def __init__(self, path: str) -> None:
        self.path = path

    def json(self, name: str, rows: DataFrame, key: str | None = None, **meta: object) -> None:
        reports.write_document(rows, f"{self.path}/{name}.json", key, **meta)

    def csv(self, name: str, rows: DataFrame) -> None:
        reports.write_csv(rows.coalesce(1), f"{self.path}/{name}.csv")


def _points(cells: DataFrame, options: Options, *extra: str) -> tuple[DataFrame, grid.Roi, Scales]:
    points = prep.prepare(cells, options.type_level, extra=extra)
    roi = grid.roi_of(points, options.grid_size)
    return points, roi, Scales.default(roi.extent, options.grid_size)


def fingerprints(store: RegionStore, region: str, options: Options, report: Report) -> None:
    points, roi, scales = _points(store.region(region), options)
    found = an.fingerprints(points, roi, scales, options.n_mocks, options.min_cells)
    report.json("fingerprints", reports.fingerprint_records(found), "type")
    report.csv("summary", an.fingerprint_summary(found))


def cooccurrence(store: RegionStore, region: str, options: Options, report: Report) -> None:
    points, roi, scales = _points(store.region(region), options)
    rows = an.cooccurrence(points, roi, scales, options.n_mocks, options.min_cells)
    arrays = rows.groupBy("type_a", "type_b").agg(*[cv.array_of(c).alias(n) for c, n in (("um", "scales_um"), ("r", "correlation_curve"), ("null_mean", "null_corr_mean"), ("null_sd", "null_corr_std"), ("significant", "significant_scales"))])
    peaks = an.cooccurrence_summary(rows)
    both = arrays.join(peaks.select("type_a", "type_b", "peak_scale_um", "peak_correlation"), ["type_a", "type_b"])
    report.json("cooccurrence", reports.pair_records(both).drop("type_a", "type_b"), "key")
    report.csv("summary", peaks)
    report.csv("matrix", an.matrix_entries(rows).orderBy("type_a", "type_b"))


def mediation(store: RegionStore, region: str, options: Options, report: Report) -> None:
    kind = STRATA.get(region.lower())
    if kind is None:
        raise NotApplicable(f"{region} has no strata")
    cells = store.strata(region)
    points, roi, scales = _points(prep.valid_strata(cells.withColumn("stratum", F.col(kind))), options, "stratum")
    curves = an.null_kinds(points, roi, scales, {"overall": None, "within": "stratum"}, options.n_mocks, options.min_cells)
    found, boot = an.mediation(curves), an.mediation_bootstrap(curves, options.n_boot)
    rows = found.join(boot.drop("mediation_pct"), "type", "left")
    summary = an.summary_of(found, "mediation_pct").first()
    strata = {r["stratum"]: r["n"] for r in points.groupBy("stratum").agg(F.count("*").alias("n")).orderBy("stratum").collect()}
    report.json(
        "mediation", rows, region=region, stratum_variable=kind, type_level=options.type_level, n_mocks=options.n_mocks, n_strata=len(strata), strata=F.map_from_arrays(F.array(*map(F.lit, strata)), F.array(*map(F.lit, strata.values()))),
        summary=F.struct(F.lit(summary["n"]).alias("n_types_analyzed"), F.lit(summary["mean"]).alias("mean_mediation_pct"), F.lit(summary["median"]).alias("median_mediation_pct")),
    )
    report.csv("summary", prep.latest_first(rows, "mediation_pct", ["type"]))


def regional(store: RegionStore, region: str, options: Options, report: Report) -> None:
    points, roi, scales = _points(store.region(region), options)
    report.json("regional", an.envelope(an.regional(points, roi, scales, min(20, options.n_mocks))).orderBy("scale_idx"), region=region)


def jitter(store: RegionStore, region: str, options: Options, report: Report) -> None:
    points, roi, scales = _points(store.region(region), options)
    rows = an.jittered(points, roi, scales, options.n_trials, options.n_mocks, options.min_cells)
    each = rows.groupBy("trial", "type").agg(F.max("n").alias("n_cells"), *[cv.array_of(c).alias(n) for c, n in (("vmr", "vmr_curve"), ("um", "scales_um"), ("null_mean", "mock_vmr_mean"))])
    reports.write_trials(each, f"{report.path}/trials.json")
    offsets = nulls.jitters(roi, options.n_trials)
    report.json("spread", an.jitter_spread(rows).orderBy("type"), offsets=F.array(*[F.array(*map(F.lit, o)) for o in offsets]))


class NotApplicable(Exception):
    """The region has nothing that the analysis needs."""


ANALYSES: dict[str, Callable[[RegionStore, str, Options, Report], None]] = {"fingerprints": fingerprints, "cooccurrence": cooccurrence, "mediation": mediation, "regional": regional, "jitter": jitter}


class _Files:
    """Small texts and renames in whatever store Spark reaches."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def read(self, path: str) -> str | None:
        p, fs = self.at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        p, fs = self.at(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        p, fs = self.at(path)
        fs.delete(p, True)

    def put(self, made: str, place: str) -> None:
        """``made`` takes the place of what is there."""
        self.delete(place)
        p, fs = self.at(made)
        to = self.at(place)[0]
        fs.mkdirs(to.getParent())
        if not fs.rename(p, to):
            raise OSError(f"{made} could not be renamed to {place}")


def key_of(entry: dict, region: str, analysis: str, options: Options) -> str:
    return hashlib.sha256(json.dumps([entry, region, analysis, asdict(options)], sort_keys=True).encode()).hexdigest()


def run(store: RegionStore, results: str, regions: list[str], names: list[str] | None = None, options: Options | None = None) -> list[Outcome]:
    """Makes the reports that are not there under ``results``/region/analysis; the outcome has one entry for each."""
    spark, options, files = store.spark, options or Options(), _Files(store.spark)
    there, out = store.manifest(), []
    for region in regions:
        entry = there.get(prep.DIVISIONS.get(region.lower(), region))
        for name in names or list(ANALYSES):
            if entry is None:
                log.warning("the store has no region %s; there are %s", region, sorted(there))
                out.append(Outcome(region, name, "skipped", "no such region in the store"))
                continue
            key, place = key_of(entry, region, name, options), f"{results.rstrip('/')}/{region}/{name}"
            if files.read(f"{place}/key") == key:
                out.append(Outcome(region, name, "kept"))
                continue
            made = f"{results.rstrip('/')}/.making/{key[:16]}"
            files.delete(made)
            try:
                with scope(spark):
                    ANALYSES[name](store, region, options, Report(made))
                files.write(f"{made}/key", key)
                files.put(made, place)
                out.append(Outcome(region, name, "made"))
            except NotApplicable as e:
                out.append(Outcome(region, name, "skipped", str(e)))
            except Exception as e:  # the others are still to be made, and this one is named
                log.exception("%s of %s failed", name, region)
                out.append(Outcome(region, name, "failed", f"{type(e).__name__}: {e}"[:500]))
            finally:
                files.delete(made)
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="All reports of a region store")
    p.add_argument("--store", required=True)
    p.add_argument("--results", required=True)
    p.add_argument("--regions", nargs="+", default=sorted(prep.DIVISIONS))
    p.add_argument("--analyses", nargs="+", choices=sorted(ANALYSES), default=None)
    for name, value in asdict(Options()).items():
        p.add_argument(f"--{name.replace('_', '-')}", type=type(value), default=value)
    args = vars(p.parse_args(argv))
    options = replace(Options(), **{k: args[k] for k in asdict(Options())})
    spark = SparkSession.builder.appName("stipple reports").getOrCreate()
    done = run(RegionStore(spark, args["store"]), args["results"], args["regions"], args["analyses"], options)
    for o in done:
        print(f"{o.region}\t{o.analysis}\t{o.state}\t{o.message}")
    return int(any(o.state == "failed" for o in done))


if __name__ == "__main__":
    raise SystemExit(main())
