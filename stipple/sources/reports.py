"""Results as JSON and CSV, and back. Missing numbers are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The keys of a fingerprint record.
FINGERPRINT = ("type", "n_cells", "vmr_curve", "skewness_curve", "scales_um", "mock_vmr_mean", "mock_vmr_std", "chi_squared", "f_statistic", "p_value", "peak_scale_um", "peak_vmr_ratio", "integrated_excess", "width", "direction", "is_significant")


def finite(rows: DataFrame) -> DataFrame:
    """Doubles that are not finite become null."""
    fix = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    return rows.select(*[fix(F.col(n)).alias(n) if t in ("double", "float") else F.transform(n, fix).alias(n) if t == "array<double>" else F.col(n) for n, t in rows.dtypes])


def fingerprint_records(found: DataFrame) -> DataFrame:
    return finite(found.select(*[c for c in FINGERPRINT if c in found.columns]))


def pair_records(rows: DataFrame) -> DataFrame:
    """Records keyed ``a__x__b``."""
    return finite(rows).withColumn("key", F.concat_ws("__x__", "type_a", "type_b"))


def write_json(rows: DataFrame, path: str) -> None:
    finite(rows).write.mode("overwrite").json(path)


def as_document(rows: DataFrame, key: str | None = None, **meta: object) -> DataFrame:
    """One row, one JSON text: the records as an object by ``key`` or a list; with ``meta``, those first and the records as results.

    The format wants one document, so this is for results: a record for each type or pair
    of types, whatever the number of points.
    """
    record = F.struct(*[c for c in rows.columns if c != key])
    every = F.map_from_entries(F.collect_list(F.struct(F.col(key), record))) if key else F.collect_list(record)
    one = finite(rows).agg(every.alias("results"))
    if not meta:
        return one.select(F.to_json("results").alias("document"))
    return one.select(F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in meta.items()], "results")).alias("document"))


def write_document(rows: DataFrame, path: str, key: str | None = None, **meta: object) -> None:
    as_document(rows, key, **meta).coalesce(1).write.mode("overwrite").text(path)


_RECORD = "struct<n_cells:bigint,vmr_curve:array<double>,skewness_curve:array<double>,scales_um:array<double>,mock_vmr_mean:array<double>,mock_vmr_std:array<double>,chi_squared:double,f_statistic:double,p_value:double,peak_scale_um:double,condition_number:double,n_mocks_used:bigint>"


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("_file"), F.regexp_replace("value", r"\bNaN\b", "null").alias("value"))


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(type, ...) of an object of records; lacking curves are empty, lacking counts 0."""
    rows = _text(spark, path).select(F.explode(F.from_json("value", f"map<string,{_RECORD}>")).alias("type", "r")).select("type", "r.*")
    return rows.withColumns({"skewness_curve": F.coalesce("skewness_curve", F.array().cast("array<double>")), "condition_number": F.coalesce("condition_number", F.lit(0.0)), "n_mocks_used": F.coalesce("n_mocks_used", F.lit(0))})


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(type_a, type_b, ...) of an object of records keyed ``a__x__b``."""
    record = "struct<scales_um:array<double>,correlation_curve:array<double>,null_corr_mean:array<double>,null_corr_std:array<double>,peak_scale_um:double,peak_correlation:double,significant_scales:array<boolean>>"
    rows = _text(spark, path).select(F.explode(F.from_json("value", f"map<string,{record}>")).alias("key", "r"))
    return rows.select(F.split_part("key", F.lit("__x__"), F.lit(1)).alias("type_a"), F.split_part("key", F.lit("__x__"), F.lit(2)).alias("type_b"), "r.*")


def write_trials(rows: DataFrame, path: str) -> None:
    """A list with an object of records by type for each trial, in order; for results, which are few."""
    record = F.struct(*[c for c in rows.columns if c not in ("trial", "type")])
    each = finite(rows).groupBy("trial").agg(F.map_from_entries(F.collect_list(F.struct(F.col("type"), record))).alias("m"))
    every = each.agg(F.transform(F.sort_array(F.collect_list(F.struct("trial", F.to_json("m").alias("t")))), lambda s: s["t"]).alias("all"))
    every.select(F.concat(F.lit("["), F.array_join("all", ","), F.lit("]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """(trial, type, ...) of a list of objects of fingerprint records."""
    rows = _text(spark, path).select(F.posexplode(F.from_json("value", f"array<map<string,{_RECORD}>>")).alias("trial", "m"))
    return rows.select("trial", F.explode("m").alias("type", "r")).select("trial", "type", "r.*")


def find_curves(spark: SparkSession, pattern: str) -> DataFrame:
    """(unit, place, scale, vmr, null_mean, null_sd) of the first file of a pattern, by name, that holds one curve.

    Such a file is one flat object with ``vmr`` and ``scales_nm`` or ``scales_um``, and
    perhaps ``null_mean`` and ``null_std``. Files that are broken or hold something else
    are passed over; without any the result is empty.
    """
    fields = "struct<vmr:array<double>,scales_nm:array<double>,scales_um:array<double>,null_mean:array<double>,null_std:array<double>>"
    rows = _text(spark, pattern).select(F.col("_file"), F.from_json("value", fields).alias("c")).where("c.vmr is not null and (c.scales_nm is not null or c.scales_um is not null)")
    first = rows.orderBy("_file").limit(1)
    curve = first.select(F.when(F.col("c.scales_nm").isNotNull(), "nm").otherwise("um").alias("unit"), F.coalesce("c.scales_nm", "c.scales_um").alias("scales"), "c.vmr", "c.null_mean", "c.null_std")
    at = curve.select("*", F.posexplode("scales").alias("place", "scale"))
    return at.select("unit", "place", "scale", *[F.get(c, F.col("place")).alias(n) for c, n in (("vmr", "vmr"), ("null_mean", "null_mean"), ("null_std", "null_sd"))])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
