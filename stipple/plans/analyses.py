"""Whole analyses as one plan each: fingerprints, co-occurrence, regions, jitter, mediation, dimensions, Ripley's L."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import curves as cv
from ..functions.scales import Scales
from ..operators import grid, nulls, packed, pairs, prep, stats
from ..sources.scratch import cut


def labelled_curves(points: DataFrame, roi: grid.Roi, scales: Scales, n_mocks: int, min_cells: int, stratum: str | None = None, salt: str = "") -> DataFrame:
    """(mock_id, type, scale_idx, vox, um, n, vmr, skewness) of the real labels (-1) and of shuffled ones.

    All types share one set of shuffles and one grid of the whole point set. The
    curves (types x mocks x scales rows) are what every later step reads several
    times, so they are written to the shared folder (``scratch.clear`` deletes them).
    """
    types = prep.frequent_types(points, min_cells)
    counts = nulls.shuffled_pixels(points, roi, n_mocks, stratum, salt).drop("trial").join(F.broadcast(types.select("type")), "type", "left_semi")
    curve = packed.curves_of_packed(counts, roi, scales, ["mock_id", "type"])
    # a shuffle leaves each type as many points as it has
    return cut(stats.usable(curve.join(types.withColumnRenamed("n_cells", "n"), "type")), "curves")


def against_null(curves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scale_idx, um, vmr, skewness, null_mean, null_sd, n_mocks, ratio) of the real curves."""
    real = curves.where("mock_id < 0").drop("mock_id")
    out = real.join(stats.null_moments(curves, keys), [*keys, "scale_idx"])
    return out.withColumn("ratio", cv.ratio(F.col("vmr"), F.col("null_mean")))


def measures(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_cells, peak_scale_um, peak_vmr_ratio, direction, integrated_excess, width) of curves with their nulls."""
    flat = rows.groupBy(*keys).agg(
        F.max("n").alias("n_cells"), cv.peak_at(F.col("vmr") - F.col("null_mean")).alias("peak_scale_um"), F.max("ratio").alias("peak_vmr_ratio"), cv.direction(F.col("ratio")).alias("direction")
    )
    return flat.join(cv.trapezoid(rows, keys, "ratio", "integrated_excess", 1.0), keys).join(cv.width(rows, keys), keys)


def fingerprints(points: DataFrame, roi: grid.Roi, scales: Scales, n_mocks: int = 50, min_cells: int = 50) -> DataFrame:
    """One row per type: curves as arrays, null moments, the joint test and all measures."""
    curves = labelled_curves(points, roi, scales, n_mocks, min_cells)
    rows = against_null(curves, ["type"])
    arrays = rows.groupBy("type").agg(*[cv.array_of(c).alias(n) for c, n in (("vmr", "vmr_curve"), ("skewness", "skewness_curve"), ("um", "scales_um"), ("null_mean", "mock_vmr_mean"), ("null_sd", "mock_vmr_std"), ("ratio", "vmr_ratio_curve"))])
    out = measures(rows, ["type"]).join(arrays, "type").join(stats.joint_test(curves, ["type"]), "type")
    return out.withColumn("is_significant", F.col("p_value") < 0.05)


def completed(records: DataFrame, n_mocks: int | None = None) -> DataFrame:
    """Fingerprint records (``reports.read_fingerprints``) with every measure: what a file lacks follows from its curves, and F and p from its statistic.

    Files of older writers hold curves, the moments of their nulls and the statistic, but
    not all that is derived. What a record does hold stays as it is. ``n_mocks`` is taken
    where a record does not say how many there were.
    """
    wanted = ("peak_scale_um", "peak_vmr_ratio", "integrated_excess", "width", "direction")
    at = records.select("type", F.col("n_cells").alias("n"), F.posexplode(F.arrays_zip("vmr_curve", "scales_um", "mock_vmr_mean")).alias("scale_idx", "s"))
    rows = at.select("type", "n", "scale_idx", F.col("s.scales_um").alias("um"), F.col("s.vmr_curve").alias("vmr"), F.col("s.mock_vmr_mean").alias("null_mean"))
    own = measures(rows.withColumn("ratio", cv.ratio(F.col("vmr"), F.col("null_mean"))), ["type"]).select("type", *[F.col(c).alias(f"_{c}") for c in wanted])
    for c in ("f_statistic", "p_value", "n_mocks_used", *wanted):
        if c not in records.columns:
            records = records.withColumn(c, F.lit(None).cast("string" if c == "direction" else "double"))
    used = F.coalesce(F.nullif(F.col("n_mocks_used").cast("long"), F.lit(0).cast("long")), F.lit(n_mocks).cast("long"))
    given = records.select("type", "chi_squared", F.size("vmr_curve").cast("long").alias("dof"), used.alias("n_mocks_used")).where("chi_squared is not null and n_mocks_used is not null")
    tested = stats.with_p_value(given).select("type", F.col("n_mocks_used").alias("_n"), F.col("f_statistic").alias("_f"), F.col("p_value").alias("_p"))
    out = records.join(own, "type", "left").join(tested, "type", "left")
    fill = {c: F.coalesce(c, f"_{c}") for c in wanted} | {"f_statistic": F.coalesce("f_statistic", "_f"), "p_value": F.coalesce("p_value", "_p"), "n_mocks_used": F.coalesce("_n", F.col("n_mocks_used").cast("long"))}
    out = out.withColumns(fill).drop(*[f"_{c}" for c in wanted], "_n", "_f", "_p")
    return out.withColumn("is_significant", F.col("p_value") < 0.05)


def fingerprint_summary(found: DataFrame, sort_by: str = "integrated_excess") -> DataFrame:
    cols = ["type", "n_cells", "peak_vmr_ratio", "peak_scale_um", "integrated_excess", "width", "direction", "p_value", "is_significant"]
    return prep.latest_first(found.select(*cols), sort_by, ["type"])


def cooccurrence(points: DataFrame, roi: grid.Roi, scales: Scales, n_mocks: int = 50, min_cells: int = 50, type_pairs: DataFrame | None = None, tile: int = packed.TILE) -> DataFrame:
    """(type_a, type_b, scale_idx, vox, um, r, null_mean, null_sd, significant): correlations of counts against shuffles.

    The frequent types are named on the driver, as a row for each pair of them comes out.
    """
    names = sorted(r["type"] for r in prep.frequent_types(points, min_cells).collect())
    r = packed.correlations(nulls.shuffled_pixels(points, roi, n_mocks).drop("trial"), roi, scales, ["mock_id"], names, tile)
    # the real correlation and the moments of its nulls in one exchange, by numbers of types
    real, null = F.when(F.col("mock_id") < 0, F.col("r")), F.when(F.col("mock_id") >= 0, F.col("r"))
    rows = r.groupBy("a", "b", "scale_idx", "vox", "um").agg(F.max(real).alias("r"), F.avg(null).alias("null_mean"), F.stddev_pop(null).alias("null_sd"))
    name = lambda c: F.element_at(F.array(*[F.lit(t) for t in names]).cast("array<string>"), F.col(c) + 1)
    out = rows.select(name("a").alias("type_a"), name("b").alias("type_b"), "scale_idx", "vox", "um", "r", "null_mean", "null_sd")
    if type_pairs is not None:
        out = out.join(type_pairs, ["type_a", "type_b"], "left_semi")
    return out.withColumn("significant", F.abs(F.col("r") - F.col("null_mean")) > 2 * F.col("null_sd"))


def correlation_band(rows: DataFrame, n: int = 3) -> DataFrame:
    """(type_a, type_b, scale_idx, um, r, low, high) of the ``n`` pairs farthest from their nulls: curves with two null deviations around the null mean."""
    far = rows.groupBy("type_a", "type_b").agg(cv.excess_sigma(F.col("r"), F.col("null_mean"), F.col("null_sd")).alias("_far")).orderBy(F.col("_far").desc(), "type_a", "type_b").limit(n)
    out = rows.join(far, ["type_a", "type_b"], "left_semi")
    return out.select("type_a", "type_b", "scale_idx", "um", "r", (F.col("null_mean") - 2 * F.col("null_sd")).alias("low"), (F.col("null_mean") + 2 * F.col("null_sd")).alias("high"))


def cooccurrence_summary(rows: DataFrame) -> DataFrame:
    """One row per pair: peaks against the null, extremes, integral, sign change, excess, significant scales."""
    keys = ["type_a", "type_b"]
    gap = F.abs(F.col("r") - F.col("null_mean"))
    top = lambda c: F.max_by(c, F.struct(gap, -F.col("scale_idx")))
    flat = rows.groupBy(*keys).agg(
        top("um").alias("peak_scale_um"), top("r").alias("peak_correlation"), F.max("r").alias("max_positive"), F.min("r").alias("max_negative"),
        cv.excess_sigma(F.col("r"), F.col("null_mean"), F.col("null_sd")).alias("excess_over_null"), F.count_if("significant").alias("n_significant"),
    )
    out = flat.join(cv.trapezoid(rows, keys, "r", "integrated"), keys).join(cv.sign_change(rows, keys, "r", "sign_change_um"), keys)
    return out.orderBy(F.col("excess_over_null").desc(), *keys)


def matrix_entries(rows: DataFrame, scale_idx: int | None = None) -> DataFrame:
    """(type_a, type_b, value) of the whole symmetric matrix: the correlation largest in size, or that of one scale; 1 on the diagonal."""
    if scale_idx is None:
        half = rows.groupBy("type_a", "type_b").agg(F.max_by("r", F.struct(F.abs("r"), -F.col("scale_idx"))).alias("value"))
    else:
        half = rows.where(F.col("scale_idx") == scale_idx).select("type_a", "type_b", F.col("r").alias("value"))
    other = half.select(F.col("type_b").alias("type_a"), F.col("type_a").alias("type_b"), "value")
    both = half.unionByName(other)
    return both.unionByName(both.select("type_a").distinct().select("type_a", F.col("type_a").alias("type_b"), F.lit(1.0).alias("value")))


def matrix(rows: DataFrame, scale_idx: int | None = None, types: list[str] | None = None) -> DataFrame:
    """The matrix with a column for each type; known ``types`` spare a look for them."""
    return matrix_entries(rows, scale_idx).groupBy("type_a").pivot("type_b", types).agg(F.first("value")).orderBy("type_a")


def regional(points: DataFrame, roi: grid.Roi, scales: Scales, n_mocks: int = 20) -> DataFrame:
    """The curve of all points, whatever their labels, against uniform points in their hull."""
    n = points.count()
    drawn = nulls.uniform_pixels(points.sparkSession, nulls.convex_hull(points), n, n_mocks, roi)
    counts = packed.counted(points.withColumn("mock_id", F.lit(-1)), roi, ["mock_id"]).unionByName(drawn)
    curves = packed.curves_of_packed(counts, roi, scales, ["mock_id"])
    null = curves.where("mock_id >= 0").groupBy("scale_idx").agg(F.avg("vmr").alias("null_mean"), F.stddev_pop("vmr").alias("null_sd"))
    out = curves.where("mock_id < 0").drop("mock_id").join(null, "scale_idx")
    return out.withColumn("ratio", cv.ratio(F.col("vmr"), F.col("null_mean")))


def regional_comparison(regions: dict[str, DataFrame], grid_size: int = 256, vox: list[int] | None = None, n_mocks: int = 20) -> DataFrame:
    """``regional`` of several regions (region, n_cells, ...), each on a grid and scales of its own, with the band of two null deviations as ratios."""
    out = None
    for name, points in regions.items():
        roi = grid.roi_of(points, grid_size)
        scales = Scales.of_pixels(vox, roi.extent, grid_size) if vox else Scales.default(roi.extent, grid_size)
        one = envelope(regional(points, roi, scales, n_mocks)).select(F.lit(name).alias("region"), F.col("n_points").alias("n_cells"), "scale_idx", "um", "vmr", "null_mean", "null_sd", "ratio", "low", "high")
        out = one if out is None else out.unionByName(one)
    return out


def jittered(points: DataFrame, roi: grid.Roi, scales: Scales, n_trials: int = 10, n_mocks: int = 20, min_cells: int = 50) -> DataFrame:
    """(trial, type, scale_idx, um, n, vmr, null_mean, null_sd, ratio): the grid's origin moved and labels shuffled anew in each trial."""
    types = prep.frequent_types(points, min_cells)
    keys = ["trial", "mock_id", "type"]
    counts = nulls.shuffled_pixels(points, roi, n_mocks, salt="trial", offsets=nulls.jitters(roi, n_trials)).join(F.broadcast(types.select("type")), "type", "left_semi")
    curve = packed.curves_of_packed(counts, roi, scales, keys).join(types.withColumnRenamed("n_cells", "n"), "type")
    return against_null(cut(stats.usable(curve), "jittered"), ["trial", "type"])


def jitter_spread(rows: DataFrame) -> DataFrame:
    """(type, n_trials, mean_excess, cv): variation of the integrated excess over trials, for types that all trials have."""
    trials = rows.select("trial").distinct().count()
    per = cv.trapezoid(rows, ["trial", "type"], "ratio", "excess", 1.0)
    mean = F.avg("excess")
    out = per.groupBy("type").agg(F.count("*").alias("n_trials"), mean.alias("mean_excess"), F.stddev_pop("excess").alias("_sd")).where(F.col("n_trials") == trials)
    return out.withColumn("cv", F.when(F.col("mean_excess") > 0, F.col("_sd") / F.when(F.col("mean_excess") > 0, F.col("mean_excess"))).otherwise(0.0)).drop("_sd")


def null_kinds(points: DataFrame, roi: grid.Roi, scales: Scales, kinds: dict[str, str | None], n_mocks: int, min_cells: int) -> DataFrame:
    """(null_kind, mock_id, type, scale_idx, ..., vmr): curves under several shuffles, each within a stratum column or none.

    The mocks of all kinds go through one grid; real curves are made once and repeated for each kind.
    The points are written to the shared folder once.
    """
    axes, counts = list(roi.axes), None
    # each kind reads the points several times, which may come from joins
    points = cut(points.select("id", *axes, "type", *dict.fromkeys(s for s in kinds.values() if s)), "points")
    types = prep.frequent_types(points, min_cells)
    for kind, stratum in kinds.items():
        one = nulls.shuffled_pixels(points.select("id", *axes, "type", *([stratum] if stratum else [])), roi, n_mocks, stratum)
        one = one.select(F.when(F.col("mock_id") < 0, F.lit("")).otherwise(F.lit(kind)).alias("null_kind"), "mock_id", "type", "px", "c")
        counts = one if counts is None else counts.unionByName(one.where("mock_id >= 0"))
    curve = packed.curves_of_packed(counts.join(F.broadcast(types.select("type")), "type", "left_semi"), roi, scales, ["null_kind", "mock_id", "type"])
    each = F.when(F.col("mock_id") < 0, F.array(*[F.lit(k) for k in kinds])).otherwise(F.array("null_kind"))
    curve = curve.withColumn("null_kind", F.explode(each))
    return cut(stats.usable(curve.join(types.withColumnRenamed("n_cells", "n"), "type")), "curves")


def _kinds_tested(curves: DataFrame, kinds: dict[str, str], least_mocks: int) -> DataFrame:
    """One row per type with n_cells and, for each of ``kinds`` (name: suffix), the joint test, peak and integral under that null."""
    keys = ["null_kind", "type"]
    m = measures(against_null(curves, keys), keys).join(stats.joint_test(curves, keys, least_mocks=least_mocks), keys)
    cols = ("chi_squared", "p_value", "peak_vmr_ratio", "integrated_excess", "n_mocks_used")
    wide = m.groupBy("type").agg(F.max("n_cells").alias("n_cells"), *[F.max(F.when(F.col("null_kind") == k, F.col(c))).alias(f"{c}_{s}") for k, s in kinds.items() for c in cols])
    return wide.dropna(subset=[f"chi_squared_{s}" for s in kinds.values()])


def mediation(curves: DataFrame, overall: str = "overall", within: str = "within", least_mocks: int = 5) -> DataFrame:
    """One row per type: both joint tests, the share that the stratum explains, peaks and integrals under both nulls."""
    both = _kinds_tested(curves, {overall: "overall", within: "within"}, least_mocks)
    return both.withColumn("mediation_pct", cv.percent_change(F.col("chi_squared_within"), F.col("chi_squared_overall")))


def mediation_bootstrap(curves: DataFrame, n_boot: int = 200, overall: str = "overall", within: str = "within", least_mocks: int = 10, least_valid: int = 50) -> DataFrame:
    """(type, mediation_pct, ci_low, ci_high, n_valid): the mocks of each null resampled with replacement, by draws of its own."""
    keys = ["null_kind", "type"]
    tests = stats.resampled_tests(curves, keys, n_boot)
    enough = curves.where("mock_id >= 0").groupBy("type", "null_kind").agg(F.countDistinct("mock_id").alias("k")).groupBy("type").agg(F.min("k").alias("k")).where(F.col("k") >= least_mocks)
    chi = tests.groupBy("type", "boot").agg(F.max(F.when(F.col("null_kind") == overall, F.col("chi_squared"))).alias("o"), F.max(F.when(F.col("null_kind") == within, F.col("chi_squared"))).alias("w"))
    values = chi.where("o > 0").withColumn("m", 100.0 * (1.0 - F.col("w") / F.col("o")))
    ci = values.groupBy("type").agg(F.count("*").alias("n_valid"), F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    ok = F.col("n_valid") >= least_valid
    point = mediation(curves, overall, within, least_mocks).select("type", "mediation_pct")
    return point.join(enough.select("type"), "type", "left_semi").join(ci, "type", "left").select("type", "mediation_pct", F.when(ok, F.col("q")[0]).alias("ci_low"), F.when(ok, F.col("q")[1]).alias("ci_high"), F.coalesce("n_valid", F.lit(0)).alias("n_valid"))


def depth_mediation(points: DataFrame, roi: grid.Roi, scales: Scales, n_mocks: int = 50, min_cells: int = 50, n_bins: int = 5) -> DataFrame:
    """One row per type: mediation by the stratum, by stratum and depth quintile (column z), and what depth adds."""
    points = cut(prep.valid_strata(points), "strata-points")  # the search for quantiles reads them several times
    deep = prep.quantile_bins(points, "z", n_bins).withColumn("both", prep.compound_stratum(F.col("stratum"), F.col("bin")))
    c = null_kinds(deep, roi, scales, {"overall": None, "stratum": "stratum", "compound": "both"}, n_mocks, min_cells)
    t = _kinds_tested(c, {k: k for k in ("overall", "stratum", "compound")}, 10)
    share = lambda k: cv.percent_change(F.col(f"chi_squared_{k}"), F.col("chi_squared_overall"))
    out = t.select("type", "n_cells", *[F.col(f"chi_squared_{k}").alias(f"chi2_{k}") for k in ("overall", "stratum", "compound")], share("stratum").alias("mediation_stratum"), share("compound").alias("mediation_compound"))
    return out.withColumn("depth_increment", F.col("mediation_compound") - F.col("mediation_stratum"))


def points_against(real: DataFrame, mocks: DataFrame, roi: grid.Roi, scales: Scales, least_mocks: int = 2) -> DataFrame:
    """The joint test of one set of points (x, y[, z]) against given sets (mock_id, x, y[, z]), whatever null made them."""
    axes = list(roi.axes)
    every = real.select(F.lit(-1).alias("mock_id"), *axes).unionByName(mocks.select(F.col("mock_id").cast("int").alias("mock_id"), *axes))
    curves = packed.curves_of_packed(packed.counted(every, roi, ["mock_id"]), roi, scales, ["mock_id"]).withColumn("set", F.lit("points"))
    return stats.joint_test(curves, ["set"], least_mocks=least_mocks).drop("set")


def summary_of(rows: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return rows.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.min(v).alias("low"), F.max(v).alias("high"))


def peak_ratios_by_dims(points: DataFrame, roi2: grid.Roi, scales2: Scales, roi3: grid.Roi, scales3: Scales, n_mocks: int = 20, min_cells: int = 50) -> DataFrame:
    """(type, peak_2d, peak_3d, ratio_change): the same shuffles gridded in two and in three dimensions."""
    types = prep.frequent_types(points, min_cells)
    sides = []
    for name, roi, scales in (("peak_2d", roi2, scales2), ("peak_3d", roi3, scales3)):
        counts = nulls.shuffled_pixels(points, roi, n_mocks).drop("trial").join(F.broadcast(types.select("type")), "type", "left_semi")
        rows = against_null(cut(packed.curves_of_packed(counts, roi, scales, ["mock_id", "type"]).withColumn("n", F.col("n_points")), name), ["type"])
        sides.append(rows.groupBy("type").agg(F.max("ratio").alias(name)))
    out = sides[0].join(sides[1], "type")
    return out.withColumn("ratio_change", F.when(F.col("peak_2d") > 0, F.col("peak_3d") / F.when(F.col("peak_2d") > 0, F.col("peak_2d"))).otherwise(1.0))


def dimension_summary(rows: DataFrame, least: float = 0.2) -> DataFrame:
    """(n_types, mean_change, median_change, n_changed): of ``ratio_change``; changed: by more than ``least``."""
    c = F.col("ratio_change")
    return rows.agg(F.count(c).alias("n_types"), F.avg(c).alias("mean_change"), F.percentile(c, F.lit(0.5)).alias("median_change"), F.count_if(F.abs(c - 1.0) > least).alias("n_changed"))


def ripley(points: DataFrame, radii: list[float], area: Column | float, keys: list[str], least: int = 10) -> DataFrame:
    """(keys, radius, n, pairs, k, l): K = area 2 pairs / (n (n - 1)) without edge correction, L = sqrt(K / pi) - r; keys below ``least`` points drop."""
    size = points.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    each = size.withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    rows = each.join(pairs.pair_counts(points, radii, keys), [*keys, "radius"], "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    area = area if isinstance(area, Column) else F.lit(float(area))
    rows = rows.withColumn("k", area * 2.0 * F.col("pairs") / (F.col("n").cast("double") * (F.col("n") - 1)))
    return rows.withColumn("l", F.sqrt(F.col("k") / F.lit(3.141592653589793)) - F.col("radius"))


def ripley_band(points: DataFrame, radii: list[float], area: float, n_null: int = 20) -> DataFrame:
    """(type, radius, n, k, l, l_low, l_high, k_null_mean): L of all points of each type against as many uniform points in its box."""
    from ..functions import chance

    box = points.groupBy("type").agg(*[f(a).alias(f"{n}{a}") for a in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    null = nulls.mocks(points.select("id", "type").join(box, "type"), n_null)
    null = null.select("type", "mock_id", "id", *[(F.col(f"lo{a}") + (F.col(f"hi{a}") - F.col(f"lo{a}")) * chance.uniform("box", F.col("mock_id"), F.col("id"), a)).alias(a) for a in "xy"])
    real = points.select("type", F.lit(-1).alias("mock_id"), "id", "x", "y")
    rows = cut(ripley(real.unionByName(null), radii, area, ["type", "mock_id"]), "ripley")
    band = rows.where("mock_id >= 0").groupBy("type", "radius").agg(F.percentile("l", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg("k").alias("k_null_mean"))
    return rows.where("mock_id < 0").drop("mock_id", "pairs").join(band, ["type", "radius"]).select("type", "radius", "n", "k", "l", F.col("q")[0].alias("l_low"), F.col("q")[1].alias("l_high"), "k_null_mean")


def peak_scales(found: DataFrame, band: DataFrame) -> DataFrame:
    """(type, vmr_peak_um, l_peak_um): each measure's scale of largest positive excess, null where there is none."""
    gap = F.col("l") - F.col("l_high")
    l_peak = band.groupBy("type").agg(F.when(F.max(gap) > 0, F.max_by("radius", F.struct(gap, -F.col("radius")))).alias("l_peak_um"))
    gap_v = F.col("vmr") - F.col("null_mean")
    v_peak = found.groupBy("type").agg(F.when(F.max(gap_v) > 0, F.max_by("um", F.struct(gap_v, -F.col("scale_idx")))).alias("vmr_peak_um"))
    return v_peak.join(l_peak, "type")


def peak_agreement(found: DataFrame, band: DataFrame) -> DataFrame:
    """(n, rho, p_value): rank correlation of the two measures' peak scales over the types for which L has a peak; null for fewer than three or constant peaks."""
    return stats.spearman(peak_scales(found, band), "vmr_peak_um", "l_peak_um")


def characteristic_scales(regions: dict[str, DataFrame]) -> DataFrame:
    """(region, type, peak_scale_um) of the significant types of each region's fingerprints."""
    out = None
    for name, found in regions.items():
        one = found.where("is_significant").select(F.lit(name).alias("region"), "type", "peak_scale_um")
        out = one if out is None else out.unionByName(one)
    return out


def universal_comparison(panels: dict[str, DataFrame]) -> DataFrame:
    """(panel, unit, place, scale, vmr, null_mean, low, high) of curves from several sources side by side; the band is two null deviations, null where a source has no null.

    Each source has unit, place, scale and vmr, and null_mean and null_sd if it knows them.
    """
    out = None
    for name, curve in panels.items():
        for c in ("null_mean", "null_sd"):
            if c not in curve.columns:
                curve = curve.withColumn(c, F.lit(None).cast("double"))
        sd = F.coalesce("null_sd", F.lit(0.0))
        one = curve.select(F.lit(name).alias("panel"), "unit", "place", "scale", "vmr", "null_mean", (F.col("null_mean") - 2 * sd).alias("low"), (F.col("null_mean") + 2 * sd).alias("high"))
        out = one if out is None else out.unionByName(one)
    return out


def universal_types(tables: dict[str, DataFrame]) -> DataFrame:
    """(type): types that all tables have."""
    out = None
    for t in tables.values():
        one = t.select("type").distinct()
        out = one if out is None else out.intersect(one)
    return out


def ranks_by_mean(rows: DataFrame, value: str, k: int) -> DataFrame:
    return rows.groupBy("type").agg(F.avg(value).alias("mean_score")).orderBy(F.col("mean_score").desc(), "type").limit(k)


def region_top(tables: dict[str, DataFrame], value: str, n: int) -> DataFrame:
    """(label, region, type, value): the largest of several regions; the label has the region's first four letters."""
    out = None
    for name, t in tables.items():
        one = t.select(F.lit(name).alias("region"), "type", F.col(value).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("label", F.concat("type", F.lit(" ("), F.substring("region", 1, 4), F.lit(")"))).orderBy(F.col("value").desc(), "region", "type").limit(n)


def telling_pairs(summary: DataFrame) -> DataFrame:
    """(role, type_a, type_b): the most positive pair, the most negative one, and the largest that changes sign (else the largest excess)."""
    def first(role: str, rows: DataFrame, by: Column) -> DataFrame:
        return rows.orderBy(by, "type_a", "type_b").limit(1).select(F.lit(role).alias("role"), "type_a", "type_b")

    pos = first("positive", summary, F.col("max_positive").desc())
    neg = first("negative", summary, F.col("max_negative").asc())
    turning = F.when(F.col("sign_change_um").isNotNull(), 0).otherwise(1)
    by = F.struct(turning, -F.when(turning == 0, F.col("max_positive") - F.col("max_negative")).otherwise(F.col("excess_over_null")))
    return pos.unionByName(neg).unionByName(first("switcher", summary, by))


def colour_limit(entries: DataFrame, least: float = 0.1) -> DataFrame:
    upper = entries.where("type_a < type_b")
    return upper.agg(F.greatest(F.abs(F.min("value")), F.abs(F.max("value")), F.lit(least)).alias("limit"))


def envelope(rows: DataFrame, value: str = "ratio") -> DataFrame:
    """Adds low and high: two null deviations around the null, as ratios, not below 0."""
    ok = F.col("null_mean") > 0
    rel = F.when(ok, 2.0 * F.col("null_sd") / F.when(ok, F.col("null_mean"))).otherwise(0.0)
    return rows.withColumns({"low": F.greatest(1.0 - rel, F.lit(0.0)), "high": 1.0 + rel})


def positive_share(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """(group, scale_idx, share): the share of listed pairs (type_a, type_b, group) with a positive correlation at each scale."""
    return rows.join(listed, ["type_a", "type_b"]).groupBy("group", "scale_idx").agg(F.avg((F.col("r") > 0).cast("double")).alias("share"))


def native_partition(found: DataFrame, native: DataFrame) -> DataFrame:
    """``found`` (region, type, integrated_excess) with is_native from a short list (region, type), largest excess first."""
    marked = found.join(native.select("region", "type").distinct().withColumn("is_native", F.lit(True)), ["region", "type"], "left")
    return marked.withColumn("is_native", F.coalesce("is_native", F.lit(False))).orderBy(F.col("integrated_excess").desc(), "region", "type")


def cropped(points: DataFrame, roi: grid.Roi, share: float = 0.05) -> DataFrame:
    """Points off the borders by ``share`` of each side."""
    keep = F.lit(True)
    for a, o, s in zip(roi.axes, roi.origin, roi.size, strict=True):
        keep = keep & (F.col(a) >= o + share * s) & (F.col(a) <= o + (1 - share) * s)
    return points.where(keep)
