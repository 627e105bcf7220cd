import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stipple.functions import curves as cv
from stipple.functions.scales import Scales
from stipple.operators import grid, nulls, order, packed, pairs, prep, stats
from stipple.plans import analyses as an


def points(spark, rows, names=("id", "x", "y", "type")):
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} {'string' if n in ('type', 'stratum') else 'long' if n == 'id' else 'double'}" for n in names))


@pytest.fixture(scope="module")
def uniform(spark):
    r = np.random.default_rng(42)
    xy = r.uniform(0, 1000, (1200, 2))
    return points(spark, [(i, float(x), float(y), "AB"[i % 2]) for i, (x, y) in enumerate(xy)]).cache()


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(1)
    xy = np.vstack([r.normal(c, 15, (100, 2)) for c in r.uniform(200, 800, (5, 2))] + [r.uniform(0, 1000, (500, 2))])
    return points(spark, [(i, float(x), float(y), "C" if i < 500 else "U") for i, (x, y) in enumerate(xy)]).cache()


def test_scales_are_distinct_and_within_bounds():
    s = Scales.for_extent(5000, 256)
    assert len(s) <= 12 and len(set(s.vox)) == len(s) and min(s.vox) >= 2 and max(s.vox) <= 128
    assert all(math.isclose(u, v * 5000 / 256) for u, v in zip(s.um, s.vox, strict=True))
    assert Scales.in_pixels(2, 32, 8).vox == tuple(sorted(set(Scales.in_pixels(2, 32, 8).vox)))
    assert Scales.for_extent(None, low=1, high=2).vox[0] == 2


def test_grid_keeps_mass_and_matches_numpy(uniform):
    roi = grid.roi_of(uniform, 64)
    px = grid.pixels(uniform, roi, ["type"])
    assert px.agg(F.sum("c")).first()[0] == 1200
    sc = Scales.of_pixels([3, 8, 40], roi.extent, 64)
    got = {(r["type"], r["vox"]): r for r in grid.curves_of(uniform, roi, sc, ["type"]).collect()}
    pdf = uniform.toPandas()
    for t in "AB":
        p = pdf[pdf.type == t]
        g = np.zeros((64, 64))
        ix = [np.floor(np.clip((p[a] - o) / s * 64, 0, 64 - 1e-9)).astype(int) for a, o, s in zip("xy", roi.origin, roi.size, strict=True)]
        np.add.at(g, tuple(ix), 1)
        for v in (3, 8):
            n = 64 // v
            c = g[: n * v, : n * v].reshape(n, v, n, v).sum(axis=(1, 3)).ravel()
            assert math.isclose(got[t, v]["vmr"], c.var() / c.mean(), rel_tol=1e-9)
            assert math.isclose(got[t, v]["skewness"], ((c - c.mean()) ** 3).mean() / c.std() ** 3, rel_tol=1e-6, abs_tol=1e-9)
        assert got[t, 40]["n_points"] == len(p) and got[t, 40]["vmr"] == 0.0


def test_clusters_stand_out(clustered):
    roi = grid.roi_of(clustered, 64)
    sc = Scales.of_pixels([2, 4, 8, 16], roi.extent, 64)
    found = {r["type"]: r for r in an.fingerprints(clustered, roi, sc, 12, 50).collect()}
    assert found["C"]["p_value"] < 0.05 and found["C"]["is_significant"] and found["C"]["peak_vmr_ratio"] > 1.3
    assert len(found["C"]["vmr_curve"]) == 4 and found["C"]["n_mocks_used"] == 12
    assert [r["type"] for r in an.fingerprint_summary(an.fingerprints(clustered, roi, sc, 12, 50)).collect()][0] == "C"


def test_shuffles_keep_composition_and_strata(uniform):
    p = uniform.withColumn("stratum", F.when(F.col("x") < 400, "a").otherwise("b"))
    drawn = nulls.shuffled(p, 3, "stratum")
    real = {(r["stratum"], r["type"]): r["count"] for r in p.groupBy("stratum", "type").count().collect()}
    for r in drawn.groupBy("mock_id", "stratum", "type").count().collect():
        assert r["count"] == real[r["stratum"], r["type"]]
    assert drawn.count() == 3 * 1200 and drawn.select("mock_id", "id").distinct().count() == 3 * 1200
    assert drawn.join(p.select("id", F.col("type").alias("t")), "id").where("type <> t").count() > 300


def test_points_without_a_stratum_keep_their_labels(uniform):
    p = uniform.withColumn("stratum", F.when(F.col("x") < 400, "a").when(F.col("x") < 600, "b"))
    drawn = nulls.shuffled(p, 4, "stratum")
    assert drawn.count() == 4 * 1200 and drawn.groupBy("mock_id").agg(F.countDistinct("id").alias("n")).where("n = 1200").count() == 4
    moved = drawn.join(p.select("id", F.col("type").alias("t")), "id").where("type <> t")
    assert moved.where("stratum is null").count() == 0 and moved.where("stratum is not null").count() > 500


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 50])
def test_shuffles_of_few_points_are_permutations(spark, n):
    p = points(spark, [(i, float(i), 0.0, f"t{i}") for i in range(n)])
    got = nulls.shuffled(p, 60).toPandas().sort_values(["mock_id", "id"])
    orders = {tuple(g["type"]) for _, g in got.groupby("mock_id")}
    assert all(sorted(o) == sorted(f"t{i}" for i in range(n)) for o in orders)
    assert len(orders) > min(60, math.factorial(n)) * 0.6


def test_shuffles_are_even(spark):
    p = points(spark, [(i, float(i), 0.0, "A" if i < 10 else "B") for i in range(60)])
    got = nulls.shuffled(p, 3000).where("type = 'A'").groupBy("id").count().toPandas()
    # each point is an A in a sixth of the mocks; two points together in 10 * 9 / (60 * 59) of them
    assert len(got) == 60 and abs(got["count"] - 500).max() < 5 * math.sqrt(3000 * 5 / 36)
    both = nulls.shuffled(p, 3000).where("type = 'A' and id in (3, 4)").groupBy("mock_id").count().where("count = 2").count()
    assert abs(both / 3000 - 90 / 3540) < 0.012


def test_bootstraps_draw_each_key_by_itself(spark):
    rows = [(k, m, s, float(100 * m + s)) for k, ms in (("a", (0, 2, 5, 7)), ("b", (0, 1, 2, 3))) for m in ms for s in range(2)]
    curves = spark.createDataFrame(rows, "null_kind string, mock_id int, scale_idx int, vmr double")
    got = nulls.resamples(curves, ["null_kind"], 40).toPandas()
    assert (got.groupby(["null_kind", "boot"]).size() == 8).all() and set(got[got.null_kind == "a"].vmr // 100) == {0, 2, 5, 7}
    picks = {k: tuple(g.sort_values(["boot", "mock_id", "scale_idx"]).vmr.rank(method="dense")) for k, g in got.groupby("null_kind")}
    assert picks["a"] != picks["b"]


def test_given_point_sets(spark, clustered):
    roi = grid.roi_of(clustered, 64)
    sc = Scales.of_pixels([2, 4, 8, 16], roi.extent, 64)
    r = np.random.default_rng(9)
    mocks = spark.createDataFrame([(m, float(x), float(y)) for m in range(30) for x, y in r.uniform(0, 1000, (500, 2))], "mock_id int, x double, y double")
    found = an.points_against(clustered.where("type = 'C'"), mocks, roi, sc).first()
    assert found["p_value"] < 0.05 and found["n_mocks_used"] == 30
    even = an.points_against(mocks.where("mock_id = 0"), mocks.where("mock_id > 0"), roi, sc).first()
    assert even["p_value"] > 0.01


# Published curves of one type, and ratio changes of twelve, with the measures given for them.
SCALES = [40.51871764713805, 81.0374352942761, 121.55615294141414, 182.3342294121212, 222.85294705925926, 283.63102352996634, 344.4091000006734, 405.18717647138044, 506.4839705892256, 668.5588411777778, 830.63371176633, 992.7085823548822]
VMR = [9.966431728447336, 37.14355180393188, 81.01221800997948, 175.06073629318632, 257.74077469741314, 408.6075538266465, 605.0491201173829, 806.8135381121364, 1225.447062760619, 2010.821344939766, 2951.0388027867975, 3977.96154577323]
NULL_MEAN = [8.404563448572677, 30.96329875762621, 67.82952583310102, 147.43676495204738, 220.2171034771618, 351.2323661872935, 525.1779936078345, 696.2258572962093, 1067.3120681629305, 1780.126705324303, 2628.247556228952, 3590.0614384385412]
PEAK, RATIO, EXCESS, WIDTH = 992.7085823548822, 1.1995993093204735, 0.23609986361363092, 1.3891660843645324
CHANGES = [1.313458, 1.902436, 1.746725, 1.173412, 0.774125, 0.873387, 1.93661, 1.901381, 1.151899, 1.003947, 0.985395, 1.053064]


def test_published_measures_follow_from_published_curves(spark):
    rows = spark.createDataFrame([("k", 1, i, *v) for i, v in enumerate(zip(SCALES, VMR, NULL_MEAN, strict=True))], "type string, n long, scale_idx int, um double, vmr double, null_mean double")
    got = an.measures(rows.withColumn("ratio", cv.ratio(F.col("vmr"), F.col("null_mean"))), ["type"]).first()
    for name, value in (("peak_scale_um", PEAK), ("peak_vmr_ratio", RATIO), ("integrated_excess", EXCESS), ("width", WIDTH)):
        assert math.isclose(got[name], value, rel_tol=1e-9)
    assert got["direction"] == "clustered"
    change = an.dimension_summary(spark.createDataFrame([(v,) for v in CHANGES], "ratio_change double")).first()
    assert round(change["mean_change"], 3) == 1.318 and change["n_types"] == 12 and change["n_changed"] == 6
    constant = spark.createDataFrame([(str(i), 1012.9679411784512, 1012.9679411784512) for i in range(8)], "type string, vmr_peak_um double, l_peak_um double")
    same = stats.spearman(constant, "vmr_peak_um", "l_peak_um").first()
    assert same["n"] == 8 and same["rho"] is None and same["p_value"] is None


# A published record of an older writer and its row in the published summary; published chi-squared under both nulls with the shares given; the same for depth; a regional curve at four scales.
OLD = {
    "vmr_curve": [0.9989166259765625, 1.2748658424982808, 1.352873857896865, 1.5642521023874896, 1.5931033733263777, 2.010735418427726, 1.86739029216622, 2.4162970905014864, 3.4281746031746034, 4.489653973222048, 3.9502782931354368, 4.917735849056603],
    "scales_um": [22.414385671470182, 56.03596417867546, 78.45034985014564, 112.07192835735091, 156.90069970029128, 212.93666387896673, 257.76543522190707, 336.2157850720527, 459.49490626513875, 616.39560596543, 750.8819199942511, 997.4401623804231],
    "mock_vmr_mean": [1.000606767, 1.006133448, 1.010338647, 1.01889999, 1.034230134, 1.069358375, 1.101756489, 1.15545202, 1.277327015, 1.493772412, 1.570785978, 1.743158934],
    "n_cells": 71, "chi_squared": 668.452732461318,
}
OLD_F, OLD_PEAK, OLD_RATIO = 43.19932624750014, 997.4401623804231, 3.0055809950698102
MEDIATION = [(571.9223841417736, 49.76170710109815, 91.29922022972215), (34383.94108360121, 171.7553324307519, 99.50047805161967), (78970.90530690085, 25151.261631201058, 68.15123046461616), (4283.576461410894, 394.8612537911977, 90.781972556149), (3139519.3474930115, 582.3664112812896, 99.98145045955056), (12638.953065202513, 111.9113118503863, 99.11455235830806), (45895.75024413818, 1014.3463044532944, 97.7898905692628), (34582.615721038455, 360.14948286317895, 98.9585822953118), (4888.879216891908, 1316.959289433113, 73.06214305964454), (729.7680525075543, 332.5615549332332, 54.42914309683478), (249.54137805635503, 357.9693172734235, -43.45088580563248), (26.377629448239283, 7.99645405713771, 69.6847130526679)]
MEDIATION_MEAN, MEDIATION_MEDIAN = 74.94187419900457, 91.04059639293558
DEPTH = [(35469.67788785198, 3067.2360952923777, 1654.6014584241664, 3.9826542584758613), (111031.44292496462, 4256.848924476028, 2544.887183809865, 1.541871109270474), (1140.2922493575143, 570.6245915695242, 399.021769642533, 15.049021163099113), (735.6070967040642, 146.6469779809504, 148.43835286288626, -0.24352332786921238)]
REGION = [(16.72142991401367, 4.971727420851893, 0.0060989961960534154), (64.61709837675924, 16.677494668043597, 0.014028822461678199), (142.8970415251338, 34.87087416725723, 0.02960634001541852), (7620.1493852439635, 1286.3143338467726, 2.878378297477757)]


def test_older_records_are_completed(spark, tmp_path):
    import json

    from stipple.sources import reports

    (tmp_path / "old.json").write_text(json.dumps({"k": OLD, "bare": {"n_cells": 3, "vmr_curve": [1.0, 1.0], "scales_um": [10.0, 20.0], "mock_vmr_mean": [1.0, 1.0], "p_value": 0.2}}))
    read = reports.read_fingerprints(spark, str(tmp_path / "old.json"))
    got = {r["type"]: r for r in an.completed(read, 50).collect()}
    k = got["k"]
    assert math.isclose(k["f_statistic"], OLD_F, rel_tol=1e-9) and k["p_value"] < 1e-9 and k["is_significant"] and k["n_mocks_used"] == 50
    assert k["peak_scale_um"] == OLD_PEAK and math.isclose(k["peak_vmr_ratio"], OLD_RATIO, rel_tol=1e-8) and k["skewness_curve"] == []
    bare = got["bare"]
    assert bare["p_value"] == 0.2 and bare["f_statistic"] is None and not bare["is_significant"] and bare["integrated_excess"] == 0.0 and bare["width"] == 0.0
    without = {r["type"]: r for r in an.completed(read).collect()}
    assert without["k"]["p_value"] is None and without["k"]["is_significant"] is None and without["k"]["peak_scale_um"] == OLD_PEAK


def test_published_shares_follow_from_published_statistics(spark):
    rows = spark.createDataFrame([(a, b, p) for a, b, p in MEDIATION], "o double, w double, want double").withColumn("m", cv.percent_change(F.col("w"), F.col("o")))
    assert all(math.isclose(r["m"], r["want"], rel_tol=1e-9) for r in rows.collect())
    s = an.summary_of(rows, "m").first()
    assert s["n"] == 12 and math.isclose(s["mean"], MEDIATION_MEAN, rel_tol=1e-9) and math.isclose(s["median"], MEDIATION_MEDIAN, rel_tol=1e-9)
    share = lambda c: cv.percent_change(F.col(c), F.col("o"))
    depth = spark.createDataFrame(DEPTH, "o double, l double, d double, want double").withColumn("inc", share("d") - share("l"))
    assert all(math.isclose(r["inc"], r["want"], rel_tol=1e-6) for r in depth.collect())


def test_published_regional_ratios_stand_out_of_their_band(spark):
    rows = spark.createDataFrame(REGION, "vmr double, null_mean double, null_sd double").withColumn("ratio", cv.ratio(F.col("vmr"), F.col("null_mean")))
    for r in an.envelope(rows).collect():
        assert math.isclose(r["ratio"], r["vmr"] / r["null_mean"]) and math.isclose(r["high"] - 1, 2 * r["null_sd"] / r["null_mean"]) and r["low"] < 1 < r["high"] < r["ratio"]


def test_curve_files_pass_over_others(spark, tmp_path):
    from stipple.sources import reports

    for name, text in (("a.json", "{not json"), ("b.json", '{"x": {"vmr": [1]}}'), ("c.json", '{"vmr": [1.5, NaN], "scales_um": [10, 20], "null_std": [0.1, 0.2]}'), ("d.json", '{"vmr": [7], "scales_nm": [1]}')):
        (tmp_path / name).write_text(text)
    got = [tuple(r) for r in reports.find_curves(spark, str(tmp_path / "*.json")).orderBy("place").collect()]
    assert got == [("um", 0, 10.0, 1.5, None, 0.1), ("um", 1, 20.0, None, None, 0.2)]


def test_an_empty_region_is_reported(spark, caplog):
    cells = spark.createDataFrame([("a", "HPF"), ("b", None)], "cell_label string, division string")
    with caplog.at_level("WARNING"):
        assert prep.region(cells, "Thalamus", report=True).count() == 0
    assert "HPF" in caplog.text


def test_hull_area_and_containment(spark):
    square = points(spark, [(i, float(x), float(y), "s") for i, (x, y) in enumerate([(0, 0), (100, 0), (100, 100), (0, 100), (50, 50), (20, 70)])])
    hull = nulls.convex_hull(square)
    assert len(hull) == 4 and nulls.hull_area(hull) == 10000
    drawn = nulls.uniform_in_hull(spark, hull, 200, 2)
    assert drawn.groupBy("mock_id").count().where("count = 200").count() == 2
    inner = [(x * 0.999999 + 50e-6, y * 0.999999 + 50e-6) for x, y in drawn.select("x", "y").collect()]
    inside = spark.createDataFrame(inner, "x double, y double")
    assert inside.where(~nulls.in_hull(hull, F.col("x"), F.col("y"))).count() == 0
    assert abs(drawn.agg(F.avg("x")).first()[0] - 50) < 6 and nulls.acceptance(spark, hull).first()["rate"] == 1.0
    thin = [(0.0, 0.0), (1000.0, 999.0), (1000.0, 1000.0)]
    assert nulls.uniform_in_hull(spark, thin, 50, 2).count() == 100
    with pytest.raises(ValueError):
        nulls.uniform_in_hull(spark, [(0.0, 0.0), (1.0, 1.0)], 5, 1)


def test_smoothed_bootstrap_keeps_the_modes(spark):
    r = np.random.default_rng(3)
    xy = np.vstack([r.normal(200, 30, (300, 2)), r.normal(800, 30, (300, 2))])
    p = points(spark, [(i, float(x), float(y), "k") for i, (x, y) in enumerate(xy)])
    d = nulls.smoothed_bootstrap(p, 400, 1).toPandas()
    near = ((np.hypot(d.x - 200, d.y - 200) < 250) | (np.hypot(d.x - 800, d.y - 800) < 250)).mean()
    assert len(d) == 400 and near > 0.6


def test_the_kernel_density_is_of_all_points(spark, monkeypatch):
    n = 50_100
    p = spark.range(n).select("id", (F.col("id") * 7 % 1009).cast("double").alias("x"), (F.col("id") * 11 % 997).cast("double").alias("y"))
    draw = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32
    x, y = np.arange(n) * 7 % 1009, np.arange(n) * 11 % 997
    rank = sorted(range(n), key=lambda i: (hashlib.md5(f"kde|{i}".encode()).hexdigest(), i))
    width = (x.std() + y.std()) / 2 * n ** (-1 / 6)
    want = {}
    for m in range(2):
        for i in range(150):
            at = rank[math.floor(draw("kde", m, i, "pick") * n)]
            off = [math.sqrt(-2 * math.log(1 - draw("kde", m, i, a, "u"))) * math.cos(2 * math.pi * draw("kde", m, i, a, "v")) for a in "xy"]
            want[m, i] = (x[at] + width * off[0], y[at] + width * off[1])
    found = lambda: {(r["mock_id"], r["id"]): (r["x"], r["y"]) for r in nulls.smoothed_bootstrap(p, 150, 2).collect()}
    sent = found()
    assert sent.keys() == want.keys() and np.allclose([sent[k] for k in want], list(want.values()), rtol=1e-9, atol=1e-9)
    # points that are too many to be sent meet the draws in parts of about so many draws
    monkeypatch.setattr(nulls, "DRAWS", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        drawn = nulls.smoothed_bootstrap(p, 150, 2)
        assert drawn.rdd.getNumPartitions() == 6
        assert found() == sent
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert nulls.smoothed_bootstrap(p.limit(0), 5, 2).count() == 0


def test_kde_sample_and_its_sql_take_all_points(spark, tmp_path):
    import duckdb

    from stipple import catalogue

    n = 70_000
    spark.range(n).selectExpr("id AS event_id", "double(id * 7 % 1009) AS value", "timestamp_seconds(id * 37 % 999983) AS ts", "'a' AS event_type").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in catalogue.QUERIES["kde_sample"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert len(got) == 20 and got == sorted(con.execute(catalogue.SQL["kde_sample"]).fetchall())
    # a density of all points has the width that kde_bandwidth states for them; one of 50,000 is 6 % wider
    x, width = np.arange(n) * 7 % 1009, con.execute(catalogue.SQL["kde_bandwidth"]).fetchall()[0][1]
    assert math.isclose(np.mean([r[3] for r in got]), math.hypot(x.std(), width), rel_tol=0.01)


def test_first_by_chance_is_a_plain_sorts(spark):
    p = points(spark, [(i, float(i), 0.0, "k") for i in range(3000)])
    for n in (1, 500, 2999, 5000):
        want = {r["id"] for r in p.orderBy(F.md5(F.concat(F.lit("kde-fit|"), "id").cast("binary")), "id").limit(n).collect()}
        assert {r["id"] for r in nulls.first_by_chance(p, n, "kde-fit").collect()} == want
    assert nulls.first_by_chance(p.limit(0), 5).count() == 0
    # neither one task nor the driver merges the sorted heads of all tasks
    assert "TakeOrdered" not in nulls.first_by_chance(p, 500)._jdf.queryExecution().executedPlan().toString()


def test_hotelling():
    r = np.random.default_rng(0)
    m = r.normal(5, 1, (50, 8))
    assert stats.hotelling(m.mean(axis=0), m)[0] < 1e-9
    assert stats.hotelling(np.full(8, 10.0), r.normal(0, 1, (50, 8)))[0] > 100
    assert stats.hotelling(np.ones(2), np.ones((1, 2)))[0] == 0.0


def test_p_values(spark):
    rows = spark.createDataFrame([(0.0, 4, 1), (3.0, 3, 3), (20.0, 2, 30)], "chi_squared double, dof long, n_mocks_used long")
    p = [r["p_value"] for r in stats.with_p_value(rows).collect()]
    assert p[0] == 1.0 and math.isclose(p[1], 0.39162517627, rel_tol=1e-6) and 0 < p[2] < 0.01


def test_pair_counts_match_brute_force(uniform):
    pdf = uniform.toPandas()
    got = {(r["type"], r["radius"]): r["pairs"] for r in pairs.pair_counts(uniform, [10.0, 40.0], ["type"]).collect()}
    for t in "AB":
        xy = pdf[pdf.type == t][["x", "y"]].to_numpy()
        d = ((xy[:, None] - xy[None]) ** 2).sum(-1)[np.triu_indices(len(xy), 1)]
        for rad in (10.0, 40.0):
            assert got[t, rad] == (d <= rad * rad).sum()


@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_pair_counts_by_cells_match_brute_force(spark, leaf):
    r = np.random.default_rng(5)
    # half of the points in one small spot, some of them equal, the others spread
    xy = np.vstack([r.normal(50, 0.5, (400, 2)), np.repeat(r.uniform(40, 60, (3, 2)), 20, axis=0), r.uniform(0, 200, (300, 2)), [[10.0, 10.0], [30.0, 10.0]]])
    p = points(spark, [(i, float(x), float(y), "AB"[i % 3 == 0]) for i, (x, y) in enumerate(xy)])
    radii = [0.3, 1.0, 20.0]
    got = {(t["type"], t["radius"]): t["pairs"] for t in pairs.pair_counts(p, radii, ["type"], leaf=leaf, flat=0).collect()}
    flat = {(t["type"], t["radius"]): t["pairs"] for t in pairs.pair_counts(p, radii, ["type"]).collect()}
    for t, mine in (("A", [i for i in range(len(xy)) if i % 3]), ("B", [i for i in range(len(xy)) if i % 3 == 0])):
        q = xy[mine]
        d = ((q[:, None] - q[None]) ** 2).sum(-1)[np.triu_indices(len(q), 1)]
        for rad in radii:
            assert got[t, rad] == flat[t, rad] == (d <= rad * rad).sum()


@pytest.mark.parametrize("flat", [0, 4096])
def test_pairs_of_cells_are_dealt_over_all_places(spark, flat):
    # small tables before a join that multiplies them, so Spark would merge them into one task
    r = np.random.default_rng(10)
    p = points(spark, [(i, float(x), float(y), "A") for i, (x, y) in enumerate(r.uniform(0, 10, (300, 2)))])
    plan = pairs.pair_counts(p, [1.0], ["type"], leaf=4, flat=flat)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_cells_within_a_radius_are_not_taken_apart(spark):
    # 4,000 points in a spot far smaller than the radius: one square, one pair of cells, no point compared
    r = np.random.default_rng(6)
    p = points(spark, [(i, float(x), float(y), "A") for i, (x, y) in enumerate(r.uniform(0, 1, (4000, 2)))])
    got = {t["radius"]: t["pairs"] for t in pairs.pair_counts(p, [5.0], ["type"], flat=0).collect()}
    assert got == {5.0: 4000 * 3999 // 2}


@pytest.mark.parametrize("tile", [3, 256])
def test_correlations_of_more_types_than_a_tile(spark, tile):
    r = np.random.default_rng(7)
    kinds = [f"t{k}" for k in range(8)]
    rows = [(i, float(x), float(y), kinds[int(k)]) for i, (x, y, k) in enumerate(zip(r.uniform(0, 100, 900), r.uniform(0, 100, 900), r.integers(0, 8, 900), strict=True))]
    p = points(spark, rows)
    roi = grid.roi_of(p, 32)
    sc = Scales.of_pixels([4, 20], roi.extent, 32)
    got = {(t["type_a"], t["type_b"], t["vox"]): t for t in an.cooccurrence(p, roi, sc, 5, 10, tile=tile).collect()}
    assert len(got) == 28 * 2
    c = {}
    for t in kinds:
        g = np.zeros((32, 32))
        xy = np.array([q[1:3] for q in rows if q[3] == t])
        np.add.at(g, tuple(np.floor(np.clip((xy[:, a] - roi.origin[a]) / roi.size[a] * 32, 0, 32 - 1e-9)).astype(int) for a in range(2)), 1)
        c[t] = g.reshape(8, 4, 8, 4).sum(axis=(1, 3)).ravel()
    for (a, b, v), row in got.items():
        assert row["r"] == 0.0 if v == 20 else math.isclose(row["r"], np.corrcoef(c[a], c[b])[0, 1], rel_tol=1e-9, abs_tol=1e-12)
    other = {(t["type_a"], t["type_b"], t["vox"]): t for t in an.cooccurrence(p, roi, sc, 5, 10, tile=5).collect()}
    assert all(math.isclose(got[k]["null_mean"], other[k]["null_mean"], abs_tol=1e-12) for k in got)


def test_packed_shuffles_are_those_of_rows(spark, uniform):
    p = uniform.withColumns({"z": F.col("x") + F.col("y"), "stratum": F.when(F.col("x") < 400, "a").when(F.col("x") < 600, "b")})
    for by, dims in ((None, 2), ("stratum", 2), ("stratum", 3)):
        roi = grid.roi_of(p, 16, dims)
        want = grid.pixels(nulls.with_real(p, nulls.shuffled(p, 3, by)), roi, ["mock_id", "type"])
        got = packed.unpacked(nulls.shuffled_pixels(p, roi, 3, by), roi, ["mock_id", "type"])
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    moved = nulls.shuffled_pixels(p, roi, 2, offsets=[(0.0, 0.0, 0.0), (40.0, 0.0, -10.0)])
    assert sorted({r["trial"] for r in moved.select("trial").collect()}) == [0, 1] and moved.where("mock_id > 1").count() == 0
    one, other = (nulls.shuffled(p, 4).where(F.col("mock_id").isin(*m)).withColumn("mock_id", F.col("mock_id") % 2) for m in ((0, 1), (2, 3)))
    shift = grid.Roi(tuple(o + d for o, d in zip(roi.origin, (40.0, 0.0, -10.0), strict=True)), roi.size, roi.grid)
    for t, rows, r in ((0, one, roi), (1, other, shift)):
        got = packed.unpacked(moved.where(f"trial = {t} and mock_id >= 0"), r, ["mock_id", "type"])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, grid.pixels(rows, r, ["mock_id", "type"]).select(got.columns).collect()))


def test_packed_counts_are_narrow():
    for px, c in (([0, 5], [1, 1]), ([3, 70_000], [300, 2]), ([], [])):
        a, b = packed.pack(np.array(px, np.int64), np.array(c, np.int64))
        grid_ = np.zeros(80_000, np.int64)
        packed.add_to(grid_, a, b)
        assert np.flatnonzero(grid_).tolist() == px and grid_[px].tolist() == c
    assert len(packed.pack(np.arange(10), np.ones(10, int))[0]) == 11


def test_full_grids_are_packed_without_pixels():
    counts = np.arange(1, 1001)
    px, c = packed.pack(np.arange(1000), counts, 1000)
    grid_ = np.zeros(1000)
    packed.add_to(grid_, px, c)
    assert px == b"" and len(c) == 2001 and (grid_ == counts).all()
    assert packed.pack(np.array([5]), np.array([2]), 1000)[0] != b""


def test_counts_are_not_exchanged_by_type(spark, uniform):
    # as many tasks as types would read all counts else
    roi = grid.roi_of(uniform, 16)
    sc = Scales.of_pixels([2, 4], roi.extent, 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (an.cooccurrence(uniform, roi, sc, 3, 10), packed.correlations(nulls.shuffled_pixels(uniform, roi, 3).drop("trial"), roi, sc, ["mock_id"], ["A", "B"])):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan.split("MapInArrow")[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_summed_areas_give_the_sums_of_bins():
    r = np.random.default_rng(8)
    for shape in ((16, 16), (12, 12, 12)):
        dense = r.poisson(0.7, shape)
        sums = grid.power_sums(dense, (1, 3, 5, 9, 40))
        for k, v in enumerate((1, 3, 5, 9, 40)):
            n, d = shape[0] // v, len(shape)
            c = np.array([dense.sum()]) if n < 2 else dense[(slice(0, n * v),) * d].reshape([n, v] * d).sum(axis=tuple(range(1, 2 * d, 2))).ravel()
            assert [sums[s][k] for s in ("n_bins", "s1", "s2", "s3")] == [len(c), c.sum(), (c**2).sum(), (c**3).sum()]


def test_joint_test_is_numpys(spark):
    r = np.random.default_rng(11)
    rows, want = [], {}
    for key, n, p, mix in (("a", 50, 12, 1.0), ("b", 7, 12, 0.1), ("c", 2, 1, 1.0), ("d", 5, 3, 0.0)):
        base = r.normal(10, 3, (n, 1)) * (1 - mix) + r.normal(0, 1, (n, p)) * mix
        real = r.normal(11, 1, p)
        want[key] = stats.hotelling(real, base)
        rows += [(key, m, j, float(v)) for m, curve in [(-1, real), *enumerate(base)] for j, v in enumerate(curve)]
    rows += [("short", m, j, 1.0) for m in (-1, 0) for j in range(2)] + [("unreal", m, 0, 1.0) for m in range(9)]
    curves = spark.createDataFrame(rows, "key string, mock_id int, scale_idx int, vmr double")
    tested = stats.joint_test(curves, ["key"], least_mocks=2)
    plan = tested._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    got = {t["key"]: t for t in tested.collect()}
    assert set(got) == set(want)
    for key, (chi, cond, n) in want.items():
        assert math.isclose(got[key]["chi_squared"], chi, rel_tol=1e-9) and got[key]["n_mocks_used"] == n
        assert math.isclose(got[key]["condition_number"], cond, rel_tol=1e-6), key
    one = stats.joint_test(curves.where("key = 'short'"), ["key"], least_mocks=1).first()
    assert one["chi_squared"] == 0.0 and one["p_value"] == 1.0 and one["condition_number"] is None
    # a matrix that has no factor: the distance by the variances alone
    bad = spark.range(1).select(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(1.0))).alias("m"), F.array(F.lit(1.0), F.lit(1.0)).alias("d"))
    q = bad.select(stats.distance(F.col("m"), F.col("d")).alias("q"), stats.condition_number(F.col("m")).alias("c")).first()
    assert (q["q"] is None or math.isnan(q["q"])) and q["c"] == float("inf")


def test_resamples_as_weights_are_those_of_rows(spark):
    r = np.random.default_rng(12)
    rows = [(k, m, j, float(v)) for k, n in (("x", 9), ("y", 6)) for m in range(-1, n) for j, v in enumerate(r.normal(5, 1, 4))]
    curves = spark.createDataFrame(rows, "type string, mock_id int, scale_idx int, vmr double")
    drawn = nulls.resamples(curves.where("mock_id >= 0"), ["type"], 30)
    real = curves.where("mock_id < 0").withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(29)))).select(drawn.columns)
    want = {(t["type"], t["boot"]): t["chi_squared"] for t in stats.joint_test(drawn.unionByName(real), ["type", "boot"], least_mocks=2).collect()}
    got = {(t["type"], t["boot"]): t["chi_squared"] for t in stats.resampled_tests(curves, ["type"], 30).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-6) for k in want)


def test_cooccurrence_matches_numpy(uniform):
    roi = grid.roi_of(uniform, 32)
    sc = Scales.of_pixels([4], roi.extent, 32)
    r = an.cooccurrence(uniform, roi, sc, 4, 10).first()
    pdf = uniform.toPandas()
    g = {}
    for t in "AB":
        p = pdf[pdf.type == t]
        c = np.zeros((32, 32))
        np.add.at(c, tuple(np.floor(np.clip((p[a] - o) / s * 32, 0, 32 - 1e-9)).astype(int) for a, o, s in zip("xy", roi.origin, roi.size, strict=True)), 1)
        g[t] = c.reshape(8, 4, 8, 4).sum(axis=(1, 3)).ravel()
    assert math.isclose(r["r"], np.corrcoef(g["A"], g["B"])[0, 1], rel_tol=1e-9)


def test_measures_of_a_curve(spark):
    rows = spark.createDataFrame([("t", i, 10.0 * 2**i, r) for i, r in enumerate([1.0, 1.2, 2.0, 1.6, 0.9])], "type string, scale_idx int, um double, ratio double")
    area = cv.trapezoid(rows, ["type"], "ratio", "a", 1.0).first()["a"]
    assert math.isclose(area, np.trapezoid(np.array([0, 0.2, 1, 0.6, -0.1]), np.log10(10.0 * 2.0 ** np.arange(5))), rel_tol=1e-9)
    assert math.isclose(cv.width(rows, ["type"]).first()["width"], math.log10(2))
    assert rows.agg(cv.direction(F.col("ratio")).alias("d")).first()["d"] == "mixed"
    assert cv.sign_change(rows.withColumn("v", F.col("ratio") - 1.1), ["type"], "v", "s").first()["s"] == 10.0


def test_layers_and_regions(spark):
    names = spark.createDataFrame([("SSp-m6b",), ("VISpm2/3",), ("GU1",), ("unassigned",), ("RT",), (None,), ("X9",)], "s string")
    assert [r[0] for r in names.select(prep.cortical_layer(F.col("s"))).collect()] == ["L6b", "L2/3", "L1", None, None, None, None]
    cells = spark.createDataFrame([("a", "HPF"), ("b", None), ("c", "TH")], "cell_label string, division string")
    assert prep.region(cells, "Hippocampus").count() == 1 and prep.region(cells, "TH").count() == 1
    with pytest.raises(ValueError):
        prep.region(cells.drop("division"), "TH")


def test_quantile_bins_follow_ties(spark):
    rows = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate([1, 1, 1, 1, 2, 3, 4, 5, 6, 7])] + [(99, "b", 3.0)], "id long, stratum string, z double")
    got = {r["id"]: r["bin"] for r in prep.quantile_bins(rows).collect()}
    import pandas as pd

    exp = pd.qcut([1, 1, 1, 1, 2, 3, 4, 5, 6, 7], 5, labels=False, duplicates="drop")
    assert [got[i] for i in range(10)] == list(exp) and got[99] == 0


@pytest.mark.parametrize("few", [4, 40, 4096])
def test_quantiles_by_selection_are_exact(spark, few):
    r = np.random.default_rng(13)
    # heavy tails, many ties, two values, one value, tiny and infinite ones, a group without a name
    groups = {"tail": np.exp(r.normal(0, 12, 500)) * r.choice([-1, 1], 500), "ties": r.integers(0, 4, 300).astype(float), "two": np.array([1.0, 2.0] * 30), "one": np.full(50, 3.5), "tiny": np.array([0.0, 5e-324] * 20), "far": np.array([-np.inf, *r.normal(0, 1, 60), np.inf, np.inf]), None: r.normal(0, 1e-3, 77) + 5000}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("tail", None), ("tail", float("nan"))]
    p = spark.createDataFrame(rows, "stratum string, z double")
    probs = [0.0, 0.2, 0.5, 0.61, 1.0]
    got = {q["stratum"]: q for q in order.quantiles(p, "z", ["stratum"], probs, few=few, buckets=8).collect()}
    want = {q["stratum"]: q["q"] for q in p.where("z is not null and not isnan(z)").groupBy("stratum").agg(F.percentile("z", F.array(*[F.lit(v) for v in probs])).alias("q")).collect()}
    assert {k: q["n"] for k, q in got.items()} == {k: len(v) for k, v in groups.items()}
    for g in groups:
        assert all(a == b or math.isclose(a, b, rel_tol=1e-12) or (math.isnan(a) and math.isnan(b)) for a, b in zip(got[g]["q"], want[g], strict=True)), g
    assert order.quantiles(p.where("z > 1e300 and z < 1e301"), "z", ["stratum"], probs).count() == 0


def test_average_ranks_over_ranges(spark):
    import pandas as pd

    r = np.random.default_rng(14)
    v = np.concatenate([r.integers(0, 30, 300).astype(float), np.exp(r.normal(0, 8, 300)), [-0.0, 0.0, np.inf, -np.inf]])
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(-1, None), (-2, float("nan"))], "id long, v double")
    got = {t["id"]: t["k"] for t in order.average_ranks(rows, "v", "k", share=20).collect()}
    want = pd.Series(v).rank(method="average")
    assert got[-1] is None and got[-2] is None and all(got[i] == want[i] for i in range(len(v)))


def test_spearman_ties_and_constants(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (4.0, 1.0)], "a double, b double")
    assert math.isclose(stats.spearman(rows, "a", "b").first()["rho"], -1.5 / math.sqrt(22.5), rel_tol=1e-9)
    assert stats.spearman(rows.withColumn("b", F.lit(1.0)), "a", "b").first()["rho"] is None


@pytest.mark.parametrize("means", [(1, 1, 1, 1, 1), (3, 5, 1, 2, 4), (2, 5, 4, 1, 3), (5, 4, 3, 1, 2), (1, 2, 3, 4, 5)])
def test_spearman_peaks_and_its_sql_agree(spark, tmp_path, means):
    import duckdb

    from stipple import catalogue

    # as many customers as 1, 2, ... of each nation; means in thousands: constant, rank correlations of 0, -0.3, -0.9 and 1
    rows = [(n, 1000.0 * m) for n, m in enumerate(means) for _ in range(n + 1)]
    spark.createDataFrame(rows, "c_nationkey int, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    got = catalogue.QUERIES["spearman_peaks"](spark, str(tmp_path)).first()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(catalogue.SQL["spearman_peaks"]).fetchall()[0]
    assert tuple(got) == want


def test_p_values_of_weak_rank_correlations(spark):
    import duckdb

    from stipple import catalogue
    from stipple.functions import tails

    cases = [(25, 0.005), (25, 0.0001), (150, 0.02), (4000, 0.001), (25, -0.07), (25, 0.9), (3, 0.5), (25, 0.70711)]
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
    want = [r[0] for r in spark.createDataFrame(cases, "n long, rho double").coalesce(1).select(F.round(tails.t_two_sided(t, F.col("n") - 2), 6)).collect()]
    got = [duckdb.connect().execute(f"SELECT {catalogue.r2p_sql()} FROM (SELECT {n} AS n, {rho}::DOUBLE AS rho)").fetchall()[0][0] for n, rho in cases]
    assert got == want


def test_the_band_of_l_is_of_all_points(spark):
    r = np.random.default_rng(12)
    p = points(spark, [(i, float(x), float(y), "A") for i, (x, y) in enumerate(r.uniform(0, 100, (5200, 2)))])
    found = an.ripley_band(p, [0.5], 100.0 * 100.0, 2).first()
    d = np.array([[q["x"], q["y"]] for q in p.collect()])
    near = sum(int((((d[i + 1 :] - d[i]) ** 2).sum(axis=1) <= 0.25).sum()) for i in range(len(d)))
    assert found["n"] == 5200 and math.isclose(found["k"], 1e4 * 2 * near / (5200 * 5199), rel_tol=1e-12)


def test_empty_points_give_empty_results(spark):
    p = points(spark, [(1, 0.0, 0.0, "A")]).where("id < 0")
    roi = grid.roi_of(p, 16)
    assert grid.curves_of(p, roi, Scales.of_pixels([2], roi.extent, 16), ["type"]).count() == 0
    assert an.fingerprints(p, roi, Scales.of_pixels([2], roi.extent, 16), 5).count() == 0


def test_streaming_counts_agree_with_batch(spark, tmp_path):
    from stipple.streaming.counts import pixel_counts

    rows = spark.range(200).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"), F.lit("t").alias("type"))
    rows.write.parquet(str(tmp_path / "in"))
    roi = grid.roi_of(rows, 4)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = pixel_counts(stream, roi, ["type"]).writeStream.outputMode("complete").format("memory").queryName("px").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("px").collect())) == sorted(map(tuple, grid.pixels(rows, roi, ["type"]).collect()))


@pytest.fixture(scope="module")
def cells(spark):
    r = np.random.default_rng(21)
    rows = []
    for i in range(900):
        x, y = r.uniform(0, 6000, 2)
        kind = "CD"[int(x > 3000)] if i % 2 else "EF"[int(r.integers(0, 2))]
        rows.append((f"c{i}", float(x), float(y), 0.0, kind, f"{kind}1", int(x // 1000) if i % 9 else (7 if i % 2 else None)))
    table = spark.createDataFrame(rows, "cell_label string, x double, y double, z double, class string, subclass string, parcellation_index int")
    terms = spark.createDataFrame([(k, "Isocortex" if k < 5 else "TH" if k == 5 else "HPF", f"S{k}", f"SSp{k + 1}") for k in range(8)], "parcellation_index int, division string, structure string, substructure string")
    return table, terms


def test_region_store_prunes_and_joins_in_place(spark, cells, tmp_path):
    from stipple.sources.store import RegionStore

    table, terms = cells
    path = str(tmp_path / "store")
    store = RegionStore(spark, path, 4).write(table.drop("parcellation_index"), table.select("cell_label", "parcellation_index"), terms)
    pdf = table.toPandas()
    mine = pdf[(pdf.parcellation_index < 5)]
    assert store.manifest()["Isocortex"]["n_cells"] == len(mine) and set(store.manifest()) == {"Isocortex", "TH", "HPF"}
    for again in (store, RegionStore(spark, path, 4)):  # the second knows only the files
        spark.sql(f"DROP TABLE IF EXISTS {again._name('cells')}") if again is not store else None
        spark.sql(f"DROP TABLE IF EXISTS {again._name('places')}") if again is not store else None
        got = again.strata("isocortex").select("cell_label", "layer", "structure", "class")
        assert sorted((r["cell_label"], r["layer"], r["structure"], r["class"]) for r in got.collect()) == sorted((c, f"L{int(k) + 1}", f"S{int(k)}", t) for c, k, t in zip(mine.cell_label, mine.parcellation_index, mine["class"], strict=True))
        threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            joined = again.region("isocortex").join(again._table("places"), "cell_label", "left")
            plan = joined._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "PartitionFilters: [isnotnull(division" in plan.replace("#", "")
    assert {r["nucleus"] for r in store.strata("thalamus").collect()} == {"S5"} and "layer" not in store.strata("hippocampus").columns
    assert store.region("nowhere").count() == 0 and RegionStore(spark, str(tmp_path / "none")).manifest() == {}


def test_runner_goes_on_where_it_stopped(spark, cells, tmp_path, monkeypatch):
    from stipple.plans import runner
    from stipple.sources import reports
    from stipple.sources.store import RegionStore

    table, terms = cells
    store = RegionStore(spark, str(tmp_path / "store"), 4).write(table.drop("parcellation_index"), table.select("cell_label", "parcellation_index"), terms)
    results, few = str(tmp_path / "results"), runner.Options(n_mocks=6, min_cells=30, grid_size=32, n_trials=2, n_boot=20)
    calls = []

    def counted(name, f):
        def call(*a):
            calls.append(name)
            if name == "cooccurrence" and calls.count(name) == 1:
                raise KeyError("lost")
            return f(*a)
        return call

    monkeypatch.setattr(runner, "ANALYSES", {k: counted(k, f) for k, f in runner.ANALYSES.items()})
    names = ["fingerprints", "cooccurrence", "mediation"]
    first = {(o.region, o.analysis): o for o in runner.run(store, results, ["isocortex", "nowhere"], names, few)}
    assert first["isocortex", "fingerprints"].state == "made" and first["isocortex", "mediation"].state == "made"
    assert first["isocortex", "cooccurrence"].state == "failed" and "lost" in first["isocortex", "cooccurrence"].message
    assert first["nowhere", "fingerprints"].state == "skipped" and not (tmp_path / "results" / "isocortex" / "cooccurrence").exists()
    second = {o.analysis: o.state for o in runner.run(store, results, ["isocortex"], names, few)}
    assert second == {"fingerprints": "kept", "cooccurrence": "made", "mediation": "kept"} and calls.count("fingerprints") == 1
    other = {o.analysis: o.state for o in runner.run(store, results, ["isocortex"], ["fingerprints"], runner.Options(n_mocks=7, min_cells=30, grid_size=32))}
    assert other == {"fingerprints": "made"}
    found = {r["type"]: r for r in reports.read_fingerprints(spark, results + "/isocortex/fingerprints/fingerprints.json").collect()}
    assert set(found) == set("CDEF") and all(len(r["vmr_curve"]) == len(r["scales_um"]) > 3 for r in found.values())
    pairs_ = reports.read_pairs(spark, results + "/isocortex/cooccurrence/cooccurrence.json").collect()
    assert len(pairs_) == 6 and all(len(r["correlation_curve"]) == len(r["significant_scales"]) for r in pairs_)
    assert [o.state for o in runner.run(store, results, ["hippocampus"], ["mediation"], few)] == ["skipped"]
    assert {o.state for o in runner.run(store, results, ["isocortex"], ["regional", "jitter"], few)} == {"made"}
    trials = reports.read_trials(spark, results + "/isocortex/jitter/trials.json").collect()
    assert {(r["trial"], r["type"]) for r in trials} == {(t, k) for t in range(2) for k in "CDEF"}
    assert runner.main(["--store", store.path, "--results", results, "--regions", "isocortex", "--analyses", "mediation", "regional", "--n-mocks", "6", "--min-cells", "30", "--grid-size", "32", "--n-trials", "2", "--n-boot", "20"]) == 0
    assert calls.count("mediation") == 2 and calls.count("regional") == 1  # one was for a region without strata
    assert not list((tmp_path / "results" / ".making").glob("*"))


def test_a_task_deals_labels_in_arrays_and_no_row_is_copied_for_a_mock_before(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(i, bool(i % 3), "AB"[int(r.integers(2))], (None, "s", "t")[int(r.integers(3))]) for i in range(300)]
    p = spark.createDataFrame(rows, "id long, flag boolean, type string, stratum string")
    monkeypatch.setattr(nulls, "SENT", 7)  # several batches a mock
    drawn = nulls.shuffled(p, 4, "stratum")
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    assert drawn.columns == ["mock_id", "id", "flag", "stratum", "type"] and drawn.count() == 1200
    kept = {x["id"]: tuple(x) for x in p.collect()}
    for m in range(4):
        got = drawn.where(F.col("mock_id") == m).collect()
        assert sorted(x["id"] for x in got) == list(range(300)) and all((x["flag"], x["stratum"]) == (kept[x["id"]][1], kept[x["id"]][3]) for x in got)
        assert all(x["type"] == kept[x["id"]][2] for x in got if x["stratum"] is None)
        assert sorted((x["stratum"] or "", x["type"]) for x in got) == sorted((x[3] or "", x[2]) for x in rows)
    assert nulls.shuffled(p.limit(0), 2).count() == nulls.shuffled(p.limit(0), 2, "stratum").count() == 0


def test_draws_in_tasks_are_those_of_columns(spark):
    from stipple.functions import chance

    ids = [0, 9, 10, 99, 12_345, 10**9, 10**18 - 1, 10**18, 2**63 - 1, *range(995, 1010)]
    for salt in ("csr", "a much longer salt than one block of md5 has room for"):
        want = [r["u"] for r in spark.createDataFrame([(i,) for i in ids], "id long").select(chance.uniform(salt, 7, F.col("id"), "t").alias("u")).collect()]
        assert chance.uniforms(np.array(ids), f"{salt}|7|", "|t").tolist() == want
        want = [r["z"] for r in spark.createDataFrame([(i,) for i in ids], "id long").select(chance.normal(salt, 7, F.col("id"), "t").alias("z")).collect()]
        assert np.allclose(chance.normals(np.array(ids), f"{salt}|7|", "|t"), want, rtol=1e-12, atol=1e-12)
    many = [r["u"] for r in spark.range(20_000).select("id", chance.uniform("b", F.col("id"), "t").alias("u")).orderBy("id").collect()]
    assert chance.uniforms(np.arange(20_000), "b|", "|t").tolist() == many


def test_uniform_points_are_counted_where_they_are_drawn(spark, uniform):
    hull, roi = nulls.convex_hull(uniform), grid.roi_of(uniform, 16)
    counts = nulls.uniform_pixels(spark, hull, 500, 3, roi)
    want = grid.pixels(nulls.uniform_in_hull(spark, hull, 500, 3), roi, ["mock_id"])
    assert sorted(map(tuple, packed.unpacked(counts, roi, ["mock_id"]).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_points_are_counted_in_tasks_as_by_rows(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, float(x), float(y), None if i % 7 == 0 else "ab"[i % 2]) for i, (x, y) in enumerate(r.uniform(-20, 120, (400, 2)))]
    p = points(spark, [*rows, (900, None, 5.0, "a"), (901, float("nan"), 5.0, "b"), (902, float("inf"), float("-inf"), "b")])
    roi = grid.Roi((0.0, 0.0), (100.0, 50.0), 8)
    want = sorted(map(repr, grid.pixels(p, roi, ["type"]).select("type", "gx", "gy", "c").collect()))
    for held in (1 << 23, 100):  # with room for one grid, too
        monkeypatch.setattr(packed, "HELD", held)
        got = packed.unpacked(packed.counted(p, roi, ["type"]), roi, ["type"]).selectExpr("type", "gx", "gy", "c")
        assert sorted(map(repr, got.collect())) == want
    assert packed.counted(p.limit(0), roi, ["type"]).count() == 0


def test_the_hull_is_that_of_all_points_in_any_batches(spark, uniform):
    rows = uniform.select("x", "y").collect()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        assert nulls.convex_hull(uniform) == nulls._hull([tuple(r) for r in rows])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_points_of_several_nulls_are_read_from_their_source_once(spark, uniform, monkeypatch):
    made = []
    monkeypatch.setattr(an, "cut", lambda rows, name: (made.append(name), nulls.cut(rows, name))[1])
    p = uniform.withColumns({"z": F.col("x") + F.col("y"), "stratum": F.when(F.col("x") < 400, "a").otherwise("b")})
    roi = grid.roi_of(p, 16)
    got = an.depth_mediation(p, roi, Scales.of_pixels([2, 4], roi.extent, 16), 12, 50)
    assert made == ["strata-points", "points", "curves"] and {r["type"] for r in got.collect()} == {"A", "B"}
