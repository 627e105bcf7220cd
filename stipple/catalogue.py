"""The queries over the driver's tables and their DuckDB twins.

Points are orders (x price, y customer key), events (x value, y seconds) and
embeddings (three components); strata are market segments. Random draws come
from md5 of keys, so DuckDB repeats them. Grids, scales and numbers of simulations
are the full ones: 256 pixels a side (64 in three dimensions), eleven scales, 50
shuffles, 20 uniform patterns, 200 resamples, 10 jittered trials.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import curves as cv
from .functions.scales import Scales
from .operators import grid, nulls, packed, pairs, prep, stats
from .plans import analyses as an
from .sources.scratch import fresh_path

GRID, VOX, MOCKS, LEAST = 256, Scales.for_extent(None).vox, 50, 50
GRID_3D, VOX_3D = 64, Scales.in_pixels(2, 32, 8).vox
UNIFORMS, BOOTS, TRIALS = 20, 200, 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def orders(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    o = read(spark, sf, "orders").withColumns({"x": F.col("o_totalprice"), "y": F.col("o_custkey").cast("double"), "z": (F.unix_timestamp("o_orderdate") / 86400).cast("double")})
    o = o.dropna(subset=["o_orderkey", "x", "y", "o_orderpriority"])
    if "stratum" in more:
        c = read(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("stratum"))
        o = prep.valid_strata(o.join(c, o["o_custkey"] == c["c_custkey"], "left"))
    return o.select(F.col("o_orderkey").alias("id"), "x", "y", F.col("o_orderpriority").alias("type"), *more)


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").dropna(subset=["event_id", "value", "ts", "event_type"])
    return e.select(F.col("event_id").alias("id"), F.col("value").alias("x"), F.unix_timestamp("ts").cast("double").alias("y"), F.col("event_type").alias("type"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    at = [F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")]
    return e.select(F.col("vec_id").alias("id"), *at, F.col("label").cast("string").alias("type")).dropna()


def setup(points: DataFrame, dims: int = 2, g: int = GRID, vox: tuple[int, ...] = VOX) -> tuple[grid.Roi, Scales]:
    roi = grid.roi_of(points, g, dims)
    return roi, Scales.of_pixels(list(vox), roi.extent, g)


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a few places, without a negative zero."""
    return rows.select(*[(F.round(n, digits) + F.lit(0.0)).alias(n) if t == "double" else F.transform(n, lambda v: F.round(v, digits) + F.lit(0.0)).alias(n) if t == "array<double>" else F.col(n) for n, t in rows.dtypes])


# --- DuckDB pieces ---------------------------------------------------------------------------------------------
PTS = "pts AS (SELECT o_orderkey AS id, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y, CAST(floor(epoch(o_orderdate)) / 86400 AS DOUBLE) AS z, o_orderpriority AS type FROM orders WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL)"
SPTS = "pts AS (SELECT o_orderkey AS id, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y, CAST(floor(epoch(o_orderdate)) / 86400 AS DOUBLE) AS z, o_orderpriority AS type, c_mktsegment AS stratum FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL AND c_mktsegment IS NOT NULL AND c_mktsegment <> 'unassigned')"
EPTS = "pts AS (SELECT event_id AS id, value AS x, CAST(floor(epoch(ts)) AS DOUBLE) AS y, event_type AS type FROM events WHERE event_id IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL)"
VPTS = "pts AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(label AS VARCHAR) AS type FROM embeddings WHERE embedding[1] IS NOT NULL AND embedding[2] IS NOT NULL AND embedding[3] IS NOT NULL AND label IS NOT NULL)"
LPTS = "pts AS (SELECT l_extendedprice AS x, CAST(l_partkey AS DOUBLE) AS y, l_returnflag AS type FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_partkey IS NOT NULL AND l_returnflag IS NOT NULL)"


def roi_sql(dims: int = 2) -> str:
    e = "CAST(0.01 AS DOUBLE)"
    return "roi AS (SELECT " + ", ".join(f"min({a}) - {e} * (max({a}) - min({a})) AS o{a}, (max({a}) - min({a})) * (1 + 2 * {e}) AS s{a}" for a in "xyz"[:dims]) + " FROM pts)"


def pix_sql(src: str, keys: str, dims: int = 2, g: int = GRID, name: str = "pix", shift: str = "") -> str:
    at = lambda a: f"CAST(floor(least(greatest(CASE WHEN s{a} > 0 THEN ({a} - (o{a}{shift.replace('@', a)})) / s{a} * {g} ELSE 0 END, 0), {g} - 1e-9)) AS INTEGER) AS g{a}"
    return f"{name} AS (SELECT {keys}, {', '.join(at(a) for a in 'xyz'[:dims])}, count(*) AS c FROM {src}, roi GROUP BY ALL)"


def bin_sql(keys: str, dims: int = 2, g: int = GRID, vox: tuple[int, ...] = VOX, pix: str = "pix", name: str = "") -> str:
    extent = "greatest(" + ", ".join(f"s{a}" for a in "xyz"[:dims]) + ")"
    sc = f"sc{name} AS (SELECT unnest([" + ", ".join(f"{{'i': {i}, 'v': {v}, 'n': {g // v}}}" for i, v in enumerate(vox)) + "]) AS s)"
    inside = " AND ".join(f"g{a} < s.n * s.v" for a in "xyz"[:dims])
    at = lambda a: f"CASE WHEN {inside} THEN g{a} // s.v ELSE -1 END AS \"b{a}\""
    b = f"bins{name} AS (SELECT {keys}, s.i AS scale_idx, s.v AS vox, s.v * ({extent} / {g}) AS um, CAST(s.n ** {dims} AS BIGINT) AS n_bins, {', '.join(at(a) for a in 'xyz'[:dims])}, CAST(sum(CASE WHEN {inside} THEN c ELSE 0 END) AS BIGINT) AS c FROM {pix}, sc{name}, roi GROUP BY ALL)"
    return f"{sc}, {b}"


def cur_sql(keys: str, name: str = "", curves: str = "cur") -> str:
    return f"""pow{name} AS (SELECT {keys}, scale_idx, vox, um, n_bins::DOUBLE AS n, sum(c)::BIGINT AS np, sum(c)::DOUBLE AS s1, sum(c * c)::DOUBLE AS s2, sum((c * c * c)::DOUBLE) AS s3 FROM bins{name} GROUP BY ALL),
mom{name} AS (SELECT *, s1 / n AS mean, greatest(s2 / n - (s1 / n) * (s1 / n), 0) AS var FROM pow{name}),
{curves} AS (SELECT {keys}, scale_idx, vox, um, np AS n_points, CASE WHEN mean < 1e-10 THEN 1.0::DOUBLE ELSE (s2 / n - mean * mean) / mean END AS vmr,
  CASE WHEN sqrt(var) >= 1e-10 THEN (s3 / n - 3.0::DOUBLE * mean * (s2 / n) + 2.0::DOUBLE * mean * mean * mean) / (var * sqrt(var)) ELSE 0.0::DOUBLE END AS skewness FROM mom{name})"""


def lab_sql(n: int = MOCKS, by: str = "", salt: str = "", cols: str = "x, y", name: str = "lab") -> str:
    """Labels permuted as ``nulls.shuffled`` does; points without a stratum keep theirs."""
    st, t = by or "0", name
    last = "".join(f", t{r}" for r in range(4))
    move = lambda r, at: f"t{r}[({at}) % m + 1] + t{r}[m + ({at}) // m + 1]"
    v = lambda r: f"(v + {move(r, 'ro + u')}) % CASE WHEN u < h THEN w ELSE rest END AS v"
    u = lambda r: f"(u + {move(r, 'co + v')}) % (h + CASE WHEN v < rest THEN 1 ELSE 0 END) AS u"
    return f"""sz{t} AS (SELECT {st} AS st, count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM pts WHERE {st} IS NOT NULL GROUP BY 1),
so{t} AS (SELECT st, w, n // w AS h, n % w AS rest, CAST(sum(n) OVER o - n AS BIGINT) AS base, CAST(sum((n + w - 1) // w) OVER o - (n + w - 1) // w AS BIGINT) AS ro, CAST(sum(w) OVER o - w AS BIGINT) AS co FROM sz{t} WINDOW o AS (ORDER BY st ROWS UNBOUNDED PRECEDING)),
ms{t} AS (SELECT CAST(floor(sqrt(greatest(sum((n + w - 1) // w), sum(w)))) AS BIGINT) + 1 AS m FROM sz{t}),
dr{t} AS (SELECT mock_id, r, list(('0x' || substr(md5('{salt}|' || mock_id || '|' || r || '|' || j), 1, 7))::BIGINT ORDER BY j) AS t FROM (SELECT unnest(range({n})) AS mock_id), (SELECT unnest(range(4)) AS r), (SELECT unnest(range(2 * m)) AS j FROM ms{t}) GROUP BY ALL),
tw{t} AS (SELECT mock_id, {", ".join(f"any_value(t) FILTER (r = {r}) AS t{r}" for r in range(4))} FROM dr{t} GROUP BY 1),
rk{t} AS (SELECT id, {cols}, {st} AS st, row_number() OVER (PARTITION BY {st} ORDER BY md5('{salt}-1|' || id), id) - 1 AS k FROM pts WHERE {st} IS NOT NULL),
s0{t} AS (SELECT mock_id, id, {cols}, base, w, h, rest, ro, co, m{last}, k // w AS u, k % w AS v FROM rk{t} JOIN so{t} USING (st), tw{t}, ms{t}),
s1{t} AS (SELECT * REPLACE ({v(0)}) FROM s0{t}), s2{t} AS (SELECT * REPLACE ({u(1)}) FROM s1{t}), s3{t} AS (SELECT * REPLACE ({v(2)}) FROM s2{t}), s4{t} AS (SELECT * REPLACE ({u(3)}) FROM s3{t}),
lb{t} AS (SELECT type, row_number() OVER (ORDER BY {st}, type) - 1 AS at FROM pts WHERE {st} IS NOT NULL),
{t} AS (SELECT mock_id, id, {cols}, lb{t}.type FROM s4{t} JOIN lb{t} ON lb{t}.at = base + u * w + v UNION ALL SELECT m, id, {cols}, type FROM pts, (SELECT unnest(range({n})) AS m) WHERE {st} IS NULL UNION ALL SELECT -1, id, {cols}, type FROM pts)"""


def freq_sql(least: int = LEAST) -> str:
    return f"freq AS (SELECT type FROM pts GROUP BY type HAVING count(*) >= {least})"


FREQ = freq_sql()
FLAB = "flab AS (SELECT lab.* FROM lab JOIN freq USING (type))"


def vs_sql(keys: str = "type") -> str:
    """Usable curves, and the real ones with the moments of their nulls."""
    return f"""size AS (SELECT mock_id, {keys}, sum(c) AS n FROM pix GROUP BY ALL), ok AS (SELECT cur.*, size.n FROM cur JOIN size USING (mock_id, {keys}) WHERE mock_id < 0 OR size.n >= 5),
nul AS (SELECT {keys}, scale_idx, avg(vmr) AS null_mean, stddev_pop(vmr) AS null_sd, count(*) AS n_mocks FROM ok WHERE mock_id >= 0 GROUP BY ALL),
vs AS (SELECT ok.*, null_mean, null_sd, n_mocks, CASE WHEN null_mean > 0 THEN vmr / null_mean ELSE 1.0 END AS ratio FROM ok JOIN nul USING ({keys}, scale_idx) WHERE mock_id < 0)"""


def null_chain(pts: str = PTS, by: str = "", least: int = LEAST) -> str:
    return f"WITH RECURSIVE {pts}, {roi_sql()}, {freq_sql(least)}, {lab_sql(by=by)}, {FLAB}, {pix_sql('flab', 'mock_id, type')}, {bin_sql('mock_id, type')}, {cur_sql('mock_id, type')}, {vs_sql()}"


def kinds_chain(pts: str, kinds: dict[str, str]) -> str:
    """Curves under several shuffles, by null_kind."""
    labs = ", ".join(lab_sql(by=by, name=f"lab_{k}") for k, by in kinds.items())
    every = " UNION ALL ".join(f"SELECT '{k}' AS null_kind, mock_id, x, y, type FROM lab_{k}" for k in kinds)
    keys = "null_kind, mock_id, type"
    return f"WITH RECURSIVE {pts}, {roi_sql()}, {FREQ}, {labs}, kl AS ({every}), flab AS (SELECT kl.* FROM kl JOIN freq USING (type)), {pix_sql('flab', keys)}, {bin_sql(keys)}, {cur_sql(keys)}, {vs_sql('null_kind, type')}"


def hot_sql(keys: str = "type", src: str = "ok", t: str = "", least: int = 5) -> str:
    """The joint test of mock -1 against the others: elimination of the shrunk covariance bordered by the distances; the F tail as a series. Gives hf."""
    a = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""hm{t} AS (SELECT {keys}, scale_idx, avg(vmr) AS hmean, count(*) AS hn FROM {src} WHERE mock_id >= 0 GROUP BY ALL),
hd{t} AS (SELECT {keys}, scale_idx AS i, vmr - hmean AS d, hn FROM {src} JOIN hm{t} USING ({keys}, scale_idx) WHERE mock_id < 0),
hc{t} AS (SELECT {a}, a.scale_idx AS i, b.scale_idx AS j, covar_samp(a.vmr, b.vmr) AS c FROM {src} a JOIN {src} b USING ({keys}, mock_id) WHERE mock_id >= 0 GROUP BY ALL),
hr{t} AS (SELECT {keys}, i, list_append(list(CASE WHEN i = j THEN c * 0.98::DOUBLE + 0.02::DOUBLE * c + 1e-10::DOUBLE ELSE c * 0.98::DOUBLE END ORDER BY j), any_value(d)) AS r FROM hc{t} JOIN hd{t} USING ({keys}, i) GROUP BY ALL),
hb{t} AS (SELECT {keys}, list_append(list(d ORDER BY i), 0.0::DOUBLE) AS r, count(*) AS p, min(hn) AS n FROM hd{t} GROUP BY ALL),
hs{t} AS (SELECT {keys}, any_value(p) AS p, any_value(n) AS n, list_append(list(hr{t}.r ORDER BY i), any_value(hb{t}.r)) AS m FROM hr{t} JOIN hb{t} USING ({keys}) GROUP BY ALL),
he{t} AS (SELECT {keys}, p, n, 1 AS k, m FROM hs{t} UNION ALL SELECT {keys}, p, n, k + 1, list_transform(m, lambda row, i: CASE WHEN i <= k THEN row ELSE list_transform(row, lambda x, j: x - row[k] * m[k][j] / m[k][k]) END) FROM he{t} WHERE k <= p),
ht{t} AS (SELECT {keys}, p AS dof, n AS n_mocks_used, -m[p + 1][p + 1] * n / (n + 1) AS chi_squared FROM he{t} WHERE k = p + 1 AND n >= {least}),
hg{t} AS (SELECT *, chi_squared * (n_mocks_used - dof) / ((n_mocks_used - 1) * dof) AS f_statistic, (n_mocks_used - dof) / 2.0::DOUBLE AS fa, dof / 2.0::DOUBLE AS fb FROM ht{t}),
hx{t} AS (SELECT *, fa / (fa + fb * f_statistic) AS fx FROM hg{t}),
hf{t} AS (SELECT *, CASE WHEN f_statistic <= 0 THEN 1.0 ELSE exp(fa * ln(fx) + fb * ln(1 - fx) - ln(fa) - (lgamma(fa) + lgamma(fb) - lgamma(fa + fb))) * list_sum(list_transform(range(0, 10000), lambda k: exp(k * ln(fx) + lgamma(fa + fb + k) - lgamma(fa + fb) + lgamma(fa + 1) - lgamma(fa + 1 + k)))) END AS p_value FROM hx{t})"""


# --- sources, joins, filters -----------------------------------------------------------------------------------
def _customers(spark: SparkSession, sf: str) -> DataFrame:
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    regions = n.join(r, n["n_regionkey"] == r["r_regionkey"], "left").select(F.col("n_nationkey").alias("parcellation_index"), F.col("r_name").alias("division"), F.col("n_name").alias("structure"))
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("cell_label"), F.col("c_nationkey").alias("parcellation_index"))
    return prep.with_regions(c, regions)


def _located(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("cell_label"), F.col("o_totalprice").alias("x"), F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("subclass"))
    return prep.annotate(o, _customers(spark, sf))


LOC = "loc AS (SELECT o_orderkey, o_custkey AS cell_label, o_totalprice AS x, o_orderpriority AS class, o_orderstatus AS subclass, r_name AS division, n_name AS structure FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"


@query
def region_join_left(spark, sf):
    return _located(spark, sf).groupBy("division", "structure").agg(F.count("*").alias("n_cells"), F.count("division").alias("n_found"), (F.round(F.sum("x"), 2)).alias("total"))


SQL["region_join_left"] = f"WITH {LOC} SELECT division, structure, count(*) AS n_cells, count(division) AS n_found, round(sum(x), 2) AS total FROM loc GROUP BY ALL"


@query
def region_filter(spark, sf):
    return prep.region(_located(spark, sf), "ASIA").select("o_orderkey", "division", "structure", "class")


SQL["region_filter"] = f"WITH {LOC} SELECT o_orderkey, division, structure, class FROM loc WHERE division = 'ASIA'"


@query
def type_breakdown(spark, sf):
    return prep.breakdown(_located(spark, sf), "structure", 10)


SQL["type_breakdown"] = f"WITH {LOC} SELECT structure, count(*) AS n_cells FROM loc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"


@query
def hierarchy_nunique(spark, sf):
    return _located(spark, sf).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in ("class", "subclass", "structure", "division")])


SQL["hierarchy_nunique"] = f"WITH {LOC} SELECT count(DISTINCT class) AS n_class, count(DISTINCT subclass) AS n_subclass, count(DISTINCT structure) AS n_structure, count(DISTINCT division) AS n_division FROM loc"


@query
def prep_dropna_units(spark, sf):
    e = read(spark, sf, "events").select("event_id", (F.col("value") / 1e6).alias("x"), F.col("user_id").cast("double").alias("y"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("cell_type_class"))
    return rounded(prep.prepare(e, "class", "event_id"))


SQL["prep_dropna_units"] = "WITH e AS (SELECT event_id AS id, value / 1000000.0::DOUBLE AS x, user_id::DOUBLE AS y, event_type AS type FROM events WHERE event_type <> 'error' AND value IS NOT NULL AND user_id IS NOT NULL), u AS (SELECT CASE WHEN max(x) < 20 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS k FROM e) SELECT id, round(x * k, 6) + 0.0 AS x, round(y * k, 6) + 0.0 AS y, type FROM e, u"


@query
def layer_regex(spark, sf):
    names = read(spark, sf, "part").select(F.col("p_brand").alias("name")).unionByName(spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in ("SSp-m6b", "VISpm2/3", "GU1", "PL5", "unassigned", "RT", "TH-unassigned", None)])).alias("name")))
    return names.withColumn("layer", prep.cortical_layer(F.col("name"))).groupBy("name", "layer").agg(F.count("*").alias("n"))


SQL["layer_regex"] = r"""WITH names AS (SELECT p_brand AS name FROM part UNION ALL SELECT unnest(['SSp-m6b', 'VISpm2/3', 'GU1', 'PL5', 'unassigned', 'RT', 'TH-unassigned', NULL])),
f AS (SELECT name, regexp_extract(name, '(\d+(?:/\d+)?[a-b]?)$', 1) AS m FROM names)
SELECT name, CASE WHEN name <> 'unassigned' AND substr(m, 1, 1) IN ('1','2','3','4','5','6') THEN 'L' || m END AS layer, count(*) AS n FROM f GROUP BY ALL"""


@query
def compound_stratum(spark, sf):
    deep = prep.quantile_bins(orders(spark, sf, "stratum", "z"), "z", 5)
    return deep.withColumn("compound", prep.compound_stratum(F.col("stratum"), F.col("bin"))).groupBy("compound").agg(F.count("*").alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi"))


SQL["compound_stratum"] = f"WITH {SPTS}, e AS (SELECT stratum, list_sort(list_distinct(quantile_cont(z, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS q FROM pts GROUP BY 1), b AS (SELECT pts.*, stratum || '_d' || CASE WHEN len(q) < 2 THEN 0 ELSE len(list_filter(q[2:len(q)-1], lambda v: v < z)) END AS compound FROM pts JOIN e USING (stratum)) SELECT compound, count(*) AS n, min(z) AS lo, max(z) AS hi FROM b GROUP BY 1"


@query
def min_cells_filter(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("type"))
    kept = prep.only_types(p, prep.frequent_types(p, 85))
    return prep.only_types(kept, ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"]).groupBy("type").agg(F.count("*").alias("n_cells"))


SQL["min_cells_filter"] = "SELECT p_brand AS type, count(*) AS n_cells FROM part WHERE p_brand IN ('Brand#1','Brand#2','Brand#3','Brand#4','Brand#5') GROUP BY 1 HAVING count(*) >= 85"


# --- grids -----------------------------------------------------------------------------------------------------
@query
def roi_bounds(spark, sf):
    roi = grid.roi_of(orders(spark, sf))
    return rounded(spark.range(1).select(*[F.lit(v).alias(n) for n, v in (("ox", roi.origin[0]), ("oy", roi.origin[1]), ("sx", roi.size[0]), ("sy", roi.size[1]))]))


SQL["roi_bounds"] = f"WITH {PTS}, {roi_sql()} SELECT round(ox, 6) + 0.0 AS ox, round(oy, 6) + 0.0 AS oy, round(sx, 6) + 0.0 AS sx, round(sy, 6) + 0.0 AS sy FROM roi"


@query
def grid_density_2d(spark, sf):
    p = orders(spark, sf)
    return grid.pixels(p, grid.roi_of(p, GRID), ["type"])


SQL["grid_density_2d"] = f"WITH {PTS}, {roi_sql()}, {pix_sql('pts', 'type')} SELECT * FROM pix"


@query
def grid_density_3d(spark, sf):
    p = vectors(spark, sf)
    return grid.pixels(p, grid.roi_of(p, 16, 3), ["type"])


SQL["grid_density_3d"] = f"WITH {VPTS}, {roi_sql(3)}, {pix_sql('pts', 'type', 3, 16)} SELECT * FROM pix"


@query
def bin_counts(spark, sf):
    p = orders(spark, sf)
    roi, sc = setup(p)
    return rounded(grid.bins(grid.pixels(p, roi, ["type"]), sc, roi, ["type"]).where("bx >= 0"))


SQL["bin_counts"] = f"WITH {PTS}, {roi_sql()}, {pix_sql('pts', 'type')}, {bin_sql('type')} SELECT type, scale_idx, vox, round(um, 6) AS um, n_bins, CAST(bx AS INTEGER) AS bx, CAST(\"by\" AS INTEGER) AS \"by\", c FROM bins WHERE bx >= 0"


def _curve(points: DataFrame, dims: int = 2, g: int = GRID, vox: tuple[int, ...] = VOX) -> DataFrame:
    roi, sc = setup(points, dims, g, vox)
    return rounded(grid.curves_of(points, roi, sc, ["type"]))


@query
def vmr_curve(spark, sf):
    return _curve(orders(spark, sf)).drop("skewness")


CURVE = "SELECT type, scale_idx, vox, round(um, 6) AS um, n_points, round(vmr, 6) AS vmr, round(skewness, 6) + 0.0 AS skewness FROM cur"
SQL["vmr_curve"] = f"WITH {PTS}, {roi_sql()}, {pix_sql('pts', 'type')}, {bin_sql('type')}, {cur_sql('type')} SELECT type, scale_idx, vox, round(um, 6) AS um, n_points, round(vmr, 6) AS vmr FROM cur"


@query
def skew_curve(spark, sf):
    li = read(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("x"), F.col("l_partkey").cast("double").alias("y"), F.col("l_returnflag").alias("type")).dropna()
    return _curve(li)


SQL["skew_curve"] = f"WITH {LPTS}, {roi_sql()}, {pix_sql('pts', 'type')}, {bin_sql('type')}, {cur_sql('type')} {CURVE}"


@query
def vmr_curve_3d(spark, sf):
    return _curve(vectors(spark, sf), 3, GRID_3D, VOX_3D)


SQL["vmr_curve_3d"] = f"WITH {VPTS}, {roi_sql(3)}, {pix_sql('pts', 'type', 3, GRID_3D)}, {bin_sql('type', 3, GRID_3D, VOX_3D)}, {cur_sql('type')} {CURVE}"


# --- null models -----------------------------------------------------------------------------------------------
@query
def label_shuffle_counts(spark, sf):
    """The shuffles of all labels on the whole grid, summed up for each mock and type: points, pixels, squares and places."""
    p = orders(spark, sf)
    roi, _ = setup(p)
    return _grid_sums(grid.pixels(nulls.shuffled(p.select("id", "x", "y", "type"), MOCKS), roi, ["mock_id", "type"]))


def _grid_sums(counts: DataFrame) -> DataFrame:
    return counts.groupBy("mock_id", "type").agg(F.sum("c").alias("n"), F.count("*").alias("n_pixels"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.sum(F.col("c") * F.col("gx")).alias("at_x"), F.sum(F.col("c") * F.col("gy")).alias("at_y"))


GRID_SUMS = "SELECT CAST(mock_id AS INTEGER) AS mock_id, type, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_pixels, CAST(sum(c * c) AS BIGINT) AS squares, CAST(sum(c * gx) AS BIGINT) AS at_x, CAST(sum(c * gy) AS BIGINT) AS at_y FROM pix GROUP BY ALL"
SQL["label_shuffle_counts"] = f"WITH {PTS}, {roi_sql()}, {lab_sql()}, {pix_sql('(SELECT * FROM lab WHERE mock_id >= 0)', 'mock_id, type')} {GRID_SUMS}"


@query
def shuffled_pixel_counts(spark, sf):
    """The same by packed counts, real labels (mock -1) too, with points without a stratum."""
    p = orders(spark, sf, "stratum").withColumn("stratum", F.nullif("stratum", F.lit("BUILDING")))
    roi, _ = setup(p)
    counts = nulls.shuffled_pixels(p, roi, MOCKS, "stratum")
    return _grid_sums(packed.unpacked(counts, roi, ["mock_id", "type"]))


NPTS = SPTS.replace("c_mktsegment AS stratum", "nullif(c_mktsegment, 'BUILDING') AS stratum")
SQL["shuffled_pixel_counts"] = f"WITH {NPTS}, {roi_sql()}, {lab_sql(by='stratum')}, {pix_sql('lab', 'mock_id, type')} {GRID_SUMS}"


@query
def stratum_shuffle_counts(spark, sf):
    p = orders(spark, sf, "stratum").withColumn("stratum", F.nullif("stratum", F.lit("BUILDING")))  # some points without a stratum
    drawn = nulls.shuffled(p.select("id", "type", "stratum", (F.col("x") > 150000).alias("half")), MOCKS, "stratum")
    return drawn.groupBy("mock_id", "stratum", "type", "half").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


SQL["stratum_shuffle_counts"] = f"WITH {NPTS}, {lab_sql(by='stratum')} SELECT CAST(mock_id AS INTEGER) AS mock_id, stratum, lab.type, lab.x > 150000 AS half, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM lab JOIN (SELECT id, stratum FROM pts) USING (id) WHERE mock_id >= 0 GROUP BY ALL"


def _labelled(spark, sf, stratum: str | None = None) -> DataFrame:
    p = orders(spark, sf, *(["stratum"] if stratum else []))
    roi, sc = setup(p)
    return an.labelled_curves(p, roi, sc, MOCKS, LEAST, stratum)


@query
def null_envelope(spark, sf):
    rows = an.envelope(an.against_null(_labelled(spark, sf), ["type"]))
    return rounded(rows.select("type", "scale_idx", "um", "vmr", "null_mean", "null_sd", "n_mocks", "ratio", "low", "high"))


SQL["null_envelope"] = f"{null_chain()} SELECT type, scale_idx, round(um, 6) AS um, round(vmr, 6) AS vmr, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, n_mocks, round(ratio, 6) AS ratio, round(greatest(1 - 2 * null_sd / null_mean, 0), 6) AS low, round(1 + 2 * null_sd / null_mean, 6) AS high FROM vs"


@query
def null_envelope_strata(spark, sf):
    rows = an.against_null(_labelled(spark, sf, "stratum"), ["type"])
    return rounded(rows.select("type", "scale_idx", "vmr", "null_mean", "null_sd", "ratio"))


SQL["null_envelope_strata"] = f"{null_chain(SPTS, 'stratum')} SELECT type, scale_idx, round(vmr, 6) AS vmr, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, round(ratio, 6) AS ratio FROM vs"


@query
def null_covariance(spark, sf):
    return rounded(stats.null_covariance(_labelled(spark, sf), ["type"]))


SQL["null_covariance"] = f"{null_chain()} SELECT a.type, a.scale_idx AS scale_i, b.scale_idx AS scale_j, round(covar_samp(a.vmr, b.vmr), 6) + 0.0 AS cov FROM ok a JOIN ok b USING (type, mock_id) WHERE mock_id >= 0 GROUP BY ALL"


def meas_sql(keys: str = "type") -> str:
    return f"""pk AS (SELECT {keys}, max(n) AS n_cells, arg_max(um, vmr - null_mean ORDER BY scale_idx) AS peak_scale_um, max(ratio) AS peak_vmr_ratio,
  CASE WHEN count(*) FILTER (ratio > 1.05) > 0 AND count(*) FILTER (ratio < 0.95) > 0 THEN 'mixed' WHEN count(*) FILTER (ratio < 0.95) > count(*) FILTER (ratio > 1.05) THEN 'regular' ELSE 'clustered' END AS direction FROM vs GROUP BY ALL),
tz AS (SELECT {keys}, (lead(ratio - 1) OVER w + ratio - 1) / 2 * (log10(lead(um) OVER w) - log10(um)) AS a FROM vs WINDOW w AS (PARTITION BY {keys} ORDER BY scale_idx)),
ie AS (SELECT {keys}, coalesce(sum(a), 0) AS integrated_excess FROM tz GROUP BY ALL),
wd AS (SELECT {keys}, coalesce(max(log10(um)) FILTER (ratio >= 1 + (p - 1) * 0.5 AND p > 1.05) - min(log10(um)) FILTER (ratio >= 1 + (p - 1) * 0.5 AND p > 1.05), 0) AS width FROM (SELECT *, max(ratio) OVER (PARTITION BY {keys}) AS p FROM vs) GROUP BY ALL),
me AS (SELECT * FROM pk JOIN ie USING ({keys}) JOIN wd USING ({keys}))"""


MEAS = meas_sql()


@query
def fingerprint_metrics(spark, sf):
    return rounded(an.measures(an.against_null(_labelled(spark, sf), ["type"]), ["type"]))


SQL["fingerprint_metrics"] = f"{null_chain()}, {MEAS} SELECT type, CAST(n_cells AS BIGINT) AS n_cells, round(peak_scale_um, 6) AS peak_scale_um, round(peak_vmr_ratio, 6) AS peak_vmr_ratio, direction, round(integrated_excess, 6) + 0.0 AS integrated_excess, round(width, 6) AS width FROM me"


def _fingerprints(spark, sf) -> DataFrame:
    p = orders(spark, sf)
    return an.fingerprints(p, *setup(p), MOCKS, LEAST)


@query
def fingerprint_summary(spark, sf):
    return rounded(an.fingerprint_summary(_fingerprints(spark, sf)), 5)


SUM = "type, CAST(n_cells AS BIGINT) AS n_cells, round(peak_vmr_ratio, 5) AS peak_vmr_ratio, round(peak_scale_um, 5) AS peak_scale_um, round(integrated_excess, 5) + 0.0 AS integrated_excess, round(width, 5) AS width, direction, round(p_value, 5) AS p_value, p_value < 0.05 AS is_significant"
SQL["fingerprint_summary"] = f"{null_chain()}, {MEAS}, {hot_sql()} SELECT {SUM} FROM me JOIN hf USING (type)"


@query
def hotelling_test(spark, sf):
    found = stats.joint_test(_labelled(spark, sf), ["type"])
    return rounded(found.select("type", "chi_squared", "f_statistic", "dof", "p_value", "n_mocks_used"), 5)


HOT = "round(chi_squared, 5) AS chi_squared, round(f_statistic, 5) AS f_statistic, dof, round(p_value, 5) AS p_value, n_mocks_used"
SQL["hotelling_test"] = f"{null_chain()}, {hot_sql()} SELECT type, {HOT} FROM hf"


@query
def fingerprints(spark, sf):
    """The flagship: whole fingerprints, a row for each type and scale."""
    found = _fingerprints(spark, sf)
    curves = F.explode(F.arrays_zip("scales_um", "vmr_curve", "skewness_curve", "mock_vmr_mean", "mock_vmr_std", "vmr_ratio_curve")).alias("s")
    rows = found.select("type", "n_cells", "direction", "peak_scale_um", "peak_vmr_ratio", "integrated_excess", "width", "chi_squared", "f_statistic", "p_value", "n_mocks_used", "is_significant", curves)
    return rounded(rows.select("*", "s.*").drop("s"), 5)


FIVE = lambda *cols: ", ".join(f"round({c}, 5) + 0.0 AS {n}" for c, n in (c.split(":") if ":" in c else (c, c) for c in cols))
SQL["fingerprints"] = f"""{null_chain()}, {MEAS}, {hot_sql()} SELECT type, CAST(n_cells AS BIGINT) AS n_cells, direction, {FIVE('peak_scale_um', 'peak_vmr_ratio', 'integrated_excess', 'width', 'chi_squared', 'f_statistic', 'p_value')}, n_mocks_used, p_value < 0.05 AS is_significant,
{FIVE('um:scales_um', 'vmr:vmr_curve', 'skewness:skewness_curve', 'null_mean:mock_vmr_mean', 'null_sd:mock_vmr_std', 'ratio:vmr_ratio_curve')} FROM vs JOIN me USING (type) JOIN hf USING (type)"""


@query
def characteristic_scales(spark, sf):
    e = events(spark, sf)
    return rounded(an.characteristic_scales({"orders": _fingerprints(spark, sf), "events": an.fingerprints(e, *setup(e), MOCKS, LEAST)}))


SQL["characteristic_scales"] = " UNION ALL ".join(f"SELECT '{k}' AS region, * FROM ({null_chain(pts)}, {MEAS}, {hot_sql()} SELECT type, round(peak_scale_um, 6) AS peak_scale_um FROM me JOIN hf USING (type) WHERE p_value < 0.05)" for k, pts in (("orders", PTS), ("events", EPTS)))


# --- co-occurrence ---------------------------------------------------------------------------------------------
def _cooccurrence(points: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    roi, sc = setup(points)
    return an.cooccurrence(points, roi, sc, MOCKS, LEAST, listed)


def co_chain(pts: str = PTS) -> str:
    return f"""WITH RECURSIVE {pts}, {roi_sql()}, {FREQ}, {lab_sql()}, {FLAB}, {pix_sql('flab', 'mock_id, type')}, {bin_sql('mock_id, type')},
sm AS (SELECT mock_id, scale_idx, vox, um, n_bins, type, sum(c)::DOUBLE AS s1, sum(c * c)::DOUBLE AS s2 FROM bins GROUP BY ALL),
pr AS (SELECT a.mock_id, a.scale_idx, a.type AS type_a, b.type AS type_b, sum(a.c * b.c)::DOUBLE AS sab FROM bins a JOIN bins b USING (mock_id, scale_idx, bx, "by") WHERE a.type < b.type GROUP BY ALL),
pc AS (SELECT a.mock_id, a.type AS type_a, b.type AS type_b, a.scale_idx, a.vox, a.um, a.n_bins::DOUBLE AS n, a.s1 AS sa, b.s1 AS sb, a.s2 AS saa, b.s2 AS sbb, coalesce(sab, 0) AS sab FROM sm a JOIN sm b USING (mock_id, scale_idx) LEFT JOIN pr ON pr.mock_id = a.mock_id AND pr.scale_idx = a.scale_idx AND pr.type_a = a.type AND pr.type_b = b.type WHERE a.type < b.type),
vv AS (SELECT *, saa / n - (sa / n) * (sa / n) AS va, sbb / n - (sb / n) * (sb / n) AS vb FROM pc),
rr AS (SELECT mock_id, type_a, type_b, scale_idx, vox, um, CASE WHEN va > 1e-20 AND vb > 1e-20 THEN (sab / n - (sa / n) * (sb / n)) / (sqrt(va) * sqrt(vb)) ELSE 0 END AS r FROM vv),
nm AS (SELECT type_a, type_b, scale_idx, avg(r) AS null_mean, stddev_pop(r) AS null_sd FROM rr WHERE mock_id >= 0 GROUP BY ALL),
co AS (SELECT rr.* EXCLUDE (mock_id), null_mean, null_sd, abs(r - null_mean) > 2 * null_sd AS significant FROM rr JOIN nm USING (type_a, type_b, scale_idx) WHERE mock_id < 0)"""


@query
def cooccurrence_curve(spark, sf):
    return rounded(_cooccurrence(orders(spark, sf)))


CO = "SELECT type_a, type_b, scale_idx, vox, round(um, 6) AS um, round(r, 6) + 0.0 AS r, round(null_mean, 6) + 0.0 AS null_mean, round(null_sd, 6) AS null_sd, significant FROM co"
SQL["cooccurrence_curve"] = f"{co_chain()} {CO}"


@query
def cooccurrence_listed(spark, sf):
    listed = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("type_a"), F.lit(b).alias("type_b")) for a, b in (("click", "error"), ("error", "view"), ("purchase", "view"), ("click", "view"))])).alias("p")).select("p.*")
    return rounded(_cooccurrence(events(spark, sf), listed))


SQL["cooccurrence_listed"] = f"{co_chain(EPTS)} {CO} WHERE (type_a, type_b) IN (('click', 'error'), ('error', 'view'), ('purchase', 'view'), ('click', 'view'))"


@query
def cooccurrence_summary(spark, sf):
    return rounded(an.cooccurrence_summary(_cooccurrence(orders(spark, sf))))


COS = """cf AS (SELECT type_a, type_b, arg_max(um, abs(r - null_mean) ORDER BY scale_idx) AS peak_scale_um, arg_max(r, abs(r - null_mean) ORDER BY scale_idx) AS peak_correlation, max(r) AS max_positive, min(r) AS max_negative,
  max(abs(r - null_mean) / CASE WHEN null_sd > 1e-10 THEN null_sd ELSE 1e-10 END) AS excess_over_null, count(*) FILTER (significant) AS n_significant FROM co GROUP BY ALL),
cl AS (SELECT *, lead(r) OVER w AS r2, lead(um) OVER w AS um2 FROM co WINDOW w AS (PARTITION BY type_a, type_b ORDER BY scale_idx)),
ci AS (SELECT type_a, type_b, coalesce(sum((r2 + r) / 2 * (log10(um2) - log10(um))), 0) AS integrated, arg_min(um, scale_idx) FILTER (r * r2 < 0) AS sign_change_um FROM cl GROUP BY ALL),
cs AS (SELECT * FROM cf JOIN ci USING (type_a, type_b))"""
SQL["cooccurrence_summary"] = f"{co_chain()}, {COS} SELECT type_a, type_b, round(peak_scale_um, 6) AS peak_scale_um, round(peak_correlation, 6) + 0.0 AS peak_correlation, round(max_positive, 6) + 0.0 AS max_positive, round(max_negative, 6) + 0.0 AS max_negative, round(excess_over_null, 6) AS excess_over_null, n_significant, round(integrated, 6) + 0.0 AS integrated, round(sign_change_um, 6) AS sign_change_um FROM cs"


@query
def cooccurrence_matrix(spark, sf):
    return rounded(an.matrix_entries(_cooccurrence(orders(spark, sf))))


MAT = "hf AS (SELECT type_a, type_b, arg_max(r, abs(r) ORDER BY scale_idx) AS value FROM co GROUP BY ALL), mt AS (SELECT * FROM hf UNION ALL SELECT type_b, type_a, value FROM hf), mx AS (SELECT * FROM mt UNION ALL SELECT DISTINCT type_a, type_a, 1.0 FROM mt)"
SQL["cooccurrence_matrix"] = f"{co_chain()}, {MAT} SELECT type_a, type_b, round(value, 6) + 0.0 AS value FROM mx"


@query
def cooccurrence_matrix_wide(spark, sf):
    return rounded(an.matrix(_cooccurrence(events(spark, sf)), 0, EVENT_TYPES))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
SQL["cooccurrence_matrix_wide"] = f"{co_chain(EPTS)}, hf AS (SELECT type_a, type_b, r AS value FROM co WHERE scale_idx = 0), mt AS (SELECT * FROM hf UNION ALL SELECT type_b, type_a, value FROM hf), mx AS (SELECT * FROM mt UNION ALL SELECT DISTINCT type_a, type_a, 1.0 FROM mt) SELECT type_a, {', '.join(f'max(round(value, 6) + 0.0) FILTER (type_b = {chr(39)}{t}{chr(39)}) AS {chr(34)}{t}{chr(34)}' for t in EVENT_TYPES)} FROM mx GROUP BY 1"


@query
def cooccurrence_band(spark, sf):
    return rounded(an.correlation_band(_cooccurrence(orders(spark, sf)), 3))


SQL["cooccurrence_band"] = f"{co_chain()}, fp AS (SELECT type_a, type_b FROM co GROUP BY ALL ORDER BY max(abs(r - null_mean) / CASE WHEN null_sd > 1e-10 THEN null_sd ELSE 1e-10 END) DESC, type_a, type_b LIMIT 3) SELECT type_a, type_b, scale_idx, round(um, 6) AS um, round(r, 6) + 0.0 AS r, round(null_mean - 2 * null_sd, 6) + 0.0 AS low, round(null_mean + 2 * null_sd, 6) + 0.0 AS high FROM co JOIN fp USING (type_a, type_b)"


@query
def heatmap_limit(spark, sf):
    return rounded(an.colour_limit(an.matrix_entries(_cooccurrence(orders(spark, sf)))))


SQL["heatmap_limit"] = f"{co_chain()}, {MAT} SELECT round(greatest(abs(min(value)), abs(max(value)), 0.1), 6) AS \"limit\" FROM mx WHERE type_a < type_b"


@query
def cooccurrence_sorted_top(spark, sf):
    s = an.cooccurrence_summary(_cooccurrence(events(spark, sf)))
    return rounded(prep.latest_first(s.select("type_a", "type_b", "peak_correlation"), "peak_correlation", ["type_a", "type_b"]).limit(5))


SQL["cooccurrence_sorted_top"] = f"{co_chain(EPTS)}, {COS} SELECT type_a, type_b, round(peak_correlation, 6) + 0.0 AS peak_correlation FROM cs ORDER BY abs(cs.peak_correlation) DESC, type_a, type_b LIMIT 5"


@query
def curated_pairs(spark, sf):
    return an.telling_pairs(an.cooccurrence_summary(_cooccurrence(orders(spark, sf))))


SQL["curated_pairs"] = f"""{co_chain()}, {COS}
(SELECT 'positive' AS role, type_a, type_b FROM cs ORDER BY max_positive DESC, type_a, type_b LIMIT 1) UNION ALL (SELECT 'negative', type_a, type_b FROM cs ORDER BY max_negative, type_a, type_b LIMIT 1)
UNION ALL (SELECT 'switcher', type_a, type_b FROM cs ORDER BY CASE WHEN sign_change_um IS NULL THEN 1 ELSE 0 END, CASE WHEN sign_change_um IS NULL THEN -excess_over_null ELSE -(max_positive - max_negative) END, type_a, type_b LIMIT 1)"""


@query
def layered_positive_share(spark, sf):
    rows = _cooccurrence(orders(spark, sf))
    listed = rows.select("type_a", "type_b").distinct().withColumn("group", F.when(F.col("type_a") < "3", "layered").otherwise("nuclear"))
    return rounded(an.positive_share(rows, listed))


SQL["layered_positive_share"] = f"{co_chain()} SELECT CASE WHEN type_a < '3' THEN 'layered' ELSE 'nuclear' END AS \"group\", scale_idx, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM co GROUP BY ALL"


# --- regions, density, hull ------------------------------------------------------------------------------------
# gift wrapping from the leftmost point; the start comes again as the last row
HULL = """h AS (SELECT 0 AS step, arg_min({'x': x, 'y': y}, {'x': x, 'y': y}) AS v, -1.0::DOUBLE AS ang FROM pts
  UNION ALL SELECT step + 1, v, ang FROM (SELECT any_value(step) AS step, arg_min({'x': x, 'y': y}, {'a': a, 'd': -dd}) AS v, min(a) AS ang FROM (
    SELECT step, x, y, ang, dd, CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END AS a FROM (SELECT h.step, p.x, p.y, h.ang, (p.x - h.v.x) ** 2 + (p.y - h.v.y) ** 2 AS dd, atan2(p.y - h.v.y, p.x - h.v.x) + pi() / 2 AS a FROM h, pts p WHERE p.x <> h.v.x OR p.y <> h.v.y)) WHERE a >= ang HAVING count(*) > 0)),
ed AS (SELECT step, v.x AS ax, v.y AS ay, lead(v.x) OVER (ORDER BY step) AS bx, lead(v.y) OVER (ORDER BY step) AS by_, max(step) OVER () AS last FROM h),
fa AS (SELECT e.step, o.ax AS ox_, o.ay AS oy_, e.ax, e.ay, e.bx, e.by_, abs((e.ax - o.ax) * (e.by_ - o.ay) - (e.ay - o.ay) * (e.bx - o.ax)) / 2 AS area FROM ed e, ed o WHERE o.step = 0 AND e.step > 0 AND e.step < e.last - 1),
tr_ AS (SELECT *, coalesce(sum(area) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(area) OVER () AS lo, CASE WHEN step = max(step) OVER () THEN 2.0 ELSE sum(area) OVER (ORDER BY step) / sum(area) OVER () END AS hi FROM fa)"""
U = lambda s: f"('0x' || substr(md5({s}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def csr_sql(n: str, mocks: int) -> str:
    """Uniform points in the hull, as ``nulls.uniform_in_hull`` draws them."""
    u = lambda k: U(f"'csr|' || mock_id || '|' || id || '|{k}'")
    return f"""{HULL}, cd AS (SELECT mock_id, id, {u('t')} AS u, sqrt({u('r')}) AS r, {u('s')} AS s FROM (SELECT unnest(range({mocks})) AS mock_id), (SELECT unnest(range({n})) AS id)),
csr AS (SELECT mock_id, id, ox_ + r * (ax - ox_ + s * (bx - ax)) AS x, oy_ + r * (ay - oy_ + s * (by_ - ay)) AS y FROM cd JOIN tr_ ON u >= lo AND u < hi)"""


@query
def hull_area(spark, sf):
    hull = nulls.convex_hull(orders(spark, sf))
    return spark.range(1).select(F.lit(len(hull)).cast("long").alias("n_vertices"), F.round(F.lit(nulls.hull_area(hull)), 2).alias("area"))


SQL["hull_area"] = f"WITH RECURSIVE {PTS}, {HULL} SELECT max(step) AS n_vertices, round(abs(sum(ax * by_ - bx * ay)) / 2, 2) AS area FROM ed"


@query
def csr_counts(spark, sf):
    p = orders(spark, sf)
    drawn = nulls.uniform_in_hull(spark, nulls.convex_hull(p), p.count(), UNIFORMS)
    return drawn.groupBy("mock_id").agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("mean_x"), F.round(F.avg("y"), 4).alias("mean_y"))


SQL["csr_counts"] = f"WITH RECURSIVE {PTS}, {csr_sql('(SELECT count(*) FROM pts)', UNIFORMS)} SELECT CAST(mock_id AS INTEGER) AS mock_id, count(*) AS n, round(avg(x), 4) AS mean_x, round(avg(y), 4) AS mean_y FROM csr GROUP BY 1"


@query
def csr_acceptance(spark, sf):
    return rounded(nulls.acceptance(spark, nulls.convex_hull(orders(spark, sf))))


SQL["csr_acceptance"] = f"""WITH RECURSIVE {PTS}, {HULL}, box AS (SELECT min(ax) AS lx, max(ax) - min(ax) AS wx, min(ay) AS ly, max(ay) - min(ay) AS wy FROM ed),
tr AS (SELECT id, lx + wx * {U("'csr|0|' || id || '|x'")} AS x, ly + wy * {U("'csr|0|' || id || '|y'")} AS y FROM (SELECT unnest(range(10000)) AS id), box),
hit AS (SELECT id, bool_and((bx - ax) * (y - ay) - (by_ - ay) * (x - ax) >= 0) AS good FROM tr, ed WHERE bx IS NOT NULL GROUP BY 1)
SELECT count(*) AS tried, count(*) FILTER (good) AS accepted, round(count(*) FILTER (good) / count(*), 6) AS rate FROM hit"""


@query
def regional_curve(spark, sf):
    p = orders(spark, sf)
    return rounded(an.regional(p, *setup(p), UNIFORMS))


def regional_sql(pts: str) -> str:
    return f"""WITH RECURSIVE {pts}, {roi_sql()}, {csr_sql('(SELECT count(*) FROM pts)', UNIFORMS)}, ev AS (SELECT mock_id, x, y FROM csr UNION ALL SELECT -1, x, y FROM pts),
{pix_sql('ev', 'mock_id')}, {bin_sql('mock_id')}, {cur_sql('mock_id')}, nu AS (SELECT scale_idx, avg(vmr) AS null_mean, stddev_pop(vmr) AS null_sd FROM cur WHERE mock_id >= 0 GROUP BY 1),
rc AS (SELECT cur.*, null_mean, null_sd, CASE WHEN null_mean > 0 THEN vmr / null_mean ELSE 1 END AS ratio FROM cur JOIN nu USING (scale_idx) WHERE mock_id < 0)"""


SQL["regional_curve"] = f"{regional_sql(PTS)} SELECT scale_idx, vox, round(um, 6) AS um, n_points, round(vmr, 6) AS vmr, round(skewness, 6) + 0.0 AS skewness, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, round(ratio, 6) AS ratio FROM rc"


ORDER_TYPES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query
def regional_comparison(spark, sf):
    p = orders(spark, sf)
    regions = {t: p.where(F.col("type") == t) for t in ORDER_TYPES}
    return rounded(an.regional_comparison(regions, GRID, list(VOX), UNIFORMS))


SQL["regional_comparison"] = " UNION ALL ".join(f"SELECT '{t}' AS region, * FROM ({regional_sql(PTS[:-1] + f' AND o_orderpriority = {chr(39)}{t}{chr(39)})')} SELECT n_points AS n_cells, scale_idx, round(um, 6) AS um, round(vmr, 6) AS vmr, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, round(ratio, 6) AS ratio, round(greatest(1 - 2 * null_sd / null_mean, 0), 6) AS low, round(1 + 2 * null_sd / null_mean, 6) AS high FROM rc)" for t in ORDER_TYPES)


@query
def point_set_test(spark, sf):
    """One type's points against uniform points in their hull, as a test of given point sets."""
    p = orders(spark, sf)
    urgent = p.where("type = '1-URGENT'")
    roi, sc = setup(p)
    return rounded(an.points_against(urgent, nulls.uniform_in_hull(spark, nulls.convex_hull(urgent), urgent.count(), 30), roi, sc).drop("condition_number", "dof_f1", "dof_f2"), 5)


SQL["point_set_test"] = f"""WITH RECURSIVE every AS ({PTS[len('pts AS ('):-1]}), roi AS ({roi_sql()[len('roi AS ('):-1].replace('FROM pts', 'FROM every')}), pts AS (SELECT * FROM every WHERE type = '1-URGENT'), {csr_sql('(SELECT count(*) FROM pts)', 30)},
ev AS (SELECT mock_id, x, y FROM csr UNION ALL SELECT -1, x, y FROM pts), {pix_sql('ev', 'mock_id')}, {bin_sql('mock_id')}, {cur_sql('mock_id')}, one AS (SELECT 'points' AS set_, * FROM cur), {hot_sql('set_', 'one')} SELECT {HOT} FROM hf"""


@query
def kde_bandwidth(spark, sf):
    return rounded(nulls.bandwidth(events(spark, sf)))


SQL["kde_bandwidth"] = f"WITH {EPTS}, s AS (SELECT count(*) AS n, (stddev_pop(x) + stddev_pop(y)) / 2 AS sd FROM pts) SELECT n, round(sd * pow(n * 4 / 4.0::DOUBLE, -1.0::DOUBLE / 6), 6) AS bandwidth FROM s"


@query
def kde_sample(spark, sf):
    e = events(spark, sf)
    drawn = nulls.smoothed_bootstrap(e, e.count(), UNIFORMS)
    return drawn.groupBy("mock_id").agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("mean_x"), F.round(F.stddev_pop("x"), 4).alias("sd_x"))


SQL["kde_sample"] = f"""WITH {EPTS}, ba AS (SELECT id, x, y, row_number() OVER (ORDER BY md5('kde|' || id), id) AS k FROM pts),
bw AS (SELECT count(*) AS n, (stddev_pop(x) + stddev_pop(y)) / 2 * pow(count(*) * 4 / 4.0::DOUBLE, -1.0::DOUBLE / 6) AS w FROM ba),
dw AS (SELECT mock_id, i, CAST(floor({U("'kde|' || mock_id || '|' || i || '|pick'")} * n) AS BIGINT) + 1 AS k, w, sqrt(-2 * ln(1 - {U("'kde|' || mock_id || '|' || i || '|x|u'")})) * cos(6.283185307179586::DOUBLE * {U("'kde|' || mock_id || '|' || i || '|x|v'")}) AS z FROM (SELECT unnest(range({UNIFORMS})) AS mock_id), (SELECT unnest(range((SELECT count(*) FROM pts))) AS i), bw)
SELECT CAST(mock_id AS INTEGER) AS mock_id, count(*) AS n, round(avg(x + w * z), 4) AS mean_x, round(stddev_pop(x + w * z), 4) AS sd_x FROM dw JOIN ba USING (k) GROUP BY 1"""


@query
def subsample(spark, sf):
    return nulls.first_by_chance(orders(spark, sf), 500).select("id", "type")


SQL["subsample"] = f"WITH {PTS} SELECT id, type FROM pts ORDER BY md5('sub|' || id), id LIMIT 500"


@query
def boundary_crop(spark, sf):
    p = orders(spark, sf)
    roi, _ = setup(p)
    return rounded(grid.curves_of(an.cropped(p, roi), *setup(p), ["type"]).select("type", "scale_idx", "n_points", "vmr"))


SQL["boundary_crop"] = f"WITH {PTS}, {roi_sql()}, crop AS (SELECT pts.* FROM pts, roi WHERE x >= ox + 0.05::DOUBLE * sx AND x <= ox + (1 - 0.05::DOUBLE) * sx AND y >= oy + 0.05::DOUBLE * sy AND y <= oy + (1 - 0.05::DOUBLE) * sy), {pix_sql('crop', 'type')}, {bin_sql('type')}, {cur_sql('type')} SELECT type, scale_idx, n_points, round(vmr, 6) AS vmr FROM cur"


# --- mediation -------------------------------------------------------------------------------------------------
def _mediated(spark, sf) -> DataFrame:
    p = orders(spark, sf, "stratum")
    roi, sc = setup(p)
    return an.null_kinds(p, roi, sc, {"overall": None, "within": "stratum"}, MOCKS, LEAST)


MEDIATED = f"{kinds_chain(SPTS, {'overall': '', 'within': 'stratum'})}, {meas_sql('null_kind, type')}, {hot_sql('null_kind, type')}, mm AS (SELECT * FROM me JOIN hf USING (null_kind, type)), md AS (SELECT type, CAST(max(n_cells) AS BIGINT) AS n_cells, " + ", ".join(f"max({c}) FILTER (null_kind = '{k}') AS {c}_{k}" for k in ("overall", "within") for c in ("chi_squared", "p_value", "peak_vmr_ratio", "integrated_excess", "n_mocks_used")) + " FROM mm GROUP BY 1), mp AS (SELECT *, CASE WHEN chi_squared_overall > 0 THEN 100 * (1 - chi_squared_within / chi_squared_overall) ELSE 0 END AS mediation_pct FROM md)"


@query
def mediation(spark, sf):
    return rounded(an.mediation(_mediated(spark, sf)), 4)


FOUR = lambda *cols: ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in cols)
SQL["mediation"] = f"{MEDIATED} SELECT type, n_cells, n_mocks_used_overall, n_mocks_used_within, {FOUR(*[f'{c}_{k}' for k in ('overall', 'within') for c in ('chi_squared', 'p_value', 'peak_vmr_ratio', 'integrated_excess')], 'mediation_pct')} FROM mp"


@query
def mediation_summary(spark, sf):
    return rounded(an.summary_of(an.mediation(_mediated(spark, sf)), "mediation_pct"), 4)


SQL["mediation_summary"] = f"{MEDIATED}, v AS (SELECT count(mediation_pct) AS n, avg(mediation_pct) AS mean, quantile_cont(mediation_pct, 0.5) AS median, min(mediation_pct) AS low, max(mediation_pct) AS high FROM mp) SELECT n, {FOUR('mean', 'median', 'low', 'high')} FROM v"


@query
def mediation_bootstrap(spark, sf):
    return rounded(an.mediation_bootstrap(_mediated(spark, sf), BOOTS), 4)


SQL["mediation_bootstrap"] = f"""{MEDIATED}, us AS (SELECT null_kind, type, mock_id, row_number() OVER (PARTITION BY null_kind, type ORDER BY mock_id) AS k, count(*) OVER (PARTITION BY null_kind, type) AS n FROM (SELECT DISTINCT null_kind, type, mock_id FROM ok WHERE mock_id >= 0)),
pi_ AS (SELECT null_kind, type, boot, slot, CAST(floor({U("'boot|' || null_kind || '|' || type || '|' || boot || '|' || slot")} * n) AS BIGINT) + 1 AS k FROM (SELECT DISTINCT null_kind, type, n FROM us), (SELECT unnest(range({BOOTS})) AS boot), LATERAL (SELECT unnest(range(n)) AS slot)),
bo AS (SELECT null_kind, type, boot, slot AS mock_id, scale_idx, vmr FROM pi_ JOIN us USING (null_kind, type, k) JOIN ok USING (null_kind, type, mock_id) UNION ALL SELECT null_kind, type, b, -1, scale_idx, vmr FROM ok, (SELECT unnest(range({BOOTS})) AS b) WHERE mock_id < 0),
{hot_sql('null_kind, type, boot', 'bo', 'b', 2)}, vb AS (SELECT type, boot, max(chi_squared) FILTER (null_kind = 'overall') AS o, max(chi_squared) FILTER (null_kind = 'within') AS w FROM htb GROUP BY ALL),
cb AS (SELECT type, count(*) AS n_valid, quantile_cont(100 * (1 - w / o), 0.025) AS lo, quantile_cont(100 * (1 - w / o), 0.975) AS hi FROM vb WHERE o > 0 GROUP BY 1)
SELECT type, round(mediation_pct, 4) + 0.0 AS mediation_pct, CASE WHEN n_valid >= 50 THEN round(lo, 4) + 0.0 END AS ci_low, CASE WHEN n_valid >= 50 THEN round(hi, 4) + 0.0 END AS ci_high, n_valid FROM mp JOIN cb USING (type)"""


@query
def depth_mediation(spark, sf):
    p = orders(spark, sf, "stratum", "z")
    roi, sc = setup(p)
    return rounded(an.depth_mediation(p, roi, sc, MOCKS, LEAST), 4)


DPTS = SPTS.replace("pts AS", "deep AS", 1) + ", qe AS (SELECT stratum, list_sort(list_distinct(quantile_cont(z, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS q FROM deep GROUP BY 1), pts AS (SELECT deep.*, stratum || '_d' || CASE WHEN len(q) < 2 THEN 0 ELSE len(list_filter(q[2:len(q)-1], lambda v: v < z)) END AS both_ FROM deep JOIN qe USING (stratum))"
SQL["depth_mediation"] = f"""{kinds_chain(DPTS, {'overall': '', 'stratum': 'stratum', 'compound': 'both_'})}, {hot_sql('null_kind, type', least=10)}, nc AS (SELECT type, CAST(max(n) AS BIGINT) AS n_cells FROM ok WHERE mock_id < 0 GROUP BY 1),
dm AS (SELECT type, max(chi_squared) FILTER (null_kind = 'overall') AS chi2_overall, max(chi_squared) FILTER (null_kind = 'stratum') AS chi2_stratum, max(chi_squared) FILTER (null_kind = 'compound') AS chi2_compound FROM ht GROUP BY 1),
dp AS (SELECT *, 100 * (1 - chi2_stratum / chi2_overall) AS mediation_stratum, 100 * (1 - chi2_compound / chi2_overall) AS mediation_compound FROM dm JOIN nc USING (type)),
di AS (SELECT *, mediation_compound - mediation_stratum AS depth_increment FROM dp) SELECT type, n_cells, {FOUR('chi2_overall', 'chi2_stratum', 'chi2_compound', 'mediation_stratum', 'mediation_compound', 'depth_increment')} FROM di"""


# --- dimensions, Ripley ----------------------------------------------------------------------------------------
def _dimensions(spark, sf) -> DataFrame:
    p = vectors(spark, sf)
    (r2, s2), (r3, s3) = setup(p), setup(p, 3, GRID_3D, VOX_3D)
    return an.peak_ratios_by_dims(p, r2, s2, r3, s3, MOCKS, 20)


@query
def peak_ratio_2d_3d(spark, sf):
    return rounded(_dimensions(spark, sf))


DIMS = f"""WITH {VPTS}, {roi_sql(3)}, {freq_sql(20)}, {lab_sql(cols='x, y, z')}, {FLAB},
{pix_sql('flab', 'mock_id, type', 2, GRID, 'pix2')}, {bin_sql('mock_id, type', 2, GRID, VOX, 'pix2', '2')}, {cur_sql('mock_id, type', '2', 'cur2')},
{pix_sql('flab', 'mock_id, type', 3, GRID_3D, 'pix3')}, {bin_sql('mock_id, type', 3, GRID_3D, VOX_3D, 'pix3', '3')}, {cur_sql('mock_id, type', '3', 'cur3')},
n2 AS (SELECT type, scale_idx, avg(vmr) AS m FROM cur2 WHERE mock_id >= 0 GROUP BY ALL), n3 AS (SELECT type, scale_idx, avg(vmr) AS m FROM cur3 WHERE mock_id >= 0 GROUP BY ALL),
p2 AS (SELECT type, max(CASE WHEN m > 0 THEN vmr / m ELSE 1 END) AS peak_2d FROM cur2 JOIN n2 USING (type, scale_idx) WHERE mock_id < 0 GROUP BY 1), p3 AS (SELECT type, max(CASE WHEN m > 0 THEN vmr / m ELSE 1 END) AS peak_3d FROM cur3 JOIN n3 USING (type, scale_idx) WHERE mock_id < 0 GROUP BY 1),
pr AS (SELECT type, peak_2d, peak_3d, CASE WHEN peak_2d > 0 THEN peak_3d / peak_2d ELSE 1 END AS ratio_change FROM p2 JOIN p3 USING (type))"""
SQL["peak_ratio_2d_3d"] = f"{DIMS} SELECT type, round(peak_2d, 6) AS peak_2d, round(peak_3d, 6) AS peak_3d, round(ratio_change, 6) AS ratio_change FROM pr"


@query
def dimension_summary(spark, sf):
    return rounded(an.dimension_summary(_dimensions(spark, sf)))


SQL["dimension_summary"] = f"{DIMS} SELECT count(ratio_change) AS n_types, round(avg(ratio_change), 6) AS mean_change, round(quantile_cont(ratio_change, 0.5), 6) AS median_change, count(*) FILTER (abs(ratio_change - 1) > 0.2) AS n_changed FROM pr"

RADII = (0.02, 0.05, 0.1, 0.2)


@query
def ripley_k(spark, sf):
    return rounded(an.ripley(vectors(spark, sf), list(RADII), 1.0, ["type"]).select("type", "radius", "n", "pairs", "k"))


RIP = f"""nn AS (SELECT type, count(*) AS n FROM pts GROUP BY 1 HAVING count(*) >= 10), rd AS (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in RADII)}]) AS radius),
dd AS (SELECT a.type, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM pts a JOIN pts b ON a.type = b.type AND a.id < b.id),
ct AS (SELECT type, radius, count(*) AS pairs FROM dd, rd WHERE d2 <= radius * radius GROUP BY ALL),
kk AS (SELECT type, radius, n, coalesce(pairs, 0) AS pairs, 2.0::DOUBLE * coalesce(pairs, 0) / (n::DOUBLE * (n - 1)) AS k FROM nn JOIN rd ON true LEFT JOIN ct USING (type, radius))"""
SQL["ripley_k"] = f"WITH {VPTS}, {RIP} SELECT type, radius, n, pairs, round(k, 6) AS k FROM kk"


@query
def pair_counts_by_cells(spark, sf):
    """The pairs behind ``ripley_k`` by the tree of cells, however few points there are."""
    p = vectors(spark, sf)
    least = p.groupBy("type").count().where("count >= 10").select("type")
    return pairs.pair_counts(p.join(least, "type", "left_semi"), list(RADII), ["type"], leaf=4, flat=0)


SQL["pair_counts_by_cells"] = f"WITH {VPTS}, {RIP} SELECT type, radius, pairs FROM kk"


@query
def besag_l(spark, sf):
    return rounded(an.ripley(vectors(spark, sf), list(RADII), 1.0, ["type"]).select("type", "radius", "l"))


SQL["besag_l"] = f"WITH {VPTS}, {RIP} SELECT type, radius, round(sqrt(k / 3.141592653589793) - radius, 6) + 0.0 AS l FROM kk"


@query
def ripley_null_band(spark, sf):
    return rounded(an.ripley_band(vectors(spark, sf), list(RADII), 1.0, UNIFORMS))


def band_sql(area: str = "1.0::DOUBLE") -> str:
    """L of real points and of uniform ones in their boxes (ll), and the band of the latter (bb)."""
    box = lambda a: f"l{a} + (h{a} - l{a}) * {U(f'{chr(39)}box|{chr(39)} || m || {chr(39)}|{chr(39)} || id || {chr(39)}|{a}{chr(39)}')}"
    return f"""nn AS (SELECT type, count(*) AS n, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM pts GROUP BY 1 HAVING count(*) >= 10), rd AS (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in RADII)}]) AS radius),
al AS (SELECT type, -1 AS mock_id, id, x, y FROM pts UNION ALL SELECT type, m, id, {box('x')}, {box('y')} FROM pts JOIN nn USING (type), (SELECT unnest(range({UNIFORMS})) AS m)),
dd AS (SELECT a.type, a.mock_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM al a JOIN al b ON a.type = b.type AND a.mock_id = b.mock_id AND a.id < b.id),
ct AS (SELECT type, mock_id, radius, count(*) AS pairs FROM dd, rd WHERE d2 <= radius * radius GROUP BY ALL),
kk AS (SELECT type, mock_id, radius, n, {area} * 2.0::DOUBLE * coalesce(pairs, 0) / (n::DOUBLE * (n - 1)) AS k FROM nn JOIN rd ON true JOIN (SELECT unnest(range(-1, {UNIFORMS})) AS mock_id) ON true LEFT JOIN ct USING (type, mock_id, radius)),
ll AS (SELECT *, sqrt(k / 3.141592653589793) - radius AS l FROM kk),
bb AS (SELECT type, radius, quantile_cont(l, 0.025) AS lo, quantile_cont(l, 0.975) AS hi, avg(k) AS km FROM ll WHERE mock_id >= 0 GROUP BY ALL)"""


SQL["ripley_null_band"] = f"WITH {VPTS}, {band_sql()} SELECT type, radius, n, round(k, 6) AS k, round(l, 6) + 0.0 AS l, round(lo, 6) + 0.0 AS l_low, round(hi, 6) + 0.0 AS l_high, round(km, 6) AS k_null_mean FROM ll JOIN bb USING (type, radius) WHERE mock_id < 0"


R2P = """CASE WHEN rho IS NULL THEN NULL WHEN abs(rho) >= 1 THEN 0 ELSE round((SELECT exp(fa * ln(fx) + 0.5::DOUBLE * ln(1 - fx) - ln(fa) - (lgamma(fa) + lgamma(0.5::DOUBLE) - lgamma(fa + 0.5::DOUBLE))) * list_sum(list_transform(range(0, 10000), lambda k: exp(k * ln(fx) + lgamma(fa + 0.5::DOUBLE + k) - lgamma(fa + 0.5::DOUBLE) + lgamma(fa + 1) - lgamma(fa + 1 + k)))) FROM (SELECT (n - 2) / 2.0::DOUBLE AS fa, 1 - rho * rho AS fx)), 6) + 0.0 END AS p_value"""  # df / (df + t^2) is 1 - rho^2


def r2p_sql() -> str:
    """p_value of a column rho over n rows: df / (df + t^2) is 1 - rho^2; the series goes in that or, where it is near 1, in rho^2 for the rest to 1, as either comes to an end soon only well below 1."""
    tail = lambda a, b, x: f"exp({a} * ln({x}) + {b} * ln(1 - {x}) - ln({a}) - (lgamma({a}) + lgamma({b}) - lgamma(fa + 0.5::DOUBLE))) * list_sum(list_transform(range(0, 10000), lambda k: exp(k * ln({x}) + lgamma(fa + 0.5::DOUBLE + k) - lgamma(fa + 0.5::DOUBLE) + lgamma({a} + 1) - lgamma({a} + 1 + k))))"
    one, rest = tail("fa", "0.5::DOUBLE", "fx"), tail("0.5::DOUBLE", "fa", "fr")
    return f"CASE WHEN rho IS NULL THEN NULL WHEN abs(rho) >= 1 THEN 0 WHEN rho = 0 THEN 1 ELSE round((SELECT CASE WHEN fr < 0.5 THEN 1 - {rest} ELSE {one} END FROM (SELECT (n - 2) / 2.0::DOUBLE AS fa, 1 - rho * rho AS fx, rho * rho AS fr)), 6) + 0.0 END AS p_value"


@query
def spearman_peaks(spark, sf):
    n = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("a"), F.round(F.avg("c_acctbal"), -3).alias("b"))
    return rounded(stats.spearman(n, "a", "b"))


SQL["spearman_peaks"] = f"WITH t AS (SELECT c_nationkey, count(*) AS a, round(avg(c_acctbal), -3) AS b FROM customer GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM t) SELECT n, round(rho, 6) + 0.0 AS rho, {r2p_sql()} FROM (SELECT count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS rho FROM r)"


def _peaks(spark, sf) -> tuple[DataFrame, DataFrame]:
    p = vectors(spark, sf)
    roi, sc = setup(p)
    return an.against_null(an.labelled_curves(p.drop("z"), roi, sc, MOCKS, 20), ["type"]), an.ripley_band(p, list(RADII), roi.area, UNIFORMS)


@query
def vmr_vs_l_peaks(spark, sf):
    return rounded(an.peak_scales(*_peaks(spark, sf)))


PEAKS = f"""{null_chain(VPTS, least=20)}, {band_sql('(SELECT sx * sy FROM roi)')}, lp AS (SELECT type, CASE WHEN max(l - hi) > 0 THEN arg_max(radius, l - hi ORDER BY radius) END AS l_peak_um FROM ll JOIN bb USING (type, radius) WHERE mock_id < 0 GROUP BY 1),
vp AS (SELECT type, CASE WHEN max(vmr - null_mean) > 0 THEN arg_max(um, vmr - null_mean ORDER BY scale_idx) END AS vmr_peak_um FROM vs GROUP BY 1), pp AS (SELECT * FROM vp JOIN lp USING (type))"""
SQL["vmr_vs_l_peaks"] = f"{PEAKS} SELECT type, round(vmr_peak_um, 6) AS vmr_peak_um, l_peak_um FROM pp"


@query
def peak_agreement(spark, sf):
    return rounded(an.peak_agreement(*_peaks(spark, sf)))


SQL["peak_agreement"] = f"{PEAKS}, t AS (SELECT vmr_peak_um AS a, l_peak_um AS b FROM pp WHERE vmr_peak_um IS NOT NULL AND l_peak_um IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM t) SELECT n, round(rho, 6) + 0.0 AS rho, {R2P} FROM (SELECT count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS rho FROM r)"


# --- jitter, top lists, histograms -----------------------------------------------------------------------------
def _jittered(spark, sf) -> DataFrame:
    p = orders(spark, sf)
    roi, sc = setup(p)
    return an.jittered(p, roi, sc, TRIALS, MOCKS, LEAST)


@query
def jitter_cv(spark, sf):
    return rounded(an.jitter_spread(_jittered(spark, sf)), 4)


def _off(t: str, a: str) -> str:
    u = U(f"'jitter|' || {t} || '|{a}'")
    return f"2 * greatest(sx, sy) / {GRID} * (2 * ({u}) - 1)"


JITTER = f"""WITH {PTS}, {roi_sql()}, {FREQ}, {lab_sql(TRIALS * MOCKS, salt='trial')},
tr AS (SELECT mock_id // {MOCKS} AS trial, mock_id % {MOCKS} AS mock_id, id, x, y, type FROM lab WHERE mock_id >= 0 UNION ALL SELECT t, -1, id, x, y, type FROM pts, (SELECT unnest(range({TRIALS})) AS t)),
of_ AS (SELECT t AS trial, {_off('t', 'x')} AS dx, {_off('t', 'y')} AS dy FROM (SELECT unnest(range({TRIALS})) AS t), roi),
mv AS (SELECT trial, mock_id, type, x - dx AS x, y - dy AS y FROM tr JOIN freq USING (type) JOIN of_ USING (trial)),
{pix_sql('mv', 'trial, mock_id, type')}, {bin_sql('trial, mock_id, type')}, {cur_sql('trial, mock_id, type')},
nul AS (SELECT trial, type, scale_idx, avg(vmr) AS m FROM cur WHERE mock_id >= 0 GROUP BY ALL),
vs AS (SELECT cur.*, CASE WHEN m > 0 THEN vmr / m ELSE 1 END AS ratio FROM cur JOIN nul USING (trial, type, scale_idx) WHERE mock_id < 0),
tz AS (SELECT trial, type, (lead(ratio - 1) OVER w + ratio - 1) / 2 * (log10(lead(um) OVER w) - log10(um)) AS a FROM vs WINDOW w AS (PARTITION BY trial, type ORDER BY scale_idx)),
ex AS (SELECT trial, type, sum(a) AS e FROM tz GROUP BY ALL)"""
SQL["jitter_cv"] = f"{JITTER} SELECT type, count(*) AS n_trials, round(avg(e), 4) + 0.0 AS mean_excess, round(CASE WHEN avg(e) > 0 THEN stddev_pop(e) / avg(e) ELSE 0 END, 4) AS cv FROM ex GROUP BY 1 HAVING count(*) = {TRIALS}"


@query
def jitter_ranking(spark, sf):
    rows = _jittered(spark, sf)
    return rounded(an.ranks_by_mean(rows.groupBy("trial", "type").agg(F.max("ratio").alias("peak")), "peak", 3), 4)


SQL["jitter_ranking"] = f"{JITTER}, pk AS (SELECT trial, type, max(ratio) AS peak FROM vs GROUP BY ALL) SELECT type, round(avg(peak), 4) AS mean_score FROM pk GROUP BY 1 ORDER BY avg(peak) DESC, type LIMIT 3"


@query
def top_k_other(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_type").alias("type"))
    return prep.top_k_or_other(p, 3).groupBy("category").agg(F.count("*").alias("n"))


SQL["top_k_other"] = "WITH t AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3) SELECT coalesce(t.p_type, 'Other') AS category, count(*) AS n FROM part LEFT JOIN t USING (p_type) GROUP BY 1"


@query
def top_effect_union(spark, sf):
    o = an.measures(an.against_null(_labelled(spark, sf), ["type"]), ["type"])
    e = events(spark, sf)
    ev = an.measures(an.against_null(an.labelled_curves(e, *setup(e), MOCKS, LEAST), ["type"]), ["type"])
    return rounded(an.region_top({"orders": o, "events": ev}, "peak_vmr_ratio", 6))


SQL["top_effect_union"] = f"""WITH o AS ({null_chain()} SELECT type, max(ratio) AS value FROM vs GROUP BY 1), e AS ({null_chain(EPTS)} SELECT type, max(ratio) AS value FROM vs GROUP BY 1), u AS (SELECT 'orders' AS region, * FROM o UNION ALL SELECT 'events', * FROM e)
SELECT region, type, round(value, 6) AS value, type || ' (' || substr(region, 1, 4) || ')' AS label FROM u ORDER BY u.value DESC, region, type LIMIT 6"""


@query
def universal_types(spark, sf):
    o = read(spark, sf, "orders")
    return an.universal_types({s: o.where(F.col("o_orderstatus") == s).select(F.col("o_orderpriority").alias("type")) for s in ("F", "O", "P")})


SQL["universal_types"] = "SELECT o_orderpriority AS type FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'P'"


@query
def pvalue_histogram(spark, sf):
    return rounded(stats.p_histogram(stats.joint_test(_labelled(spark, sf), ["type"])))


SQL["pvalue_histogram"] = f"{null_chain()}, {hot_sql()}, pb AS (SELECT CAST(least(floor(p_value * 20), 19) AS INTEGER) AS b, count(*) AS n FROM hf GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, i / 20.0::DOUBLE AS low, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER () AS BIGINT) AS n_all, round(CAST(sum(coalesce(n, 0)) OVER () AS DOUBLE) * 0.05::DOUBLE, 6) AS expected FROM (SELECT unnest(range(20)) AS i) LEFT JOIN pb ON b = i"


@query
def native_sensitivity(spark, sf):
    found = an.measures(an.against_null(_labelled(spark, sf), ["type"]), ["type"]).withColumn("region", F.lit("orders"))
    native = spark.range(1).select(F.lit("orders").alias("region"), F.explode(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("type"))
    return rounded(an.native_partition(found, native).select("region", "type", "integrated_excess", "is_native"))


SQL["native_sensitivity"] = f"{null_chain()}, {MEAS} SELECT 'orders' AS region, type, round(integrated_excess, 6) + 0.0 AS integrated_excess, type IN ('1-URGENT', '2-HIGH') AS is_native FROM me"


@query
def threshold_sweep(spark, sf):
    n = prep.frequent_types(read(spark, sf, "part").select(F.col("p_brand").alias("type")), 1)
    return n.withColumn("least", F.explode(F.array(*[F.lit(v) for v in (10, 50, 80, 90, 100)]))).groupBy("least").agg(F.count_if(F.col("n_cells") >= F.col("least")).alias("n_types"))


SQL["threshold_sweep"] = "WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT CAST(least AS INTEGER) AS least, count(*) FILTER (n >= least) AS n_types FROM n, (SELECT unnest([10, 50, 80, 90, 100]) AS least) GROUP BY 1"


@query
def default_scales(spark, sf):
    """The scales of the customers' own box."""
    c = read(spark, sf, "customer").select(F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y")).dropna()
    sc = Scales.default(grid.roi_of(c, GRID).extent, GRID)
    return rounded(spark.createDataFrame(list(zip(sc.vox, sc.um, strict=True)), "vox int, um double"))


SQL["default_scales"] = f"""WITH pts AS (SELECT c_acctbal AS x, c_custkey::DOUBLE AS y FROM customer WHERE c_acctbal IS NOT NULL AND c_custkey IS NOT NULL), {roi_sql()}, e AS (SELECT greatest(sx, sy) AS extent, greatest(sx, sy) / {GRID} AS px FROM roi),
s AS (SELECT i, px, pow(10::DOUBLE, 1 + i * (log10(least(1000.0::DOUBLE, 0.4::DOUBLE * extent)) - 1) / 47) AS um FROM e, (SELECT unnest(range(48)) AS i)),
v AS (SELECT min(i) AS i, px, greatest(2, CAST(round_even(um / px, 0) AS INTEGER)) AS vox FROM s WHERE um >= 1.8::DOUBLE * px GROUP BY ALL), k AS (SELECT vox, px, row_number() OVER (ORDER BY i) - 1 AS place, count(*) OVER () AS n FROM v WHERE vox <= {GRID // 2}),
p AS (SELECT DISTINCT CASE WHEN n <= 12 THEN j ELSE CAST(round_even(j * (n - 1) / 11.0::DOUBLE, 0) AS INTEGER) END AS place FROM (SELECT unnest(range(12)) AS j), (SELECT max(n) AS n FROM k)) SELECT CAST(vox AS INTEGER) AS vox, round(vox * px, 6) AS um FROM k JOIN p USING (place)"""


# --- round trips -----------------------------------------------------------------------------------------------
@query
def parquet_roundtrip(spark, sf):
    from .sources import tables

    path = fresh_path(spark, "parquet")
    tables.write_region(read(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_label"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"), F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("other")), path)
    return tables.read_region(spark, path)


SQL["parquet_roundtrip"] = "SELECT o_orderkey AS cell_label, o_totalprice AS x, o_custkey::DOUBLE AS y, o_orderpriority AS class FROM orders"


@query
def csv_roundtrip(spark, sf):
    from .sources import reports, tables

    path = fresh_path(spark, "csv")
    reports.write_csv(read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("cell_label"), F.lit("1").alias("brain_section_label"), F.col("o_totalprice").alias("x"), F.col("o_orderpriority").alias("class")), path)
    return tables.read_csv(spark, path, tables.CELLS)


SQL["csv_roundtrip"] = "SELECT CAST(o_orderkey AS VARCHAR) AS cell_label, '1' AS brain_section_label, o_totalprice AS x, o_orderpriority AS class FROM orders"


@query
def matrix_roundtrip(spark, sf):
    from .sources import tables

    path = fresh_path(spark, "matrix")
    wide = read(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey").cast("double"))
    tables.write_matrix(wide, path)
    return tables.read_matrix(spark, path)


SQL["matrix_roundtrip"] = "SELECT o_orderpriority AS row, o_orderstatus AS \"column\", count(*)::DOUBLE AS value FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY ALL"


@query
def json_roundtrip(spark, sf):
    from .sources import reports

    path = fresh_path(spark, "json")
    rows = an.against_null(_labelled(spark, sf), ["type"])
    arrays = rows.groupBy("type").agg(F.max("n").alias("n_cells"), cv.array_of("vmr").alias("vmr_curve"), cv.array_of("um").alias("scales_um"))
    reports.write_document(arrays, path, "type")
    back = reports.read_fingerprints(spark, path)
    return rounded(back.select("type", "n_cells", F.explode(F.arrays_zip("vmr_curve", "scales_um")).alias("s"), F.size("skewness_curve").cast("long").alias("n_skew"), "n_mocks_used").select("type", "n_cells", "s.vmr_curve", "s.scales_um", "n_skew", "n_mocks_used"))


SQL["json_roundtrip"] = f"{null_chain()} SELECT type, CAST(n AS BIGINT) AS n_cells, round(vmr, 6) AS vmr_curve, round(um, 6) AS scales_um, 0::BIGINT AS n_skew, 0::BIGINT AS n_mocks_used FROM vs"


@query
def pairs_json_roundtrip(spark, sf):
    from .sources import reports

    path = fresh_path(spark, "pairs")
    rows = _cooccurrence(orders(spark, sf))
    arrays = rows.groupBy("type_a", "type_b").agg(cv.array_of("r").alias("correlation_curve"), F.max_by("um", F.struct(F.abs(F.col("r") - F.col("null_mean")), -F.col("scale_idx"))).alias("peak_scale_um"))
    reports.write_document(reports.pair_records(arrays).drop("type_a", "type_b"), path, "key")
    return rounded(reports.read_pairs(spark, path).select("type_a", "type_b", "peak_scale_um", F.explode("correlation_curve").alias("r")))


SQL["pairs_json_roundtrip"] = f"{co_chain()}, pk AS (SELECT type_a, type_b, arg_max(um, abs(r - null_mean) ORDER BY scale_idx) AS peak_scale_um FROM co GROUP BY ALL) SELECT type_a, type_b, round(peak_scale_um, 6) AS peak_scale_um, round(r, 6) + 0.0 AS r FROM co JOIN pk USING (type_a, type_b)"


@query
def fingerprints_json(spark, sf):
    """Fingerprint records written a line each, and read again."""
    from .sources import reports

    path = fresh_path(spark, "fingerprints")
    reports.write_json(reports.fingerprint_records(_fingerprints(spark, sf).withColumn("other", F.lit(1))), path)
    back = spark.read.schema("type string, n_cells long, vmr_curve array<double>, p_value double, peak_vmr_ratio double, direction string, is_significant boolean, other int").json(path)
    return rounded(back.select("type", "n_cells", F.explode("vmr_curve").alias("vmr"), "peak_vmr_ratio", "p_value", "direction", "is_significant", "other"), 5)


SQL["fingerprints_json"] = f"{null_chain()}, {MEAS}, {hot_sql()} SELECT type, CAST(n_cells AS BIGINT) AS n_cells, {FIVE('vmr', 'peak_vmr_ratio', 'p_value')}, direction, p_value < 0.05 AS is_significant, CAST(NULL AS INTEGER) AS other FROM vs JOIN me USING (type) JOIN hf USING (type)"


@query
def completed_records(spark, sf):
    """Records as an older writer left them, curves and statistics alone, read again with all measures."""
    from .sources import reports

    path = fresh_path(spark, "older")
    kept = _fingerprints(spark, sf).select("type", "n_cells", "vmr_curve", "scales_um", "mock_vmr_mean", "chi_squared", "n_mocks_used")
    reports.write_document(kept, path, "type")
    cols = ("peak_scale_um", "peak_vmr_ratio", "integrated_excess", "width", "f_statistic", "p_value")
    return rounded(an.completed(reports.read_fingerprints(spark, path)).select("type", "n_cells", "direction", "n_mocks_used", "is_significant", *cols), 5)


SQL["completed_records"] = f"{null_chain()}, {MEAS}, {hot_sql()} SELECT type, CAST(n_cells AS BIGINT) AS n_cells, direction, n_mocks_used, p_value < 0.05 AS is_significant, {FIVE('peak_scale_um', 'peak_vmr_ratio', 'integrated_excess', 'width', 'f_statistic', 'p_value')} FROM me JOIN hf USING (type)"


@query
def report_document(spark, sf):
    """The report of a mediation with metadata and a summary before its results, written and read again."""
    from .sources import reports

    path = fresh_path(spark, "report")
    found = an.mediation(_mediated(spark, sf)).select("type", "n_cells", "chi_squared_overall", "chi_squared_within", "mediation_pct")
    summary = an.summary_of(found, "mediation_pct").first()
    reports.write_document(found, path, analysis="mediation", n_types=summary["n"], summary=F.struct(F.lit(summary["median"]).alias("median"), F.lit(summary["high"]).alias("high")))
    text = spark.read.text(path).select(F.from_json("value", "struct<analysis:string,n_types:bigint,summary:struct<median:double,high:double>,results:array<struct<type:string,n_cells:bigint,chi_squared_overall:double,chi_squared_within:double,mediation_pct:double>>>").alias("d"))
    rows = text.select("d.analysis", "d.n_types", F.col("d.summary.median").alias("median"), F.col("d.summary.high").alias("high"), F.explode("d.results").alias("r"))
    return rounded(rows.select("analysis", "n_types", "median", "high", "r.*"), 4)


SQL["report_document"] = f"{MEDIATED}, su AS (SELECT count(mediation_pct) AS n_types, round(quantile_cont(mediation_pct, 0.5), 4) + 0.0 AS median, round(max(mediation_pct), 4) + 0.0 AS high FROM mp) SELECT 'mediation' AS analysis, n_types, median, high, type, n_cells, {FOUR('chi_squared_overall', 'chi_squared_within', 'mediation_pct')} FROM mp, su"


@query
def trials_json(spark, sf):
    """The curves of all jittered trials, a list of objects by type, read by trial and type."""
    from .sources import reports

    path = fresh_path(spark, "trials")
    rows = _jittered(spark, sf).groupBy("trial", "type").agg(F.max("n").alias("n_cells"), cv.array_of("vmr").alias("vmr_curve"), cv.array_of("um").alias("scales_um"), cv.array_of("null_mean").alias("mock_vmr_mean"))
    reports.write_trials(rows, path)
    back = reports.read_trials(spark, path)
    return rounded(back.select(F.col("trial").cast("long").alias("trial"), "type", "n_cells", F.posexplode(F.arrays_zip("vmr_curve", "scales_um", "mock_vmr_mean")).alias("place", "s"), "p_value").select("trial", "type", "n_cells", "place", "s.*", "p_value"), 5)


SQL["trials_json"] = f"{JITTER}, sz AS (SELECT trial, type, sum(c)::BIGINT AS n FROM pix WHERE mock_id = -1 GROUP BY ALL) SELECT CAST(trial AS BIGINT) AS trial, type, n AS n_cells, CAST(scale_idx AS INTEGER) AS place, round(vmr, 5) AS vmr_curve, round(um, 5) AS scales_um, round(m, 5) AS mock_vmr_mean, CAST(NULL AS DOUBLE) AS p_value FROM (SELECT cur.*, m FROM cur JOIN nul USING (trial, type, scale_idx) WHERE mock_id < 0) JOIN sz USING (trial, type)"


def _curve_files(spark, sf) -> str:
    """A folder with the curves of the urgent orders in nanometres and of the low ones in micrometres, behind a broken file and one of another kind."""
    path = fresh_path(spark, "curves")
    rows = an.against_null(_labelled(spark, sf), ["type"])
    every = rows.groupBy("type").agg(cv.array_of("vmr").alias("vmr"), cv.array_of("um").alias("um"), cv.array_of("null_mean").alias("null_mean"), cv.array_of("null_sd").alias("null_std"))
    nm = F.to_json(F.struct("vmr", F.transform("um", lambda u: u * 1000.0).alias("scales_nm"), "null_mean", "null_std"))
    um = F.to_json(F.struct("vmr", F.col("um").alias("scales_um")))
    first, last = every.where("type = '1-URGENT'"), every.where("type = '5-LOW'")
    for name, text in (("a", first.select(F.substring(nm, 1, 40).alias("value"))), ("b", first.select(F.to_json(F.struct("vmr", "null_mean")).alias("value"))), ("c", first.select(nm.alias("value"))), ("d", last.select(um.alias("value")))):
        text.coalesce(1).write.text(f"{path}/{name}")
    return f"{path}/*/*.txt"


@query
def curve_files(spark, sf):
    from .sources import reports

    return rounded(reports.find_curves(spark, _curve_files(spark, sf)), 4)


SQL["curve_files"] = f"{null_chain()} SELECT 'nm' AS unit, CAST(scale_idx AS INTEGER) AS place, round(um * 1000, 4) AS scale, round(vmr, 4) AS vmr, round(null_mean, 4) AS null_mean, round(null_sd, 4) AS null_sd FROM vs WHERE type = '1-URGENT'"


@query
def result_source(spark, sf):
    """Fingerprints of two types and the number of bad files, by the source of result files, from a folder with a document cut off beside the whole one."""
    from .sources import reports, results

    path = fresh_path(spark, "results")
    rows = an.against_null(_labelled(spark, sf), ["type"])
    arrays = rows.groupBy("type").agg(F.max("n").alias("n_cells"), cv.array_of("vmr").alias("vmr_curve"), cv.array_of("um").alias("scales_um"))
    reports.write_document(arrays, f"{path}/whole", "type")
    spark.read.text(f"{path}/whole").select(F.substring("value", 1, 60)).write.text(f"{path}/cut")
    back = results.read(spark, path, "fingerprints", ["1-URGENT", "5-LOW"])
    bad = back.where("error is not null").agg(F.count("*").alias("n_bad"))
    kept = back.where("error is null").select("type", "n_cells", F.posexplode(F.arrays_zip("vmr_curve", "scales_um")).alias("place", "s"), "n_mocks_used")
    return rounded(kept.join(bad).select("type", "n_cells", "place", "s.*", "n_mocks_used", "n_bad"))


SQL["result_source"] = f"{null_chain()} SELECT type, CAST(n AS BIGINT) AS n_cells, CAST(scale_idx AS INTEGER) AS place, round(vmr, 6) AS vmr_curve, round(um, 6) AS scales_um, 0::BIGINT AS n_mocks_used, 1::BIGINT AS n_bad FROM vs WHERE type IN ('1-URGENT', '5-LOW')"


@query
def result_source_pairs(spark, sf):
    """The pairs of one type, by the source of result files."""
    from .sources import reports, results

    path = fresh_path(spark, "result-pairs")
    arrays = _cooccurrence(orders(spark, sf)).groupBy("type_a", "type_b").agg(cv.array_of("r").alias("correlation_curve"), cv.array_of("null_mean").alias("null_corr_mean"))
    reports.write_document(reports.pair_records(arrays).drop("type_a", "type_b"), path, "key")
    back = results.read(spark, path, "pairs", ["1-URGENT"])
    return rounded(back.select("type_a", "type_b", F.posexplode(F.arrays_zip("correlation_curve", "null_corr_mean")).alias("place", "s")).select("type_a", "type_b", "place", F.col("s.correlation_curve").alias("r"), F.col("s.null_corr_mean").alias("null_mean")))


SQL["result_source_pairs"] = f"{co_chain()} SELECT type_a, type_b, CAST(scale_idx AS INTEGER) AS place, round(r, 6) + 0.0 AS r, round(null_mean, 6) + 0.0 AS null_mean FROM co WHERE type_a = '1-URGENT' OR type_b = '1-URGENT'"


@query
def result_source_curves(spark, sf):
    """All curves of a folder by the source of result files; a broken file and one of another kind are rows without a unit."""
    from .sources import results

    return rounded(results.read(spark, _curve_files(spark, sf), "curves").select("unit", "place", "scale", "vmr", "null_mean", "null_sd"), 4)


SQL["result_source_curves"] = f"{null_chain()} SELECT CASE WHEN type = '1-URGENT' THEN 'nm' ELSE 'um' END AS unit, CAST(scale_idx AS INTEGER) AS place, round(CASE WHEN type = '1-URGENT' THEN um * 1000 ELSE um END, 4) AS scale, round(vmr, 4) AS vmr, round(CASE WHEN type = '1-URGENT' THEN null_mean END, 4) AS null_mean, round(CASE WHEN type = '1-URGENT' THEN null_sd END, 4) AS null_sd FROM vs WHERE type IN ('1-URGENT', '5-LOW') UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL FROM range(2)"


@query
def universal_comparison(spark, sf):
    """A curve from files beside the orders' own regional curve."""
    from .sources import reports

    p = orders(spark, sf)
    tissue = an.regional(p, *setup(p), UNIFORMS).select(F.lit("um").alias("unit"), F.col("scale_idx").alias("place"), F.col("um").alias("scale"), "vmr", "null_mean", "null_sd")
    return rounded(an.universal_comparison({"files": reports.find_curves(spark, _curve_files(spark, sf)), "orders": tissue}), 4)


SQL["universal_comparison"] = f"""SELECT 'files' AS panel, 'nm' AS unit, CAST(scale_idx AS INTEGER) AS place, round(um * 1000, 4) AS scale, round(vmr, 4) AS vmr, round(null_mean, 4) AS null_mean, round(null_mean - 2 * null_sd, 4) + 0.0 AS low, round(null_mean + 2 * null_sd, 4) + 0.0 AS high FROM ({null_chain()} SELECT * FROM vs WHERE type = '1-URGENT')
UNION ALL SELECT 'orders', 'um', scale_idx, round(um, 4), round(vmr, 4), round(null_mean, 4), round(null_mean - 2 * null_sd, 4) + 0.0, round(null_mean + 2 * null_sd, 4) + 0.0 FROM ({regional_sql(PTS)} SELECT * FROM rc)"""


@query
def regions_there(spark, sf):
    """Region files that exist, out of a longer list."""
    from .sources import tables

    path = fresh_path(spark, "regions")
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_label"), F.col("o_totalprice").alias("x"), F.col("o_orderpriority").alias("class"), "o_orderstatus")
    for k in ("F", "O"):
        tables.write_region(o.where(F.col("o_orderstatus") == k), f"{path}/{k}")
    found = tables.read_regions_there(spark, {k: f"{path}/{k}" for k in ("F", "O", "missing")})
    out = None
    for k, rows in sorted(found.items()):
        one = rows.groupBy("class").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total")).withColumn("region", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


SQL["regions_there"] = "SELECT o_orderstatus AS region, o_orderpriority AS class, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL"


@query
def region_etl(spark, sf):
    """Cells with coordinates and parcellation joined, filtered and projected, through a region file."""
    from .sources import tables

    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("cell_label"), F.col("c_nationkey").alias("parcellation_index"))
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    regions = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("parcellation_index"), F.col("r_name").alias("division"), F.col("n_name").alias("structure"))
    cells = read(spark, sf, "customer").select(F.col("c_custkey").alias("cell_label"), F.col("c_acctbal").alias("x"), F.col("c_mktsegment").alias("class"), F.lit("q").alias("dropped"))
    path = fresh_path(spark, "etl")
    tables.write_region(tables.region_etl(cells, c, regions, "EUROPE"), path)
    return tables.read_region(spark, path)


SQL["region_etl"] = "SELECT c_custkey AS cell_label, c_acctbal AS x, c_mktsegment AS class FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'"


@query
def region_strata(spark, sf):
    """Customers in a region store, read by region with the strata of each: layers of one, nuclei of the other."""
    from .sources.store import RegionStore

    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    code = F.when(F.col("r_name") == "EUROPE", "Isocortex").when(F.col("r_name") == "ASIA", "TH").otherwise(F.col("r_name"))
    terms = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("parcellation_index"), code.alias("division"), F.col("n_name").alias("structure"), F.concat("n_name", F.lit("-"), (F.col("n_nationkey") % 8).cast("string")).alias("substructure"))
    c = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("cell_label"), F.col("c_acctbal").alias("x"), F.col("c_mktsegment").alias("class"), F.col("c_nationkey").alias("parcellation_index"))
    store = RegionStore(spark, fresh_path(spark, "store"), 8).write(c.drop("parcellation_index"), c.select("cell_label", "parcellation_index"), terms)
    parts = [store.strata(name).groupBy(F.lit(name).alias("region"), F.col(kind).alias("stratum"), "structure").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total")) for name, kind in (("isocortex", "layer"), ("thalamus", "nucleus"))]
    return parts[0].unionByName(parts[1])


SQL["region_strata"] = """WITH c AS (SELECT c_acctbal AS x, r_name, n_name, n_nationkey % 8 AS layer FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT 'isocortex' AS region, CASE WHEN layer BETWEEN 1 AND 6 THEN 'L' || layer END AS stratum, n_name AS structure, count(*) AS n, round(sum(x), 2) AS total FROM c WHERE r_name = 'EUROPE' GROUP BY ALL UNION ALL SELECT 'thalamus', n_name, n_name, count(*), round(sum(x), 2) FROM c WHERE r_name = 'ASIA' GROUP BY ALL"""


@query
def csv_inferred(spark, sf):
    from .sources import reports, tables

    path = fresh_path(spark, "inferred")
    reports.write_csv(read(spark, sf, "nation").select("n_nationkey", "n_name", (F.col("n_regionkey") + 0.5).cast("double").alias("half")), path)
    return tables.read_csv(spark, path).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", "half")


SQL["csv_inferred"] = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, n_regionkey + 0.5::DOUBLE AS half FROM nation"


@query
def stream_pixel_counts(spark, sf):
    from .streaming.counts import pixel_counts

    e = read(spark, sf, "events")
    p = e.select("ts", F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), F.col("event_type").alias("type")).dropna()
    roi = grid.roi_of(p, 8)
    return pixel_counts(p, roi, ["type"], "ts", "6 hours").select("type", F.unix_timestamp("window.start").alias("start"), "gx", "gy", "c")


SQL["stream_pixel_counts"] = f"WITH pts AS (SELECT ts, value AS x, user_id::DOUBLE AS y, event_type AS type FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL), {roi_sql()}, {pix_sql('pts', 'type, CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS start', 2, 8)} SELECT * FROM pix"
