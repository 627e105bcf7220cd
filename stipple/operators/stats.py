"""Moments of null curves, the joint test against them, correlations and counts of p-values."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from . import order

LEAST_POINTS = 5


def usable(curves: DataFrame, least_points: int = LEAST_POINTS) -> DataFrame:
    """Mock curves of labels with enough points; ``n`` counts a key's points."""
    return curves.where((F.col("mock_id") < 0) | (F.col("n") >= least_points))


def null_moments(curves: DataFrame, keys: list[str], value: str = "vmr") -> DataFrame:
    """(keys, scale_idx, null_mean, null_sd population, n_mocks) over the mocks."""
    return curves.where("mock_id >= 0").groupBy(*keys, "scale_idx").agg(F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("null_sd"), F.count("*").alias("n_mocks"))


def null_covariance(curves: DataFrame, keys: list[str], value: str = "vmr") -> DataFrame:
    """(keys, scale_i, scale_j, cov) of the sample covariance over mocks."""
    rows = curves.where("mock_id >= 0").select(*keys, "mock_id", "scale_idx", value)
    a = rows.withColumnsRenamed({"scale_idx": "scale_i", value: "_u"})
    b = rows.withColumnsRenamed({"scale_idx": "scale_j", value: "_v"})
    return a.join(b, [*keys, "mock_id"]).groupBy(*keys, "scale_i", "scale_j").agg(F.covar_samp("_u", "_v").alias("cov"))


def hotelling(real: np.ndarray, nulls: np.ndarray, shrinkage: float = 0.02) -> tuple[float, float, int]:
    """(statistic, condition number, mocks): distance of a curve from null curves in their shrunk covariance.

    The covariance of the mocks moves by ``shrinkage`` towards its diagonal. Fewer
    than two mocks give 0; a singular matrix falls back to the variances.
    """
    n = len(nulls)
    if n < 2:
        return 0.0, float("inf"), n
    apart = real - nulls.mean(axis=0)
    cov = np.atleast_2d(np.cov(nulls, rowvar=False))
    var = np.diag(cov)
    shrunk = cov * (1 - shrinkage) + np.diag(shrinkage * var + 1e-10)
    cond = float(np.linalg.cond(shrunk))
    return hotelling_distance(apart, shrunk, var) * n / (n + 1), cond, n


def hotelling_distance(apart: np.ndarray, shrunk: np.ndarray, var: np.ndarray) -> float:
    """apart' shrunk^-1 apart, or by the variances alone if the matrix is singular."""
    try:
        return float(apart @ np.linalg.solve(shrunk, apart))
    except np.linalg.LinAlgError:
        return float((apart**2 / (var + 1e-10)).sum())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often and in whatever loops ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _upto(n: Column | int) -> Column:
    """0 to n - 1; nothing for n = 0."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def shrunk_covariance(apart: Column, shrinkage: float) -> Column:
    """Matrix (array of rows) of the sample covariance of ``apart``, an array of curves less their mean, moved by ``shrinkage`` towards its diagonal."""
    def entry(cols: Column, n: Column, i: Column, j: Column) -> Column:
        c = _dot(F.get(cols, i), F.get(cols, j)) / (n - 1)
        return F.when(i == j, c * (1 - shrinkage) + (c * shrinkage + 1e-10)).otherwise(c * (1 - shrinkage))

    def of(cols: Column) -> Column:
        n = F.size(F.get(cols, F.lit(0)))
        return F.transform(_upto(F.size(cols)), lambda i: F.transform(_upto(F.size(cols)), lambda j: entry(cols, n, i, j)))

    return _let(F.transform(_upto(F.size(F.get(apart, F.lit(0)))), lambda j: F.transform(apart, lambda x: F.get(x, j))), of)


def cholesky_row(rows: Column, given: Column, n: Column) -> Column:
    """The next row of a triangular factor: ``rows`` are those before it, ``given`` the matrix's row, ``n`` how many entries it has; the last is a root if it is the diagonal's."""
    def entry(row: Column, j: Column) -> Column:
        rest = F.get(given, j)
        before = F.aggregate(_upto(j), F.lit(0.0), lambda t, k: t + F.get(row, k) * F.when(j == F.size(rows), F.get(row, k)).otherwise(F.get(F.get(rows, j), k)))
        return F.when(j == F.size(rows), F.sqrt(rest - before)).otherwise((rest - before) / F.get(F.get(rows, j), j))

    return F.aggregate(_upto(n), F.array().cast("array<double>"), lambda row, j: F.concat(row, F.array(entry(row, j))))


def distance(matrix: Column, apart: Column) -> Column:
    """apart' matrix^-1 apart: the matrix is factored, and ``apart`` runs through the factor as one more row. Not a number, or null, where the matrix is not positive definite."""
    p = F.size(apart)

    def of(m: Column) -> Column:
        factor = F.aggregate(_upto(p), F.array().cast("array<array<double>>"), lambda rows, i: F.concat(rows, F.array(cholesky_row(rows, F.get(m, i), i + 1))))
        return _let(factor, lambda rows: _let(cholesky_row(rows, apart, p), lambda y: _dot(y, y)))

    return _let(matrix, of)


#: Sweeps of rotations; each squares what is left off the diagonal, so a matrix of a dozen scales is done before.
SWEEPS = 10


def condition_number(matrix: Column) -> Column:
    """Largest over smallest eigenvalue of a symmetric matrix, by Jacobi's rotations in turn; infinite if the smallest is not positive."""
    def rotated(m: Column, i: Column, j: Column) -> Column:
        at = lambda a, b: F.get(F.get(m, a), b)
        theta = (at(j, j) - at(i, i)) / (2.0 * at(i, j))
        t = F.when(theta >= 0, 1.0).otherwise(-1.0) / (F.abs(theta) + F.sqrt(theta * theta + 1.0))

        def turn(t: Column) -> Column:
            def with_cs(cs: Column) -> Column:
                c, s = F.get(cs, F.lit(0)), F.get(cs, F.lit(1))
                cols = F.transform(m, lambda row: F.transform(row, lambda v, k: F.when(k == i, c * v - s * F.get(row, j)).when(k == j, s * F.get(row, i) + c * v).otherwise(v)))
                return _let(cols, lambda w: F.transform(w, lambda row, k: F.when(k == i, F.zip_with(row, F.get(w, j), lambda a, b: c * a - s * b)).when(k == j, F.zip_with(F.get(w, i), row, lambda a, b: s * a + c * b)).otherwise(row)))

            return _let(F.array(1.0 / F.sqrt(t * t + 1.0), t / F.sqrt(t * t + 1.0)), with_cs)

        return F.when(at(i, j) == 0, m).otherwise(_let(t, turn))

    def values(p: Column) -> Column:
        each = F.flatten(F.transform(_upto(p), lambda i: F.transform(F.filter(_upto(p), lambda j: j > i), lambda j: F.array(i, j))))
        turns = F.flatten(F.array_repeat(each, SWEEPS))
        done = F.aggregate(turns, matrix, lambda m, ij: rotated(m, F.get(ij, F.lit(0)), F.get(ij, F.lit(1))))
        return _let(done, lambda m: F.transform(m, lambda row, k: F.get(row, k)))

    low, high = F.array_min, F.array_max
    return _let(values(F.size(matrix)), lambda v: F.when(low(v) > 0, high(v) / low(v)).otherwise(float("inf")))


def joint_test(curves: DataFrame, keys: list[str], value: str = "vmr", shrinkage: float = 0.02, least_mocks: int = 5) -> DataFrame:
    """(keys, chi_squared, f_statistic, dof, dof_f1, dof_f2, p_value, condition_number, n_mocks_used) of mock -1 against the others.

    A key comes to one row with the curves of its mocks, mocks times scales numbers; the
    covariance, its factor, the solution and its form are functions of that row, so there
    is no Python in the plan. Keys without a real curve or with fewer than ``least_mocks``
    mocks drop. A matrix that can't be factored falls back to the variances; then, as for
    fewer than two mocks, the condition number is null.
    """
    vectors = curves.groupBy(*keys, "mock_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("scale_idx", F.col(value).alias("_v")))), lambda s: s["_v"]).alias("_v"))
    mock = F.when(F.col("mock_id") >= 0, F.struct("mock_id", "_v"))
    rows = vectors.groupBy(*keys).agg(F.max(F.when(F.col("mock_id") < 0, F.col("_v"))).alias("_real"), F.transform(F.sort_array(F.collect_list(mock)), lambda s: s["_v"]).alias("_nulls"))
    rows = rows.where(F.col("_real").isNotNull() & (F.size("_nulls") >= least_mocks))
    n, p = F.size("_nulls"), F.size("_real")
    mean = F.transform(_upto(p), lambda j: F.aggregate("_nulls", F.lit(0.0), lambda t, x: t + F.get(x, j)) / n)

    def tested(mean: Column) -> Column:
        apart = F.zip_with("_real", mean, lambda a, b: a - b)
        matrix = shrunk_covariance(F.transform("_nulls", lambda x: F.zip_with(x, mean, lambda a, b: a - b)), shrinkage)
        return _let(F.struct(matrix.alias("m"), apart.alias("d")), lambda s: F.struct(s["m"].alias("m"), s["d"].alias("d"), distance(s["m"], s["d"]).alias("q")))

    def verdict(s: Column) -> Column:
        # the variances without the shift: an entry of the diagonal is the variance and 1e-10
        alone = F.aggregate(_upto(p), F.lit(0.0), lambda t, j: t + F.get(s["d"], j) * F.get(s["d"], j) / F.get(F.get(s["m"], j), j))
        ok = s["q"].isNotNull() & ~F.isnan(s["q"]) & (s["q"] < float("inf"))
        return F.struct(F.when(ok, s["q"]).otherwise(alone).alias("q"), F.when(ok, condition_number(s["m"])).alias("cond"))

    rows = rows.withColumn("_t", F.when(n >= 2, _let(_let(mean, tested), verdict)))
    chi = F.when(n < 2, 0.0).otherwise(F.col("_t.q") * n / (n + 1))
    cond = F.when(F.col("_t.cond") < float("inf"), F.col("_t.cond"))
    return with_p_value(rows.select(*keys, chi.alias("chi_squared"), p.cast("long").alias("dof"), cond.alias("condition_number"), n.cast("long").alias("n_mocks_used")))


def resampled_tests(curves: DataFrame, keys: list[str], n_boot: int, value: str = "vmr", shrinkage: float = 0.02, salt: str = "boot") -> DataFrame:
    """(keys, boot, chi_squared): the statistic of ``joint_test`` with the mocks of a key resampled ``n_boot`` times, by the draws of ``nulls.resamples``.

    A resample is a vector of how often each mock is drawn, so the means and covariances
    of all resamples are products of these vectors with the mocks' curves and with their
    outer products: one group for each key, mocks times scales numbers, and no curve is
    copied. Keys without a real curve or with fewer than two mocks drop.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in curves.select(*keys).schema)

    def draws(key: list[str], n: int) -> np.ndarray:
        name = "|".join([salt, *key])
        pick = lambda b, slot: int(int(hashlib.md5(f"{name}|{b}|{slot}".encode()).hexdigest()[:8], 16) / 4294967296.0 * n)
        return np.array([np.bincount([pick(b, slot) for slot in range(n)], minlength=n) for b in range(n_boot)], dtype=np.float64)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, i = np.unique(pdf["mock_id"].to_numpy(), return_inverse=True)
        scales, j = np.unique(pdf["scale_idx"].to_numpy(), return_inverse=True)
        wide = np.full((len(ids), len(scales)), np.nan)
        wide[i, j] = pdf[value].to_numpy()
        real, nulls = wide[ids < 0], wide[ids >= 0]
        n, p = nulls.shape
        out = pdf[keys].iloc[:1]
        if not len(real) or n < 2:
            return out.iloc[:0].assign(boot=[], chi_squared=[])
        middle = nulls.mean(axis=0)  # what is left is small, so that squares of means take little from squares
        v, w = nulls - middle, draws([str(x) for x in out.iloc[0]], n)
        mean = w @ v / n
        outer = (w @ (v[:, :, None] * v[:, None, :]).reshape(n, p * p)).reshape(n_boot, p, p)
        cov = (outer - n * mean[:, :, None] * mean[:, None, :]) / (n - 1)
        var = np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0.0)
        shrunk = cov * (1 - shrinkage)
        shrunk[:, range(p), range(p)] = var * (1 - shrinkage) + (shrinkage * var + 1e-10)
        apart = real[0] - middle - mean
        try:
            chi = (apart * np.linalg.solve(shrunk, apart[:, :, None])[:, :, 0]).sum(axis=1)
        except np.linalg.LinAlgError:
            chi = np.array([hotelling_distance(d, m, s) for d, m, s in zip(apart, shrunk, var, strict=True)])
        return out.loc[out.index.repeat(n_boot)].assign(boot=np.arange(n_boot), chi_squared=chi * n / (n + 1))

    return curves.select(*keys, "mock_id", "scale_idx", value).groupBy(*keys).applyInPandas(run, f"{fields}, boot int, chi_squared double")


def with_p_value(rows: DataFrame) -> DataFrame:
    """F statistic and tail from chi_squared, dof and n_mocks_used; the chi-squared tail where mocks are too few for F."""
    chi, p, n = F.col("chi_squared"), F.col("dof"), F.col("n_mocks_used")
    df2 = n - p
    enough = df2 > 0
    f = F.when(n < 2, 0.0).when(enough, chi * df2 / ((n - 1) * p)).otherwise(chi / p)
    rows = rows.withColumn("f_statistic", f).withColumns({"dof_f1": p, "dof_f2": df2})
    safe = F.when(enough, df2).otherwise(1)
    tail = F.when(n < 2, 1.0).when(enough, tails.f_tail(F.col("f_statistic"), p, safe)).otherwise(tails.chi2_tail(chi, p))
    return rows.withColumn("p_value", tail)


def spearman(rows: DataFrame, a: str, b: str, least: int = 3) -> DataFrame:
    """(n, rho, p_value) with average ranks for ties; null below ``least`` rows or for constant input. Rows may be any number."""
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    both = rows.where(there(a) & there(b)).select(F.col(a).alias("_x"), F.col(b).alias("_y"))
    ranks = order.average_ranks(order.average_ranks(both, "_x", "_a"), "_y", "_b")
    r = ranks.agg(F.count("*").alias("n"), F.covar_pop("_a", "_b").alias("_c"), F.stddev_pop("_a").alias("_sa"), F.stddev_pop("_b").alias("_sb"))
    r = r.withColumn("rho", F.when(F.col("n") >= least, F.try_divide("_c", F.col("_sa") * F.col("_sb")))).select("n", "rho")
    inner = F.col("rho").isNotNull() & (F.abs("rho") < 1)
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.when(inner, 1 - F.col("rho") * F.col("rho")))
    return r.withColumn("p_value", F.when(inner, tails.t_two_sided(t, F.col("n") - 2)).when(F.col("rho").isNotNull(), 0.0))


def p_histogram(rows: DataFrame, p: str = "p_value", n_bins: int = 20, alpha: float = 0.05) -> DataFrame:
    """(bin, low, n, n_all, expected): counts in equal bins of [0, 1], 1 in the last; expected: alpha times all."""
    at = F.least(F.floor(F.col(p) * n_bins), F.lit(n_bins - 1)).cast("int")
    counts = rows.where(F.col(p).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = every.agg(F.sum("n").alias("n_all"))
    return every.crossJoin(F.broadcast(total)).select("bin", (F.col("bin") / n_bins).alias("low"), "n", "n_all", (F.col("n_all") * alpha).alias("expected"))
