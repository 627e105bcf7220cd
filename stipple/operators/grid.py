"""Counts in cells: points to pixels, pixels to bins of several widths, bins to curves.

All tables are long and sparse: only occupied pixels and bins have rows, and the
number of all bins is a constant of the scale, so empty bins count in every
statistic without being there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scales import Scales

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Roi:
    """A box and its grid: ``grid`` pixels along each axis."""

    origin: tuple[float, ...]
    size: tuple[float, ...]
    grid: int = 256

    @property
    def axes(self) -> tuple[str, ...]:
        return AXES[: len(self.origin)]

    @property
    def extent(self) -> float:
        return max(self.size)

    @property
    def area(self) -> float:
        out = 1.0
        for s in self.size:
            out *= s
        return out

    def moved(self, offset: tuple[float, ...]) -> Roi:
        return Roi(tuple(o + d for o, d in zip(self.origin, offset, strict=True)), self.size, self.grid)


def roi_of(points: DataFrame, grid: int = 256, dims: int = 2, padding: float = 0.01) -> Roi:
    """The points' box, a little wider on each side: one aggregate, one row to the driver."""
    axes = AXES[:dims]
    row = points.agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]).first()
    lo, hi = [row[f"lo_{a}"] or 0.0 for a in axes], [row[f"hi_{a}"] or 0.0 for a in axes]
    return Roi(tuple(a - padding * (b - a) for a, b in zip(lo, hi, strict=True)), tuple((b - a) * (1 + 2 * padding) for a, b in zip(lo, hi, strict=True)), grid)


def pixel(value: Column, origin: Column | float, size: Column | float, grid: int) -> Column:
    """The pixel of a coordinate; what lies outside goes to the border."""
    size = size if isinstance(size, Column) else F.lit(size)
    origin = origin if isinstance(origin, Column) else F.lit(origin)
    at = F.when(size > 0, (value - origin) / F.when(size > 0, size) * grid).otherwise(0.0)
    return F.floor(F.least(F.greatest(at, F.lit(0.0)), F.lit(grid - 1e-9))).cast("int")


def pixels(points: DataFrame, roi: Roi, keys: list[str], shift: dict[str, str] | None = None) -> DataFrame:
    """(keys, gx, gy[, gz], c): points in each pixel. ``shift``: columns with an axis's offset of the origin."""
    shift = shift or {}
    cols = {f"g{a}": pixel(F.col(a), (F.lit(o) + F.col(shift[a])) if a in shift else o, s, roi.grid) for a, o, s in zip(roi.axes, roi.origin, roi.size, strict=True)}
    return points.withColumns(cols).groupBy(*keys, *cols).agg(F.count("*").alias("c"))


def bins(counts: DataFrame, scales: Scales, roi: Roi, keys: list[str]) -> DataFrame:
    """(keys, scale_idx, vox, um, n_bins, bx, by[, bz], c) of each scale, all from the pixels: scales do not nest.

    Pixels beyond the last whole bin are lost; they become one bin -1 with a count of
    0, so that a key stays even if all its points lie there. A scale wider than half
    the grid is one bin.
    """
    axes = [f"g{a}" for a in roi.axes]
    rows = [(i, v, float(u), roi.grid // v) for i, (v, u) in enumerate(zip(scales.vox, scales.um, strict=True))]
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v"), F.lit(u).alias("u"), F.lit(n).alias("n")) for i, v, u, n in rows])
    wide = counts.withColumn("s", F.explode(each))
    inside = F.col("s.n") < 2
    whole = F.lit(True)
    for a in axes:
        whole = whole & (F.col(a) < F.col("s.n") * F.col("s.v"))
    keep = inside | whole
    place = {f"b{a[1]}": F.when(inside, 0).when(whole, F.floor(F.col(a) / F.col("s.v"))).otherwise(-1).cast("int") for a in axes}
    n_bins = F.when(inside, 1).otherwise(F.pow(F.col("s.n"), F.lit(len(axes)))).cast("long")
    return (
        wide.select(*keys, F.col("s.i").alias("scale_idx"), F.col("s.v").alias("vox"), F.col("s.u").alias("um"), n_bins.alias("n_bins"), *[c.alias(n) for n, c in place.items()], F.when(keep, F.col("c")).otherwise(0).alias("c"))
        .groupBy(*keys, "scale_idx", "vox", "um", "n_bins", *place)
        .agg(F.sum("c").cast("long").alias("c"))
    )


def vmr(n: Column, s1: Column, s2: Column) -> Column:
    """Population variance over mean; 1 for an empty grid."""
    mean = s1 / n
    return F.when(mean < 1e-10, 1.0).otherwise((s2 / n - mean * mean) / F.when(mean >= 1e-10, mean))


def skewness(n: Column, s1: Column, s2: Column, s3: Column) -> Column:
    """Population skewness; 0 without spread."""
    mean = s1 / n
    var = F.greatest(s2 / n - mean * mean, F.lit(0.0))
    third = s3 / n - 3.0 * mean * (s2 / n) + 2.0 * mean * mean * mean
    spread = F.sqrt(var) >= 1e-10
    return F.when(spread, third / F.when(spread, var * F.sqrt(var))).otherwise(0.0)


def curves(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scale_idx, vox, um, n_points, vmr, skewness) from power sums (n_bins, s1, s2, s3), which are exact in doubles."""
    n, s1, s2, s3 = (F.col(k).cast("double") for k in ("n_bins", "s1", "s2", "s3"))
    return sums.select(*keys, "scale_idx", "vox", "um", F.col("s1").cast("long").alias("n_points"), vmr(n, s1, s2).alias("vmr"), skewness(n, s1, s2, s3).alias("skewness"))


def curves_of(points: DataFrame, roi: Roi, scales: Scales, keys: list[str]) -> DataFrame:
    return curves_of_counts(pixels(points, roi, keys), scales, roi, keys)


def summed_area(dense: np.ndarray) -> np.ndarray:
    """Counts of all boxes from the origin, with a border of zeros: the number in any box is a few look-ups."""
    out = np.zeros([n + 1 for n in dense.shape])
    inner = out[(slice(1, None),) * dense.ndim]
    inner[...] = dense
    for axis in range(dense.ndim):
        np.cumsum(inner, axis=axis, out=inner)
    return out


def power_sums(dense: np.ndarray, vox: tuple[int, ...]) -> dict[str, list[float]]:
    """n_bins, s1, s2 and s3 of the bins of each width: differences of a summed-area table at the bins' corners. A width above half the grid is one bin."""
    table, out = summed_area(dense), {k: [] for k in ("n_bins", "s1", "s2", "s3")}
    for v in vox:
        n = dense.shape[0] // v
        c = table[(slice(0, n * v + 1, v),) * dense.ndim] if n > 1 else table[np.ix_(*[[0, -1]] * dense.ndim)]
        for axis in range(dense.ndim):
            c = np.diff(c, axis=axis)
        c = c.ravel()
        for k, value in zip(out, (len(c), c.sum(), c @ c, (c * c) @ c), strict=True):
            out[k].append(value)
    return out


def curves_of_counts(counts: DataFrame, scales: Scales, roi: Roi, keys: list[str]) -> DataFrame:
    """``curves`` of pixel counts (keys, gx, gy[, gz], c): for each key the pixels as one dense grid, no larger for more points, summed into bins at every scale.

    Scales do not nest, so adding up ``bins`` would first make scales times as many rows.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.select(*keys).schema)
    place, g = [f"g{a}" for a in roi.axes], roi.grid
    um = [float(u) for u in scales.um]

    def run(table: pa.Table) -> pa.Table:
        at = np.ravel_multi_index(tuple(table[p].to_numpy() for p in place), [g] * len(place))
        dense = np.bincount(at, table["c"].to_numpy(), g ** len(place)).reshape([g] * len(place))
        sums = power_sums(dense, scales.vox)
        columns = {k: pa.array([table[k][0].as_py()] * len(um), table.schema.field(k).type) for k in keys}
        columns |= {"scale_idx": pa.array(range(len(um)), pa.int32()), "vox": pa.array(scales.vox, pa.int32()), "um": pa.array(um, pa.float64())}
        return pa.table(columns | {k: pa.array(v, pa.int64() if k == "n_bins" else pa.float64()) for k, v in sums.items()})

    sums = counts.groupBy(*keys).applyInArrow(run, f"{fields}, scale_idx int, vox int, um double, n_bins long, s1 double, s2 double, s3 double")
    return curves(sums, keys)
