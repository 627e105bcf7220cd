"""Joins, filters and projections that turn raw tables into points (id, x, y[, z], type[, stratum])."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import order

log = logging.getLogger(__name__)

# Type levels from coarse to fine, and the division code of each named region.
LEVELS = ("class", "subclass", "supertype", "cluster")
DIVISIONS = {"isocortex": "Isocortex", "hippocampus": "HPF", "thalamus": "TH"}
# Fixed value: the form of a layer at the end of a name.
LAYER = r"(\d+(?:/\d+)?[a-b]?)$"


def with_regions(coordinates: DataFrame, parcellation: DataFrame) -> DataFrame:
    """Left join of each cell's parcellation; Spark broadcasts the dimension if its size allows."""
    wanted = [c for c in ("parcellation_index", "organ", "category", "division", "structure", "substructure") if c in parcellation.columns]
    return coordinates.join(parcellation.select(*wanted), "parcellation_index", "left")


def annotate(cells: DataFrame, regions: DataFrame, keep: tuple[str, ...] = ("division", "structure", "substructure"), on: str = "cell_label") -> DataFrame:
    """Left join of region columns onto cells; coordinates stay those of ``cells``, and the key stays a column."""
    return cells.join(regions.select(on, *[c for c in keep if c in regions.columns]), on, "left")


def region(cells: DataFrame, name: str, column: str = "division", report: bool = False) -> DataFrame:
    """Rows of a region: a known name's division code, or the name itself as code. Nulls drop.

    With ``report`` an empty result is looked for, and the log names the divisions there are.
    """
    if column not in cells.columns:
        raise ValueError(f"no column {column!r}: join regions first")
    rows = cells.where(F.col(column) == DIVISIONS.get(name.lower(), name))
    if report and rows.isEmpty():
        log.warning("no cells in region %s; there are %s", name, some_divisions(cells, column))
    return rows


def some_divisions(cells: DataFrame, column: str = "division", n: int = 20) -> list[str]:
    """Up to ``n`` values there are, for the message about an empty region."""
    return [r[0] for r in cells.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(n).collect()]


def type_column(cells: DataFrame, level: str) -> str:
    for name in (level, f"cell_type_{level}"):
        if name in cells.columns:
            return name
    raise ValueError(f"no column for type level {level!r} in {cells.columns}")


def in_micrometres(cells: DataFrame, axes: tuple[str, ...] = ("x", "y"), force: bool = False) -> DataFrame:
    """Multiplies by 1000 where the largest x is below 20, that is, in millimetres (or always)."""
    top = None if force else cells.agg(F.max("x")).first()[0]
    factor = 1000.0 if force or (top is not None and top < 20) else 1.0
    return cells.withColumns({a: F.col(a).cast("double") * factor for a in axes})


def prepare(cells: DataFrame, level: str = "class", id_col: str = "cell_label", axes: tuple[str, ...] = ("x", "y"), extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, axes, type): rows without a coordinate or type drop, lengths become micrometres, types strings."""
    name = type_column(cells, level)
    rows = cells.dropna(subset=[*axes, name]).select(F.col(id_col).alias("id"), *[F.col(a).cast("double").alias(a) for a in axes], F.col(name).cast("string").alias("type"), *extra)
    return in_micrometres(rows, axes)


def cortical_layer(substructure: Column) -> Column:
    """``L`` and the layer at the end of a name (``L2/3`` of VISpm2/3); null where there is none or it isn't 1 to 6."""
    found = F.regexp_extract(substructure, LAYER, 1)
    ok = substructure.isNotNull() & (substructure != "unassigned") & F.substring(found, 1, 1).isin(*"123456")
    return F.when(ok, F.concat(F.lit("L"), found))


def valid_strata(points: DataFrame, column: str = "stratum") -> DataFrame:
    """Drops null and exactly ``unassigned`` strata."""
    return points.where(F.col(column).isNotNull() & (F.col(column) != "unassigned"))


def frequent_types(points: DataFrame, least: int = 50) -> DataFrame:
    """(type, n_cells) of types with ``least`` points or more."""
    return points.groupBy("type").agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= least)


def only_types(points: DataFrame, types: list[str] | DataFrame) -> DataFrame:
    if isinstance(types, DataFrame):
        return points.join(types.select("type").distinct(), "type", "left_semi")
    return points.where(F.col("type").isin(*types))


def quantile_bins(points: DataFrame, value: str = "z", n: int = 5, within: str = "stratum", out: str = "bin") -> DataFrame:
    """Quantile bin (from 0) of a value within its group: edges at interpolated percentiles, equal edges once, right ends closed.

    Edges are found by selection (``order.quantiles``), so no group's values are held or
    ordered in one task; then they are joined back. A group without a value has bin 0.
    """
    edges = order.quantiles(points, value, [within], [i / n for i in range(n + 1)], "_edges")
    inner = edges.select(F.col(within).alias("_w"), F.array_distinct("_edges").alias("_edges"))
    joined = points.join(inner, F.col(within).eqNullSafe(F.col("_w")), "left").drop("_w")
    count = F.size(F.filter(F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0))), lambda e: e < F.col(value)))
    return joined.withColumn(out, F.when(F.coalesce(F.size("_edges"), F.lit(0)) < 2, 0).otherwise(count).cast("long")).drop("_edges")


def compound_stratum(stratum: Column, depth_bin: Column) -> Column:
    return F.concat(stratum, F.lit("_d"), depth_bin.cast("string"))


def breakdown(cells: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values; ties in the order of the values."""
    return cells.groupBy(column).agg(F.count("*").alias("n_cells")).orderBy(F.col("n_cells").desc(), F.col(column)).limit(n)


def top_k_or_other(points: DataFrame, k: int, column: str = "type", other: str = "Other") -> DataFrame:
    """``category``: the type where it is among the ``k`` most frequent, ``other`` elsewhere."""
    top = breakdown(points, column, k).select(F.col(column).alias("_t"))
    return points.join(F.broadcast(top), F.col(column) == F.col("_t"), "left").withColumn("category", F.coalesce("_t", F.lit(other))).drop("_t")


def latest_first(rows: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """Sorted by the size of a column, largest first, with ``keys`` to settle ties."""
    return rows.orderBy(F.abs(F.col(by)).desc(), *keys)


def per_group_top(rows: DataFrame, group: str, by: Column, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each task's groups before the exchange."""
    rank = F.row_number().over(W.Window.partitionBy(group).orderBy(by))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
