"""Measures of curves over scales, in long form: one row for each key and scale, one row for each key out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def ratio(real: Column, null: Column) -> Column:
    """Real over null; 1 where the null is not above 0."""
    return F.when(null > 0, real / F.when(null > 0, null)).otherwise(1.0)


def percent_change(a: Column, b: Column) -> Column:
    """100 (1 - a / b); 0 where b is not above 0."""
    return F.when(b > 0, 100.0 * (1.0 - a / F.when(b > 0, b))).otherwise(0.0)


def trapezoid(rows: DataFrame, keys: list[str], value: str, out: str, minus: float = 0.0, um: str = "um") -> DataFrame:
    """Integral of ``value - minus`` over log10 of the scale."""
    w = W.Window.partitionBy(*keys).orderBy("scale_idx")
    v = F.col(value) - minus
    area = (F.lead(v).over(w) + v) / 2.0 * (F.log10(F.lead(um).over(w)) - F.log10(F.col(um)))
    return rows.withColumn("_a", area).groupBy(*keys).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias(out))


def peak_at(value: Column, um: str = "um") -> Column:
    """Aggregate: the scale at the largest value, the first on ties."""
    return F.max_by(um, F.struct(value, -F.col("scale_idx")))


def width(rows: DataFrame, keys: list[str], value: str = "ratio", out: str = "width") -> DataFrame:
    """Decades between the first and last scale at or above half of the peak's excess over 1; 0 for peaks up to 1.05."""
    peak = F.max(value).over(W.Window.partitionBy(*keys))
    marked = rows.withColumn("_p", peak).withColumn("_in", (F.col(value) >= 1.0 + (F.col("_p") - 1.0) * 0.5) & (F.col("_p") > 1.05))
    log = F.when(F.col("_in"), F.log10("um"))
    return marked.groupBy(*keys).agg(F.coalesce(F.max(log) - F.min(log), F.lit(0.0)).alias(out))


def direction(value: Column) -> Column:
    """Aggregate: mixed, regular or clustered by how many scales lie above 1.05 and below 0.95."""
    above, below = F.count_if(value > 1.05), F.count_if(value < 0.95)
    return F.when((above > 0) & (below > 0), "mixed").when(below > above, "regular").otherwise("clustered")


def sign_change(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The first scale whose value and the next one's have opposite signs, null if none."""
    after = F.lead(value).over(W.Window.partitionBy(*keys).orderBy("scale_idx"))
    marked = rows.withColumn("_c", F.when(F.col(value) * after < 0, F.struct("scale_idx", "um")))
    return marked.groupBy(*keys).agg(F.min("_c")["um"].alias(out))


def excess_sigma(value: Column, mean: Column, sd: Column) -> Column:
    """Aggregate: the largest distance from the null in its deviations, which count as 1e-10 at least."""
    return F.max(F.abs(value - mean) / F.when(sd > 1e-10, sd).otherwise(1e-10))


def array_of(value: str) -> Column:
    """Aggregate: a curve as an array in the order of scales."""
    return F.transform(F.sort_array(F.collect_list(F.struct("scale_idx", value))), lambda s: s[value])
