"""Order statistics of tables of any size: exact quantiles of groups and ranks with ties, without a group or the whole in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources.scratch import cut

#: Buckets that an interval of values is cut into in a round, and how many values are few enough to be sorted as one row.
BUCKETS, FEW = 4096, 4096


def _ranked(rows: DataFrame, probs: list[float]) -> DataFrame:
    """(g, n, lo, hi) of groups to the wanted ranks (g, rank, lo, hi, before, k): those on both sides of each share of n - 1, from 0."""
    at = F.array(*[F.lit(float(p)) for p in probs])
    both = F.flatten(F.transform(at, lambda p: F.array(F.floor(p * (F.col("n") - 1)), F.ceil(p * (F.col("n") - 1)))))
    return rows.select("g", F.explode(F.array_distinct(both)).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("k"))


def _bucket(buckets: int) -> Column:
    """Which of ``buckets`` parts of (lo, hi) a value v is in; lo is in the first and hi in the last, so an interval of two values or more always comes apart."""
    lo, hi, v = F.col("lo"), F.col("hi"), F.col("v")
    width = hi / 2 - lo / 2  # halves, since the whole width may be beyond a double
    usual = (width > 0) & (width < float("inf"))
    share = (v / 2 - lo / 2) / F.when(usual, width)
    return F.when(v == lo, 0).when(v == hi, buckets - 1).when(usual, F.least(F.floor(share * buckets), F.lit(buckets - 1))).otherwise(buckets // 2).cast("int")


def selected(points: DataFrame, value: str, within: list[str], probs: list[float], few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """(g, n, rank, v): for each group the values at the ranks that ``probs`` need, by narrowing intervals.

    ``g`` is a struct of the ``within`` columns; null values and those that are not
    numbers are left out. A round counts the values of each open interval in buckets of
    equal width, partly before any exchange, and a rank's next interval is the smallest
    and largest value that its bucket really holds; so each round divides a range by the
    number of buckets, or by more where values cluster. A rank is found when its interval
    is one value, or holds so few that they are sorted as one row. Only values in open
    intervals are read on in the next round.
    """
    v = F.col(value).cast("double")
    data = points.select(F.struct(*within).alias("g"), v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    sizes = cut(data.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile-sizes")
    wanted, found = _ranked(sizes, probs), []
    within_span = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    while True:
        found.append(wanted.where("lo = hi").select("g", "rank", F.col("lo").alias("v")))
        small = wanted.where((F.col("lo") < F.col("hi")) & (F.col("k") <= few))
        values = data.join(small.select("g", "lo", "hi").distinct(), "g").where(within_span).groupBy("g", "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("all"))
        found.append(cut(small.join(values, ["g", "lo", "hi"]).select("g", "rank", F.get("all", (F.col("rank") - F.col("before")).cast("int")).alias("v")), "quantile-found"))
        todo = wanted.where((F.col("lo") < F.col("hi")) & (F.col("k") > few))
        if todo.isEmpty():
            break
        # a group's open intervals, which do not overlap, in one row
        spans = todo.groupBy("g").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
        span = F.get(F.filter("spans", lambda s: (F.col("v") >= s["lo"]) & (F.col("v") <= s["hi"])), F.lit(0))
        held = cut(data.join(spans, "g").withColumn("s", span).where("s is not null").select("g", "v", "s.lo", "s.hi"), "quantile-values")
        counts = held.groupBy("g", "lo", "hi", _bucket(buckets).alias("b")).agg(F.count("*").alias("k"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("k").over(W.Window.partitionBy("g", "lo", "hi").orderBy("b"))
        place = F.col("rank") - F.col("before")
        new = todo.drop("k").join(counts.withColumn("upto", upto), ["g", "lo", "hi"]).where((place < F.col("upto")) & (place >= F.col("upto") - F.col("k")))
        wanted = cut(new.select("g", "rank", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("before") + F.col("upto") - F.col("k")).alias("before"), "k"), "quantile-ranks")
        data = held.select("g", "v")
    return reduce(DataFrame.unionByName, found).join(sizes.select("g", "n"), "g")


def quantiles(points: DataFrame, value: str, within: list[str], probs: list[float], out: str = "q", few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """(within, n, ``out``): the exact quantiles of each group at ``probs``, interpolated between neighbouring values, as an array.

    No group's values stand in one buffer: see ``selected``. Groups without a value drop.
    """
    rows = selected(points, value, within, probs, few, buckets)
    by = rows.groupBy("g").agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def one(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.element_at("at", F.floor(place)), F.element_at("at", F.ceil(place))
        return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return by.select("g.*", "n", F.array(*[one(p) for p in probs]).alias(out))


def average_ranks(rows: DataFrame, value: str, out: str, share: int = 50_000) -> DataFrame:
    """``rows`` with the rank of ``value`` from 1, equal values sharing their average rank; null and not-a-number get none.

    Values are counted first, so ties are one row. Their order comes from ranges: Spark
    cuts the different values into ranges of about ``share`` by a sample, each range is
    summed up in its place, and a short table of ranges, one row each, gives every range
    what lies before it. Neither a window over all rows nor a sort in one task is needed.
    """
    v = F.col(value).cast("double")
    clean = F.when(v.isNotNull() & ~F.isnan(v), v + F.lit(0.0))  # one zero
    counts = rows.select(clean.alias("_v")).where("_v is not null").groupBy("_v").agg(F.count("*").alias("_k"))
    places = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = cut(counts.repartitionByRange(places, "_v").withColumn("_p", F.spark_partition_id()), "ranks-counts")
    # within a range by finer steps of its own width, so that no window holds more than about ``share`` values
    size = ranges.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    step = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * F.ceil(F.col("_n") / F.lit(share)))).otherwise(0)
    fine = ranges.join(F.broadcast(size), "_p").select("_v", "_k", "_p", step.cast("long").alias("_b"))
    sums = fine.groupBy("_p", "_b").agg(F.sum("_k").alias("_s"))
    parts = sums.groupBy("_p").agg(F.sum("_s").alias("_t"))
    before = F.coalesce(F.sum("_t").over(W.Window.orderBy("_p").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    inner = F.coalesce(F.sum("_s").over(W.Window.partitionBy("_p").orderBy("_b").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.withColumn("_i", inner).join(F.broadcast(parts.withColumn("_o", before).select("_p", "_o")), "_p").select("_p", "_b", (F.col("_i") + F.col("_o")).alias("_base"))
    upto = F.sum("_k").over(W.Window.partitionBy("_p", "_b").orderBy("_v"))
    ranks = fine.withColumn("_u", upto).join(base, ["_p", "_b"]).select("_v", (F.col("_base") + F.col("_u") - (F.col("_k") - 1) / 2.0).alias(out))
    return rows.withColumn("_v", clean).join(ranks, "_v", "left").drop("_v")


def prefix_sums(rows: DataFrame, by: list[str], sums: dict[str, str]) -> DataFrame:
    """``rows`` with, for each new column, the sum of another over all rows that come before in the order of ``by``, which tells rows apart.

    Rows go by ranges of the order; each range is summed up in its place, and a table of
    one row for each range gives what lies before it.
    """
    if not by:
        return rows.withColumns({new: F.lit(0).cast("long") for new in sums})
    places = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(rows.repartitionByRange(places, *by).withColumn("_p", F.spark_partition_id()), "prefix-sums")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    ranges = placed.groupBy("_p").agg(*[F.sum(old).alias(f"_s{new}") for new, old in sums.items()])
    ranges = ranges.select("_p", *[before(f"_s{new}", W.Window.orderBy("_p")).alias(f"_o{new}") for new in sums])
    inner = W.Window.partitionBy("_p").orderBy(*by)
    out = placed.withColumns({f"_i{new}": before(old, inner) for new, old in sums.items()}).join(F.broadcast(ranges), "_p")
    return out.select(*[c for c in rows.columns], *[(F.col(f"_i{new}") + F.col(f"_o{new}")).alias(new) for new in sums])
