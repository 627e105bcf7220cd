"""Pairs of points within a distance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut

#: Points up to which a cell is not divided, and how often a square as wide as the largest radius can be, by four along each axis.
LEAF, DEPTH = 32, 8
#: Points of a square up to which all points of neighbouring squares are compared, some 80 million comparisons for a square.
FLAT = 4096
_STEPS = ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))


def _d2(ax: str, ay: str, bx: str, by: str) -> Column:
    return (F.col(ax) - F.col(bx)) * (F.col(ax) - F.col(bx)) + (F.col(ay) - F.col(by)) * (F.col(ay) - F.col(by))


def _dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` over a fixed number of places by the columns they are joined on: they are few and small, but each becomes very many in the join, so Spark should not merge the places."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _squares(points: DataFrame, wide: float, keys: list[str], depth: int) -> DataFrame:
    """Points with the cell at the finest level; a square at level 0 is a little wider than ``wide``, so rounding parts no pair."""
    step = wide * (1 + 1e-9) / 4**depth
    return points.select(*keys, "id", "x", "y", F.floor(F.col("x") / step).cast("long").alias("cx"), F.floor(F.col("y") / step).cast("long").alias("cy"))


def _meet(rows: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Each row of a square with each one of its own and the eight squares around it, a pair of squares once: the ``carried`` columns as a and b, and same (square)."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _STEPS])
    sent = rows.withColumn("s", F.explode(steps)).select(*keys, (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"), F.struct(*carried).alias("a"), ((F.col("s.dx") == 0) & (F.col("s.dy") == 0)).alias("same"))
    by = [*keys, "cx", "cy"]
    return _dealt(rows.select(*by, F.struct(*carried).alias("b")), by).join(_dealt(sent, by), by).select(*keys, "a", "b", "same")


def _flat(points: DataFrame, radii: list[float], keys: list[str]) -> DataFrame:
    """(keys, r0, r1, ...): every two points of neighbouring squares are compared, which is quadratic in the points of a square."""
    met = _meet(_squares(points, max(radii), keys, 0), keys, ["id", "x", "y"]).where(~F.col("same") | (F.col("a.id") < F.col("b.id")))
    near = met.withColumn("d2", _d2("a.x", "a.y", "b.x", "b.y")).where(F.col("d2") <= max(radii) ** 2)
    return near.groupBy(*keys).agg(*[F.count_if(F.col("d2") <= r * r).alias(f"r{i}") for i, r in enumerate(radii)])


def _judged(pairs: DataFrame, radii: list[float], keys: list[str]) -> DataFrame:
    """Pairs of cells (keys, a, b, same, open) with ``inside``, the radii (bits) that hold all their points' pairs, ``open``, those that hold some, and ``pairs``, their number.

    Bounds come from the boxes of the points that are there. Rounding is monotonic, so what
    is said of a box is said of every pair in it, as a comparison of the points would.
    """
    far = lambda c: F.greatest(F.col(f"a.{c}1") - F.col(f"b.{c}0"), F.col(f"b.{c}1") - F.col(f"a.{c}0"))
    gap = lambda c: F.greatest(F.col(f"a.{c}0") - F.col(f"b.{c}1"), F.col(f"b.{c}0") - F.col(f"a.{c}1"), F.lit(0.0))
    rows = pairs.withColumns({"_lo": gap("x") * gap("x") + gap("y") * gap("y"), "_hi": far("x") * far("x") + far("y") * far("y")})
    was = lambda i: F.col("open").bitwiseAND(1 << i) > 0
    bits = lambda test: sum((F.when(was(i) & test(r * r), 1 << i).otherwise(0) for i, r in enumerate(radii)), F.lit(0))
    n, m = F.col("a.n"), F.col("b.n")
    number = F.when(F.col("same"), F.expr("(a.n * (a.n - 1)) div 2")).otherwise(n * m)
    return rows.select(*keys, "a", "b", "same", bits(lambda q: F.col("_hi") <= q).alias("inside"), bits(lambda q: (F.col("_hi") > q) & (F.col("_lo") <= q)).alias("open"), number.alias("pairs"))


def _by_cells(points: DataFrame, radii: list[float], keys: list[str], leaf: int) -> DataFrame:
    """(keys, r0, r1, ...) by a tree of cells: see ``pair_counts``."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(DEPTH)))
    each = _squares(points, max(radii), keys, DEPTH).withColumn("l", levels).withColumns({c: F.expr(f"shiftright({c}, 2 * ({DEPTH} - l))") for c in ("cx", "cy")})
    own = ["l", "cx", "cy"]
    cells = each.groupBy(*keys, *own).agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))])
    cells = cut(cells.withColumns({"whole": (F.col("n") <= leaf) | (F.col("l") == DEPTH), "px": F.shiftright("cx", 2), "py": F.shiftright("cy", 2)}), "cells")
    divided = cells.where("not whole").select(*keys, (F.col("l") + 1).alias("l"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    nodes = cut(cells.where("l = 0").unionByName(cells.where("l > 0").join(divided, [*keys, "l", "px", "py"], "left_semi").select(*cells.columns)), "nodes")
    carried = [*own, "n", "x0", "x1", "y0", "y1", "whole"]
    # what takes a cell's place when a pair is divided: its parts, or the cell itself if it has none
    parts = nodes.where("l > 0").select(*keys, (F.col("l") - 1).alias("l"), F.col("px").alias("cx"), F.col("py").alias("cy"), F.struct(*carried).alias("to"))
    parts = parts.unionByName(nodes.where("whole").select(*keys, *own, F.struct(*carried).alias("to")))
    pairs, rounds = _meet(nodes.where("l = 0"), keys, carried).withColumn("open", F.lit((1 << len(radii)) - 1)), []
    both = F.col("a.whole") & F.col("b.whole")
    while True:
        rounds.append(cut(_judged(pairs, radii, keys), "pairs"))
        todo = rounds[-1].where((F.col("open") > 0) & ~both)
        if todo.isEmpty():
            break
        for side in "ab":
            todo = _dealt(todo.withColumns({c: F.col(f"{side}.{c}") for c in own}), [*keys, *own]).join(parts, [*keys, *own]).withColumn(side, F.col("to")).drop("to", *own)
        place = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in own])
        pairs = todo.where(~F.col("same") | (place("a") <= place("b"))).withColumn("same", F.col("same") & (place("a") == place("b"))).select(*keys, "a", "b", "same", "open")
    every = reduce(DataFrame.unionAll, rounds)
    bit = lambda c, i: F.col(c).bitwiseAND(1 << i) > 0
    names = [f"r{i}" for i in range(len(radii))]
    sums = every.where("inside > 0").groupBy(*keys).agg(*[F.sum(F.when(bit("inside", i), F.col("pairs")).otherwise(0)).alias(n) for i, n in enumerate(names)])
    # pairs of cells on the edge of a radius: their points
    placed = each.join(nodes.where("whole").select(*keys, *own), [*keys, *own]).select(*keys, *own, F.struct("id", "x", "y").alias("p"))
    edge = every.where((F.col("open") > 0) & both)
    for side in "ab":
        edge = _dealt(edge.withColumns({c: F.col(f"{side}.{c}") for c in own}), [*keys, *own]).join(placed, [*keys, *own]).withColumn(side, F.struct(f"{side}.l", F.col("p.id").alias("id"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))).drop("p", *own)
    met = edge.where(~F.col("same") | (F.col("a.id") < F.col("b.id"))).withColumn("d2", _d2("a.x", "a.y", "b.x", "b.y"))
    near = met.groupBy(*keys).agg(*[F.count_if(bit("open", i) & (F.col("d2") <= r * r)).alias(n) for i, (n, r) in enumerate(zip(names, radii, strict=True))])
    return sums.unionByName(near).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def pair_counts(points: DataFrame, radii: list[float], keys: list[str], leaf: int = LEAF, flat: int = FLAT) -> DataFrame:
    """(keys, radius, pairs): unordered pairs no farther apart than each radius; exact, whatever the points' places.

    Points fall into squares as wide as the largest radius, and only neighbouring squares
    meet. Where no square holds more than ``flat`` points, these are compared. Else squares are divided,
    by four along each axis, until a cell has ``leaf`` points or fewer: two cells wholly
    within a radius add the product of their counts, wholly beyond it nothing, and only
    pairs on its edge are divided further and come down to points in the end. A round
    divides all open pairs in one plan; rows are pairs of cells, dealt by cell, so a dense
    square is spread over as many places as it has cells.
    """
    wide = max(radii)
    most = _squares(points, wide, keys, 0).groupBy(*keys, "cx", "cy").count().agg(F.max("count")).first()[0] or 0
    counts = _flat(points, radii, keys) if most <= flat else _by_cells(points, radii, keys, leaf)
    each = F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.col(f"r{i}").alias("pairs")) for i, r in enumerate(radii)])
    return counts.select(*keys, F.explode(each).alias("e")).select(*keys, "e.radius", "e.pairs")
