"""Null models: label shuffles, uniform points in a hull or box, smoothed bootstraps, resamples, jitter.

Every draw is a function of (mock, id) by ``functions.chance``, so plans can be
recomputed anywhere. Ranks of whole tables are found without a global sort: rows
are dealt into buckets by the first hex digits of their random key, ranked in
their bucket, and the small table of bucket sizes gives each bucket's base.

Points are ranked once for all label shuffles. A mock permutes the ranks by
arithmetic alone: ranks fill a grid row by row, whose last row may be short; each
round moves every row, or every column, round by a random amount, which tabulation
hashing gives: a row's number has two digits, and two small tables of random numbers
are added up. That is a permutation of exactly the ranks there are, so no mock sorts
or exchanges anything, and labels come from the runs that equal labels form in
sorted order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import chance
from ..sources.scratch import cut
from . import order
from .grid import Roi
from .packed import CHUNK, occupied, pack, places


def ranked(rows: DataFrame, order: Column, keys: list[str], digits: int = 2, out: str = "k") -> DataFrame:
    """Rank from 1 by (``order``, id) within ``keys``; ``order`` is a hexadecimal string, evenly spread."""
    marked = rows.withColumn("_o", order).withColumn("_b", F.substring("_o", 1, digits))
    sizes = marked.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = W.Window.partitionBy(*keys).orderBy("_b").rowsBetween(W.Window.unboundedPreceding, -1)
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.Window.partitionBy(*keys, "_b").orderBy("_o", "id"))
    return marked.withColumn("_r", inside).join(base, [*keys, "_b"]).withColumn(out, F.col("_r") + F.col("_base")).drop("_o", "_b", "_r", "_base")


def mocks(rows: DataFrame, n: int, out: str = "mock_id") -> DataFrame:
    """Each row once for each of ``n`` mocks."""
    return rows.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


#: Rounds of a permutation.
ROUNDS = 4
#: Points of a task that works out the labels of all mocks, where there are more points than tasks need.
PART = 1 << 19


def _digits(n: int) -> int:
    """Hex digits that cut ``n`` random keys into buckets of some 50,000."""
    return max(1, (max(n, 1) // 50_000).bit_length() // 4 + 1)


_SHAPE = ("_wide", "_high", "_rest", "_rows", "_columns")


def layout(points: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """(by, n, _wide, _high, _rest, _rows, _columns, _kinds, _upto) of each stratum, and the size of the random tables.

    The points of a stratum fill a grid of ranks of ``_wide`` columns, ``_high`` whole
    rows and ``_rest`` points in one more; ``_rows`` and ``_columns`` count those of the
    strata before it. ``_kinds`` are its types in order and ``_upto`` how many points have
    these or earlier ones. All this stays a table, however many strata there are.
    """
    counts = points.groupBy(*by, "type").agg(F.count("*").alias("n"))
    shapes = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("type", "n"))).alias("_t"))
    wide = F.ceil(F.sqrt("n")).cast("int")
    shapes = shapes.withColumn("_wide", wide).withColumns({"_high": F.expr("int(n div _wide)"), "_rest": F.expr("int(n % _wide)"), "_tall": F.ceil(F.col("n") / F.col("_wide"))})
    upto = F.transform(F.sequence(F.lit(1), F.size("_t")), lambda i: F.aggregate(F.slice("_t", F.lit(1), i), F.lit(0).cast("long"), lambda total, x: total + x["n"]))
    shapes = shapes.select(*by, "n", "_wide", "_high", "_rest", "_tall", F.transform("_t", lambda x: x["type"]).alias("_kinds"), upto.alias("_upto"))
    shapes = order.prefix_sums(shapes, by, {"_rows": "_tall", "_columns": "_wide"})
    shapes = cut(shapes.withColumns({c: F.col(c).cast("int") for c in ("_rows", "_columns")}), "strata")
    most = shapes.agg(F.greatest(F.sum("_tall"), F.sum("_wide"))).first()[0] or 0
    return shapes.drop("_tall"), isqrt(most) + 1


def _whole(points: DataFrame) -> tuple[dict[str, int], list[tuple], int]:
    """The same for one stratum of all points: its shape, the types with their counts and the size of the tables. The driver sees a row for each type."""
    runs = sorted((r["type"], r["n"]) for r in points.groupBy("type").agg(F.count("*").alias("n")).collect())
    n = sum(k for _, k in runs)
    wide = isqrt(max(n - 1, 0)) + 1
    return dict(zip(_SHAPE, (wide, n // wide, n % wide, 0, 0), strict=True)), runs, isqrt(max(-(-n // wide), wide)) + 1


#: Rows of a batch that a task sends on.
SENT = 1 << 16


def shuffled(points: DataFrame, n_mocks: int, stratum: str | None = None, salt: str = "") -> DataFrame:
    """(mock_id, id, x, y[, z, stratum], type): the labels permuted over the points, in each stratum by itself if there is one.

    Ids are unique, types not null. Each mock has the same number of every label (in
    every stratum). Points without a stratum keep their labels. Strata are a table that
    is joined to the points by stratum; the driver sees the names of the types. A task
    takes a chunk of ranked points and sends its rows of one mock after the other, with
    all columns of ``points``, so leave out those that are not needed.
    """
    columns = [c for c in points.columns if c != "type"]
    spread, every, labels = _dealt(points, columns, stratum, salt)
    kind = to_arrow_type(points.schema["type"].dataType)

    def rows(chunk: pa.Table, known: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        names, label = pa.array(every, kind), labels(chunk, known)
        own = [chunk[c].combine_chunks() for c in columns]
        for mock in range(n_mocks):
            code = label(mock)
            for n in range(0, len(code), SENT):
                some = code[n : n + SENT]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), mock, np.int32)), *[c.slice(n, SENT) for c in own], names.take(pa.array(some))], ["mock_id", *columns, "type"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*columns, "type").schema)
    return spread.mapInArrow(lambda batches: _by_chunks(batches, rows), f"mock_id int, {fields}")


class Strata:
    """The rows and columns of the grids of ranks of some strata, numbered through: what a permutation needs to know of them, once for all mocks."""

    def __init__(self, shape: dict[str, np.ndarray]) -> None:
        wide, high, rest, rows, columns = (np.asarray(shape[c], np.int64) for c in _SHAPE)
        tall = high + (rest > 0)
        self.wide, self.row_base, self.column_base = wide, np.cumsum(tall) - tall, np.cumsum(wide) - wide
        own = np.repeat(np.arange(len(wide)), tall)
        at = np.arange(len(own)) - self.row_base[own]
        self.row_number, self.row_wide = rows[own] + at, np.where(at < high[own], wide[own], rest[own])
        own = np.repeat(np.arange(len(wide)), wide)
        at = np.arange(len(own)) - self.column_base[own]
        self.column_number, self.column_high = columns[own] + at, high[own] + (at < rest[own])

    def start(self, rank: np.ndarray, own: np.ndarray | int = 0) -> tuple[np.ndarray, ...]:
        """Row, column, width, first row and first column of points of these ranks (from 0, in their stratum, the ``own`` one of these), the same for all mocks."""
        wide, rows, columns = (a[own] for a in (self.wide, self.row_base.astype(np.int32), self.column_base.astype(np.int32)))
        u = rank // wide
        return u.astype(np.int32), (rank - u * wide).astype(np.int32), wide, rows, columns


@dataclass(frozen=True)
class Moves:
    """The random tables of all mocks, worked out where they are used, and the permutations they make of ranks."""

    salt: str
    size: int

    def amounts(self, mock: int) -> list[np.ndarray]:
        draw = lambda r, j: int(hashlib.md5(f"{self.salt}|{mock}|{r}|{j}".encode()).hexdigest()[:7], 16)
        return [np.array([draw(r, j) for j in range(2 * self.size)], dtype=np.int64) for r in range(ROUNDS)]

    def places(self, tables: list[np.ndarray], strata: Strata, start: tuple[np.ndarray, ...]) -> np.ndarray:
        """Where points (``strata.start`` of their ranks) go in a mock, as ranks (from 0) of their stratum.

        All points of a row, or column, move by one amount, so amounts and ends are looked
        up by its number; none is divided by for a point.
        """
        u, v, wide, rows, columns = start
        for r, t in enumerate(tables):
            # a row's number, or a column's, has two digits, each with a random number of its own
            number, ends = (strata.column_number, strata.column_high) if r % 2 else (strata.row_number, strata.row_wide)
            tens, ones = np.divmod(number, self.size)
            amount = ((t[ones] + t[self.size + tens]) % np.maximum(ends, 1)).astype(np.int32)
            line = columns + v if r % 2 else rows + u
            end = ends.astype(np.int32)[line]
            moved = amount[line]
            moved += u if r % 2 else v
            np.subtract(moved, end, out=moved, where=moved >= end)
            u, v = (moved, v) if r % 2 else (u, moved)
        return u * wide + v


def _tasks(spark: SparkSession, total: int) -> int:
    """Tasks for few rows with the work of all mocks; the more points a task has, the fewer counts it sends for each."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2 * spark.sparkContext.defaultParallelism, -(-total // PART)))


def _dealt(points: DataFrame, columns: list[str], stratum: str | None, salt: str) -> tuple[DataFrame, list, Callable]:
    """Points ranked and dealt over tasks with these columns, the names of the types, and what gives a chunk its labels.

    ``labels(chunk, known)`` is for use in a task; it gives a function of a mock, whose
    result is each point's place among the names (mock -1: its real one). ``known`` keeps
    random tables from one chunk to the next.
    """
    by = [stratum] if stratum else []
    rows = points.select("id", "type", *[c for c in dict.fromkeys([*columns, *by]) if c != "id"])
    free = rows.where(F.col(stratum).isNotNull()) if by else rows
    total = points.count()
    # rows and columns are about the square root of the points, so integers hold them
    ranks = ranked(free, chance.key(f"{salt}-1", F.col("id")), by, _digits(total))
    if by:
        shapes, size = layout(free, by)
        carried = [*_SHAPE, "_kinds", "_upto"]
        ranks = ranks.join(shapes.drop("n"), by).select("k", *columns, "type", *carried)
        # a point without a stratum is alone in one, so it keeps its label
        alone = dict(zip(_SHAPE, (1, 1, 0, 0, 0), strict=True))
        ranks = ranks.unionByName(rows.where(F.col(stratum).isNull()).select(F.lit(1).cast("long").alias("k"), *columns, "type", *[F.lit(v).cast("int").alias(c) for c, v in alone.items()], F.array("type").alias("_kinds"), F.array(F.lit(1).cast("long")).alias("_upto")))
        every = sorted(r["type"] for r in rows.select("type").distinct().collect())
    else:
        whole, runs, size = _whole(points)
        ranks = ranks.select("k", *columns, "type")
        every, ends = [t for t, _ in runs], np.cumsum([n for _, n in runs], dtype=np.int64)
    kind, moves = to_arrow_type(points.schema["type"].dataType), Moves(salt, size)
    spread = ranks.repartition(_tasks(points.sparkSession, total))

    def labels(chunk: pa.Table, known: dict[int, list[np.ndarray]]) -> Callable[[int], np.ndarray]:
        names = pa.array(every, kind)
        real, rank = pc.index_in(chunk["type"], names).to_numpy().astype(np.int64), chunk["k"].to_numpy() - 1
        if by:
            # a stratum's shape and runs once for all its points here; a stratum of one point, which keeps its label, is as good as any other such
            shape = {c: chunk[c].to_numpy().astype(np.int64) for c in _SHAPE}
            alone = shape["_wide"] * shape["_high"] + shape["_rest"] == 1
            _, first, own = np.unique(np.where(alone, -1, shape["_rows"]), return_index=True, return_inverse=True)
            runs_of = chunk.select(["_kinds", "_upto"]).take(pa.array(first))
            kinds, upto = (runs_of[c].combine_chunks() for c in ("_kinds", "_upto"))
            codes, upto, many = pc.index_in(kinds.flatten(), names).to_numpy().astype(np.int64), upto.flatten().to_numpy(), np.diff(kinds.offsets.to_numpy())
            shape = {c: v[first] for c, v in shape.items()}
            # one rising line of all strata's runs: a stratum's places are set behind those of the strata before it
            ends_of = np.cumsum(shape["_wide"] * (shape["_high"] + 1))
            behind = np.concatenate([[0], ends_of])[:-1]
            line, behind = upto + np.repeat(behind, many), behind[own]
        else:
            shape, own = {c: np.array([v]) for c, v in whole.items()}, 0
        strata = Strata(shape)
        start = strata.start(rank, own)

        def label(mock: int) -> np.ndarray:
            if mock < 0:
                return real
            if mock not in known:
                known[mock] = moves.amounts(mock)
            place = moves.places(known[mock], strata, start)
            if by:
                return np.where(alone, real, codes[np.searchsorted(line, behind + place, side="right")])
            return np.searchsorted(ends, place, side="right")

        return label

    return spread, every, labels


def _by_chunks(batches: Iterator[pa.RecordBatch], work: Callable) -> Iterator[pa.RecordBatch]:
    """``work(chunk, known)`` for every ``CHUNK`` points of a task."""
    held: list[pa.RecordBatch] = []
    known: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield from work(pa.Table.from_batches(held), known)
            held = []
    if held and sum(b.num_rows for b in held):
        yield from work(pa.Table.from_batches(held), known)


def shuffled_pixels(points: DataFrame, roi: Roi, n_mocks: int, stratum: str | None = None, salt: str = "", offsets: list[tuple[float, ...]] | None = None) -> DataFrame:
    """(trial, mock_id, type, px, c): packed pixel counts (``operators.packed``) of the real labels (mock -1) and of ``n_mocks`` shuffles of them.

    The shuffles are those of ``shuffled``, but no row is made for a point in a mock:
    points are ranked, each task takes a chunk of them and works out the labels of all
    mocks in turn, and what leaves it are counts. With strata, each point brings along the
    shape of its stratum and its runs of labels. ``offsets``: shifts of the grid's origin,
    one for each trial, each with mocks of its own. The driver sees the names of the types.
    """
    axes = list(roi.axes)
    shifts = offsets if offsets is not None else [(0.0,) * len(axes)]
    spread, every, labels = _dealt(points, axes, stratum, salt)
    kind, cells = to_arrow_type(points.schema["type"].dataType), roi.grid ** len(axes)

    def count(chunk: pa.Table, known: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        xyz = [chunk[a].to_numpy().astype(np.float64) for a in axes]
        label = labels(chunk, known)
        for trial, shift in enumerate(shifts):
            at = places(roi, xyz, shift)
            found: dict[str, list] = {"mock_id": [], "type": [], "px": [], "c": []}
            for mock in range(-1, n_mocks):
                code = label(trial * n_mocks + mock if mock >= 0 else mock)
                key, n = occupied(code * np.int64(cells) + at, len(every) * cells)
                edge = np.searchsorted(key, np.arange(len(every) + 1) * cells)
                for t in np.flatnonzero(np.diff(edge)):
                    px, c = pack(key[edge[t] : edge[t + 1]] - t * cells, n[edge[t] : edge[t + 1]], cells)
                    for name, value in zip(found, (mock, every[t], px, c), strict=True):
                        found[name].append(value)
            yield pa.RecordBatch.from_pydict({"trial": pa.array([trial] * len(found["px"]), pa.int32()), "mock_id": pa.array(found["mock_id"], pa.int32()), "type": pa.array(found["type"], kind), "px": pa.array(found["px"], pa.binary()), "c": pa.array(found["c"], pa.binary())})

    return spread.mapInArrow(lambda batches: _by_chunks(batches, count), f"trial int, mock_id int, type {points.schema['type'].dataType.simpleString()}, px binary, c binary")


def with_real(points: DataFrame, drawn: DataFrame) -> DataFrame:
    """The real labels as mock -1, and the mocks."""
    return points.withColumn("mock_id", F.lit(-1)).select(*drawn.columns).unionByName(drawn)


def convex_hull(points: DataFrame) -> list[tuple[float, float]]:
    """Vertices of the hull, counterclockwise.

    Each task keeps only the hull of its own batches (a hull's points are hull points
    of their part), so the driver gets few rows for each task.
    """

    def run(batches):
        held: list[tuple[float, float]] = []
        import pandas as pd

        for pdf in batches:
            xy = _beyond(held, pdf["x"].to_numpy(), pdf["y"].to_numpy())
            held = _hull([*held, *zip(*(a.tolist() for a in xy), strict=True)])
        yield pd.DataFrame(held, columns=["x", "y"])

    rows = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna().mapInPandas(run, "x double, y double").collect()
    return _hull([(r["x"], r["y"]) for r in rows])


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Andrew's monotone chain."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(seq: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def _beyond(hull: list[tuple[float, float]], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points that are not clearly within the hull."""
    if len(hull) < 3:
        return x, y
    inner, least = np.ones(len(x), bool), 1e-9 * hull_area(hull)
    for (ax, ay), (bx, by) in zip(hull, [*hull[1:], hull[0]], strict=True):
        inner &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) > least
    return x[~inner], y[~inner]


def hull_area(hull: list[tuple[float, float]]) -> float:
    x, y = np.array(hull).T if hull else (np.zeros(1), np.zeros(1))
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def in_hull(hull: list[tuple[float, float]], x: Column, y: Column) -> Column:
    """Whether a point is on no edge's outer side."""
    if len(hull) < 3:
        return F.lit(False)
    inner = [F.lit(b[0] - a[0]) * (y - a[1]) - F.lit(b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(hull, [*hull[1:], hull[0]], strict=True)]
    return reduce(Column.__and__, inner)


def _in_fan(hull: list[tuple[float, float]], n_mocks: int, salt: str) -> Callable[[np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """(mock, x, y) for ids, mock by mock: a draw picks a triangle of the hull's fan by area, two more a place in it, so none is drawn in vain."""
    if hull_area(hull) <= 0:
        raise ValueError("the hull has no area")
    (ax, ay), fan = hull[0], np.array(list(zip(hull[1:], hull[2:], strict=False)))
    (bx, by), (cx, cy) = fan[:, 0].T, fan[:, 1].T
    areas = (np.abs((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) / 2).tolist()
    limits = [a / sum(areas) for a in accumulate(areas)][:-1]

    def draw(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for mock in range(n_mocks):
            u, r, s = (chance.uniforms(ids, f"{salt}|{mock}|", f"|{k}") for k in "trs")
            t, r = np.searchsorted(limits, u, side="right"), np.sqrt(r)
            yield mock, ax + r * (bx[t] - ax + s * (cx[t] - bx[t])), ay + r * (by[t] - ay + s * (cy[t] - by[t]))

    return draw


def uniform_in_hull(spark: SparkSession, hull: list[tuple[float, float]], n: int, n_mocks: int, salt: str = "csr") -> DataFrame:
    """(mock_id, id, x, y): ``n`` uniform points of the hull for each mock, drawn in arrays. A hull without area is refused."""
    draw = _in_fan(hull, n_mocks, salt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mock, x, y in draw(batch.column("id").to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), mock, np.int32)), batch.column("id"), pa.array(x), pa.array(y)], ["mock_id", "id", "x", "y"])

    return spark.range(0, n, 1, _tasks(spark, n)).mapInArrow(run, "mock_id int, id long, x double, y double")


def uniform_pixels(spark: SparkSession, hull: list[tuple[float, float]], n: int, n_mocks: int, roi: Roi, salt: str = "csr") -> DataFrame:
    """(mock_id, px, c): packed pixel counts of the points of ``uniform_in_hull``. Tasks count as they draw, so no row is made for a point; a task holds a grid for each mock."""
    draw, cells = _in_fan(hull, n_mocks, salt), roi.grid**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = np.zeros((n_mocks, cells), np.int64)
        for batch in batches:
            for mock, x, y in draw(batch.column("id").to_numpy()):
                np.add.at(grids[mock], places(roi, [x, y]), 1)
        rows = [(mock, pack(at, g[at], cells)) for mock, g in enumerate(grids) if len(at := np.flatnonzero(g))]
        yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in rows], pa.int32()), *[pa.array([r[k] for _, r in rows], pa.binary()) for k in (0, 1)]], ["mock_id", "px", "c"])

    return spark.range(0, n, 1, _tasks(spark, n)).mapInArrow(run, "mock_id int, px binary, c binary")


def acceptance(spark: SparkSession, hull: list[tuple[float, float]], tries: int = 10000, salt: str = "csr") -> DataFrame:
    """(tried, accepted, rate) of uniform points of the hull's box that fall into the hull."""
    x, y = np.array(hull).T
    u, v = (F.lit(float(a.min())) + F.lit(float(np.ptp(a))) * chance.uniform(salt, 0, F.col("id"), n) for a, n in ((x, "x"), (y, "y")))
    at = spark.range(tries).select(u.alias("u"), v.alias("v"))
    return at.agg(F.count("*").alias("tried"), F.count_if(in_hull(hull, F.col("u"), F.col("v"))).alias("accepted")).withColumn("rate", F.col("accepted") / F.col("tried"))


def bandwidth(points: DataFrame, dims: int = 2) -> DataFrame:
    """(n, bandwidth): Silverman's rule with the mean of the axes' population deviations."""
    sd = (F.stddev_pop("x") + F.stddev_pop("y")) / 2
    row = points.agg(F.count("*").alias("n"), sd.alias("sd"))
    return row.select("n", (F.col("sd") * F.pow(F.col("n") * (dims + 2) / 4.0, F.lit(-1.0 / (dims + 4)))).alias("bandwidth"))


def first_by_chance(points: DataFrame, n: int, salt: str = "sub") -> DataFrame:
    """``n`` points without replacement (all, if there are no more): those with the smallest random keys.

    Points are counted by the first digits of their keys, and only the groups that hold
    the first ``n`` are ranked, so no task sorts more than a group; the driver sees one row.
    """
    digits = _digits(points.count())
    marked = points.withColumn("_key", chance.key(salt, F.col("id"))).withColumn("_group", F.substring("_key", 1, digits))
    sizes = marked.groupBy("_group").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.Window.orderBy("_group").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))  # a row for each group
    last = sizes.select("_group", before.alias("_before")).where(F.col("_before") < n).agg(F.max("_group")).first()[0] or ""
    return ranked(marked.where(F.col("_group") <= last), F.col("_key"), [], digits, "_rank").where(F.col("_rank") <= n).select(*points.columns)


#: Draws that a task joins with their points, where there are more than the tasks need.
DRAWS = 1 << 21


def smoothed_bootstrap(points: DataFrame, n: int, n_mocks: int, salt: str = "kde") -> DataFrame:
    """(mock_id, id, x, y): draws from a Gaussian kernel density of all the points.

    Tasks work out in arrays the rank of the point that each draw starts from and how far
    off it falls; a join by rank fetches the point. The points are written once, so Spark
    knows whether they are few enough to be sent to all tasks; if not, a task of the join
    takes about ``DRAWS``. Spark cannot know the number of the draws, so the join is an
    outer one, where these are never sent; each has its point.
    """
    spark = points.sparkSession
    row = bandwidth(points).first()
    size, width = row["n"], float(row["bandwidth"] or 0.0)
    base = cut(ranked(points.select("id", "x", "y"), chance.key(salt, F.col("id")), [], _digits(size)).select("k", "x", "y"), "kde-base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for mock in range(n_mocks):
                k = np.floor(chance.uniforms(ids, f"{salt}|{mock}|", "|pick") * size).astype(np.int64) + 1
                off = [pa.array(width * chance.normals(ids, f"{salt}|{mock}|", f"|{a}")) for a in "xy"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), mock, np.int32)), batch.column("id"), pa.array(k), *off], ["mock_id", "id", "k", "_dx", "_dy"])

    n = n if size else 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * n_mocks // DRAWS))
    draws = spark.range(0, n, 1, _tasks(spark, n)).mapInArrow(run, "mock_id int, id long, k long, _dx double, _dy double")
    return draws.join(base.repartition(parts, "k"), "k", "left").select("mock_id", "id", *[(F.col(a) + F.col(f"_d{a}")).alias(a) for a in ("x", "y")])


def jitters(roi: Roi, n: int, salt: str = "jitter") -> list[tuple[float, ...]]:
    """Offsets of the origin for each trial, uniform within two pixels of the longest side."""
    reach = 2 * roi.extent / roi.grid
    draw = lambda t, a: int(hashlib.md5(f"{salt}|{t}|{a}".encode()).hexdigest()[:8], 16) / 2**32
    return [tuple(reach * (2 * draw(t, a) - 1) for a in roi.axes) for t in range(n)]


def resamples(curves: DataFrame, keys: list[str], n_boot: int, value: str = "vmr", salt: str = "boot") -> DataFrame:
    """(keys, boot, mock_id, scale_idx, value): for each key as many of its mocks as it has, drawn with replacement ``n_boot`` times, each key by draws of its own.

    ``curves`` (keys, mock_id from 0, scale_idx, value) hold the usable mocks of a key, which
    are picked by their rank among them; ``mock_id`` of the result numbers the draws.
    """
    order = W.Window.partitionBy(*keys).orderBy("mock_id")
    usable = curves.select(*keys, "mock_id").distinct().withColumn("_k", F.row_number().over(order).cast("long"))
    many = usable.groupBy(*keys).agg(F.count("*").alias("_n"))
    slots = many.withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("slot", F.explode(F.expr("sequence(0, cast(_n as int) - 1)")))
    picks = slots.withColumn("_k", F.floor(chance.uniform(salt, *[F.col(k) for k in keys], F.col("boot"), F.col("slot")) * F.col("_n")).cast("long") + 1)
    picked = picks.join(usable, [*keys, "_k"]).select(*keys, "boot", "slot", "mock_id")
    return picked.join(curves.select(*keys, "mock_id", "scale_idx", value), [*keys, "mock_id"]).select(*keys, "boot", F.col("slot").alias("mock_id"), "scale_idx", value)
