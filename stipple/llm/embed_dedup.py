"""Near-duplicate vectors by int8 tile products with error bounds.

Vectors are scaled to unit length and cut into tiles. A vector u is quantised to
q = round(u / s) with s = max|u| / 127 for each vector, and e = |u - s q| is kept. For two vectors
u.v = s t (q.r) + (u - s q).(t r) + u.(v - t r), so the true cosine is at most
s t (q.r) + e |t r| + |u| f: the integer product plus a bound that both
vectors carry. Only pairs whose bound reaches the threshold are computed again in
double precision from the given components. Tiles hold vectors that lie near
each other, and a pair of tiles whose centres are too far apart for any of its
pairs to link is never joined. Where nothing can be told from the centres (vectors
that point anywhere) all pairs of tiles are multiplied; so that few copies of a
vector travel then, a tile is as large as a task holds and is multiplied block by
block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .simhash import local_stars
from .store import cut, parts, table

#: Cells, the most rows of their statistics that the driver sees.
MAX_CELLS = 4096
TILE_BYTES = 16 << 20
TILE_ROWS = 65536
BLOCK = 2048
EXACT_DIMS = 1024  # products of int8 values summed in float32 are exact up to 1040 dimensions
SLACK = 1e-6  # beyond rounding of the float32 bounds below


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q int8, scale, error) of unit rows; ``error`` is |u - scale q| or a little more."""
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - scale[:, None] * q, axis=1) + 1e-12


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to between 1/2 and 1, so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 values, exact before it becomes float32."""
    parts_ = [a[:, k : k + EXACT_DIMS].astype(np.float32) @ b[:, k : k + EXACT_DIMS].astype(np.float32).T for k in range(0, a.shape[1], EXACT_DIMS)]
    return parts_[0] if len(parts_) == 1 else sum(p.astype(np.float64) for p in parts_).astype(np.float32)


class Side:
    """A tile's vectors, quantised, with the middle and radius of each block."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = scaled(x)
        self.norm = np.linalg.norm(self.x, axis=1)
        self.q, self.scale, self.error = quantise(self.x / self.norm[:, None])
        self.blocks = [slice(at, at + BLOCK) for at in range(0, len(x), BLOCK)]
        unit = [self.x[b] / self.norm[b, None] for b in self.blocks]
        middle = np.array([u.mean(axis=0) for u in unit]).reshape(len(unit), x.shape[1])
        self.middle = middle / np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), 1e-300)
        self.radius = np.array([np.arccos(np.clip(u @ m, -1, 1)).max() for u, m in zip(unit, self.middle, strict=True)])


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of rows (of x and y, or of x alone once each) with a cosine of ``threshold`` or more."""
    left = Side(x)
    right = left if y is None else Side(y)
    apart = np.arccos(np.clip(left.middle @ right.middle.T, -1, 1)) - left.radius[:, None] - right.radius[None, :]
    near = apart <= np.arccos(threshold) + 1e-6
    a, b = [], []
    for g, h in zip(*np.nonzero(near), strict=True):
        if y is None and g > h:
            continue
        rows, cols = left.blocks[g], right.blocks[h]
        bound = integer_products(left.q[rows], right.q[cols])
        bound *= left.scale[rows, None].astype(np.float32)
        bound *= right.scale[None, cols].astype(np.float32)
        bound += left.error[rows, None].astype(np.float32) * (1.0 + right.error[None, cols]).astype(np.float32)
        bound += right.error[None, cols].astype(np.float32)
        i, j = np.nonzero(bound >= np.float32(threshold - SLACK))
        i, j = i + rows.start, j + cols.start
        if y is None:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 100_000):
            u, v = i[s : s + 100_000], j[s : s + 100_000]
            cos = np.einsum("ij,ij->i", left.x[u], right.x[v]) / (left.norm[u] * right.norm[v])
            a.append(u[cos >= threshold])
            b.append(v[cos >= threshold])
    none = np.empty(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def _valid() -> F.Column:
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    x = F.col("x")
    return x.isNotNull() & F.forall(x, ok) & F.exists(x, lambda c: c != 0)


def _centres(unit: DataFrame, n: int, tile: int) -> np.ndarray:
    """Unit vectors from a bounded sample, one for about each tile: the middles of cells."""
    k = min(MAX_CELLS, max(1, -(-n // tile)))
    rows = unit.orderBy(F.xxhash64("node")).limit(k).select("x").collect()
    x = scaled(np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), -1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(once: DataFrame, centres: np.ndarray) -> DataFrame:
    """(node, x, copies, cell, angle): the nearest centre of each vector and the angle to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = scaled(np.stack(pdf["x"].to_numpy()))
            cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ centres.T
            cell = cos.argmax(axis=1)
            angle = np.arccos(np.clip(cos[np.arange(len(x)), cell], -1, 1))
            yield pd.DataFrame({"node": pdf["node"], "x": pdf["x"], "copies": pdf["copies"], "cell": cell, "angle": angle})

    return once.select("node", "x", "copies").mapInPandas(run, "node long, x array<double>, copies long, cell int, angle double")


class Plan:
    """Which tile a vector of a cell goes to, and which tiles can hold links with each other.

    A cell with many vectors is cut into several tiles, neighbouring small cells
    share one. Two cells can link only if their centres are no farther apart than
    their radii and the threshold's angle together.
    """

    def __init__(self, centres: np.ndarray, count: np.ndarray, radius: np.ndarray, threshold: float, tile: int) -> None:
        self.first, self.many = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64)
        groups: list[list[int]] = []
        self.tiles: list[tuple[int, int]] = []  # first tile and number of tiles of each group
        held = 0
        for c in np.flatnonzero(count):
            if groups and held + count[c] <= tile and held:
                groups[-1].append(c)
                held += count[c]
            else:
                groups.append([c])
                held = count[c] if count[c] <= tile else 0
        at = 0
        for g in groups:
            many = max(1, -(-int(count[g].sum()) // tile))
            self.first[g], self.many[g] = at, many
            self.tiles.append((at, many))
            at += many
        self.n = at
        apart = np.arccos(np.clip(centres @ centres.T, -1, 1)) - radius[:, None] - radius[None, :]
        near = apart <= np.arccos(threshold) + 1e-6
        order, heads = np.concatenate(groups), np.cumsum([0, *map(len, groups)])[:-1]
        near = np.logical_or.reduceat(np.logical_or.reduceat(near[np.ix_(order, order)], heads, axis=0), heads, axis=1)
        self.width, self.near = len(groups), np.packbits(near, axis=1)  # 2 MB at most
        self.group = np.repeat(np.arange(len(groups)), [m for _, m in self.tiles])

    def partners(self, t: int) -> list[int]:
        row = np.unpackbits(self.near[self.group[t]], count=self.width)
        return [u for h in np.flatnonzero(row) for u in range(self.tiles[h][0], sum(self.tiles[h]))]


def _tile_links(cells: DataFrame, plan: Plan, threshold: float, dim: int) -> DataFrame:
    """(node, links, root) for each pair of tiles: a vector's links in it, and the smallest node it reaches in it."""
    spark = cells.sparkSession
    first, many = plan.first, plan.many

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = pdf["cell"].to_numpy()
            yield pd.DataFrame({"node": pdf["node"], "x": pdf["x"], "copies": pdf["copies"], "tile": first[cell] + pdf["node"].map(hash).to_numpy() % many[cell]})

    def blob(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        t = int(pdf["tile"].iat[0])
        x = np.stack(pdf["x"].to_numpy()).astype("<f8")
        small = x.astype("<f4")
        exact = np.array_equal(small, x)
        pairs = [{"i": min(t, u), "j": max(t, u)} for u in plan.partners(t)]
        return pd.DataFrame({"tile": [t], "nodes": [pdf[["node", "copies"]].to_numpy("<i8").tobytes()], "single": [exact], "body": [(small if exact else x).tobytes()], "pairs": [pairs]})

    tiles = cut(cells.mapInPandas(deal, "node long, x array<double>, copies long, tile long").groupBy("tile").applyInPandas(blob, "tile long, nodes binary, single boolean, body binary, pairs array<struct<i: long, j: long>>"), "vector-tiles")
    n_pairs = tiles.agg(F.sum(F.size("pairs"))).first()[0] or 0
    sent = tiles.select(F.explode("pairs").alias("p"), "tile", "nodes", "single", "body").select("p.i", "p.j", "tile", "nodes", "single", "body")
    sent = sent.repartition(max(parts(spark), n_pairs // 2), "i", "j").sortWithinPartitions("i", "j", "tile")

    def unpack(row) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(row.nodes, "<i8").reshape(-1, 2), np.frombuffer(row.body, "<f4" if row.single else "<f8").reshape(-1, dim).astype(np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.i != row.j and held is None:
                    held = row
                    continue
                nodes, x = unpack(row)
                if row.i == row.j:
                    a, b = tile_links(x, None, threshold)
                else:
                    left, y = unpack(held)
                    held = None
                    b, a = tile_links(y, x, threshold)
                    nodes, a = np.concatenate([left, nodes]), a + len(left)
                if not len(a):
                    continue
                nodes, copies = nodes.T
                links = np.bincount(a, copies[b], len(nodes)) + np.bincount(b, copies[a], len(nodes))
                some = np.flatnonzero(links)
                yield pd.DataFrame({"node": nodes[some], "links": links[some].astype(np.int64), "root": nodes[local_stars(len(nodes), a, b)[some]]})

    return sent.mapInPandas(run, "node long, links long, root long")


def _tile_rows(n: int, dim: int, n_parts: int) -> int:
    """Vectors of a tile: few tiles, so that few copies travel, but a pair of them for each partition; bounded by what a task holds."""
    most = min(TILE_ROWS, max(1, TILE_BYTES // (4 * dim)))
    return min(most, max(BLOCK, -(-n // int(np.ceil(np.sqrt(2 * n_parts))))))


def _links(once: DataFrame, dim: int, n: int, threshold: float, tile: int | None) -> DataFrame:
    """(node, links, root) of the ``n`` distinct vectors ``once`` (node, x, copies) of one length."""
    tile = tile or _tile_rows(n, dim, parts(once.sparkSession))
    centres = _centres(once, n, tile)
    cells = cut(_cells(once, centres), "vector-cells")
    size, wide = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect():  # MAX_CELLS rows at most
        size[r["cell"]], wide[r["cell"]] = r["n"], r["angle"]
    return cut(_tile_links(cells, Plan(centres, size, wide, threshold, tile), threshold, dim), "vector-links")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", tile: int | None = None) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept).

    A vector that is null, empty, zero, or has null or non-finite components links
    with nothing: its component is itself. Vectors link with those of their own
    length only, and each length is searched by itself. Equal vectors are compared
    once and counted as often as they occur. Rows that repeat an id are separate
    vectors in n_links; a null id stays, in the component of the others. Very long
    vectors are added up in blocks. An empty table gives an empty table; other
    columns are ignored. ``tile``: vectors of a tile, not the result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    tagged = rows.withColumn("x", F.when(_valid(), F.transform("x", lambda c: c + F.lit(0.0))))
    good = tagged.where("x is not null")
    once = cut(good.groupBy("x").agg(F.min("id").alias("low"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    lengths = once.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect()
    found = vectors.sparkSession.createDataFrame([], "node long, links long, root long")
    for r in lengths:
        found = found.unionAll(_links(once.where(F.size("x") == r["dim"]), r["dim"], r["n"], threshold, tile))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    placed = once.select("x", "node", "low", "copies").join(links, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = cut(placed.select("x", "low", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("own")), "vector-placed")
    # a link leads to every copy of the vector at its other end
    lows = cut(placed.groupBy("component").agg(F.min("low").alias("component_id")), "vector-lows")
    of = cut(placed.join(lows, "component").select("x", F.col("own").cast("long").alias("n_links"), "component_id"), "vector-groups")
    linked = good.join(of, "x").select("id", "n_links", "component_id")
    alone = tagged.where("x is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionAll(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all of ``embeddings`` at a cosine of 0.95 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP8_SQL = r"""
WITH RECURSIVE given AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), tagged AS (
  SELECT vec_id, x, row_number() OVER () AS n, list_sum(list_transform(x, lambda c: c * c)) AS q,
    coalesce(len(x) = len(list_filter(x, lambda c: c IS NOT NULL AND isfinite(c))), false) AS whole
  FROM given
), good AS MATERIALIZED (SELECT vec_id, n, CASE WHEN whole THEN x END AS x, sqrt(q) AS norm FROM tagged WHERE whole AND q > 0
), links AS (
  SELECT a.n AS u, b.n AS v FROM good a JOIN good b ON len(a.x) = len(b.x) AND a.n <> b.n
  WHERE list_dot_product(a.x, b.x) >= 0.95::DOUBLE * a.norm * b.norm
), reach AS (
  SELECT n AS u, n AS v FROM good UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
), lows AS (SELECT u AS n, min(vec_id) AS least FROM reach JOIN good ON v = good.n GROUP BY u
), counts AS (SELECT u AS n, count(*) AS n_links FROM links GROUP BY u)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CASE WHEN lows.n IS NULL THEN vec_id ELSE least END AS component_id,
  vec_id IS NOT DISTINCT FROM CASE WHEN lows.n IS NULL THEN vec_id ELSE least END AS kept
FROM tagged LEFT JOIN lows USING (n) LEFT JOIN counts USING (n)
"""
