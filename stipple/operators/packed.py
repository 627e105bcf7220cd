"""Pixel counts packed by key: one row holds the occupied pixels that one task has seen of one key.

A packed table has key columns, ``px`` (numbers of pixels, ascending) and ``c`` (how
many points in each; empty where it is one everywhere), as narrow little-endian
integers; where that is shorter ``px`` is empty and ``c`` has all pixels of the grid. Tasks count before they send, so an exchange moves a few bytes for each
occupied pixel of a key and task instead of a row for each point, and whatever reads a
key's rows adds them up in a grid that doesn't grow with the points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scales import Scales
from .grid import Roi, curves, power_sums

#: Points that a task counts at a time.
CHUNK = 1 << 20


def narrow(values: np.ndarray) -> bytes:
    """Unsigned integers in the fewest bytes of 1, 2 and 4 that hold them, behind one byte that says which."""
    width = next(w for w in (1, 2, 4) if not len(values) or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def pack(pixels: np.ndarray, counts: np.ndarray, cells: int | None = None) -> tuple[bytes, bytes]:
    """``px`` and ``c`` of a row; ``cells``, the size of the grid, allows the dense form."""
    px, c = narrow(pixels), b"" if (counts == 1).all() else narrow(counts)
    if cells and c and (c[0] * cells < len(px) + len(c)):
        every = np.zeros(cells, f"<u{c[0]}")
        every[pixels] = counts
        return b"", c[:1] + every.tobytes()
    return px, c


def add_to(grid: np.ndarray, px: bytes, c: bytes) -> None:
    """Adds a packed row to a flat grid; its pixels are distinct."""
    if len(px):
        grid[wide(px)] += wide(c) if c else 1
    else:
        grid += wide(c)


def occupied(keys: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``keys`` below ``top``, ascending, and how often each comes."""
    if top <= 8 * len(keys):
        counts = np.bincount(keys, minlength=top)
        at = np.flatnonzero(counts)
        return at, counts[at]
    return np.unique(keys, return_counts=True)


def places(roi: Roi, xyz: list[np.ndarray], shift: tuple[float, ...] | None = None) -> np.ndarray:
    """The pixel number of each point, as ``grid.pixel`` gives it for each axis; ``shift``: an offset of the origin."""
    out = np.zeros(len(xyz[0]), np.int64)
    for value, origin, size, d in zip(xyz, roi.origin, roi.size, shift or (0.0,) * len(xyz), strict=True):
        at = (value - (origin + d)) / size * roi.grid if size > 0 else np.zeros(len(value))
        out = out * roi.grid + np.floor(np.minimum(np.maximum(at, 0.0), roi.grid - 1e-9)).astype(np.int64)
    return out


#: Pixels that a task holds for all its keys together.
HELD = 1 << 23


def counted(points: DataFrame, roi: Roi, keys: list[str]) -> DataFrame:
    """(keys, px, c): ``grid.pixels`` packed. A task adds up its points in a grid for each key and sends what it has at its end, or when it has many keys."""
    fields = points.select(*keys).schema
    names, kinds, cells = list(roi.axes), [to_arrow_type(f.dataType) for f in fields], roi.grid ** len(roi.axes)

    def axis(column: pa.Array, origin: float) -> np.ndarray:
        # as grid.pixel has it: no value is the first pixel, not a number the last
        return np.nan_to_num(pc.fill_null(column.cast(pa.float64()), origin).to_numpy(zero_copy_only=False), nan=np.inf, posinf=np.inf, neginf=-np.inf)

    def sent(grids: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = [(key, pack(at, g[at], cells)) for key, g in grids.items() if len(at := np.flatnonzero(g))]
        own = [pa.array([key[n] for key, _ in rows], kind) for n, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*own, pa.array([r[0] for _, r in rows], pa.binary()), pa.array([r[1] for _, r in rows], pa.binary())], [*keys, "px", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids: dict[tuple, np.ndarray] = {}
        for batch in batches:
            at = places(roi, [axis(batch.column(a), o) for a, o in zip(names, roi.origin, strict=True)])
            coded = [batch.column(k).dictionary_encode(null_encoding="encode") for k in keys]
            code = np.zeros(len(at), np.int64)
            for c in coded:
                code = code * len(c.dictionary) + c.indices.to_numpy()
            _, first, which = np.unique(code, return_index=True, return_inverse=True)
            for n, i in enumerate(first.tolist()):
                key = tuple(batch.column(k)[i].as_py() for k in keys)
                if key not in grids:
                    if (len(grids) + 1) * cells > HELD:
                        yield from sent(grids)
                        grids = {}
                    grids[key] = np.zeros(cells, np.int64)
                np.add.at(grids[key], at if len(first) == 1 else at[which == n], 1)
        if grids:
            yield from sent(grids)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return points.select(*keys, *names).mapInArrow(run, f"{own}, px binary, c binary")


def in_order(packed: DataFrame, keys: list[str], run: Callable[[tuple, Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``run(key, rows)`` for each key, with the rows of a key streamed to it; yields columns without the keys.

    Rows are dealt by key over a fixed number of places, as the work of a place is far
    larger than its rows, and sorted there; a task holds one batch of rows at a time.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.select(*keys).schema)
    others = [c for c in packed.columns if c not in keys]
    types = {f.name: f for f in packed.select(*keys).schema}

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict]]:
        for batch in batches:
            own, rest = [batch.column(k) for k in keys], {c: batch.column(c) for c in others}
            for i in range(batch.num_rows):  # one row after the other, as a batch may be large
                yield tuple(k[i].as_py() for k in own), {c: v[i].as_py() for c, v in rest.items()}
            del batch, own, rest

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        kinds = [to_arrow_type(types[k].dataType) for k in keys]
        for key, rows in groupby(flat(batches), key=lambda r: r[0]):
            for columns in run(key, (r for _, r in rows)):
                n = len(next(iter(columns.values())))
                if n:
                    own = {k: pa.array([v], kind).take(pa.array(np.zeros(n, np.int64))) for k, v, kind in zip(keys, key, kinds, strict=True)}
                    yield pa.RecordBatch.from_pydict(own | {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    places = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(places, *keys).sortWithinPartitions(*keys).mapInArrow(work, f"{fields}, {schema}")


def unpacked(packed: DataFrame, roi: Roi, keys: list[str]) -> DataFrame:
    """(keys, gx, gy[, gz], c): a row for each occupied pixel of a key."""
    def run(key: tuple, rows: Iterator[dict]) -> Iterator[dict]:
        grid = np.zeros(roi.grid ** len(roi.axes), np.int64)
        for r in rows:
            add_to(grid, r["px"], r["c"])
        at = np.flatnonzero(grid)
        place = np.unravel_index(at, (roi.grid,) * len(roi.axes))
        yield {f"g{a}": pa.array(p, pa.int32()) for a, p in zip(roi.axes, place, strict=True)} | {"c": pa.array(grid[at])}

    return in_order(packed.select(*keys, "px", "c"), keys, run, ", ".join(f"g{a} int" for a in roi.axes) + ", c long")


def curves_of_packed(packed: DataFrame, roi: Roi, scales: Scales, keys: list[str]) -> DataFrame:
    """``grid.curves`` of packed counts (keys, px, c): one exchange, then one grid for each key."""
    shape, steps = (roi.grid,) * len(roi.axes), list(zip(scales.vox, scales.um, strict=True))

    def run(key: tuple, rows: Iterator[dict]) -> Iterator[dict]:
        grid = np.zeros(roi.grid ** len(roi.axes))
        for r in rows:
            add_to(grid, r["px"], r["c"])
        sums = power_sums(grid.reshape(shape), scales.vox)
        kinds = {"n_bins": pa.int64()}
        yield {
            "scale_idx": pa.array(range(len(steps)), pa.int32()), "vox": pa.array(scales.vox, pa.int32()), "um": pa.array([float(u) for _, u in steps], pa.float64()),
            **{k: pa.array(v, kinds.get(k, pa.float64())) for k, v in sums.items()},
        }

    return curves(in_order(packed, keys, run, "scale_idx int, vox int, um double, n_bins long, s1 double, s2 double, s3 double"), keys)


#: Types in a tile of the matrix of all pairs. A task holds two tiles: 2 TILE grids of 4-byte counts, and as many bins of one scale in doubles.
TILE = 256


def correlations(packed: DataFrame, roi: Roi, scales: Scales, keys: list[str], names: list[str], tile: int = TILE) -> DataFrame:
    """(keys, a, b, scale_idx, vox, um, r): Pearson correlation of two types' counts over all bins, empty ones too, for all a < b.

    ``packed`` is (keys, type, px, c); a and b are places in ``names``, which is sorted.
    Types are cut into tiles. The rows of a tile go once to each pair of tiles that it is
    in, in one exchange by (keys, pair); there the counts of both tiles are binned at each
    scale and one matrix product gives the sums of all pairs of types between them, of
    types that never meet, too. No task holds all types, and none a product of all pairs.
    """
    shape, dims, steps = (roi.grid,) * len(roi.axes), len(roi.axes), list(enumerate(zip(scales.vox, scales.um, strict=True)))
    places = packed.sparkSession.createDataFrame([(t, k) for k, t in enumerate(names)], f"type {packed.schema['type'].dataType.simpleString()}, at int")
    tiles = -(-len(names) // tile)
    # a row for each type goes to all tasks: joined by an exchange, all counts of a type would meet in one task
    rows = packed.join(F.broadcast(places), "type").drop("type").withColumn("_t", F.expr(f"int(at div {tile})"))
    other = F.explode(F.sequence(F.lit(0), F.lit(max(tiles - 1, 0))))
    rows = rows.withColumn("_o", other).select(*keys, F.least("_t", "_o").alias("ti"), F.greatest("_t", "_o").alias("tj"), "at", "px", "c")

    def binned(grids: np.ndarray, v: int) -> np.ndarray:
        n = roi.grid // v
        if n < 2:
            return grids.reshape(len(grids), -1).sum(axis=1, keepdims=True, dtype=np.float64)
        inner = grids.reshape(len(grids), *shape)[(slice(None), *[slice(0, n * v)] * dims)]
        return inner.reshape(len(grids), *[n, v] * dims).sum(axis=tuple(range(2, 2 * dims + 1, 2)), dtype=np.float64).reshape(len(grids), -1)

    def run(key: tuple, rows: Iterator[dict]) -> Iterator[dict]:
        ti, tj = key[-2:]
        sides = [range(t * tile, min(len(names), (t + 1) * tile)) for t in sorted({ti, tj})]
        grids = [np.zeros((len(s), roi.grid**dims), np.uint32) for s in sides]
        there = [np.zeros(len(s), bool) for s in sides]
        for r in rows:
            k = next(k for k, s in enumerate(sides) if r["at"] in s)
            there[k][r["at"] - sides[k][0]] = True
            add_to(grids[k][r["at"] - sides[k][0]], r["px"], r["c"])
        at = [np.flatnonzero(t) for t in there]
        grids = [g if len(w) == len(g) else g[w] for g, w in zip(grids, at, strict=True)]
        a, b = np.triu_indices(len(at[0]), 1) if ti == tj else (m.ravel() for m in np.indices((len(at[0]), len(at[-1]))))
        first, second = at[0][a] + sides[0][0], at[-1][b] + sides[-1][0]
        for i, (v, um) in steps:
            c = [binned(g, v) for g in grids]
            n = float(c[0].shape[1])
            one, two, both = [x.sum(axis=1) / n for x in c], [(x * x).sum(axis=1) / n for x in c], c[0] @ c[-1].T / n
            var = [s - m * m for s, m in zip(two, one, strict=True)]
            ok = (var[0][a] > 1e-20) & (var[-1][b] > 1e-20)
            scale = np.where(ok, np.sqrt(np.maximum(var[0], 0))[a] * np.sqrt(np.maximum(var[-1], 0))[b], 1.0)
            r = np.where(ok, (both[a, b] - one[0][a] * one[-1][b]) / scale, 0.0)
            m = len(r)
            yield {"a": pa.array(first, pa.int32()), "b": pa.array(second, pa.int32()), "scale_idx": pa.array(np.full(m, i, np.int32)), "vox": pa.array(np.full(m, v, np.int32)), "um": pa.array(np.full(m, float(um))), "r": pa.array(r)}

    return in_order(rows, [*keys, "ti", "tj"], run, "a int, b int, scale_idx int, vox int, um double, r double").drop("ti", "tj")

