"""SimHash fingerprints and their near-duplicate groups by a Gray-order hierarchical index.

A fingerprint has 64 bits; two link at ``max_diff`` or fewer differing bits. The
index has two parts. The upper nodes are masks that cut the 64 bits into
``max_diff + 1 + extra`` blocks: of two linking fingerprints at least
``extra + 1`` blocks are equal, so each fingerprint hangs below one node
(mask, shared bits) for each choice of ``extra + 1`` blocks, and linking pairs
meet below at least one node. Below such a node the fingerprints are sorted by
Gray rank and cut into runs; each run keeps the bits all its members share
(mask and pattern), and children keep only what their parent has not. A search
walks down adding up differences on those masked bits and drops a whole run once
they exceed ``max_diff``. A node with very many members is cut into chunks and
each pair of chunks is searched by itself, so no task holds a whole node.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .store import cut, parts, table

SEED = 42
FAN = 16


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits from each hash; lane 0 is the hash itself."""
    if not lane:
        return h
    h = h + np.uint64((0x9E3779B97F4A7C15 * lane) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _shingles(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the ``words``-word shingles in blocks: ASCII letters lower-cased, words between ASCII white space; nothing for a blank text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    for at in range(0, k, 65536):
        upto = min(k, at + 65536)
        a, b = starts[at:upto].tolist(), ends[np.minimum(np.arange(at, upto) + words - 1, len(tokens) - 1)].tolist()
        yield np.array([digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)], dtype=np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *_shingles(text, words)]))


def simhash(text: str | None, words: int = 4, lanes: int = 1) -> np.ndarray:
    """``lanes`` unsigned 64-bit words: one lane counts every shingle as often as it occurs, more lanes vote by the set of shingles."""
    votes, k = np.zeros((lanes, 64), np.int64), 0
    if lanes == 1:
        blocks = _shingles(text, words)
    else:
        own = shingle_set(text, words)
        blocks = (own[at : at + 65536] for at in range(0, len(own), 65536))
    for h in blocks:
        k += len(h)
        for lane in range(lanes):
            bits = np.unpackbits(_mixed(h, lane).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[lane] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits((2 * votes > k).astype(np.uint8), axis=1, bitorder="little").view("<u8").reshape(lanes).astype(np.uint64)


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, lanes: int = 1) -> DataFrame:
    """(id, text_hash, fp): Spark's xxhash64 of the text, and the fingerprint's words as signed longs. Null and blank texts get 0. No exchange."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "text_hash": pdf["text_hash"], "fp": [simhash(t, words, lanes).view(np.int64) for t in pdf["text"]]})

    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return narrow.mapInPandas(run, "id long, text_hash long, fp array<long>")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each value in the Gray sequence."""
    out = fp.astype(np.uint64).copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def _tree(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the root down, each (masked bits that the parent has not, their pattern); the last level is the fingerprints."""
    masks, pats, ors, ands = [np.full_like(fps, ~np.uint64(0))], [fps], fps, fps
    while len(ors) > 1:
        cuts = np.arange(0, len(ors), FAN)
        ors, ands = np.bitwise_or.reduceat(ors, cuts), np.bitwise_and.reduceat(ands, cuts)
        mask = ~(ors ^ ands)
        masks.append(mask)
        pats.append(ands & mask)
    levels = []
    for i in range(len(masks) - 1, -1, -1):
        own = masks[i] if i == len(masks) - 1 else masks[i] & ~masks[i + 1][np.arange(len(masks[i])) // FAN]
        levels.append((own, pats[i] & own))
    return levels


def _differences(queries: np.ndarray, pat: np.ndarray, own: np.ndarray) -> np.ndarray:
    return np.bitwise_count((queries ^ pat) & own).sum(axis=-1, dtype=np.int16)


def index_pairs(queries: np.ndarray, fps: np.ndarray, max_diff: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in queries, in fps) of all pairs of rows (of 64-bit words) that differ in ``max_diff`` bits or fewer.

    Wide fingerprints leave an upper level little to drop: as long as a level keeps more
    than a ``SPARSE``-th, the next one is worked out as a table of queries by runs.
    """
    order = np.lexsort(tuple(gray_rank(fps[:, k]) for k in range(fps.shape[1] - 1, -1, -1)))
    levels = _tree(fps[order])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    block = 1024 if fps.shape[1] == 1 else 64
    by_word = [(np.ascontiguousarray(own.T), np.ascontiguousarray(pat.T)) for own, pat in levels[1:]] if fps.shape[1] > 1 else []
    for at in range(0, len(queries), block):
        q = np.arange(at, min(len(queries), at + block))
        node = np.zeros(len(q), np.int64)
        own, pat = levels[0]
        acc = _differences(queries[q], pat[0], own[0])
        below = levels[1:]
        if fps.shape[1] > 1:
            q, node, acc, done = _tables(queries[q], acc, by_word, max_diff)
            q, below = q + at, below[done:]
        for own, pat in below:
            keep = acc <= max_diff
            q, node, acc = q[keep], node[keep], acc[keep]
            first = node * FAN
            many = np.minimum(FAN, len(own) - first)
            rep = np.repeat(np.arange(len(q)), many)
            node = first[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
            q = q[rep]
            acc = acc[rep] + _differences(queries[q], pat[node], own[node])
        keep = acc <= max_diff
        found.append((q[keep], order[node[keep]]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


#: A level of which a smaller share is kept is searched pair by pair of query and run.
SPARSE = 32


def _tables(queries: np.ndarray, root: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], max_diff: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The walk of ``index_pairs`` down to where few runs are kept: (query, run, differences) and how many ``levels`` (words by runs) that took. A run once beyond ``max_diff`` stays so, as differences add up."""
    acc, words = root[:, None], np.ascontiguousarray(queries.T)
    for done, (own, pat) in enumerate(levels):
        if np.count_nonzero(acc <= max_diff) * SPARSE <= acc.size:
            q, node = np.nonzero(acc <= max_diff)
            return q, node, acc[q, node], done
        last = done + 1 == len(levels)
        acc = np.repeat(acc.astype(np.int16), FAN, axis=1)[:, : own.shape[1]]
        first = min(3, len(words)) if last else len(words)  # what the first words drop at the last level needs no others
        acc = acc + sum(np.bitwise_count((words[k, :, None] ^ pat[k]) & own[k]) for k in range(first))
        if last and first < len(words):
            q, node = np.nonzero(acc <= max_diff)
            more = np.bitwise_count((words[first:, q] ^ pat[first:, node]) & own[first:, node]).sum(axis=0, dtype=np.int16)
            return q, node, acc[q, node] + more, len(levels)
    q, node = np.nonzero(acc <= max_diff)
    return q, node, acc[q, node], len(levels)


def dense_pairs(queries: np.ndarray, fps: np.ndarray, max_diff: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``index_pairs`` by comparing all, which the index is held against."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    first = min(3, fps.shape[1])  # three words differ in 192 bits at most, which a byte holds
    words = [np.ascontiguousarray(fps[:, k]) for k in range(first)]
    for at in range(0, len(queries), 128):
        acc = sum(np.bitwise_count(queries[at : at + 128, k, None] ^ words[k]) for k in range(first))
        a, b = np.nonzero(acc <= max_diff)
        a += at
        keep = np.bitwise_count(queries[a] ^ fps[b]).sum(axis=1, dtype=np.int16) <= max_diff
        found.append((a[keep], b[keep]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def local_stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n positions the smallest position that the pairs (a, b) reach."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = np.minimum(low, low[low])
        while not np.array_equal(jumped := low[low], low):
            low = jumped
        if np.array_equal(low, label):
            return label
        label = low


def _blocks(max_diff: int, extra: int) -> list[list[int]]:
    """Masks of 64 bits, one for each choice of ``extra + 1`` of ``max_diff + 1 + extra`` blocks."""
    k = max_diff + 1 + extra
    edges = [round(64 * i / k) for i in range(k + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [[sum(c)] for c in combinations(block, extra + 1)]


def _upper_nodes(n: int, lanes: int, max_diff: int, below: int) -> list[list[int]]:
    """The masks (a word for each lane) of the upper nodes for ``n`` fingerprints.

    One lane: blocks of which linking fingerprints share enough, so none is missed;
    ``extra`` grows until a node of evenly spread fingerprints has ``below`` members
    at most. More lanes: disjoint blocks of 12 bits over all the lanes, the same for
    any ``n`` (large nodes are cut into chunks); these find a link with a chance that
    grows with its likeness (README has the figures).
    """
    if lanes == 1:
        extra = 0
        while extra < 3 and n / 2 ** (64 * (extra + 1) / (max_diff + 1 + extra)) > below:
            extra += 1
        return _blocks(max_diff, extra)
    whole = [((1 << 12) - 1) << at for at in range(0, 64 * lanes - 11, 12)]
    return [[m >> 64 * k & (1 << 64) - 1 for k in range(lanes)] for m in whole]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_edges(nodes: DataFrame, lanes: int, max_diff: int = 4, chunk: int = 4096, below: int = 2048) -> DataFrame:
    """Edges (u, v) whose components are those of the links between the distinct fingerprints ``nodes`` (node, fp).

    ``chunk`` rows is the most that one side of a search holds (within what hashing
    makes uneven); a node with more members is searched chunk against chunk.
    """
    masks = [[_signed(m) for m in mask] for mask in _upper_nodes(nodes.count(), lanes, max_diff, below)]
    under = F.array(*[F.xxhash64(*[F.col("fp")[k].bitwiseAND(F.lit(m)) for k, m in enumerate(mask) if m]) for mask in masks])
    keyed = nodes.select("node", "fp", F.posexplode(under).alias("mask", "bits"))
    size = cut(keyed.groupBy("mask", "bits").agg(F.count("*").alias("size")).where("size > 1"), "node-size")
    dealt = keyed.join(size, ["mask", "bits"]).withColumn("cuts", F.ceil(F.col("size") / F.lit(chunk)).cast("int")).withColumn("c", F.pmod(F.xxhash64("node"), "cuts").cast("int"))
    tiles = dealt.select("node", "fp", "mask", "bits", "c", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")).select(
        "node", "fp", "mask", "bits", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), F.when(F.col("c") <= F.col("other"), 0).otherwise(1).cast("int").alias("side")
    )
    key = ["mask", "bits", "i", "j"]
    spread = tiles.repartition(parts(nodes.sparkSession), *key).sortWithinPartitions(*key)

    def tile(node: np.ndarray, fps: np.ndarray, side: np.ndarray, one: bool) -> pd.DataFrame | None:
        if one:
            a, b = index_pairs(fps, fps, max_diff)
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                return None
            a, b = index_pairs(fps[left], fps[right], max_diff)
            a, b = left[a], right[b]
        apart = a != b
        if not apart.any():
            return None
        root = local_stars(len(fps), a[apart], b[apart])
        moved = np.flatnonzero(root != np.arange(len(fps)))
        return pd.DataFrame({"u": node[moved], "v": node[root[moved]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            k, node, side = pdf[key].to_numpy(), pdf["node"].to_numpy(), pdf["side"].to_numpy()
            fps = np.stack(pdf["fp"].to_numpy()).view(np.uint64)
            bounds = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist()]
            out = [tile(node[s:e], fps[s:e], side[s:e], k[s, 2] == k[s, 3]) for s, e in zip(bounds, bounds[1:], strict=False) if e - s > 1]
            if out := [x for x in out if x is not None]:
                yield pd.concat(out, ignore_index=True)
            held = pdf.iloc[bounds[-1] :]
        if held is not None and len(held) > 1:
            out = tile(held["node"].to_numpy(), np.stack(held["fp"].to_numpy()).view(np.uint64), held["side"].to_numpy(), held["i"].iat[0] == held["j"].iat[0])
            if out is not None:
                yield out

    return spread.mapInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_diff: int = 4) -> DataFrame:
    """One row per document: (id_col, fingerprint 16 hex digits, component_id: smallest id reachable over links).

    Null texts count as empty; empty and blank texts have fingerprint 0 and link
    like any other. Repeated rows each come back, with the same values. A null id
    keeps its row; a component whose ids are all null has a null component_id. An
    empty table gives an empty table. Other columns are ignored.
    """
    return grouped(docs, id_col, text_col, words, max_diff).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id"
    )


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_diff: int = 4, lanes: int = 1) -> DataFrame:
    """One row per document: (id, text_hash, fp, component: a number that stands for the group, component_id)."""
    fps = cut(with_fingerprint(docs, id_col, text_col, words, lanes), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("id").alias("low"))
    nodes = cut(nodes.withColumn("node", F.col("fp")[0] if lanes == 1 else F.monotonically_increasing_id()), "simhash-nodes")
    comp = components(link_edges(nodes.select("node", "fp"), lanes, max_diff))
    group = nodes.join(comp, "node", "left").select("fp", "low", F.coalesce("component", "node").alias("component"))
    lows = cut(group.groupBy("component").agg(F.min("low").alias("component_id")), "simhash-lows")
    of = cut(group.join(lows, "component").select("fp", "component", "component_id"), "simhash-groups")
    return fps.join(of, "fp")


def most_differences(similarity: float, lanes: int) -> int:
    """Differing bits of two texts whose shingle sets have a Jaccard likeness of ``similarity``, plus 3 standard deviations."""
    cosine = 2 * similarity / (1 + similarity)
    share = np.arccos(cosine) / np.pi
    bits = 64 * lanes
    return int(round(bits * share + 3 * np.sqrt(bits * share * (1 - share))))


class Kept:
    """Shingle sets of kept documents, found by likeness."""

    def __init__(self, least: float) -> None:
        self.least = least
        self.of: dict[int, list[int]] = {}
        self.sizes: list[int] = []

    def add(self, own: list[int]) -> None:
        for h in own:
            self.of.setdefault(h, []).append(len(self.sizes))
        self.sizes.append(len(own))

    def near(self, own: list[int]) -> bool:
        """Whether a kept set has a Jaccard likeness of ``least`` or more; two empty ones are alike."""
        if not own:
            return 0 in self.sizes
        hits = Counter(chain.from_iterable(self.of.get(h, ()) for h in own))
        return any(n >= self.least * (len(own) + self.sizes[k] - n) - 1e-9 for k, n in hits.items())


#: Parts of a large group, each with its own first rows.
HEAD_PLACES = 64
#: Documents of a group that one task compares in turn; larger groups go in rounds, block by block.
IN_TURN = 256
#: ``id`` is 0 where ``none`` says that there is none: pandas would make floats of longs with nulls.
_CAND = "component long, none boolean, id long, text_hash long"


def _in_turn(rows: DataFrame, least: float) -> DataFrame:
    """Those of ``rows`` (_CAND, own) that no kept row before them in their group is near to; by the order of ids."""
    key = ["component", "none", "id", "text_hash"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, kept = None, Kept(least)
        for pdf in batches:
            good = []
            for c, own in zip(pdf["component"].tolist(), pdf["own"], strict=True):
                if c != at:
                    at, kept = c, Kept(least)
                own = np.frombuffer(own, "<u8").tolist()
                good.append(not kept.near(own))
                if good[-1]:
                    kept.add(own)
            yield pdf[good]

    spread = rows.select(*key, "own").repartition("component").sortWithinPartitions(*key)  # Spark merges partitions where few rows are left
    return spread.mapInPandas(run, f"{_CAND}, own binary")


def _not_near(rows: DataFrame, kept: DataFrame, least: float) -> DataFrame:
    """Those of ``rows`` (_CAND, own, cuts) that are near no row of ``kept`` (component, own, cuts); groups are dealt over their ``cuts``."""
    key = ["component", "salt"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, known = None, Kept(least)
        for pdf in batches:
            good = []
            for c, salt, side, own in zip(pdf["component"].tolist(), pdf["salt"].tolist(), pdf["side"].tolist(), pdf["own"], strict=True):
                if (c, salt) != at:
                    at, known = (c, salt), Kept(least)
                own = np.frombuffer(own, "<u8").tolist()
                if side == 0:
                    known.add(own)
                good.append(side == 1 and not known.near(own))
            yield pdf.loc[good, ["component", "none", "id", "text_hash", "own"]]

    mine = rows.select("component", F.pmod(F.xxhash64("text_hash"), "cuts").cast("int").alias("salt"), F.lit(1).alias("side"), "none", "id", "text_hash", "own")
    theirs = kept.select("component", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("salt"), F.lit(0).alias("side"), "none", "id", "text_hash", "own")
    both = mine.unionAll(theirs).repartition(*key).sortWithinPartitions(*key, "side")
    return both.mapInPandas(run, f"{_CAND}, own binary")


def _heads(rows: DataFrame, block: int) -> DataFrame:
    """The first ``block`` rows of each group (component, none, id, text_hash), those of each of its ``HEAD_PLACES`` parts first, so no task sorts a whole group."""

    def first(some: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy("component", *by).orderBy("none", "id", "text_hash")
        return some.withColumn("at", F.row_number().over(order)).where(F.col("at") <= block).drop("at")

    dealt = rows.withColumn("place", F.pmod(F.xxhash64("text_hash"), F.lit(HEAD_PLACES)).cast("int"))
    return first(first(dealt, "place").drop("place"))


def _stand_alone(docs: DataFrame, grouping: DataFrame, words: int, least: float) -> DataFrame:
    """(none, id, text_hash) of the rows that stay: in each group of ``grouping``, by the order of ids, those not near one that stays.

    Near is a Jaccard likeness of the sets of ``words``-word shingles (by their 64-bit
    hashes) of ``least`` or more. ``docs`` has _none, _id, _hash and _text.
    """
    key = F.struct("none", "id", "text_hash")
    once = cut(grouping.withColumns({"none": F.col("id").isNull(), "id": F.coalesce("id", F.lit(0))}).groupBy("component", "text_hash").agg(F.min(F.struct("none", "id")).alias("low")).select("component", "low.none", "low.id", "text_hash"), "simhash-texts")
    sizes = lambda rows: rows.groupBy("component").agg(F.count("*").alias("size"))
    many = cut(sizes(once), "simhash-sizes")
    alone = once.join(many.where("size = 1"), "component", "left_semi").select("none", "id", "text_hash")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [shingle_set(t, words).astype("<u8").tobytes() for t in pdf["text"]]
            yield pdf[["component", "none", "id", "text_hash"]].assign(own=own)

    some = once.join(many.where("size > 1"), "component", "left_semi")
    texts = docs.join(some, (F.col("_none") == F.col("none")) & (F.col("_id") == F.col("id")) & (F.col("_hash") == F.col("text_hash"))).select("component", "none", "id", "text_hash", F.col("_text").alias("text"))
    left = cut(texts.mapInPandas(sets, f"{_CAND}, own binary"), "simhash-sets")
    block, stay = 1, [alone]
    while True:
        many = cut(sizes(left), "simhash-sizes")
        stay.append(cut(_in_turn(left.join(many.where(F.col("size") <= IN_TURN), "component", "left_semi"), least).select("none", "id", "text_hash"), "simhash-stay"))
        most = many.agg(F.max("size")).first()[0] or 0
        if most <= IN_TURN:
            return reduce(DataFrame.unionAll, stay)
        large = left.join(many.where(F.col("size") > IN_TURN).select("component", F.ceil(F.col("size") / F.lit(IN_TURN)).cast("int").alias("cuts")), "component")
        if block == 1:
            heads = large.groupBy("component").agg(F.min(key).alias("key")).select("component", "key.*")
        else:
            heads = _heads(large.select("component", "none", "id", "text_hash"), block)
        heads = cut(heads.distinct(), "simhash-heads")
        first = cut(_in_turn(large.join(heads, heads.columns, "left_semi"), least), "simhash-first")
        stay.append(first.select("none", "id", "text_hash"))
        cuts = large.groupBy("component").agg(F.first("cuts").alias("cuts"))
        left = cut(_not_near(large, first.join(cuts, "component"), least), "simhash-left")
        block = min(4096, max(IN_TURN, most // 32))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, lanes: int = 5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay when near duplicates go: each dropped row is near one with a smaller id that stays.

    Candidates are groups linked by fingerprints of ``lanes`` words; in them, a row goes
    only where its set of shingles has a likeness of ``similarity`` or more with that of
    a row that stays. A null id comes after all others; rows of one id are told apart by
    their texts, and of rows that repeat both one stays. Null, empty and blank texts have
    no shingle and are alike. Texts of any length are read whole. An empty table gives an
    empty table; columns may have any name.
    """
    text = F.col(text_col).cast("string")
    # all columns travel as one, so that none can clash with those made here
    marked = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    grouping = grouped(docs, id_col, text_col, words, most_differences(similarity, lanes), lanes)
    kept = _stand_alone(marked.select(F.col("_id").isNull().alias("_none"), F.coalesce("_id", F.lit(0)).alias("_id"), "_hash", "_text"), grouping, words, similarity)
    kept = cut(kept.select(F.when(~F.col("none"), F.col("id")).alias("_kept_id"), F.col("text_hash").alias("_kept_hash")).distinct(), "simhash-kept")
    rows = marked.drop("_text").join(kept, F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_hash") == F.col("_kept_hash")), "left_semi")
    again = marked.groupBy("_id", "_hash").count().where("count > 1")
    if not again.isEmpty():
        rows = rows.dropDuplicates(["_id", "_hash"])
    return rows.select("_row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all of ``documents`` by 4-word shingles and 4 differing bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))
