"""SentencePiece encoding, decoding, and distinct sampled segmentations of whole texts.

A text's segmentations are the paths of a lattice of pieces. With a weight for
each piece the lattice is a Markov chain: from each place the next piece has the
chance of all paths that go on with it. ``sample`` draws the k best paths under
Gumbel noise, which is a sample without replacement, by a best-first search:
the first path carries the noise of the whole space; each place of a drawn path
bounds the paths that leave it there by a Gumbel truncated at that path's key;
the place with the highest bound gives the next path. The noise is seeded by the
row's key. With the (k+1)-th bound as threshold each path has its inclusion
score, the chance that its key passes the threshold.

Pieces never run across the start of a word, so a text is a row of units (marks
for spaces, then a word), each unit's lattice is built once and kept in a bounded
pool, and all units of a text are walked at the same time.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table

SAMPLES = 3
SEED = 42
_SPACE = "▁"
_UNIT = re.compile(f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+")
_POOL_EDGES = 5_000_000
BLOCK = 512
_codecs: dict[str, Codec] = {}


class Codec:
    """A SentencePiece model with its pool of unit lattices."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.piece = {sp.id_to_piece(i): i for i in plain}
        self.longest = max(map(len, self.piece), default=1)
        self._trie()
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        scores = np.array([sp.get_score(i) for i in range(n)])
        whole = np.array([scores[i] for i in plain])
        # merge ranks (-0, -1, ...) become Zipf weights; a unigram model's log probabilities stay
        self.logw = -np.log(2.0 + np.minimum(-scores, n)) if len(whole) and np.all(whole == np.rint(whole)) and whole.max(initial=-1) <= 0 else scores
        self.byte_logw = float(-np.log(2.0 + n)) if self.logw is not scores else float(whole.min(initial=0) - 10)
        self.apart = all(re.fullmatch(f"{_SPACE}*[^{_SPACE}]*", p) for p in self.piece)
        self.text = self._texts(n)
        self._reset()

    def _texts(self, n: int) -> np.ndarray:
        out = np.full(n, b"", object)
        for p, i in self.piece.items():
            out[i] = p.replace(_SPACE, " ").encode()
        for b, i in self.byte.items():
            out[i] = bytes([b])
        return out

    def _trie(self) -> None:
        """States are beginnings of pieces; ``step`` is a hash table of state * 2**21 + character (-1: free place), and ``then`` the next state of each."""
        state, moves = {"": 0}, {}
        for p in sorted(self.piece):
            for n in range(1, len(p) + 1):
                if p[:n] not in state:
                    state[p[:n]] = len(state)
                    moves[(state[p[: n - 1]] << 21) | ord(p[n - 1])] = state[p[:n]]
        self.free_bits = np.uint64(64 - max(4, (4 * len(moves)).bit_length()))
        self.step = np.full(1 << (64 - int(self.free_bits)), -1, np.int64)
        self.then = np.zeros(len(self.step), np.int64)
        keys = np.array(list(moves), np.int64)
        for m, k in zip(moves, self._place(keys).tolist(), strict=True):
            while self.step[k] >= 0:
                k = (k + 1) % len(self.step)
            self.step[k], self.then[k] = m, moves[m]
        self.begin = np.zeros(0x110000, np.int32)  # the state after a first character, 0 if no piece begins with it
        for p, i in state.items():
            if len(p) == 1:
                self.begin[ord(p)] = i
        self.piece_of = np.full(len(state), -1, np.int32)
        for p, i in self.piece.items():
            self.piece_of[state[p]] = i

    def _place(self, key: np.ndarray) -> np.ndarray:
        """Where the search for a key begins in ``step``; it ends at a free place."""
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.free_bits).astype(np.int64)

    def _found(self, key: np.ndarray) -> np.ndarray:
        """The next states of keys, -1 where there is none."""
        k = self._place(key)
        held = self.step[k]
        out = np.where(held == key, self.then[k], -1)
        on = np.flatnonzero((held != key) & (held >= 0))
        while len(on):
            k[on] = (k[on] + 1) % len(self.step)
            held = self.step[k[on]]
            hit = held == key[on]
            out[on[hit]] = self.then[k[on[hit]]]
            on = on[~hit & (held >= 0)]
        return out

    def _reset(self) -> None:
        self.root: dict[str, int] = {}
        self.nodes = self.edges = 0
        #: of each edge: the chance of it and those before it (2 at a node's last), next node (-1: end of unit), id (below 0: bytes of a character), log chance, log chance of the node's others; room for more behind
        if not hasattr(self, "edge"):
            room = _POOL_EDGES + _POOL_EDGES // 4
            self.edge = [np.empty(room), np.empty(room, np.int32), np.empty(room, np.int32), np.empty(room), np.empty(room)]
            self.first = np.empty(room // 3, np.int32)  # the first edge of each node, and room for more
        self.char_ids = np.empty(0, np.int64)  # of each character that is no piece: its id, -1 for several
        self.chars: list[tuple[int, ...]] = []
        self.char_at: dict[str, int] = {}

    def _char(self, char: str) -> int:
        """Where the byte ids of a character that is no piece stand, as a number below 0."""
        if char not in self.char_at:
            ids = [self.byte.get(b) for b in char.encode("utf-8", "surrogatepass")]
            self.chars.append(tuple(ids) if None not in ids else (self.unknown,))
            self.char_at[char] = -len(self.chars)
        return self.char_at[char]

    def _learn(self, units: set[str]) -> None:
        """Adds the lattices of new units to the pool."""
        if self.edges > _POOL_EDGES:
            self._reset()
        new = list(units.difference(self.root))
        if not new:
            return
        base, old = self.nodes, self.edges
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        heads = np.cumsum(sizes) - sizes
        self.root.update(zip(new, (base + heads).tolist(), strict=True))
        chars = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        self.nodes += len(chars)
        ends = np.repeat(heads + sizes, sizes)  # the end of each place's unit
        left = ends - np.arange(len(chars))
        starts, pieces = [], []
        counts = np.zeros(len(chars), np.int32)  # edges of each place so far, the shortest first
        places = []
        at, state = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for n in range(1, self.longest + 1):
            if n == 1:
                state = self.begin[chars].astype(np.int64)
                known = state > 0
            else:
                inside = at + n <= ends[at]
                at, state = at[inside], state[inside]
                state = self._found((state << 21) | chars[at + n - 1])
                known = state >= 0
            at, state = at[known], state[known]
            piece = self.piece_of[state]
            full = piece >= 0
            where, piece = at[full], piece[full]
            if n == 1:
                bare = np.ones(len(chars), bool)  # places whose character is no piece
                bare[where] = False
                lone = np.flatnonzero(bare)
                piece = np.concatenate([piece, np.array([self._char(chr(c)) for c in chars[lone].tolist()], np.int32)])
                where = np.concatenate([where, lone])
            starts.append(where)
            pieces.append(piece)
            places.append(counts[where])
            counts[where] += 1
            if not len(at):
                break
        first_edge = np.cumsum(counts, dtype=np.int64) - counts
        widths = np.repeat(np.arange(1, len(starts) + 1, dtype=np.int32), list(map(len, starts)))
        at = np.concatenate(starts, dtype=np.int32)
        place = np.concatenate(places)
        order = first_edge[at] + place
        start, end, ids, place = (_scattered(order, x) for x in (at, at + widths, np.concatenate(pieces), place))
        w = np.where(ids >= 0, self.logw[np.maximum(ids, 0)], 0.0)
        for k in np.flatnonzero(ids < 0):
            w[k] = self.byte_logw * len(self.chars[-ids[k] - 1])
        last = end == ends[start]
        after = np.where(last, len(left), end)  # a unit's end is the place behind all nodes, whose beta is 0
        beta = np.zeros(len(left) + 1)
        order = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")  # short numbers are sorted by digits
        cuts = np.searchsorted(left[order], np.arange(1, left.max() + 2))
        for a, b in zip(cuts, cuts[1:], strict=False):  # the nodes so many characters before their units' ends
            nodes = order[a:b]
            many = counts[nodes].astype(np.int64)
            e = np.repeat(first_edge[nodes] - np.cumsum(many) + many, many) + np.arange(many.sum())
            total = w[e] + beta[after[e]]
            beta[nodes] = np.logaddexp.reduceat(total, np.cumsum(many) - many)
        logs = np.minimum(w + beta[after] - beta[start], 0.0)
        # summed edge by edge within each node, so that a unit's chances are the same in any pool
        chance = np.exp(logs)
        marks = chance.copy()
        more = np.flatnonzero(place)
        for k in range(1, int(place.max()) + 1):
            on = more[place[more] == k]
            marks[on] += marks[on - 1]
            more = more[place[more] > k]
        marks[first_edge + counts - 1] = 2.0
        with np.errstate(divide="ignore"):
            others = np.log(1.0 - np.where(logs > -1e-12, 1.0, chance))
        self.edges += len(start)
        self.first = _put(self.first, base, first_edge + old)
        self.edge = [_put(a, old, b) for a, b in zip(self.edge, (marks, np.where(last, -1, end + base), ids, logs, others), strict=True)]
        self.char_ids = np.array([c[0] if len(c) == 1 else -1 for c in self.chars], np.int64)

    def units(self, text: str) -> list[str]:
        norm = self.sp.normalize(text)
        return _UNIT.findall(norm) if self.apart else ([norm] if norm else [])

    def _walk(self, node: np.ndarray, unit: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit, edge) of a random path from each node to its unit's end, by unit; ``salt`` seeds each unit."""
        marks, nexts, *_ = self.edge
        us, es, step, many = [], [], 0, np.zeros(int(unit.max()) + 1 if len(unit) else 0, np.int64)
        while len(node):
            e = self.first[node].astype(np.int64)
            x = _unit_interval(salt, step)
            on = np.flatnonzero(marks[e] <= x)
            while len(on):
                e[on] += 1
                on = on[marks[e[on]] <= x[on]]
            us.append(unit)
            es.append(e)
            many[unit] += 1  # a unit is walked once
            node = nexts[e]
            on = node >= 0
            node, unit, salt, step = node[on], unit[on], salt[on], step + 1
        if not us:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        first, out = np.cumsum(many) - many, np.empty(int(many.sum()), np.int64)
        for step, (u, e) in enumerate(zip(us, es, strict=True)):
            out[first[u] + step] = e
        return np.repeat(np.arange(len(many)), many), out

    def sample(self, text: str, seed: int, k: int) -> list[dict]:
        """Up to ``k`` distinct segmentations (fewer if there are no more), best key first."""
        return self.sample_block([text], [seed], k)[0]

    def sample_block(self, texts: list[str], seeds: list[int], k: int) -> list[list[dict]]:
        """``sample`` for each text; the texts are walked together, the results do not depend on which they are."""
        split = [self.units(t) for t in texts]
        self._learn(set().union(*split))
        searches = [_Search(self, units, seed) for units, seed in zip(split, seeds, strict=True)]
        for turn in range(k):
            going = [s for s in searches if s.wants(turn)]
            if not going:
                break
            starts = [s.start() for s in going]
            first = np.cumsum([0, *(len(s.roots) for s in going)])
            node = np.concatenate([n for n, _ in starts])
            unit = np.concatenate([u + f for (_, u), f in zip(starts, first, strict=False)])
            salt = np.concatenate([_mix(u.astype(np.uint64) + np.uint64((s.seed << 20) % 2**64) + np.uint64(turn << 52)) for (_, u), s in zip(starts, going, strict=True)])
            u, e = self._walk(node, unit, salt)
            cuts = np.searchsorted(u, first)
            for n, s in enumerate(going):
                s.finish(u[cuts[n] : cuts[n + 1]] - first[n], e[cuts[n] : cuts[n + 1]])
        return [s.result() for s in searches]

    def _ids(self, edges: np.ndarray) -> np.ndarray:
        ids = self.edge[2][edges]
        low = np.flatnonzero(ids < 0)
        if not len(low):
            return ids.astype("<u4")
        one = self.char_ids[-ids[low] - 1]
        if (one >= 0).all():
            ids[low] = one
            return ids.astype("<u4")
        return np.array([i for k in ids.tolist() for i in ((k,) if k >= 0 else self.chars[-k - 1])], "<u4")

    def encode(self, text: str | None) -> np.ndarray:
        """The model's own segmentation."""
        return np.array(self.sp.encode(text or ""), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces' bytes behind each other, without the space put before the text."""
        return b"".join(self.text[ids].tolist()).decode("utf-8", "replace").removeprefix(" ")


def _scattered(order: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[order] = values
    return out


def _put(held: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` from position ``at`` on, in place where there is room, else in an array half as long again."""
    need = at + len(more)
    if need > len(held):
        held, old = np.empty(max(need, len(held) * 3 // 2), held.dtype), held
        held[:at] = old[:at]
    held[at:need] = more
    return held


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit_interval(salt: np.ndarray, step: int) -> np.ndarray:
    """In [0, 1), from a seed for each unit and the step within it."""
    return (_mix(salt + np.uint64((0x9E3779B97F4A7C15 * (step + 1)) % 2**64)) >> np.uint64(11)) * 2.0**-53


class _Search:
    """The best-first search of one text: drawn paths, the bounds of what leaves them, and the next place to go on from."""

    def __init__(self, codec: Codec, units: list[str], seed: int) -> None:
        self.codec, self.seed = codec, seed
        self.roots = np.fromiter(map(codec.root.__getitem__, units), np.int64, len(units))
        self.rng = np.random.Generator(np.random.Philox(seed))
        self.paths: list[tuple[np.ndarray, np.ndarray]] = []
        self.logs: list[np.ndarray] = []  # the log chances along each path
        self.keys: list[float] = []
        self.after: list[np.ndarray] = []  # of each place of a path: the lower, the higher the bound of what leaves it there
        self.tops: list[float] = []
        self.taken: list[dict[int, tuple[int, ...]]] = []
        self.threshold = float(-np.log(self.rng.standard_exponential()))
        self.branch: tuple | None = None

    def wants(self, turn: int) -> bool:
        return len(self.paths) == turn and self.threshold > -np.inf

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, units) to walk from: all units for the first path, else what follows the branch."""
        if not self.paths:
            return self.roots, np.arange(len(self.roots))
        marks, nexts, _, logs, _ = self.codec.edge
        w = self.tops.index(self.threshold)
        at = int(self.after[w].argmin())
        unit, edge = self.paths[w]
        out = self.taken[w].get(at, (int(edge[at]),))
        lo = hi = int(edge[at])
        while lo and marks[lo - 1] < 2.0:  # the mark 2 ends a node
            lo -= 1
        while marks[hi] < 2.0:
            hi += 1
        rest = [e for e in range(lo, hi + 1) if e not in out]
        chance = list(accumulate(map(math.exp, logs[rest].tolist())))
        self.after[w][at] = np.inf
        self.tops[w] = self._bound(self.keys[w], self.after[w])
        pick = rest[min(bisect_right(chance, self.rng.random() * chance[-1]), len(rest) - 1)]
        self.branch = (w, at, pick, out, len(rest) == 1)
        u = int(unit[at])
        later = np.arange(u + 1, len(self.roots))
        if nexts[pick] < 0:
            return self.roots[later], later
        return np.concatenate([[nexts[pick]], self.roots[later]]), np.concatenate([[u], later])

    def finish(self, unit: np.ndarray, edge: np.ndarray) -> None:
        logs, others, at = self.codec.edge[3], self.codec.edge[4], 0
        taken: dict[int, tuple[int, ...]] = {}
        if self.branch is None:
            p, leave = logs[edge], others[edge]
        else:
            # what the path shares with the one that it leaves is not looked up again
            w, at, pick, out, final = self.branch
            u, e = self.paths[w]
            new = np.concatenate([[pick], edge])
            p, leave = np.concatenate([self.logs[w][:at], logs[new]]), others[new]
            unit, edge = np.concatenate([u[: at + 1], unit]), np.concatenate([e[:at], new])
            taken[at] = (*out, pick)
            left = 0.0 if final else max(0.0, 1.0 - math.fsum(map(math.exp, logs[[*out, pick]].tolist())))
            leave[0] = math.log(left) if left else -np.inf
        after = self.rng.standard_exponential(len(p))
        after[:at] = np.inf
        rest = np.log(after[at:])
        rest -= (np.cumsum(p) - p)[at:] + leave
        after[at:] = rest
        self.paths.append((unit, edge))
        self.logs.append(p)
        self.keys.append(self.threshold)
        self.after.append(after)
        self.taken.append(taken)
        self.tops.append(self._bound(self.threshold, after))
        self.threshold = max(self.tops)

    @staticmethod
    def _bound(key: float, after: np.ndarray) -> float:
        """The highest bound of a path: a Gumbel of the best place's chance, truncated at the path's key."""
        return float(-np.logaddexp(-key, after.min())) if len(after) else -np.inf

    def result(self) -> list[dict]:
        found, threshold = [], self.threshold
        for (_, e), p, key in zip(self.paths, self.logs, self.keys, strict=True):
            lp = float(p.sum())
            gap = lp - threshold  # the threshold is -inf where every segmentation was drawn: inclusion is sure
            score = 0.0 if threshold == -np.inf else (float(np.log(-np.expm1(-np.exp(min(gap, 700.0))))) if gap > -30 else gap)
            found.append({"ids": self.codec._ids(e), "log_prob": lp, "key": key, "log_inclusion": score})
        return found


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def row_seed(key: str) -> int:
    return zlib.crc32(key.encode()) | (SEED << 32)


def sample_segmentations(docs: DataFrame, model: str, k: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, sample from 1, ids unsigned 32-bit, n_pieces, log_prob, key, log_inclusion, round_trip).

    Up to ``k`` rows a document, distinct and best key first. A null or empty text
    has one segmentation, of no pieces. The seed is the id, so repeated rows give
    repeated samples; null ids share a seed. An empty table gives an empty table.
    round_trip: decoding gives the text back.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for pdf in batches:
            ids = pdf["id"].astype("Int64").tolist()
            texts = [t or "" for t in pdf["text"]]
            for n in range(0, len(ids), BLOCK):
                some = texts[n : n + BLOCK]
                seeds = [row_seed("" if i is pd.NA else str(i)) for i in ids[n : n + BLOCK]]
                drawn = c.sample_block(some, seeds, k)
                yield frame([
                    (i, s, x["ids"].tobytes(), len(x["ids"]), x["log_prob"], x["key"], x["log_inclusion"], c.decode(x["ids"]) == text)
                    for i, text, found in zip(ids[n : n + BLOCK], some, drawn, strict=True) for s, x in enumerate(found, 1)
                ])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["id", "sample", "ids", "n_pieces", "log_prob", "key", "log_inclusion", "round_trip"])
        return out.assign(id=out["id"].astype("Int64"))

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInPandas(run, "id long, sample long, ids binary, n_pieces long, log_prob double, key double, log_inclusion double, round_trip boolean").withColumnRenamed("id", id_col)


def encode_column(text: Column, model: str) -> Column:
    """The model's own ids of a text (array<int>); null counts as empty."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([codec(model).encode(t).astype(np.int32) for t in texts])

    return ids(F.coalesce(text.cast("string"), F.lit("")))


def decode_column(ids: Column, model: str) -> Column:
    """The text of ids (array<int>); null counts as none."""

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        return pd.Series([codec(model).decode(np.asarray(r, dtype=np.int64)) for r in rows])

    return text(F.coalesce(ids, F.array().cast("array<int>")))


def op10_sp_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distinct sampled segmentations of every whole text of ``documents``, decoded again."""
    import public_tokenizers

    out = sample_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "sample", "n_pieces", F.crc32("ids").alias("ids_crc32"), "log_prob", "key", "log_inclusion", "round_trip")
