"""Hierarchical packing of token documents into windows of several lengths.

Every document is cut into full windows of the longest tier; what is left over
is routed to the shortest tier that holds it. Tiers are packed from the longest
to the shortest: a window opens with a remainder of its own tier, its gap is
filled with the longest remainders of shorter tiers that fit, and the last gap
with the head of one that does not, whose tail goes back to its tier. So every
window is full; only what is left in a task at its end is cut into windows of
powers of two. Windows of one tier are dealt into step groups of equal token
count and nearly equal attention cost. It all happens while a task reads its
input: no exchange, and a task holds a bounded pool of remainders.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table
from .tokens import CACHE_WORDS, encoder

TIERS = (1024, 512, 256, 128)
STEP_TOKENS = 16384
POOL = 2048
ID_BYTES = 4
_OUT = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, window int, step_group long"


class Packer:
    """Packs the documents of one task; ``base`` makes its sequence and group numbers unique."""

    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, pool: int = POOL) -> None:
        if any(t & (t - 1) for t in tiers):
            raise ValueError("tiers are powers of two")
        self.base, self.tiers, self.step_tokens, self.pool = base, tuple(sorted(tiers, reverse=True)), step_tokens, pool
        self.by_len: dict[int, list[tuple]] = {}
        self.lengths = 0  # bit n: a remainder of n tokens waits
        self.waiting = self.tokens = 0
        self.sequences = self.groups = 0
        self.blocks: dict[int, list[tuple[int, list[tuple]]]] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id: object, ids: bytes) -> None:
        n, top = len(ids) // ID_BYTES, self.tiers[0]
        for at in range(0, n - top + 1, top):
            self._emit(top, [(doc_id, at, top, n, ids[at * ID_BYTES : (at + top) * ID_BYTES])])
        if rest := n % top:
            self._put((doc_id, n - rest, rest, n, ids[(n - rest) * ID_BYTES :]))
        if self.waiting >= self.pool:
            self._pack()

    def _put(self, piece: tuple) -> None:
        n = piece[2]
        self.by_len.setdefault(n, []).append(piece)
        self.lengths |= 1 << n
        self.waiting += 1
        self.tokens += n

    def _take(self, n: int) -> tuple:
        of = self.by_len[n]
        piece = of.pop()
        if not of:
            self.lengths ^= 1 << n
        self.waiting -= 1
        self.tokens -= n
        return piece

    def _at_most(self, n: int) -> int:
        """The longest waiting length of n or less, 0 if there is none."""
        return max((self.lengths & ((1 << (n + 1)) - 1)).bit_length() - 1, 0)

    def _more_than(self, n: int) -> int:
        """The shortest waiting length over n, 0 if there is none."""
        over = self.lengths >> (n + 1)
        return (over & -over).bit_length() + n if over else 0

    def _fill(self, window: int) -> None:
        """One full window; at least so many tokens wait."""
        gap, pieces = window, []
        while gap:
            if n := self._at_most(gap):
                piece = self._take(n)
                pieces.append(piece)
                gap -= n
                continue
            doc, start, n, total, ids = self._take(self._more_than(gap))
            pieces.append((doc, start, gap, total, ids[: gap * ID_BYTES]))
            self._put((doc, start + gap, n - gap, total, ids[gap * ID_BYTES :]))
            gap = 0
        self._emit(window, pieces)

    def _pack(self, last: bool = False) -> None:
        for window, shorter in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            # windows of this tier open while remainders of this tier wait
            while self.tokens >= window and self._at_most(window) > shorter:
                self._fill(window)
        if last:
            while self.tokens:
                self._fill(1 << (min(self.tokens, self.tiers[0]).bit_length() - 1))

    def _emit(self, window: int, pieces: list[tuple]) -> None:
        block = self.blocks.setdefault(window, [])
        block.append((sum(p[2] ** 2 for p in pieces), pieces))
        if len(block) * window >= 4 * self.step_tokens:
            self._deal(window)

    def _deal(self, window: int) -> None:
        """The windows of a block, dealt back and forth by falling cost into groups of ``step_tokens``."""
        block = sorted(self.blocks.pop(window, []), key=lambda x: -x[0])
        many = -(-len(block) * window // self.step_tokens)
        for k, (_, pieces) in enumerate(block):
            lap, at = divmod(k, many)
            group = self.base + self.groups + (many - 1 - at if lap % 2 else at)
            offset = 0
            for doc, start, n, total, ids in pieces:
                self.rows.append((doc, start, n, total, self.base + self.sequences, offset, ids, window, group))
                offset += n
            self.sequences += 1
        self.groups += many

    def drain(self, last: bool = False) -> list[tuple]:
        if last:
            self._pack(last=True)
            for window in list(self.blocks):
                self._deal(window)
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, tiers: tuple[int, ...] = TIERS, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, doc_tokens, sequence_id, offset, ids (unsigned 32-bit little-endian), window, step_group.

    A document is the ids of its whole text, then ``end_id``. Null and empty texts
    are that one id. A null doc_id is kept; repeated rows are packed each by
    itself; an empty table gives no pieces; other columns are ignored. The result
    follows the order in which the input is read, so ``docs`` should be a table or
    another plan whose partitions come out alike when a lost task runs again.
    ``cache_words`` bounds the memory of a worker's token cache, not the result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(tokenizer, "byte", ID_BYTES, cache_words), end_id.to_bytes(ID_BYTES, "little")
        packer = Packer(TaskContext.get().partitionId() << 40, tiers)
        columns = [c.split()[0] for c in _OUT.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=columns)
            out["doc_id"] = out["doc_id"].astype("Int64")
            return out

        for pdf in batches:
            for doc, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                packer.add(doc, enc.encode(text) + end)
                if len(packer.rows) > 4000:
                    yield frame(packer.drain())
        if rows := packer.drain(last=True):
            yield frame(rows)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInPandas(run, _OUT)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in windows of 1024 tokens and shorter tiers, one row per piece."""
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group"
    )
