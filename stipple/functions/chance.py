"""Randomness as pure functions of keys: the same in any engine, on any partitioning, in any retry."""

from __future__ import annotations

import hashlib
from math import sin

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# md5 of one block: constants, shifts and the word of each step
_ADD = np.array([int(abs(sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_SHIFT = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
#: Numbers that are worked on together, so that they stay in the processor's cache.
_SOME = 8192


def key(*parts: Column | str | int) -> Column:
    """md5 of the parts with ``|`` between them; sorting by it is a random order."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary"))


def uniform(*parts: Column | str | int) -> Column:
    """In [0, 1), in steps of 2**-32."""
    return F.conv(F.substring(key(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(*parts: Column | str | int) -> Column:
    """Standard normal by Box and Muller."""
    u, v = uniform(*parts, "u"), uniform(*parts, "v")
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(F.lit(6.283185307179586) * v)


def uniforms(numbers: np.ndarray, before: str, after: str) -> np.ndarray:
    """``uniform`` for use in tasks: of ``before``, a number from 0, and ``after`` behind each other, for each of the numbers (int64).

    md5 of short texts that differ in a number alone, step by step for many at once;
    hashlib takes some ten times as long for each. Longer texts are left to it.
    """
    head, tail = before.encode(), after.encode()
    if len(head) + len(tail) > 55 - 19:
        first = [int(hashlib.md5(b"%s%d%s" % (head, n, tail)).hexdigest()[:8], 16) for n in numbers.tolist()]
        return np.array(first, np.float64) / 4294967296.0
    out = np.empty(len(numbers))
    digits = np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), numbers, side="right") + 1
    for d in np.flatnonzero(np.bincount(digits)):
        own = np.flatnonzero(digits == d)
        for k in range(0, len(own), _SOME):
            at = own[k : k + _SOME]
            out[at] = _first_words(numbers[at], int(d), head, tail)
    return out / 4294967296.0


def normals(numbers: np.ndarray, before: str, after: str) -> np.ndarray:
    """``normal`` for use in tasks, as ``uniforms``."""
    u, v = (uniforms(numbers, before, f"{after}|{k}") for k in "uv")
    return np.sqrt(-2.0 * np.log(1.0 - u)) * np.cos(6.283185307179586 * v)


def _first_words(numbers: np.ndarray, digits: int, head: bytes, tail: bytes) -> np.ndarray:
    """The first four bytes of the md5 digests, as a number, of texts of one length."""
    size = len(head) + digits + len(tail)
    text = np.zeros((64, len(numbers)), np.uint8)
    text[: len(head)] = np.frombuffer(head, np.uint8)[:, None]
    for k in range(len(head) + digits - 1, len(head) - 1, -1):
        rest = numbers // 10
        text[k], numbers = numbers - rest * 10 + 48, rest
    text[size - len(tail) : size] = np.frombuffer(tail, np.uint8)[:, None]
    text[size] = 0x80
    words = [sum(text[4 * w + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4)) for w in range(size // 4 + 1)]
    words += [np.uint32(0)] * (14 - len(words)) + [np.uint32(8 * size), np.uint32(0)]
    a, b, c, d = (np.full(len(numbers), v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    start, low = a, np.empty_like(a)
    for i, (add, word) in enumerate(zip(_ADD, _WORD, strict=True)):
        kind, turn = i // 16, _SHIFT[i // 16][i % 4]
        f = d ^ (b & (c ^ d)) if kind == 0 else c ^ (d & (b ^ c)) if kind == 1 else b ^ c ^ d if kind == 2 else c ^ (b | ~d)
        f += a
        f += add
        f += words[word]
        np.right_shift(f, np.uint32(32 - turn), out=low)
        f <<= np.uint32(turn)
        f |= low
        f += b
        a, d, c, b = d, c, b, f
    return (a + start).byteswap()
