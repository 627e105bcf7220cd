"""Whole-text token ids from a tokenizer file, with a bounded cache of pieces between spaces.

Both vocabularies split a text into pre-tokens before merging, and a pre-token
never runs across the places cut here, so the ids of a text are those of its
pieces in order. A piece that is one Latin word with marks behind it goes to the
library's model word by word, any other piece through the library's whole
pipeline. Control strings of the vocabulary (``<|endoftext|>``) that stand in a
text are read as the library reads them, as one id; ``plain_controls`` makes them
ordinary text.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

#: A space at which a pre-token might not start: the next character could be white space or the end.
_UNSURE = re.compile(r" (?![!-~]|[^\W_])")
_SURE_CUT = re.compile(r" (?=[!-~]|[^\W_])")
#: One word of Latin letters, then ASCII marks without the apostrophe.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ſ]+)([!-&(-/:-@\[-`{-~]*)")
#: Words in one generation of a worker's cache, about 150 bytes each; half as many pieces are kept beside them.
CACHE_WORDS = 600_000
_PIECE_CHARS = 48
_encoders: dict[tuple, Encoder] = {}


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write each byte as one printable character: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class _Cache(dict):
    """Two generations: when the young one is full it becomes the old one, so at most twice ``size`` stay."""

    def __init__(self, make, size: int) -> None:
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = self.make(piece)
        if len(piece) <= _PIECE_CHARS:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """``mode`` "byte": white space belongs to pre-tokens. ``mode`` "word": white space only separates them. ``width``: bytes of an id.

    A vocabulary whose control strings hold white space, or take in the white space
    beside them, isn't cut into pieces: whole texts go through the library.
    """

    def __init__(self, path: str, mode: str, width: int, cache_words: int = CACHE_WORDS, plain_controls: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain_controls
        added = self.tok.get_added_tokens_decoder().values()
        self.controls = tuple(a.content for a in added)
        self.cuttable = not any(a.lstrip or a.rstrip or a.single_word or any(map(str.isspace, a.content)) for a in added)
        self.model = self.tok.model
        self.mode, self.kind = mode, {2: "H", 4: "I"}[width]
        self.words = _Cache(self._word, cache_words)
        self.pieces = _Cache(self._bare if mode == "word" else self._after_space, cache_words // 2)

    def _ids(self, ids: list[int]) -> bytes:
        out = array(self.kind, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _whole(self, text: str) -> bytes:
        return self._ids(self.tok.encode(text, add_special_tokens=False).ids)

    def _word(self, text: str) -> bytes:
        """A whole pre-token by the model alone, which reads the byte-level spelling."""
        if not text.isascii():
            text = text.encode().decode("latin-1")
        return self._ids([t.id for t in self.model.tokenize(text.translate(_LETTERS))])

    def _after_space(self, piece: str) -> bytes:
        lines = [_WORD.fullmatch(p) for p in piece.split("\n")]
        if not all(lines) or any(c in piece for c in self.controls):
            return self._whole(" " + piece)
        out, before = [], " "
        for m in lines:
            if out:
                out.append(self.words["\n"])
            out.append(self.words[before + m[1]])
            if m[2]:
                out.append(self.words[m[2]])
            before = ""
        return b"".join(out)

    def _bare(self, piece: str) -> bytes:
        if not (m := _WORD.fullmatch(piece.lower())) or "İ" in piece or any(c in piece for c in self.controls):
            return self._whole(piece)
        return self.words[m[1]] + (self.words[m[2]] if m[2] else b"")

    def encode(self, text: str | None) -> bytes:
        """Little-endian ids of the whole text; null counts as empty."""
        if not text:
            return b""
        if not self.cuttable:
            return self._whole(text)
        get = self.pieces.__getitem__
        if self.mode == "word":
            # the library looks for control strings before it lower-cases
            if text.isascii() and "<" not in text:
                text = text.lower()
            return b"".join(map(get, filter(None, text.replace("\n", " ").split(" "))))
        head, *rest = _SURE_CUT.split(text) if _UNSURE.search(text) else text.split(" ")
        return (self._whole(head) if head else b"") + b"".join(map(get, rest))


def encoder(path: str, mode: str, width: int, cache_words: int = CACHE_WORDS, plain_controls: bool = False) -> Encoder:
    """One encoder for each Python worker and kind; ``width`` is the bytes of an id."""
    key = (path, mode, width, cache_words, plain_controls)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
