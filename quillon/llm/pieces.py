"""Whole texts to token ids by way of a bounded cache of pieces.

A text is cut where no token can cross; each distinct piece is encoded once
per worker and the ids of a batch are gathered with numpy. The cache is
emptied when it is full, so memory stays bounded for any vocabulary.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from itertools import chain

import numpy as np
import pandas as pd

from quillon.llm.common import KEPT, gather

#: Distinct pieces that a worker keeps.
CACHE_PIECES = 1_000_000
#: Bytes hashed at once.
BLOCK = 1 << 16


def token_type(size: int):
    return np.uint16 if size <= 1 << 16 else np.uint32


class NumberTable:
    """Numbers 0, 1, 2, ... of 64-bit keys, by open addressing; whole arrays of keys at once."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.count = 0
        self._room(12)

    def _room(self, bits: int):
        self.bits, self.keys, self.numbers = bits, np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where it isn't known."""
        out, at, left = np.full(len(keys), -1, np.int64), self._slots(keys), np.arange(len(keys))
        while len(left):
            number = self.numbers[at]
            same = self.keys[at] == keys[left]
            hit, on = (number >= 0) & same, (number >= 0) & ~same
            out[left[hit]] = number[hit]
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Number new keys, each given once."""
        new = np.arange(self.count, self.count + len(keys), dtype=np.int32)
        self.count += len(keys)
        if self.count > 1 << self.bits - 1:
            held = self.numbers >= 0
            old = self.keys[held], self.numbers[held]
            self._room(self.count.bit_length() + 1)
            self._put(*old)
        self._put(keys, new)
        return new.astype(np.int64)

    def _put(self, keys: np.ndarray, numbers: np.ndarray):
        at = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.numbers[at] < 0)
            self.numbers[at[free]] = numbers[free]  # of several for a slot the last one stays
            won = free[self.numbers[at[free]] == numbers[free]]
            self.keys[at[won]] = keys[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            keys, numbers, at = keys[left], numbers[left], (at[left] + 1) & ((1 << self.bits) - 1)


class PieceCache:
    """Ids of pieces; ``encode_new(list[bytes]) -> list of ids``.

    ``cut(text)`` gives the pieces of any text. Plain texts, in which every
    piece starts at a mark, a space or a line, are cut and looked up with
    numpy, by 64-bit hashes of their pieces; with ``fold`` in lower case.
    """

    def __init__(self, encode_new, cut, fold: bool = False, limit: int = CACHE_PIECES):
        self.encode_new, self.cut, self.fold, self.limit = encode_new, cut, fold, limit
        self.clear()

    def clear(self):
        self.index = NumberTable()
        self.flat, self.starts, self.lengths = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = self.count = 0

    def _add(self, new: list[bytes]) -> None:
        """Keep the ids of new pieces, behind those kept so far."""
        gc.disable()  # many short lists, no cycles
        try:
            ids = self.encode_new(new)
        finally:
            gc.enable()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        first, total = self.count, int(sizes.sum())
        while len(self.starts) < first + len(new):
            self.starts, self.lengths = np.concatenate([self.starts, self.starts]), np.concatenate([self.lengths, self.lengths])
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, self.flat])
        at = slice(first, first + len(new))
        self.starts[at], self.lengths[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.used, self.count = self.used + total, first + len(new)

    def _numbers(self, data: bytes, starts: np.ndarray) -> np.ndarray:
        """The number of each piece of data; pieces begin at starts."""
        ends = np.append(starts[1:], len(data))
        keys, first, inverse = distinct(piece_hashes(data, starts, ends))
        found = self.index.find(keys)
        if len(missing := np.flatnonzero(found < 0)):
            lo, hi = starts[first[missing]].tolist(), ends[first[missing]].tolist()
            self._add([data[x:y] for x, y in zip(lo, hi, strict=True)])
            found[missing] = self.index.add(keys[missing])
        return found[inverse]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text)."""
        if self.count > self.limit:
            self.clear()
        plain = [is_plain(t) for t in texts]
        parts = [[t.lower() if self.fold else t] if ok else self.cut(t) for t, ok in zip(texts, plain, strict=True)]
        data = b"".join(chain.from_iterable(parts))
        if not data:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        lengths = np.fromiter(map(len, chain.from_iterable(parts)), np.int64)
        pieces = np.fromiter(map(len, parts), np.int64, len(parts))
        where = np.cumsum(lengths) - lengths
        free = np.repeat(np.array(plain), pieces)  # parts that are whole plain texts
        raw = np.frombuffer(data, np.uint8)
        border = STARTS[raw]
        border[1:] |= raw[:-1] == 10
        border &= np.repeat(free, lengths)
        border[where[lengths > 0]] = True
        starts = np.flatnonzero(border)
        numbers = self._numbers(data, starts)
        sizes = self.lengths[numbers]
        ids = gather(self.flat, self.starts[numbers], sizes)
        sums = np.concatenate([[0], np.cumsum(sizes)])
        text_end = np.cumsum([0, *(sum(map(len, p)) for p in parts)])
        edge = sums[np.searchsorted(starts, text_end)]
        return ids, np.diff(edge)


_RANDOM = np.random.default_rng(20240)
_BYTE_HASH = _RANDOM.integers(0, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
_PLACE_HASH = _RANDOM.integers(0, 1 << 63, 1 << 12, np.uint64) << np.uint64(1) | np.uint64(1)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, first place of each, number of each key), by a hash table."""
    number, kinds = pd.factorize(keys)
    first = np.empty(len(kinds), np.int64)
    first[number[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return kinds, first, number


def piece_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; long pieces by a digest."""
    sizes = ends - starts
    raw, out = np.frombuffer(data, np.uint8), np.empty(len(starts), np.uint64)
    blocks = np.searchsorted(starts, np.arange(0, len(data) + BLOCK, BLOCK))  # what a block needs stays in the CPU's cache
    for a, z in zip(blocks[:-1].tolist(), blocks[1:].tolist(), strict=True):
        if z > a:
            lo, hi = int(starts[a]), int(ends[z - 1])
            place = np.arange(lo, hi) - np.repeat(starts[a:z], sizes[a:z])
            out[a:z] = np.add.reduceat(_BYTE_HASH[raw[lo:hi]] * _PLACE_HASH[place & 4095], starts[a:z] - lo)
    out += sizes.astype(np.uint64)
    for k in np.flatnonzero(sizes > 4096):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


#: White space beside which the fast cut isn't sure: other controls, and the first bytes of Unicode spaces.
CONTROLS = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
WIDE = (b"\xc2\xa0", b"\xc2\x85", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
RUNS = re.compile(r"\s*\S+|\s+")


#: Letters, digits, '.', ',', space, line end, and the bytes of U+0080 to U+00FF.
SIMPLE = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + b".,\n \xc3" + bytes(range(0x80, 0xC0))
BESIDE = (b"  ", b"\n\n", b"\n \n", b"..", b".,", b",.", b",,", b" .", b" ,", b"\n.", b"\n,", b"\xc3\x97", b"\xc3\xb7")
#: Bytes at which a piece of a plain text starts.
STARTS = np.isin(np.arange(256), list(b" .,\n"))


def is_plain(text: bytes) -> bool:
    """Whether spaces, line ends, and each '.' and ',' (which must follow a letter or digit) are borders of tokens."""
    return not (text.translate(None, SIMPLE) or text[:1] in (b".", b",") or any(x in text for x in BESIDE))


def byte_level_pieces(text: bytes) -> list[bytes]:
    """Pieces for byte-level BPE, which binds a space to the word behind it.

    Before a single space there is a token border, unless white space stands on
    both sides of it. Texts with such places are cut where white space follows
    something else; texts with information separators, on which libraries
    differ, stay whole.
    """
    if not text:
        return []
    if b"  " in text or b"\n \n" in text or len(text.translate(None, CONTROLS)) < len(text) or any(x in text for x in WIDE):
        if len(text.translate(None, CONTROLS[4:])) < len(text):
            return [text]
        return [x.encode() for x in RUNS.findall(text.decode("utf-8"))]
    first, *rest = text.split(b" ")
    return [first, *[b" " + x for x in rest]] if first else [b" " + x for x in rest]


def library_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def library_encoder(path: str, kind: str):
    """Ids of pieces by the library: a piece that is one word goes to its BPE model, others through all of its steps."""
    t = library_tokenizer(path)
    model, stand_in = t.model, {b: c for c, b in byte_alphabet().items()}
    space = stand_in[32] if kind == "byte" else ""

    def encode(new: list[bytes]) -> list:
        out: list = [None] * len(new)
        rest = []
        for i, piece in enumerate(new):
            text = piece.decode("utf-8")
            word = text[1:] if text[:1] == " " else text
            if word.isalpha() and (word.isascii() or max(word) <= "\xff"):
                word = word if kind == "byte" else word.lower()
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(stand_in)
                out[i] = [x.id for x in model.tokenize(space + word if text[:1] == " " else word)]
            else:
                rest.append(i)
        for k in range(0, len(rest), 20_000):
            part = rest[k : k + 20_000]
            for i, e in zip(part, t.encode_batch_fast([new[i].decode("utf-8") for i in part], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    return encode


_CACHES: dict[tuple, PieceCache] = {}
KEPT.append(_CACHES)


def encode_texts(texts: list[bytes], path: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, ids per text) by the library; kind 'byte' (byte-level) or 'word' (white space dropped, case folded)."""
    if (path, kind) not in _CACHES:
        _CACHES[path, kind] = PieceCache(library_encoder(path, kind), byte_level_pieces if kind == "byte" else bytes.split, kind == "word", CACHE_PIECES if kind == "byte" else CACHE_PIECES // 2)
    return _CACHES[path, kind].encode(texts)
