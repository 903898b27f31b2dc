"""Words of many texts at once, with values per distinct word from a bounded cache."""

from __future__ import annotations

import numpy as np

from quillon.llm.pieces import _BYTE_HASH, _PLACE_HASH, NumberTable, distinct

#: Distinct words that a worker keeps.
CACHE_WORDS = 150_000
#: Bytes of words: ASCII letters and digits and all of UTF-8 beyond ASCII.
WORD_BYTES = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
FIRST, LAST = 2, 3  # stand before and behind a word


def lowered(texts: list[bytes]) -> list[bytes]:
    return [t.lower() if t.isascii() else t.decode("utf-8").lower().encode() for t in texts]


def spans(texts: list[bytes], word_bytes: np.ndarray = WORD_BYTES) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, words per text): the maximal runs of word bytes in texts joined by line ends."""
    data = b"\n".join(texts) + b"\n"
    inside = word_bytes[np.frombuffer(data, np.uint8)]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_end = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, text_end)
    return data, starts, ends, np.diff(upto, prepend=0)


def word_keys(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[start:end]."""
    raw = np.frombuffer(data, np.uint8)
    place = np.arange(len(raw)) - np.repeat(np.append(0, starts), np.diff(np.r_[0, starts, len(raw)]))
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    term = np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, _BYTE_HASH[raw] * (_PLACE_HASH[place & 4095] + (place >> 12).astype(np.uint64)), 0)
    return np.add.reduceat(term, starts) + (ends - starts).astype(np.uint64)


class WordTable:
    """``compute(list[bytes]) -> array (n, k)`` for distinct words, kept by 64-bit hash."""

    def __init__(self, compute, width: int, limit: int = CACHE_WORDS):
        self.compute, self.width, self.limit = compute, width, limit
        self.clear()

    def clear(self):
        self.index = NumberTable()
        self.values = np.zeros((1 << 12, self.width), np.float32)

    def look_up(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The values of each word data[start:end], an array (words, width)."""
        number = self.numbers(data, starts, ends)  # first, as it may put another array in the place of values
        return self.values[number]

    def numbers(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where in ``values`` each word data[start:end] stands, until the next call."""
        if self.index.count > self.limit:
            self.clear()
        if not len(starts):
            return np.zeros(0, np.int64)
        key = word_keys(data, starts, ends)
        keys, first, inverse = distinct(key)
        found = self.index.find(keys)
        if len(missing := np.flatnonzero(found < 0)):
            at = first[missing]
            new = [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            n = self.index.count
            while len(self.values) < n + len(new):
                self.values = np.concatenate([self.values, self.values])
            self.values[n : n + len(new)] = self.compute(new)
            found[missing] = self.index.add(keys[missing])
        return found[inverse].astype(np.int64)


def framed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, place in word, start of each word) of words between FIRST and LAST."""
    raw = np.frombuffer(b"\x02" + b"\x03\x02".join(words) + b"\x03" if words else b"", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    return raw, np.arange(len(raw)) - np.repeat(starts, sizes), starts


def gram_levels(raw: np.ndarray, order: int):
    """For k from 1 to order: the hash of the k symbols that end at each place, one array at a time."""
    last = _BYTE_HASH[raw]
    yield last
    for _ in range(order - 1):
        step = _BYTE_HASH[raw]
        for a in range(1, len(raw), 1 << 16):  # in blocks, so that no second array is held
            z = min(a + (1 << 16), len(raw))
            step[a:z] += last[a - 1 : z - 1] * np.uint64(0x9E3779B97F4A7C15)
        last = step
        yield step


def grams(raw: np.ndarray, order: int) -> list[np.ndarray]:
    """grams[k - 1][i]: hash of the k symbols that end at i, its low bits mixed."""
    return [h ^ (h >> np.uint64(29)) for h in gram_levels(raw, order)]
