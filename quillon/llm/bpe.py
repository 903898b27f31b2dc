"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks the keys of all
adjacent pairs up by binary search in the sorted pair keys, takes in each word
the pair of lowest rank, and merges all its places at once; words without a
known pair leave the array. Distinct words are encoded once per worker.

Defined cases: null text counts as empty; empty text has no ids; the strings
of special tokens in a text become their ids, as in the library; repeated rows
each get a row; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import gather, own_columns, runs, utf8
from quillon.llm.pieces import PieceCache, byte_alphabet, byte_level_pieces

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: How byte-level BPE cuts a text into words (a fixed value of the format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE = 4 << 20


class NumpyBpe:
    """A byte-level BPE vocabulary with batched encoding and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        raw = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items() if all(c in alphabet for c in s)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        raw |= {i: s for s, i in self.special.items()}
        self.size = max(raw) + 1
        self.byte_id = np.full(256, -1, np.int64)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab.get(c, -1)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        table = [raw.get(i, b"") for i in range(self.size)]
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.token_size = np.array([len(x) for x in table], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.words = regex.compile(PATTERN)
        self.cut_special = regex.compile("|".join(map(regex.escape, sorted((s.decode() for s in self.special), key=len, reverse=True)))) if self.special else None
        self.cache = PieceCache(self.encode_pieces, byte_level_pieces)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys))

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, all words at once in rounds of merges."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        out: list = [sym[:0]] * len(words)
        none = len(self.keys)
        # rank[i]: of the pair (i, i + 1); none across words
        rank = np.full(len(sym), none, np.int64)
        if len(sym) > 1:
            rank[:-1] = np.where(word[:-1] == word[1:], self._ranks(sym[:-1], sym[1:]), none)
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, first)
            if (done := low == none).any():
                ends = np.r_[first[1:], len(sym)]
                for k in np.flatnonzero(done):
                    out[word[first[k]]] = sym[first[k] : ends[k]]
                keep = np.repeat(~done, ends - first)
                sym, word, rank = sym[keep], word[keep], rank[keep]
                low, n = low[~done], (ends - first)[~done]
                if not len(sym):
                    break
            else:
                n = np.r_[first[1:], len(sym)] - first
            hit = rank == np.repeat(low, n)
            # of overlapping places (a a a) every second one merges
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():
                start = np.r_[True, np.diff(at) != 1]
                offset = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                at = at[offset % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))  # places of the merged symbols after the cut
            sym, word, rank = sym[keep], word[keep], rank[keep]
            for place in (new, new - 1):
                place = place[(place >= 0) & (place < len(sym))]
                if len(place):
                    right = np.minimum(place + 1, len(sym) - 1)
                    same = (place < right) & (word[place] == word[right])
                    rank[place] = np.where(same, self._ranks(sym[place], sym[right]), none)
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of text: words by pattern, special strings whole."""
        words: dict[bytes, int] = {}
        plan: list[list[int]] = []  # >= 0: a word, < 0: a special id

        def add(part: str, row: list[int]) -> None:
            row.extend(words.setdefault(w.encode(), len(words)) for w in self.words.findall(part))

        marks = list(self.special)
        for p in pieces:
            row: list[int] = []
            text, last = p.decode("utf-8"), 0
            if any(s in p for s in marks):
                for m in self.cut_special.finditer(text):
                    add(text[last : m.start()], row)
                    row.append(-1 - self.special[m[0].encode()])
                    last = m.end()
            add(text[last:], row)
            plan.append(row)
        ids = self.merge_words(list(words))
        of = lambda k: ids[k] if k >= 0 else np.array([-1 - k])
        return [of(row[0]) if len(row) == 1 else np.concatenate([of(k) for k in row]) if row else np.zeros(0, np.int64) for row in plan]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text)."""
        return self.cache.encode(texts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; bytes that are no UTF-8 become U+FFFD."""
        sizes = self.token_size[ids]
        flat = gather(self.token_bytes, self.token_start[ids], sizes).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        parts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [p if not counts[i] else p.decode("utf-8", "replace").encode() for i, p in enumerate(parts)]


_LOADED: dict[str, NumpyBpe] = {}


def loaded(path: str) -> NumpyBpe:
    """This worker's tokenizer of the file ``path``."""
    if path not in _LOADED:
        _LOADED[path] = NumpyBpe(path)
    return _LOADED[path]


def _decimal_sha256(digits: list[bytes], ids: np.ndarray) -> str:
    return hashlib.sha256(b",".join(map(digits.__getitem__, ids.tolist()))).hexdigest()


def bpe_round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Counts and digests of the ids of each text and of their decoding."""

    def step(batches):
        t = loaded(vocabulary)
        digits = [b"%d" % i for i in range(t.size)]
        for b in batches:
            texts = utf8(b.column("text"))
            rows: list[tuple] = []
            for lo, hi in runs([len(x) for x in texts], SLICE):
                ids, counts = t.encode(texts[lo:hi])
                back = t.decode(ids, counts)
                ends = np.cumsum(counts)
                rows += [(int(n), _decimal_sha256(digits, ids[e - n : e]), hashlib.sha256(s).hexdigest()) for n, e, s in zip(counts, ends, back, strict=True)]
            n, a, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(step, OUT)
