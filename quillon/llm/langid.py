"""Language of words by a linear-chain conditional random field.

The words of a document are a chain. A word's emission scores are sums of
learned weights of its affixes, character n-grams and its own entry in the
lexicon, hashed into one table; neighbouring words are tied by learned
transition scores. Forward-backward gives each word's label distribution, also
where a text switches between languages; the document's language is the label
with the largest share, its score that share.

The field is trained on at most TRAIN_DOCS rows of each language whose crc32
modulo 4 isn't 2, whatever the number of languages, cut into segments that are
joined across languages, so that transitions are learned from switches. Long
texts give pieces from all over their length. What is learned from are CHAINS
chains in all or LANGUAGE_CHAINS a language, if that is more, of 40 to 79 words.
Every document is labelled on its whole text.

Defined cases: null text or text without a letter gives ``und`` with score 0;
without any row to learn from every document is ``und``; words without a
letter aren't part of the chain; ties go to the language first in order;
repeated rows are labelled each; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import own_columns, runs, utf8
from quillon.llm.toxicity import score_column
from quillon.llm.training import PIECES, TRAIN_CHARS, excerpt, remainder  # noqa: F401
from quillon.llm.words import WordTable, framed, grams, lowered, spans

#: Rows learned from, per language.
TRAIN_DOCS = 400
#: LANGUAGE_CHAINS hold some 470 segments of each language, more than it has rows to learn from.
CHAIN, CHAINS, LANGUAGE_CHAINS = 40, 3000, 200
FEATURES = 1 << 17
STEPS = 60
#: Words times labels that training holds at once.
BLOCK = 4 << 20
SLICE = 4 << 20
OUT = "doc_id long, held_out boolean, lang_pred string, score double"
WORD = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
LETTER = re.compile(r"[^\W\d_]")


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature of each entry, word of each entry): n-grams to four, prefixes and suffixes to three, the word."""
    raw, place, starts = framed(words)
    size = np.diff(np.append(starts, len(raw)))
    word = np.repeat(np.arange(len(words)), size)
    g = grams(raw, 4)
    ends = starts + size - 1
    feature, owner = [], []
    for k in range(1, 5):
        at = np.flatnonzero(place >= k - 1)
        feature.append(g[k - 1][at] + np.uint64(k * 0x51ED27))
        owner.append(word[at])
    for k in (2, 3, 4):  # with FIRST or LAST in it, a gram of the frame is an affix; weighed once more by its length
        ok = np.flatnonzero(size >= k)
        for at, salt in ((starts[ok] + k - 1, 0xA511), (ends[ok], 0xB522)):
            feature.append(g[k - 1][at] * np.uint64(2 * (salt + k) + 1))
            owner.append(ok)
    whole = np.bitwise_xor.reduceat(g[3] * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), starts)
    feature.append(whole + np.uint64(0xC533))
    owner.append(np.arange(len(words)))
    f = np.concatenate(feature)
    f = (f ^ (f >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (f >> np.uint64(64 - 17)).astype(np.int64), np.concatenate(owner)


def forward_backward(score: np.ndarray, trans: np.ndarray, start: np.ndarray, sizes: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Label distribution of each word; score (words, labels), chains one behind the other.

    All chains advance together, longest first, so step t touches the chains
    that still have a word t. The expected number of each transition, forward
    by transition by emission by backward, is added to ``pairs``.
    """
    e = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float64)
    order = np.argsort(-sizes, kind="stable")
    size, first = sizes[order], (np.cumsum(sizes) - sizes)[order]
    a = np.exp(trans - trans.max())
    alpha = np.empty_like(e)
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), side="left")  # chains with size > t
    now = None
    for t in range(longest):
        at = first[: alive[t]] + t
        now = e[at] * (np.exp(start) if t == 0 else now[: alive[t]] @ a)
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    beta = np.ones((int(alive[0]) if longest else 0, e.shape[1]))
    for t in range(longest - 2, -1, -1):
        n = alive[t + 1]
        at = first[:n] + t + 1
        right = e[at] * beta[:n]
        back = right @ a.T
        if pairs is not None:
            left = alpha[first[:n] + t]
            pairs += (left / np.maximum((left * back).sum(axis=1, keepdims=True), 1e-300)).T @ right * a
        beta[:n] = back / back.sum(axis=1, keepdims=True)
        alpha[first[:n] + t] *= beta[:n]
    return alpha / np.maximum(alpha.sum(axis=1, keepdims=True), 1e-300)


class Field:
    """Weights of the random field."""

    def __init__(self, languages: list[str]):
        n = len(languages)
        self.languages, self.weights = languages, np.zeros((FEATURES, n), np.float32)
        self.trans, self.start = np.zeros((n, n)), np.zeros(n)
        self.table: WordTable | None = None

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def emissions(self, words: list[bytes]) -> np.ndarray:
        feature, owner = word_features(words)
        return np.stack([np.bincount(owner, w[feature], len(words)) for w in self.weights.T], axis=1)

    def fit(self, chains: list[list[tuple[bytes, int]]]) -> None:
        """Adam on the conditional likelihood of whole chains, a block of chains at a time."""
        kinds: dict[bytes, int] = {}
        word = np.array([kinds.setdefault(w, len(kinds)) for c in chains for w, _ in c])
        label = np.array([y for c in chains for _, y in c])
        sizes = np.array([len(c) for c in chains])
        n, m = len(self.languages), len(word)
        feature, owner = word_features(list(kinds))
        used, local = np.unique(feature, return_inverse=True)
        w = np.zeros((len(used), n))
        ends = np.cumsum(sizes)
        blocks = [(a, z, int(ends[a] - sizes[a]), int(ends[z - 1])) for a, z in runs((sizes * n).tolist(), BLOCK)]
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, self.trans, self.start)]
        for step in range(1, STEPS + 1):
            kind_score = np.stack([np.bincount(owner, w[local, k], len(kinds)) for k in range(n)], axis=1)
            by_kind, gt, gs = np.zeros((len(kinds), n)), np.zeros((n, n)), np.zeros(n)
            for a, z, lo, hi in blocks:
                miss, t, s = self.misses(kind_score[word[lo:hi]], label[lo:hi], sizes[a:z])
                by_kind += np.stack([np.bincount(word[lo:hi], miss[:, k], len(kinds)) for k in range(n)], axis=1)
                gt += t
                gs += s
            gw = np.stack([np.bincount(local, by_kind[owner, k], len(used)) for k in range(n)], axis=1) / m + 1e-6 * w
            for x, g, s in ((w, gw, state[0]), (self.trans, gt / m + 1e-4 * self.trans, state[1]), (self.start, gs / m + 1e-4 * self.start, state[2])):
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.99 * s[1] + 0.01 * g * g
                x -= 0.1 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-9)
        self.weights[used] = w

    def misses(self, score: np.ndarray, label: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradient of the negative log-likelihood by the scores, transitions and starts: expected less given."""
        pairs = np.zeros_like(self.trans)
        miss = forward_backward(score, self.trans, self.start, sizes, pairs)
        miss[np.arange(len(label)), label] -= 1
        last = np.cumsum(sizes) - 1
        inner = np.ones(len(label), bool)
        inner[last] = False
        np.subtract.at(pairs, (label[:-1][inner[:-1]], label[1:][inner[:-1]]), 1)
        return miss, pairs, miss[last - sizes + 1].sum(axis=0)

    def label(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        names: list[str] = []
        scores: list[float] = []
        for lo, hi in runs([len(t) for t in texts], SLICE):
            a, b = self._label(texts[lo:hi])
            names += a
            scores += b
        return names, scores

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """Mean label distribution over the words of each text."""
        if self.table is None:
            self.table = WordTable(self.emissions, len(self.languages), limit=300_000)
        data, starts, ends, words = spans(lowered(texts), WORD)
        p = forward_backward(self.table.look_up(data, starts, ends), self.trans, self.start, words)
        text = np.repeat(np.arange(len(texts)), words)
        total = np.stack([np.bincount(text, p[:, k], len(texts)) for k in range(p.shape[1])], axis=1)
        return total / np.maximum(words, 1)[:, None]

    def _label(self, texts):
        share = self.shares(texts)
        best = share.argmax(axis=1)
        known = [bool(LETTER.search(t.decode("utf-8"))) for t in texts]
        names = [self.languages[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
        return names, [float(min(1.0, share[i, k])) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, known, strict=True))]


def code_switched(texts: dict[str, list[bytes]], languages: list[str]) -> list[list[tuple[bytes, int]]]:
    """Chains of at least CHAIN words: segments of 5 to CHAIN words, each from the next document of some language."""
    rng = np.random.default_rng(11)
    words = {}
    for name in languages:
        rows = []
        for t in texts[name]:
            data, starts, ends, _ = spans(lowered([t]), WORD)
            if len(starts):
                rows.append([data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        words[name] = rows
    usable = [k for k, name in enumerate(languages) if words[name]]
    deal = {k: itertools.cycle(rng.permutation(len(words[languages[k]])).tolist()) for k in usable}
    chains = []
    for _ in range(max(CHAINS, LANGUAGE_CHAINS * len(usable)) if usable else 0):
        chain: list[tuple[bytes, int]] = []
        while len(chain) < CHAIN:
            k = int(rng.choice(usable))
            row = words[languages[k]][next(deal[k])]
            n = int(rng.integers(5, CHAIN + 1))
            at = int(rng.integers(max(1, len(row) - n + 1)))
            chain += [(w, k) for w in row[at : at + n]]
        chains.append(chain)
    return chains


def train(docs: DataFrame) -> Field | None:
    """A field learned from text and lang of rows whose crc32 modulo 4 isn't 2.

    Two passes: rows per language, then the rows with the least hashes of each
    language, of which only those below about four times the wanted share leave
    their task, cut to excerpts.
    """
    rows = own_columns(docs, "doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.where(remainder(F.col("doc_id").cast("long"), 4) != 2)
    # as many rows as there are languages to learn, each of which takes a column of the model
    share = rows.groupBy("lang").count().select("lang", (F.lit(4.0 * TRAIN_DOCS) / F.col("count")).alias("share"))
    low = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 <= F.col("share")
    near = rows.join(F.broadcast(share), "lang").where(low & (F.length("text") > 0))
    near = near.groupBy("lang", F.xxhash64("doc_id").alias("h"), "doc_id").agg(excerpt(F.min("text")).alias("text"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    got = ranked.where(F.col("rank") <= TRAIN_DOCS).select("lang", "doc_id", "text").toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(got.column("lang").to_pylist(), utf8(got.column("text")), strict=True):
        texts.setdefault(lang, []).append(text)
    return fit(texts)


def fit(texts: dict[str, list[bytes]]) -> Field | None:
    languages = sorted(texts)
    chains = code_switched(texts, languages) if languages else []
    if not chains:
        return None
    field = Field(languages)
    field.fit(chains)
    return field


def language(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """held_out, predicted language and its share, of each document."""
    field = field or train(docs)

    def step(batches, m):
        for b in batches:
            texts = utf8(b.column("text"))
            names, scores = m.label(texts) if m else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    few = own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    few = few.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)))
    return score_column(few, field, OUT, step)
