"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary text each get a Kneser-Ney model over the characters of
words, counted once a document. The highest order has counts of the class
alone; all lower orders are continuation counts shared by both classes, so a
rare expression, inflected or compounded, is smoothed by what both know of its
parts. A word's two log-likelihoods are compared; a document's score is
calibrated on their mean difference per character, on its three words that
lean to toxic most, on how many lean so by LEAN or more, and on how many
distinct words it has, by which the best of many must be judged.

The models are fitted on every labelled row, and the calibration on features
that models of the other half of these rows give; every document is learned
from and scored on its whole text. ``fit`` holds the models of a few texts;
``train`` computes the values of a table's words by tasks (windows.py), of
which tasks get a table of 12 bytes a word.

Defined cases: null or empty texts get the score of a text without evidence;
without labelled rows of both kinds (in either half) every score is 0;
repeated rows are scored each; a null doc_id is kept and never held out; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import give_back, own_columns, runs, slices, utf8
from quillon.llm.pieces import distinct
from quillon.llm.training import feature_table, labelled_rows, logistic, logistic_of, remainder
from quillon.llm.windows import DISCOUNT, ORDER, word_values
from quillon.llm.words import WordTable, framed, gram_levels, lowered, spans, word_keys

#: Difference of log-likelihoods from which on a word counts as leaning to toxic; words that are averaged as the best.
LEAN, BEST = 4.0, 3
THRESHOLD = 0.7
PARTS = 8
SLICE = 1 << 20
OUT = "doc_id long, held_out boolean, score double, predicted int"


class Table:
    """Values by 64-bit key, in 12 bytes an entry: sorted by key, with a first-bits index.

    An entry keeps 32 bits beyond those of its index, so a key that isn't
    there is taken for another once in some four billion look-ups.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(1, int(len(keys)).bit_length())
        order = np.argsort(keys)
        keys = keys[order]
        self.tags, self.values = self._tag(keys), values[order].astype(np.float32)
        self.first = np.searchsorted(self._slot(keys), np.arange((1 << self.bits) + 1)).astype(np.uint32)
        self.most = int(np.diff(self.first).max(initial=0))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def _tag(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(32 - self.bits)).astype(np.uint32)

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        out = np.full(len(keys), default, np.float32)
        slot, tag = self._slot(keys), self._tag(keys)
        at, end = self.first[slot].astype(np.int64), self.first[slot + 1]
        left = np.flatnonzero(at < end)
        for _ in range(self.most):
            hit = self.tags[at[left]] == tag[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
            if not len(left):
                break
        return out


class KneserNey:
    """The two class-conditional models with their shared lower orders.

    The highest order goes by the longest gram that ends at a place: ORDER
    symbols, or fewer from the start of the word's frame. Grams are counted in
    PARTS parts by their context, one behind the other, so that only a part's
    sorting takes memory at a time.
    """

    def __init__(self, words: list[bytes], ordinary: np.ndarray, toxic: np.ndarray):
        raw, place, starts = framed(words)
        size = np.diff(np.append(starts, len(raw)))
        place = np.minimum(place, ORDER).astype(np.uint8)
        counts = [np.repeat(c.astype(np.float32), size) for c in (ordinary, toxic)]
        self.shared, own = [], ([], [])
        below = gram = None
        for k, longer in enumerate(gram_levels(raw, ORDER)):
            if k:
                self.shared.append(_tables([self._continued(k, place, below, gram, longer)]))
                longest = place == k if k < ORDER - 1 else place >= k
                for c, level in zip(counts, own, strict=True):
                    level.append(list(self._weighed(k, longest & (c > 0), gram, longer, c)))
            below, gram = gram, longer
        self.own = [_tables(level) for level in own]

    @staticmethod
    def _continued(k, place, below, gram, longer):
        """The level of grams of k symbols: continuation counts, distinct longer grams by their end."""
        for at in _parts(below, place >= max(1, k - 1)) if k > 1 else [np.flatnonzero(place >= 1)]:
            before = at[place[at] >= k]
            whole = at[place[at] == k - 1] if k > 1 else at[:0]  # at a word's start nothing longer exists, which counts as one
            at = np.concatenate([before[np.unique(longer[before], return_index=True)[1]], whole[np.unique(gram[whole], return_index=True)[1]]])
            kind, where, count = np.unique(gram[at], return_index=True, return_counts=True)
            yield kind, below[at[where] - 1] if k > 1 else np.zeros(len(kind), np.uint64), count

    @staticmethod
    def _weighed(k, used, gram, longer, count):
        """The longest grams that have k symbols before the last, with the counts of a class."""
        for at in _parts(gram, used):
            kind, where, inverse = np.unique(longer[at], return_index=True, return_inverse=True)
            yield kind + np.uint64(k), gram[at[where] - 1] + np.uint64(k), np.bincount(inverse, count[at], len(kind))

    def word_values(self, words: list[bytes]) -> np.ndarray:
        """Columns: toxic less ordinary log-likelihood, and characters, of each word."""
        raw, place, starts = framed(words)
        at = np.flatnonzero(place >= 1)
        of_word = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(raw))) - 1)
        place = np.minimum(place[at], ORDER).astype(np.uint8)
        p, differ, alive, below = np.full(len(at), 1 / 256, np.float32), np.zeros(len(at)), np.arange(len(at)), None
        for k, gram in enumerate(gram_levels(raw, ORDER)):
            here = at[alive]
            if k < len(self.shared):
                share, weight = self.shared[k]
                known = weight.get(below[here - 1] if k else np.zeros(len(alive), np.uint64), -1)
                # behind a context that was never seen no longer one was, and both classes back off to the same
                alive, here, known = alive[known >= 0], here[known >= 0], known[known >= 0]
                p[alive] = share.get(gram[here], 0) + known * p[alive]
            if k:
                longest = place[alive] == k if k < ORDER - 1 else np.ones(len(alive), bool)
                done, there = alive[longest], here[longest]
                key, context = gram[there] + np.uint64(k), below[there - 1] + np.uint64(k)
                ordinary, toxic = (np.log(share.get(key, 0) + weight.get(context, 1) * p[done]) for share, weight in self.own)
                differ[done] = toxic - ordinary
                alive = alive[~longest]
            below = gram
        return np.stack([np.bincount(of_word, differ, len(words)), np.diff(np.append(starts, len(raw))) - 1], axis=1)


def _parts(context: np.ndarray, used: np.ndarray):
    """The used places, in PARTS parts by the hash that ends before each."""
    part = np.full(len(used), PARTS, np.uint8)
    for a in range(1, len(used), 1 << 16):  # in blocks, so that no second array of hashes is held
        z = min(a + (1 << 16), len(used))
        part[a:z] = context[a - 1 : z - 1] % np.uint64(PARTS)
    part[~used] = PARTS
    for n in range(PARTS):
        yield np.flatnonzero(part == n)


def _tables(levels) -> tuple[Table, Table]:
    """Discounted shares of grams and weights of their contexts, from parts of (distinct grams, contexts, counts) that share no context."""
    shares, weights = [], []
    for gram, context, count in (part for level in levels for part in level):
        contexts, inverse = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(inverse, count, len(contexts)), np.bincount(inverse, minlength=len(contexts))
        shares.append((gram, (np.maximum(count - DISCOUNT, 0) / total[inverse]).astype(np.float32)))
        weights.append((contexts, (DISCOUNT * kinds / total).astype(np.float32)))
    return tuple(Table(*(np.concatenate(x) for x in zip(*side, strict=True))) for side in (shares, weights))


class Scorer:
    """Values of words and the calibration on top; small enough to travel with each task.

    ``values`` knows the words of the table that it was made for, others count nothing.
    """

    def __init__(self, values: Table, weights: np.ndarray):
        self.values, self.weights = values, weights

    def look_up(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word data[start:end], values by number): the toxic less ordinary log-likelihood."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0)
        keys, _, number = distinct(word_keys(data, starts, ends))
        return number.astype(np.int64), self.values.get(keys, 0).astype(np.float64)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Per text: 1, mean difference per character, mean of its best distinct words, how many lean to toxic, how many there are."""
        data, starts, ends, words = spans(lowered(texts))
        number, value = self.look_up(data, starts, ends)
        text = np.repeat(np.arange(len(texts)), words)
        total = np.bincount(text, value[number], len(texts)) / np.maximum(np.bincount(text, ends - starts + 1, len(texts)), 1)
        pair = np.unique(text << 32 | number)
        text, diff = pair >> 32, value[pair & 0xFFFFFFFF]
        kinds = np.bincount(text, minlength=len(texts))
        lean = np.bincount(text, diff >= LEAN, len(texts))
        order = np.lexsort((-diff, text))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(kinds) - kinds, kinds)
        best = order[rank < BEST]
        best = np.bincount(text[best], diff[best], len(texts)) / np.clip(kinds, 1, BEST)
        return np.stack([np.ones(len(texts)), total, best, np.log1p(lean), np.log1p(kinds)], axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = [self._calibrated(self.features(texts[lo:hi])) for lo, hi in runs([len(t) for t in texts], SLICE)]
        return np.concatenate(out) if out else np.zeros(0)

    def _calibrated(self, x):
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


class Model(Scorer):
    """A Scorer by models in memory, for any words."""

    def __init__(self, kn: KneserNey, weights: np.ndarray):
        self.kn, self.weights = kn, weights
        self.table: WordTable | None = None

    def __getstate__(self):
        return {"kn": self.kn, "weights": self.weights, "table": None}

    def look_up(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.table is None:
            self.table = WordTable(self.kn.word_values, 2)
        number = self.table.numbers(data, starts, ends)
        return number, self.table.values[:, 0].astype(np.float64)


def distinct_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, text of each entry, word of each entry): every text's distinct words once."""
    kinds: dict[bytes, int] = {}
    owner, number = [], []
    for i, t in enumerate(texts):
        data, starts, ends, _ = spans(lowered([t]))
        own = {kinds.setdefault(data[a:b], len(kinds)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}
        owner.append(np.full(len(own), i, np.int32))
        number.append(np.fromiter(own, np.int32, len(own)))
    return list(kinds), np.concatenate(owner), np.concatenate(number)


def fit(texts: list[bytes], toxic: np.ndarray) -> Model | None:
    """Calibrated on what the models of either half give for the other; the models that score are of all rows."""
    half = np.arange(len(texts)) % 2 == 0
    if any(len(set(toxic[rows].tolist())) < 2 for rows in (half, ~half)):
        return None
    kinds, owner, number = distinct_words(texts)

    def models(rows: np.ndarray) -> KneserNey:
        ordinary, bad = (np.bincount(number[rows[owner] & (toxic[owner] == v)], minlength=len(kinds)).astype(float) for v in (0, 1))
        some = np.flatnonzero(ordinary + bad)
        return KneserNey([kinds[k] for k in some.tolist()], ordinary[some], bad[some])

    x = np.zeros((len(texts), 5))
    for rows in (half, ~half):
        probe, at = Model(models(~rows), np.zeros(5)), np.flatnonzero(rows)
        for lo, hi in runs([len(texts[i]) for i in at], SLICE):
            x[at[lo:hi]] = probe.features([texts[i] for i in at[lo:hi]])
        del probe  # not held beside the next models
        give_back()
    return Model(models(np.ones(len(texts), bool)), logistic(x, toxic, ridge=0.1))


def train(docs: DataFrame, labels: DataFrame) -> Scorer | None:
    """A Scorer for the words of docs, learned from all of its labelled rows."""
    kind = (F.col("label") * 2 + F.pmod(F.xxhash64("doc_id"), F.lit(2))).cast("int")
    rows, every = (labelled_rows(docs, labels, "toxic", how).withColumn("kind", kind) for how in ("inner", "left"))
    if rows.select("kind").distinct().count() < 4:
        return None
    values = word_values(every.select("text", "kind"))

    def table(got: pa.Table, name: str) -> Table:
        return Table(got.column("key").to_numpy().view(np.uint64), got.column(name).to_numpy())

    got = values.where("learned").select("key", "h0", "h1").toArrow()
    halves = docs.sparkSession.sparkContext.broadcast([table(got, name) for name in ("h0", "h1")])
    del got

    def of(b: pa.RecordBatch) -> np.ndarray:
        texts, half = utf8(b.column("text")), b.column("kind").to_numpy() & 1
        x = np.zeros((len(texts), 5))
        for h in (0, 1):
            at = np.flatnonzero(half == h)
            probe = Scorer(halves.value[1 - h], np.zeros(5))
            for lo, hi in runs([len(texts[i]) for i in at], SLICE):
                x[at[lo:hi]] = probe.features([texts[i] for i in at[lo:hi]])
        return x

    weights = logistic_of(feature_table(rows, of, 5, "toxicity-features"), 5, ridge=0.1)
    halves.destroy()
    scorer = Scorer(table(values.select("key", "all").toArrow(), "all"), weights)
    give_back()
    return scorer


def score_column(docs: DataFrame, model, schema: str, step) -> DataFrame:
    """docs.mapInArrow with a model that goes to the executors once, by broadcast; a worker makes room before it loads it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        give_back()
        yield from step(batches, shared.value)

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, model: Scorer | None = None) -> DataFrame:
    """held_out, score and verdict of each document."""
    model = model or train(docs, labels)

    def step(batches, m):
        for b in batches:
            texts = utf8(b.column("text"))
            score = m.scores(texts) if m else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    few = own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    few = few.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)))
    return score_column(few, model, OUT, step)


def kept_rows(docs: DataFrame, model, keep) -> DataFrame:
    """The rows of docs, with all columns, whose text passes ``keep(texts, model) -> mask``; no shuffle."""

    def step(batches, m):
        for b in (x for whole in batches for x in slices(whole, SLICE)):
            yield b.filter(pa.array(keep(utf8(b.column("text")), m)))

    return score_column(docs, model, docs.schema, step)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score THRESHOLD or more."""
    return kept_rows(docs, train(docs, labels), lambda texts, m: m.scores(texts) < THRESHOLD if m else np.ones(len(texts), bool))
