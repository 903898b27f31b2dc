"""Quality by Bradley-Terry pairwise ranking.

Every document has a latent strength, linear in features of its text; that a
good document beats a poor one is a logistic function of the difference of
their features. The weights are learned from the preferences between each
labelled good and each poor document; the cut between them is the quantile of
the strengths at which as many lie above as are good. Scores are logistic in
the distance to that cut.

Every labelled row is learned from, on its whole text. The likelihood of all
pairs is never summed pair by pair: its gradient weighs a document by a smooth
function of its strength, the strengths of the other label being binned on a
grid of STEP (linear between its knots, which is off by STEP ** 2 / 80 at most).

Defined cases: null or empty text has the features of an empty text; without
labelled rows of both kinds every score is 0.5; repeated rows are scored each;
other columns are not looked at.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import own_columns, utf8
from quillon.llm.toxicity import kept_rows, score_column
from quillon.llm.training import feature_table, labelled_rows, remainder

#: RIDGE is a pair's, on the mean likelihood.
RIDGE, STEP, STEPS = 20 / 40_000, 1 / 32, 30
#: Bins by which the cut is searched; so many strengths are looked at singly.
BINS, SINGLE = 4096, 100_000
WIDTH = 18
OUT = "doc_id long, held_out boolean, score double, predicted int"
UPPER, LOWER, DIGITS = (np.isin(np.arange(256), list(range(*r))) for r in ((65, 91), (97, 123), (48, 58)))
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>@=+_~^{}[]\\/"))
STOPS = np.isin(np.arange(256), list(b".,;:"))


def features(text: bytes) -> list[float]:
    """Shares of kinds of characters, words and lines in a text."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, int(count[UPPER].sum() + count[LOWER].sum()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct, n1 = len(set(words)), max(1, n)
    again = sum(map(bytes.__eq__, words, words[1:]))
    odd = sum(x[-1:] in (b"!", b"#", b"%", b"$", b"&", b"*") for x in words)
    return [
        np.log1p(n), n < 20, n < 50, size / n1 / 10, count[UPPER].sum() / letters, count[DIGITS].sum() / size * 5, count[SYMBOLS].sum() / n1,
        count[33] / n1, count[63] / n1, count[STOPS].sum() / n1, count[124] / n1, distinct / n1, again / n1, odd / n1,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(n1 / max(1, len(lines))), text.count(b"http") / n1, text.count(b"@") / n1 * 5,
    ]


class Ranker:
    def __init__(self, mean, spread, weights, cut, scale):
        self.mean, self.spread, self.weights, self.cut, self.scale = mean, spread, weights, cut, scale

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.concatenate([z, np.abs(z), np.minimum(np.abs(z), 1)], axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        known: dict[bytes, int] = {}
        place = [known.setdefault(t, len(known)) for t in texts]
        u = self.expand(np.array([features(t) for t in known], float)) @ self.weights
        return (1 / (1 + np.exp(-np.clip((u - self.cut) * self.scale, -30, 30))))[place]


def moments(x: np.ndarray, good: np.ndarray) -> dict:
    return {int(v): np.concatenate([[len(x[good == v])], x[good == v].sum(0), (x[good == v] ** 2).sum(0)]) for v in np.unique(good)}


def knots(ranker: Ranker, x: np.ndarray, good: np.ndarray) -> dict:
    """By label and knot of the grid of strengths: how many documents, and the sum of what they expand to."""
    z, out = ranker.expand(x), {}
    at = z @ ranker.weights / STEP
    for v in np.unique(good):
        rows = good == v
        low = np.floor(at[rows])
        kind, place = np.unique(np.concatenate([low, low + 1]).astype(np.int64), return_inverse=True)
        part = np.concatenate([1 - (at[rows] - low), at[rows] - low])
        columns = [np.ones(int(rows.sum())), *z[rows].T]
        sums = np.stack([np.bincount(place, part * np.tile(c, 2), len(kind)) for c in columns], axis=1)
        out |= {(int(v), int(k)): row for k, row in zip(kind, sums, strict=True)}
    return out


def curvature(ranker: Ranker, weights: dict, x: np.ndarray, good: np.ndarray) -> dict:
    """Sum of the outer products of what documents expand to, each by the weight that its label's pairs give its strength."""
    z = ranker.expand(x)
    u = z @ ranker.weights
    c = np.where(good == 1, *(np.interp(u, *weights[v]) for v in (1, 0)))
    return {"h": (z * c[:, None]).T @ z}


def slope(sums: dict) -> tuple[float, np.ndarray, np.ndarray, dict]:
    """Of all pairs, from the sums at knots: mean loss, its gradient, the part of the curvature across labels, weights for the rest."""
    at, n, z = {}, {}, {}
    for v in (0, 1):
        found = sorted(k for w, k in sums if w == v)
        held = np.array([sums[v, k] for k in found])
        at[v], n[v], z[v] = np.array(found) * STEP, held[:, 0], held[:, 1:]
    pairs, width = n[1].sum() * n[0].sum(), z[0].shape[1]
    loss, gradient, across = 0.0, np.zeros(width), np.zeros((width, width))
    weight, back, pull = np.zeros(len(n[1])), np.zeros(len(n[0])), np.zeros(len(n[0]))
    for a in range(0, len(n[1]), 256):  # in blocks, so that no square of all knots is held
        own = slice(a, a + 256)
        d = np.subtract.outer(at[1][own], at[0])
        miss = 1 / (1 + np.exp(np.clip(d, -500, 500)))
        bend = miss * (1 - miss)
        loss += n[1][own] @ np.logaddexp(0, -d) @ n[0]
        gradient -= (miss @ n[0]) @ z[1][own]
        across += z[1][own].T @ bend @ z[0]
        weight[own] = bend @ n[0]
        back += n[1][own] @ bend
        pull += n[1][own] @ miss
    gradient += pull @ z[0]
    return loss / pairs, gradient / pairs, (across + across.T) / pairs, {1: (at[1], weight / pairs), 0: (at[0], back / pairs)}


def learn(totals, share: float | None = None) -> Ranker | None:
    """From totals(f), the sums of f(features, good) over all labelled documents.

    share: of good documents among the labelled ones, where it isn't that of the given ones.
    """
    m = totals(moments)
    if len(m) < 2:
        return None
    count = {v: m[v][0] for v in m}
    # either label has half of a say in the scale
    mean, square = (sum(m[v][1 + k * WIDTH : 1 + (k + 1) * WIDTH] / count[v] for v in m) / 2 for k in (0, 1))
    ranker = Ranker(mean, np.sqrt(np.maximum(square - mean**2, 0)) + 1e-6, np.zeros(3 * WIDTH), 0.0, 1.0)
    before, step = np.inf, np.zeros(3 * WIDTH)
    for _ in range(STEPS):
        loss, gradient, across, weights = slope(totals(partial(knots, ranker)))
        loss += RIDGE / 2 * ranker.weights @ ranker.weights
        if loss > before + 1e-6:  # too far
            step = step / 2
        else:
            before, h = loss, totals(partial(curvature, ranker, weights))["h"] - across
            step = -np.linalg.solve(h + RIDGE * np.eye(len(h)), gradient + RIDGE * ranker.weights)
            start = ranker.weights
        ranker.weights = start + step
        if np.abs(step).max() < 1e-5:
            break
    share = count[1] / (count[0] + count[1]) if share is None else share
    ranker.cut = quantile(totals, ranker, 1 - share, np.array([(1 - share) / count[0], share / count[1]]))
    return ranker


def strengths(ranker: Ranker, bins: list, single: bool, x: np.ndarray, good: np.ndarray) -> dict:
    """By bin (or strength): documents of either label, of those in the last of the bins."""
    u = ranker.expand(x) @ ranker.weights
    for low, high, k in bins[:-1]:
        u, good = (a[place(u, low, high) == k] for a in (u, good))
    kind, where = np.unique(u if single else place(u, *bins[-1][:2]), return_inverse=True)
    both = np.stack([np.bincount(where, good == v, len(kind)) for v in (0, 1)], axis=1)
    return dict(zip(kind.tolist(), both, strict=True))


def place(u: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip(np.floor((u - low) / (high - low) * BINS), 0, BINS - 1).astype(np.int64)


def quantile(totals, ranker: Ranker, target: float, weights: np.ndarray) -> float:
    """The least strength up to which the documents weigh ``target``: bins in bins until few strengths are left, then exactly."""
    most = 6 * np.abs(ranker.weights).sum() + 1e-9  # what a document expands to is 6 at most
    low, high, below, bins, single = -most, most, 0.0, [], False
    while True:
        found = totals(partial(strengths, ranker, [*bins, (low, high, None)], single))
        kinds = sorted(found)
        upto = below + np.cumsum([found[k] @ weights for k in kinds])
        k = min(len(kinds) - 1, int(np.searchsorted(upto, target - 1e-12)))
        if single:
            return float(kinds[k])
        below = float(upto[k - 1]) if k else below
        bins.append((low, high, kinds[k]))
        width = (high - low) / BINS
        low, high = low + kinds[k] * width, low + (kinds[k] + 1) * width
        single = found[kinds[k]].sum() <= SINGLE or width < 1e-12 * most


def fit(texts: list[bytes], good: np.ndarray, share: float) -> Ranker | None:
    """share: of good documents among the labelled ones."""
    x = np.array([features(t) for t in texts], float).reshape(-1, WIDTH)
    return learn(lambda f: f(x, np.asarray(good)), share)


def train(docs: DataFrame, labels: DataFrame) -> Ranker | None:
    def of(b: pa.RecordBatch) -> np.ndarray:
        return np.array([features(t) for t in utf8(b.column("text"))], float).reshape(-1, WIDTH)

    return learn(feature_table(labelled_rows(docs, labels, "quality"), of, WIDTH, "quality-features"))


def quality(docs: DataFrame, labels: DataFrame, ranker: Ranker | None = None) -> DataFrame:
    """held_out, score and verdict of each document."""
    ranker = ranker or train(docs, labels)

    def step(batches, m):
        for b in batches:
            texts = utf8(b.column("text"))
            score = m.scores(texts) if m else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    few = own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    few = few.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)))
    return score_column(few, ranker, OUT, step)


def only_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score under 0.5."""
    return kept_rows(docs, train(docs, labels), lambda texts, m: m.scores(texts) >= 0.5 if m else np.ones(len(texts), bool))
