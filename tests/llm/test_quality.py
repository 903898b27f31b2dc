"""Bradley-Terry against its likelihood, the quantile cut, and documents that weren't learned from."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import quality_classifier as q
from quillon.llm.queries import op3_quality_classifier
from quillon.llm.training import logistic

LARGE = "/root/testdata/sf0.1"


def sample(n=160, seed=3):
    rng = np.random.default_rng(seed)
    good = rng.random(n) < 0.4
    words = lambda k: " ".join("".join(rng.choice(list("abcdefghi"), rng.integers(2, 9))) for _ in range(k))
    texts = [(words(rng.integers(40, 120)) + "." if g else words(rng.integers(3, 60)) + " ### $$$ !!!" * rng.integers(0, 6)).encode() for g in good]
    return texts, good.astype(np.int64)


def test_weights_are_where_the_likelihood_of_pairs_is_greatest():
    """The gradient of the pairs' log-likelihood, less the ridge, is zero, and any step away is worse."""
    rng = np.random.default_rng(1)
    z = rng.normal(size=(50, 4))
    a, b = rng.integers(0, 50, (2, 400))
    wins = (rng.random(400) < 1 / (1 + np.exp(-(z[a] - z[b]) @ np.array([1.0, -2, 0, 0.5])))).astype(float)
    d = z[a] - z[b]
    w = logistic(d, wins, ridge=2.0)

    def loss(v):
        return np.log1p(np.exp(-(2 * wins - 1) * (d @ v))).sum() + v @ v

    gradient = d.T @ (1 / (1 + np.exp(-d @ w)) - wins) + 2 * w
    assert np.abs(gradient).max() < 1e-4
    assert all(loss(w + step) > loss(w) for step in 0.05 * rng.normal(size=(20, 4)))


def test_all_pairs_of_the_labelled_rows_are_learned_from():
    """The mean loss of each good document against each poor one, with its ridge, has no slope at the weights."""
    texts, good = sample()
    ranker = q.fit(texts, good, 0.4)
    z = ranker.expand(np.array([q.features(t) for t in texts], float))
    d = (z[good == 1][:, None] - z[good == 0][None]).reshape(-1, z.shape[1])
    gradient = -(1 / (1 + np.exp(d @ ranker.weights))) @ d / len(d) + 20 / 40_000 * ranker.weights
    assert np.abs(gradient).max() < 1e-6


def test_no_labelled_row_and_no_part_of_a_text_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(q, "TRAIN_DOCS", 40, raising=False)  # once a bound
    monkeypatch.setattr(q, "SINGLE", 10, raising=False)
    texts, good = sample(240)
    texts[:6] = [t + b" word" * 4000 + b" ### $$$" * 4000 for t in texts[:6]]
    table = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    marks = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    used = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 != 1]
    got, want = q.train(table, marks), q.fit([texts[i] for i in used], good[used], good[used].mean())
    assert np.allclose(got.weights, want.weights, atol=1e-6) and abs(got.cut - want.cut) < 1e-6
    assert np.allclose(got.mean, want.mean) and np.allclose(got.spread, want.spread)


@pytest.mark.parametrize("share", [0.1, 0.4, 0.9])
def test_the_cut_is_the_quantile_of_strengths(share):
    """Weighed back to the labelled rows, the documents above the cut are the share that is good."""
    texts, good = sample()
    ranker = q.fit(texts, good, share)
    u = ranker.expand(np.array([q.features(t) for t in texts], float)) @ ranker.weights
    w = np.where(good == 1, share / (good == 1).sum(), (1 - share) / (good == 0).sum())
    above, at = w[u > ranker.cut].sum(), w[u == ranker.cut].sum()
    assert above <= share + 1e-9 <= above + at + 1e-9
    scores = ranker.scores(texts)
    assert ((scores >= 0.5) == (u >= ranker.cut)).all() and ranker.scores([]).shape == (0,)
    assert scores[good == 1].mean() > scores[good == 0].mean() + 0.3


def test_good_beats_poor_and_equal_texts_tie():
    texts, good = sample(200, 5)
    ranker = q.fit(texts, good, 0.4)
    fresh, truth = sample(120, 9)
    s = ranker.scores(fresh)
    wins = (s[truth == 1][:, None] > s[truth == 0][None, :]).mean()
    assert wins > 0.97
    assert len(set(ranker.scores([b"same text here", b"same text here"]).tolist())) == 1
    assert 0 <= ranker.scores([b""])[0] <= 1 and q.fit(texts, np.zeros(len(texts), np.int64), 0.4) is None


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no test tables")
def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{LARGE}/labels.parquet").select("doc_id", "quality")
    rows = op3_quality_classifier(spark, LARGE).where("held_out").join(truth, "doc_id")
    n, right = rows.agg(F.count("*"), F.count_if(F.col("predicted") == F.col("quality"))).first()
    print(n, right)
    assert n > 1000 and right / n >= 0.98
