"""Kneser-Ney against its definition, and what op6 catches among documents it didn't learn from."""

import collections
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import toxicity, windows
from quillon.llm.queries import op6_toxicity
from quillon.llm.toxicity import DISCOUNT, ORDER, KneserNey, Table

LARGE = "/root/testdata/sf0.1"


class Definition:
    """The models of KneserNey, by dictionaries."""

    def __init__(self, words, ordinary, toxic):
        longer, self.own = collections.defaultdict(set), []
        for w in words:
            s = b"\2" + w + b"\3"
            for i in range(1, len(s)):
                for k in range(1, min(i + 1, ORDER - 1) + 1):
                    # a gram at the start of the frame has nothing before it, which counts as one kind
                    longer[s[i - k + 1 : i + 1]].add(s[i - k : i + 1] if i >= k else None)
        self.shared = self.by_context({g: len(x) for g, x in longer.items()})
        for counts in (ordinary, toxic):
            c = collections.Counter()
            for w, n in zip(words, counts, strict=True):
                s = b"\2" + w + b"\3"
                for i in range(1, len(s)):
                    if n:
                        c[self.longest(s, i)] += n
            self.own.append(self.by_context(c))

    @staticmethod
    def longest(s, i):
        return s[max(0, i - ORDER + 1) : i + 1]

    @staticmethod
    def by_context(counts):
        out = collections.defaultdict(dict)
        for g, n in counts.items():
            out[len(g), g[:-1]][g[-1]] = n
        return out

    @staticmethod
    def smoothed(level, gram, lower):
        seen = level.get((len(gram), gram[:-1]))
        if not seen:
            return lower
        total = sum(seen.values())
        return max(seen.get(gram[-1], 0) - DISCOUNT, 0) / total + DISCOUNT * len(seen) / total * lower

    def probability(self, side, s, i):
        p = 1 / 256
        for k in range(1, min(i + 1, ORDER - 1) + 1):
            p = self.smoothed(self.shared, s[i - k + 1 : i + 1], p)
        return self.smoothed(self.own[side], self.longest(s, i), p)


def some_words(n, seed):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices(["a", "b", "é", "st", "ing", "x"], k=rng.randint(1, 9))).encode() for _ in range(n)})


def test_kneser_ney_is_its_definition():
    words, rng = some_words(120, 1), np.random.default_rng(2)
    ordinary, toxic = rng.integers(0, 4, len(words)).astype(float), rng.integers(0, 2, len(words)).astype(float)
    fast, slow = KneserNey(words, ordinary, toxic), Definition(words, ordinary, toxic)
    asked = [*words[::5], *some_words(40, 3), "unseen".encode(), b"z"]
    got = fast.word_values(asked)
    for w, (diff, size) in zip(asked, got, strict=True):
        s = b"\2" + w + b"\3"
        want = sum(np.log(slow.probability(1, s, i)) - np.log(slow.probability(0, s, i)) for i in range(1, len(s)))
        assert abs(diff - want) < 1e-3 and size == len(w) + 1


def test_values_by_tasks_are_those_of_the_models(spark, monkeypatch):
    """Of all words, from all labelled rows, whole: the models of all of them and of either half."""
    monkeypatch.setattr(toxicity, "TRAIN_DOCS", 30, raising=False)  # once a bound
    monkeypatch.setattr(windows, "BLOCK", 70)
    monkeypatch.setattr(windows, "SLICE", 2000)
    rng, stock = random.Random(6), [*some_words(300, 7), b"zweitausendundvier", b"abababababababab", "\u00fcber\u00dfa\u65e5\u672c".encode()]
    texts = [b" ".join(rng.choices(stock, k=rng.randint(0, 30))) for _ in range(120)]
    texts[5] += b" rare" + b" ab" * 30_000 + b" zork"
    kinds = [rng.choice([None, 0, 1, 2, 3]) for _ in texts]
    kinds[5] = 3
    table = spark.createDataFrame([(t.decode(), k) for t, k in zip(texts, kinds, strict=True)], "text string, kind int").repartition(5)
    got = {np.uint64(r.key & (1 << 64) - 1): r for r in windows.word_values(table).collect()}
    known, owner, number = toxicity.distinct_words(texts)
    assert len(got) == len(known)
    for name, halves in zip(("all", "h0", "h1"), windows.HALVES, strict=True):
        of = [np.array([k == 2 * v + h for k in kinds]) for v in (0, 1) for h in halves]
        sides = [np.bincount(number[np.any(of[v * len(halves) : (v + 1) * len(halves)], axis=0)[owner]], minlength=len(known)).astype(float) for v in (0, 1)]
        some = np.flatnonzero(sides[0] + sides[1])
        want = KneserNey([known[k] for k in some], sides[0][some], sides[1][some]).word_values(known)[:, 0]
        data, starts, ends, _ = windows.spans([b" ".join(known)])
        for key, value in zip(windows.word_keys(data, starts, ends), want, strict=True):
            if name == "all" or got[key].learned:
                assert abs(got[key][name] - value) < 1e-3


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_DOCS", 60, raising=False)  # once a bound
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("aeinrst", k=rng.randint(2, 7)))
    docs = [(i, " ".join([word() for _ in range(30)] + [f"{'zork' if i % 2 else 'calm'}{chr(97 + i // 16)}x"] * 2)) for i in range(400)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(table, spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int"))
    scores = model.scores([t.encode() for _, t in docs])
    assert ((scores >= toxicity.THRESHOLD) == np.arange(400) % 2).mean() > 0.95
    learned = [any(i // 16 == k and i % 2 and zlib.crc32(str(i).encode()) % 3 != 1 for i in range(400)) for k in range(25)]
    value = model.features([f"zork{chr(97 + k)}x".encode() for k in range(25)])[:, 2]  # of the best word, here the only one
    assert sum(learned) > 20 and (value[learned] > 8).all()


def test_kneser_ney_sums_to_one():
    words = some_words(60, 4)
    slow = Definition(words, np.ones(len(words)), np.arange(len(words)) % 3)
    for s in (b"\2", b"\2a", b"\2" + words[3][:4], b"\2" + max(words, key=len), b"\2zz"):
        for side in (0, 1):
            assert abs(sum(slow.probability(side, s + bytes([x]), len(s)) for x in range(256)) - 1) < 1e-9


def test_table_finds_its_keys_alone():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
        table = Table(keys, np.arange(len(keys)))
        assert (table.get(keys, -1) == np.arange(len(keys))).all()
        assert (table.get(rng.integers(0, 1 << 63, 1000, dtype=np.uint64), -1) == -1).all()


def test_words_count_once_a_document():
    kinds, owner, number = toxicity.distinct_words([b"b a B a", b"", b"a, c"])
    assert sorted((int(o), kinds[w]) for o, w in zip(owner, number, strict=True)) == [(0, b"a"), (0, b"b"), (2, b"a"), (2, b"c")]


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no test tables")
def test_toxic_documents_are_caught_in_every_language(spark):
    scored = op6_toxicity(spark, LARGE)
    truth = spark.read.parquet(f"{LARGE}/labels.parquet").select("doc_id", "toxic").join(spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "lang"), "doc_id")
    got = scored.where("held_out").join(truth, "doc_id").groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("found")).collect()
    counts = {(r.lang, r.toxic): (r.found, r.n) for r in got}
    print(counts)
    found, toxic = (sum(v[k] for (_, t), v in counts.items() if t) for k in (0, 1))
    wrong = sum(v[0] for (_, t), v in counts.items() if not t)
    assert found / toxic >= 0.85 and found / (found + wrong) >= 0.95
    for (lang, t), (caught, n) in counts.items():
        assert not t or caught / n >= 0.75, lang
