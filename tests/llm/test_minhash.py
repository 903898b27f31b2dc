"""Near-duplicates: texts against ids, rows without words or ids, and large buckets, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import minhash

SCHEMA = "doc_id long, text string"


def class_rows(spark, docs, **more):
    return [tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(docs, SCHEMA), **more).collect()]


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def brute_force(docs, similarity=0.8):
    """The least doc_id of each document's component, by all pairs."""
    bags = []
    for _, t in docs:
        e, _, _ = minhash.shingles([t.encode()])
        bags.append(minhash.counted(np.sort((e >> np.uint64(32)).astype("<u4")).tobytes()))
    root = list(range(len(docs)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(docs)):
        for j in range(i):
            if minhash.weighted_jaccard(bags[i], bags[j]) >= similarity:
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), d), d)
    return sorted((d, least[find(k)]) for k, (d, _) in enumerate(docs))


def test_every_text_of_an_id_is_compared(spark):
    a, b = words(60, 1), words(60, 2)
    changed = " ".join([*a[:30], "other", *a[31:]])
    got = class_rows(spark, [(1, " ".join(a)), (1, " ".join(b)), (2, changed), (3, " ".join(words(60, 3)))])
    assert sorted(got) == [(1, 1), (1, 1), (2, 1), (3, 3)]


def test_texts_without_words_and_rows_without_ids(spark):
    a = " ".join(words(40, 4))
    got = class_rows(spark, [(1, "!!! ***"), (2, "!!! ***"), (3, "!!!"), (4, ""), (5, None), (None, a), (None, a), (None, "?"), (6, a + " "), (None, "?")])
    known = dict(x for x in got if x[0] is not None)
    assert known == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}
    nameless = sorted(c for d, c in got if d is None)
    assert nameless[2:] == [6, 6] and nameless[0] == nameless[1] < 0


@pytest.mark.parametrize("ids", [True, False])
def test_one_row_of_each_class(spark, ids):
    a = " ".join(words(40, 5))
    rows = [(7, a, "x"), (3, a + "!", "y"), (9, "", "z"), (None, None, "u")]
    rows += [] if ids else [(3, a + "!", "y"), (None, "", "v"), (9, " ".join(words(40, 6)), "w")]
    docs = spark.createDataFrame(rows, SCHEMA + ", p string")  # a column that the operator uses a name of
    got = minhash.one_of_each(docs)
    assert got.columns == docs.columns
    # the id 9 ties its two texts, and with them the empty ones
    assert sorted((r.doc_id, r.p) for r in got.collect()) == [(3, "y"), (9, "z")]


@pytest.mark.parametrize("block", [1 << 10, 8])
def test_large_buckets_equal_brute_force(spark, monkeypatch, block):
    """Texts that share most of a base, some beyond and some below the similarity, of several sizes, in blocks of any size."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng, docs = random.Random(7), []
    for family in range(3):
        base = words((25, 60, 140)[family], 10 + family)
        for _ in range(45):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            docs.append((1000 + len(docs), " ".join(t[: len(t) - rng.choice([0, 0, 1, 5])])))
    assert sorted(class_rows(spark, docs)) == brute_force(docs)


def test_across_alone_finds_every_link_of_a_bucket(spark, monkeypatch):
    """One bucket of all, each member a component of its own: links must join what brute force joins."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng, texts = random.Random(8), []
    for family in range(12):
        base = words(rng.choice([20, 30, 45, 80]), 50 + family)
        for _ in range(10):
            t = list(base)
            t[rng.randrange(len(t))] = f"y{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    docs = list(enumerate(texts))
    frame = spark.createDataFrame([(d, t) for d, t in docs], SCHEMA)
    table = minhash.signed(frame).withColumnRenamed("doc_id", "node")
    one = F.lit(1).cast("long")
    bucketed = table.select("node", "size", "s", "t", one.alias("key"))
    keys = table.select("node", F.array(one).alias("bands"))
    bags = minhash.weights_of(frame.withColumnRenamed("doc_id", "node")).select("node", "bag")
    links = minhash.across(bucketed, keys, bags, spark.createDataFrame([], "node long, comp long"), 0.8)
    comp = {r.node: r.comp for r in minhash.components(links).collect()}
    assert sorted((d, comp.get(d, d)) for d, _ in docs) == brute_force(docs)
