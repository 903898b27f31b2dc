"""Intersections, orders of joins, pruned top-k and cost trees."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import planner
from quillon.plans import ast


def test_worked_intersection():
    got = planner.intersect([2, 5, 9, 20], [1, 5, 7, 9])
    assert got.ids == [5, 9] and got.comparisons == 5
    assert got.steps == [("advance-b", 2, 1), ("advance-a", 2, 5), ("emit", 5, 5), ("advance-b", 9, 7), ("emit", 9, 9)]


def test_random_intersections():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (sorted(rng.sample(range(400), rng.randint(0, 60))) for _ in range(2))
        want = sorted(set(a) & set(b))
        assert planner.intersect(a, b).ids == want
        got = planner.intersect_galloping(a, b)
        assert got.ids == want and got.advances <= min(len(a), len(b))


def test_orders():
    got = planner.compare_orders({"rare": list(range(0, 1000, 100)), "common": list(range(1000)), "mid": list(range(0, 1000, 10))})
    assert got["cheapest first"]["order"] == ["rare", "mid", "common"] and got["dearest first"]["order"][0] == "common"
    assert got["cheapest first"]["matches"] == got["dearest first"]["matches"] == 10
    assert got["cheapest first"]["work"] < got["dearest first"]["work"]


@pytest.mark.parametrize("k", [0, 1, 5, 10, 25, 10_000])
def test_pruned_equals_exhaustive(k):
    rng = np.random.default_rng(k + 1)
    saved = 0
    for _ in range(12):
        terms = []
        for _ in range(3):
            ids = np.flatnonzero(rng.random(1600) < 0.25)
            terms.append((ids, rng.integers(1, 200, len(ids)) / 40))  # with many ties
        slow, fast = planner.exhaustive(terms, k), planner.wand(terms, k)
        assert fast.hits == slow.hits and fast.evaluated <= slow.evaluated
        saved += slow.evaluated - fast.evaluated
    assert saved > 0 or k == 10_000


def test_no_terms():
    assert planner.wand([], 5).hits == planner.exhaustive([], 5).hits == []
    empty = (np.zeros(0, np.int64), np.zeros(0))
    assert planner.wand([empty, (np.array([3]), np.array([1.0]))], 5).hits == [(3, 1.0)]


def test_sharded(spark):
    rng = random.Random(3)
    rows = [(t, d, rng.randint(1, 50) / 10) for t in "abc" for d in range(500) if rng.random() < 0.3]
    post = spark.createDataFrame(rows, "term string, doc_id long, score double")
    want = post.groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("s")).orderBy(F.desc("s"), "doc_id").limit(7).collect()
    for pruned in (True, False):
        got = planner.sharded_top(post, 7, 4, pruned).orderBy(F.desc(F.round("score", 6)), "doc_id").limit(7).collect()
        assert [(r.doc_id, round(r.score, 6)) for r in got] == [(r.doc_id, r.s) for r in want]


def test_cost_tree():
    t = lambda v: ast.Term(1.0, "f", v)
    freqs = {("f", "a"): 10, ("f", "b"): 3, ("f", "c"): 50}
    tree = planner.plan_tree(ast.Bool(must=(t("a"), t("b")), should=(t("c"),), must_not=(t("x"),)), freqs, 100)
    assert tree["cost"] == 3 and [c["query"] for c in tree["children"]] == ["f:b", "f:a", "f:c", "f:x"] and tree["children"][-1]["excluded"]
    assert planner.plan_tree(ast.Bool(should=(t("a"), t("c"))), freqs, 55)["cost"] == 55
    assert planner.plan_tree(ast.Bool(must_not=(t("a"),)), freqs, 100)["cost"] == 100
    assert planner.plan_tree(ast.Phrase(1.0, "f", "a\0b"), freqs, 100)["cost"] == 3
    assert planner.plan_tree(ast.Script(1.0, ast.Terms(1.0, "f", ("a", "b"))), freqs, 100)["cost"] == 13
