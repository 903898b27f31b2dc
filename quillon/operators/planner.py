"""Plans over postings: intersections and their order, bounded top-k, cost trees.

In Spark a conjunction is part of one aggregation and top-k of one sort, so
these work on one task's sorted lists: they say what an order costs, and prune
postings by upper bounds where a task holds a shard's.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans import ast


@dataclass
class Meeting:
    """An intersection: what is in both lists, the steps, and what was compared."""

    ids: list[int] = field(default_factory=list)
    steps: list[tuple[str, int, int]] = field(default_factory=list)
    comparisons: int = 0
    advances: int = 0


def intersect(a: list[int], b: list[int]) -> Meeting:
    """Two sorted lists in step: (action, value of a, value of b) at each comparison."""
    out, i, j = Meeting(), 0, 0
    while i < len(a) and j < len(b):
        out.comparisons += 1
        x, y = a[i], b[j]
        out.steps.append(("emit" if x == y else "advance-a" if x < y else "advance-b", x, y))
        if x == y:
            out.ids.append(x)
        i, j = i + (x <= y), j + (y <= x)
    return out


def gallop(ids: list[int], target: int, start: int) -> tuple[int, int]:
    """(first place from start with at least target, comparisons): doubling steps, then a binary search."""
    step, lo, compared = 1, start, 0
    while lo + step < len(ids) and ids[lo + step] < target:
        lo, step, compared = lo + step, 2 * step, compared + 1
    hi = min(lo + step + 1, len(ids))
    return bisect_left(ids, target, lo, hi), compared + max(1, hi - lo).bit_length()


def intersect_galloping(a: list[int], b: list[int]) -> Meeting:
    """The shorter list leads; the longer is searched from where the last search ended."""
    lead, follow = sorted((a, b), key=len)
    out, at = Meeting(), 0
    for target in lead:
        if at >= len(follow):
            break
        at, compared = gallop(follow, target, at)
        out.comparisons += compared
        out.advances += 1
        if at < len(follow) and follow[at] == target:
            out.ids.append(target)
    return out


def compare_orders(clauses: dict[str, list[int]]) -> dict[str, dict]:
    """Work of a conjunction with the rarest clause first and with the commonest first."""
    out = {}
    for name, dear_first in (("cheapest first", False), ("dearest first", True)):
        order = sorted(clauses, key=lambda c: len(clauses[c]), reverse=dear_first)
        now, work, advances = clauses[order[0]], len(clauses[order[0]]), 0
        for c in order[1:]:
            met = intersect_galloping(now, clauses[c])
            work += min(len(now), len(clauses[c])) + met.comparisons
            advances += met.advances
            now = met.ids
        out[name] = {"order": order, "work": work, "advances": advances, "matches": len(now)}
    return out


# -- top-k with upper bounds ----------------------------------------------


@dataclass
class TopK:
    """The k best (score descending, then id) and what they cost."""

    hits: list[tuple[int, float]] = field(default_factory=list)
    evaluated: int = 0
    touched: int = 0


class _Best:
    def __init__(self, k: int):
        self.k, self.heap = k, []

    def offer(self, doc: int, score: float) -> None:
        if self.k > 0:
            (heapq.heappush if len(self.heap) < self.k else heapq.heappushpop)(self.heap, (score, -doc))

    def threshold(self) -> float:
        """The score of the last hit once there are k; nothing below it gets in."""
        return self.heap[0][0] if len(self.heap) == self.k and self.k else -np.inf if self.k else np.inf

    def hits(self) -> list[tuple[int, float]]:
        return [(-d, s) for s, d in sorted(self.heap, reverse=True)]


def exhaustive(terms: list[tuple[np.ndarray, np.ndarray]], k: int) -> TopK:
    """terms: (ascending ids, scores) of each."""
    every = np.concatenate([ids for ids, _ in terms]) if terms else np.zeros(0, np.int64)
    docs, inverse = np.unique(every, return_inverse=True)
    score = np.bincount(inverse, np.concatenate([s for _, s in terms]), len(docs)) if terms else np.zeros(0)
    best = np.lexsort((docs, -score))[:k]
    return TopK([(int(docs[i]), float(score[i])) for i in best], len(docs), len(every))


def wand(terms: list[tuple[np.ndarray, np.ndarray]], k: int) -> TopK:
    """The same hits; a document is evaluated only if the bounds of the terms that may hold it reach the last hit.

    Sums run in the order of terms, as in ``exhaustive``, so scores are equal
    to the last bit. Documents come in ascending order, so one that only ties
    with the last hit loses to it.
    """
    best, out = _Best(k), TopK()
    bounds = [float(s.max(initial=0)) for _, s in terms]
    at = [0] * len(terms)
    doc = lambda t: int(terms[t][0][at[t]])
    while live := sorted((t for t in range(len(terms)) if at[t] < len(terms[t][0])), key=doc):
        threshold, total, pivot = best.threshold(), 0.0, None
        for t in live:
            total += bounds[t]
            # bounds add up in another order than scores do: leave room for rounding
            if total * (1 + 1e-9) > threshold:
                pivot = doc(t)
                break
        if pivot is None:
            break
        if doc(live[0]) == pivot:
            here = [t for t in sorted(live) if doc(t) == pivot]
            score = 0.0
            for t in here:
                score += float(terms[t][1][at[t]])
                at[t] += 1
            out.touched += len(here)
            out.evaluated += 1
            best.offer(pivot, score)
        else:
            for t in live:
                if doc(t) < pivot:
                    at[t] += int(np.searchsorted(terms[t][0][at[t] :], pivot))
                    out.touched += 1
    out.hits = best.hits()
    return out


def sharded_top(postings: DataFrame, k: int, shards: int, pruned: bool = True) -> DataFrame:
    """(shard, doc_id, score, evaluated): each shard's k best by ``wand``, or exhaustively.

    postings: (term, doc_id, score), with whole-number ids. A shard is a range
    of hashes of ids; give as many as keep one in a task's memory.
    """
    run = wand if pruned else exhaustive

    def step(table: pa.Table) -> pa.Table:
        table = table.sort_by([("term", "ascending"), ("doc_id", "ascending")])
        term, ids, score = (table.column(c).to_numpy() for c in ("term", "doc_id", "score"))
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        got = run([(ids[a:z], score[a:z]) for a, z in zip(first, np.r_[first[1:], len(ids)], strict=True)], k)
        n = len(got.hits)
        columns = [pa.array([table.column("shard")[0].as_py()] * n, pa.int32()), pa.array([d for d, _ in got.hits], pa.int64()), pa.array([s for _, s in got.hits], pa.float64()), pa.array([got.evaluated] * n, pa.int64())]
        return pa.table(columns, names=["shard", "doc_id", "score", "evaluated"])

    dealt = postings.select("term", F.col("doc_id").cast("long").alias("doc_id"), "score", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInArrow(step, "shard int, doc_id long, score double, evaluated long")


# -- the cost of a tree -----------------------------------------------------


def plan_tree(q: ast.Query, freqs: dict[tuple[str, str], int], num_docs: int) -> dict:
    """A resolved tree with what each clause may match at most; conjunctions list the cheapest first."""
    children: list[dict] = []
    if isinstance(q, ast.Bool):
        must = [plan_tree(x, freqs, num_docs) for x in (*q.must, *q.filter)]
        should = [plan_tree(x, freqs, num_docs) for x in q.should]
        children = [*sorted(must, key=lambda c: c["cost"]), *should, *(plan_tree(x, freqs, num_docs) | {"excluded": True} for x in q.must_not)]
        cost = min(c["cost"] for c in must) if must else min(num_docs, sum(c["cost"] for c in should)) if should else num_docs if q.must_not else 0
    elif isinstance(q, ast.Script):
        children = [plan_tree(q.query, freqs, num_docs)]
        cost = children[0]["cost"]
    elif isinstance(q, ast.Term):
        cost = freqs.get((q.field, q.value), 0)
    elif isinstance(q, ast.Terms):
        cost = min(num_docs, sum(freqs.get((q.field, v), 0) for v in q.values))
    elif isinstance(q, ast.Phrase):
        cost = min((freqs.get((q.field, t), 0) for t in q.text.split("\0")), default=0)
    else:
        cost = 0 if isinstance(q, ast.MatchNone) else num_docs
    return {"kind": type(q).__name__, "query": str(q).replace("\0", " "), "cost": cost, "children": children}
