"""Tries, automata, transducers, blocks, KD and BKD trees against plain lists."""

import itertools
import random

import numpy as np
import pytest

from quillon.functions.distance import LevenshteinAutomaton, distance
from quillon.structures import points, words


def vocabulary(n, seed, alphabet="abcd"):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices(alphabet, k=rng.randint(0, 7))) for _ in range(n)})


def suffix_sets(some):
    """For every prefix the endings that follow it: a minimal automaton has a state for each distinct set."""
    prefixes = {w[:i] for w in some for i in range(len(w) + 1)}
    return {p: tuple(sorted(w[len(p) :] for w in some if w.startswith(p))) for p in prefixes}


@pytest.mark.parametrize("seed", range(5))
def test_trie(seed):
    some = vocabulary(60, seed)
    trie = words.Trie(some)
    prefixes = suffix_sets(some)
    assert len(trie) == len(some) and trie.nodes() == len(prefixes) and trie.edges() == len(prefixes) - 1
    assert trie.estimated_bytes() == 40 * trie.nodes() + 48 * trie.edges()
    for w in [*some, "abca", "zz", "ab"]:
        assert trie.contains(w)[0] == (w in some)
        got = trie.prefix_search(w[:2])
        assert got.words == [x for x in some if x.startswith(w[:2])]
        if got.words:
            assert got.visited == len(w[:2]) + sum(p.startswith(w[:2]) for p in prefixes)
    assert trie.contains("a" * 30)[1] <= 30 and trie.prefix_search("", 3).words == some[:3]
    graph = trie.graph()
    assert len(graph["nodes"]) == trie.nodes() and len(graph["edges"]) == trie.edges() and not graph["truncated"]
    assert trie.graph(2)["truncated"] and [len(trie.graph(k)["nodes"]) for k in (1, 5)] == [1, 5]


def test_empty_vocabulary():
    trie = words.Trie([])
    assert (trie.nodes(), trie.contains("a"), trie.prefix_search("").words) == (1, (False, 1), [])
    assert words.Transducer([]).get("") is None and words.BlockTree([]).lookup("a")["found"] is False
    assert words.Trie([""]).contains("")[0] and words.Transducer([""], [7]).get("") == 7


@pytest.mark.parametrize("seed", range(5))
def test_minimal_automaton_and_transducer(seed):
    some, rng = vocabulary(50, 10 + seed), random.Random(seed)
    rights = suffix_sets(some)
    plain = words.Transducer(some)
    assert len(plain.states) == len(set(rights.values()))
    assert plain.arcs() == sum(len({r[0] for r in rs if r}) for rs in set(rights.values()))
    counts = words.merged(some)
    assert counts["states"] == len(plain.states) <= counts["trie_nodes"] and counts["arcs"] == plain.arcs()
    outputs = [rng.randrange(50) for _ in some]
    fst = words.Transducer(some, outputs)
    assert fst.under() == list(zip(some, outputs, strict=True))
    for w, out in zip(some, outputs, strict=True):
        assert fst.get(w) == out
        steps = fst.trace(w)
        assert len(steps) == len(w) and (steps[-1]["running"] if steps else 0) <= out
    assert fst.get("zz") is None and fst.seek("zz")[0] is None
    assert [w for w, _ in fst.under("a", 4)] == [w for w in some if w.startswith("a")][:4]
    ordinals = words.ordinal_transducer(some)
    assert [ordinals.get(w) for w in some] == list(range(len(some))) and fst.estimated_bytes() == 5 * fst.arcs()
    graph = fst.graph()
    assert len(graph["edges"]) == fst.arcs() and min(n["depth"] for n in graph["nodes"]) == 0


def test_outputs_go_to_the_front():
    fst = words.Transducer(["bar", "car"], [200, 100])
    assert [s["output"] for s in fst.trace("bar")] == [200, 0, 0] and [s["output"] for s in fst.trace("car")] == [100, 0, 0]
    assert len(fst.states) == 4  # both go on as one
    mixed = words.Transducer(["can", "car", "cat"], [300, 100, 200])
    assert [s["output"] for s in mixed.trace("can")] == [100, 0, 200]
    for bad in (["b", "a"], ["a", "a"]):
        with pytest.raises(ValueError):
            words.Transducer(bad)


@pytest.mark.parametrize(("k", "swap"), list(itertools.product((0, 1, 2), (False, True))))
def test_words_within_a_distance(k, swap):
    some = vocabulary(150, 30 + k, "abc")
    for asked in ("", "ab", "abcab", "ccc"):
        want = [w for w in some if distance(asked, w, swap) <= k]
        trie, fst = words.Trie(some), words.ordinal_transducer(some)
        new = lambda a=asked: LevenshteinAutomaton(a, k, swap)
        assert words.scan(some, new()).words == want
        got = trie.within(new())
        assert got.words == want and got.visited <= trie.nodes()
        assert fst.within(new()).words == [(w, some.index(w)) for w in want]
        assert trie.within(new(), 2).words == want[:2]


@pytest.mark.parametrize("size", [1, 3, 8])
def test_blocks(size):
    some = vocabulary(70, 40)
    tree = words.BlockTree(some, size)
    for k, w in enumerate(some):
        got = tree.lookup(w)
        assert got["found"] and got["ordinal"] == k and got["compared"] <= size
    assert not tree.lookup("zzzz")["found"] and tree.lookup("zzzz")["ordinal"] == -1
    for p in ("", "a", "ab", "dd", "z"):
        got, read = tree.prefix_scan(p)
        assert got == [w for w in some if w.startswith(p)] and read <= len(tree.blocks)
    assert tree.prefix_scan("a", 2)[0] == [w for w in some if w.startswith("a")][:2]
    offset = 0
    for b in tree.blocks:
        coded = sum(2 + len(w) - words.shared(before, w) for before, w in zip(("", *b.words), b.words, strict=False))
        assert (b.offset, b.bytes, b.raw_bytes) == (offset, coded, sum(1 + len(w) for w in b.words))
        assert all(w.startswith(b.prefix) for w in b.words)
        offset += b.bytes
    index = tree.index()
    assert [index.get(w) for w in tree.firsts] == list(range(len(tree.blocks)))


BOXES = [points.Region(), points.Region(2, 5, 1, 9), points.Region(3, 3, 0, 9), points.Region(6, 5, 0, 1), points.Region(-np.inf, 4, 4, np.inf)]


@pytest.mark.parametrize("n", [0, 1, 2, 50, 300])
def test_trees_equal_a_scan(n):
    rng = np.random.default_rng(n)
    xy, ids = rng.integers(0, 10, (n, 2)).astype(float), rng.permutation(n)
    kd = points.KdTree(xy, ids)
    for leaf in (1, 4, 64):
        bkd = points.BkdTree(xy, ids, leaf)
        assert sum(b.hi - b.lo for b in bkd.leaves()) == n and bkd.bytes == 10 * n
        assert all(b.hi - b.lo <= leaf for b in bkd.leaves())
        assert [b.offset for b in bkd.leaves()] == np.cumsum([0, *(b.bytes for b in bkd.leaves())])[:-1].tolist()
        shape = bkd.layout()
        assert len(shape["nodes"]) == len(bkd.nodes) and len(shape["edges"]) == max(0, len(bkd.nodes) - 1)
        for box in BOXES:
            want = points.naive_search(xy, ids, box)
            got = bkd.search(box)
            assert got.ids == want and got.checked <= n and got.bytes <= bkd.bytes
            assert kd.search(box).ids == want and kd.search(box).visited <= n
    if n:
        whole = points.BkdTree(xy, ids).search(points.Region())
        assert (whole.inside, whole.checked) == (1, 0)
        assert points.BkdTree(xy, ids).search(points.Region(50, 60, 50, 60)).skipped == 1


def test_a_line_and_bounds():
    values = np.array([1.0, 2, 2, 2, 5, 8])
    ids = np.arange(10, 16)
    assert [points.bound(values, x)[0] for x in (0, 2, 3, 9)] == [0, 1, 4, 6]
    assert [points.bound(values, x, True)[0] for x in (0, 2, 3, 9)] == [0, 4, 4, 6]
    assert points.point_range(values, ids, gte=2, lt=5) == [11, 12, 13]
    assert points.point_range(values, ids, gt=2, gte=1) == [14, 15] and points.point_range(values, ids, gt=9, lt=1) == []
    assert points.point_range(values, ids) == ids.tolist()
    line = points.line_tree(values, ids, 2)
    assert line.search(points.Region(2, 5)).ids == [11, 12, 13, 14]


def test_regions():
    a, b, c = points.Region(0, 2, 0, 2), points.Region(2, 3, 2, 3), points.Region(0.5, 1, 0.5, 1)
    assert a.intersects(b) and b.intersects(a) and not b.intersects(c)
    assert a.contains(c) and not c.contains(a) and a.contains(a)
    assert a.has(np.array([[2.0, 2.0], [2.1, 0.0]])).tolist() == [True, False]


def test_blocks_are_taken_in_runs(spark, monkeypatch):
    """A row a block, from as many calls into Python as there are runs of blocks."""
    from quillon import structure_queries as module

    monkeypatch.setattr(module, "GROUP", 4)
    rows = spark.createDataFrame([(f"w{i:03}", i, i // 16) for i in range(150)], "term string, ordinal long, block long").repartition(5)

    def of(some, first):
        return {"first": some[0], "n": len(some), "at": first}

    made = module._by_block(rows, of, "block long, first string, n long, at long")
    assert sorted(map(tuple, made.collect())) == [(b, f"w{16 * b:03}", min(16, 150 - 16 * b), 16 * b) for b in range(10)]
    assert "group#" in made._jdf.queryExecution().executedPlan().toString()
