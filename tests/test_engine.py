"""The search engine against hand-made facts and its own slow oracles."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import distance
from quillon.functions.analysis import DEFAULT, stem_light
from quillon.functions.bm25 import Bm25, idf
from quillon.functions.script import compile_script
from quillon.operators.index import Index, Mapping
from quillon.operators.observability import percentile, summarize
from quillon.plans import ast
from quillon.plans.compile import Compiler, search
from quillon.plans.dsl import DslError, decode
from quillon.plans.parser import Parser

# Example queries of the language.
EXAMPLES = (
    "kubernetes", "kubernetes deployment", "kubernetes AND deployment", "title:kubernetes AND status:published", '"kubernetes deployment"',
    '"kubernetes service"~3', "kube*", "deploy*ent", "kubernets~1", "price:[100 TO 200]", "kubernetes -status:draft",
    "title:kubernetes^3 body:kubernetes", "(redis OR kafka) AND status:published", "terraform AND kubernetes",
)

GOLDEN = [("D1", "kubernetes deployment"), ("D2", "docker deployment"), ("D3", "kubernetes service")]


@pytest.fixture(scope="module")
def golden(spark):
    return Index(spark.createDataFrame(GOLDEN, "id string, title string"), Mapping("id", {"title": DEFAULT}))


def ids(index, q):
    return sorted(r.doc_id for r in Compiler(index).compile(q).frame.collect())


def test_golden_terms(golden):
    t = lambda v: ast.Term(1.0, "title", v)
    assert ids(golden, t("kubernetes")) == ["D1", "D3"]
    assert ids(golden, t("deployment")) == ["D1", "D2"]
    assert ids(golden, ast.Bool(must=(t("kubernetes"), t("service")))) == ["D3"]
    assert ids(golden, ast.Phrase(1.0, "title", "kubernetes deployment")) == ["D1"]
    assert ids(golden, t("terraform")) == []
    assert ids(golden, ast.Bool(must_not=(t("kubernetes"),))) == ["D2"]


def test_bm25_example(spark):
    rows = [("a", "kubernetes kubernetes deployment"), ("b", "kubernetes deployment"), ("c", "docker deployment")]
    index = Index(spark.createDataFrame(rows, "id string, title string"), Mapping("id", {"title": DEFAULT}))
    assert idf(3, 2) == pytest.approx(0.4700036)
    hits = search(index, ast.Term(1.0, "title", "kubernetes")).collect()
    assert [h.doc_id for h in hits] == ["a", "b"]
    tf, ratio = 2, 3 / (7 / 3)
    assert hits[0].score == pytest.approx(idf(3, 2) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * ratio)))
    flat = Compiler(index, Bm25(b=0.0)).compile(ast.Term(1.0, "title", "kubernetes")).top(1).first()
    assert flat.score == pytest.approx(idf(3, 2) * 2 * 2.2 / 3.2)


def test_wide_expansion_goes_by_join(spark):
    rows = [(i, " ".join(f"w{i * 3 + k:03d}" for k in range(3))) for i in range(60)]
    index = Index(spark.createDataFrame(rows, "id long, t string"), Mapping("id", {"t": DEFAULT}))
    assert ids(index, ast.Prefix(1.0, "t", "w")) == list(range(60))


def test_nulls_and_empty(spark):
    index = Index(spark.createDataFrame([(1, None, None), (2, "", 5.0), (3, "a b", None)], "id long, t string, n double"), Mapping("id", {"t": DEFAULT}, (), ("n",)))
    assert ids(index, ast.Match(1.0, "t", "a")) == [3]
    assert ids(index, ast.Range(1.0, "n", gte=0)) == [2]
    assert ids(index, ast.Match(1.0, "t", "...")) == []
    empty = Index(spark.createDataFrame([], "id long, t string"), Mapping("id", {"t": DEFAULT}))
    assert ids(empty, ast.Match(1.0, "t", "a")) == []


def test_light_stemmer(spark):
    words = {"running": "runn", "settings": "sett", "flies": "fly", "boxes": "box", "cats": "cat", "jumped": "jump", "quickly": "quick", "ing": "ing", "bed": "bed"}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem_light(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == words


def test_script(spark):
    df = spark.createDataFrame([(2.0, 5.0, 0.0)], "s double, rating double, price double")

    def value(source):
        c = compile_script(source)
        return df.select(c.column({"_score": F.col("s"), "rating": F.col("rating"), "price": F.col("price")}).alias("v")).first().v

    assert value("_score * (1 + rating / 5)") == 4.0
    assert value("price == 0 ? _score * 2 : _score") == 4.0
    assert value("_score / 0") == 0.0
    assert value("2 + 3 * 4") == 14.0
    assert value("-5 % 3") == -2.0
    assert value("round(-2.5)") == -2.0
    assert value("doc['rating'].value + doc.rating.value") == 10.0
    assert value("missing + log(0)") == 0.0
    assert compile_script("1 +").error and value("1 +") == 2.0
    assert compile_script("nope(1)").error


def test_parser_never_throws():
    p = Parser(("title", "body"), ("title", "body"), ("price",))
    for text in EXAMPLES:
        assert not p.parse(text).errors, text
    for text in ("(", "a AND", '"open', "price:[1 TO", "^2", "a^x", "[1 TO 2}", ")"):
        assert p.parse(text).errors and isinstance(p.parse(text).query, ast.MatchNone)
    assert isinstance(p.parse("  ").query, ast.MatchAll)
    q = p.parse("kubernetes -status:draft").query
    assert q.must_not == (ast.Term(field="status", value="draft"),)
    assert p.parse("price:[-5 TO 1]").query == ast.Range(field="price", gte=-5.0, lte=1.0)


def test_dsl():
    q, size = decode('{"query": {"bool": {"must": {"match": {"title": "a"}}, "filter": [{"range": {"price": {"gte": 1}}}]}}, "size": 3}')
    assert size == 3 and q.must == (ast.Match(field="title", text="a"),)
    assert isinstance(decode({"query": {"bool": {"must_not": [{"term": {"a": "b"}}]}}})[0], ast.MatchNone)
    for bad in ("{", "{}", '{"query": {}}', '{"query": {"nope": {"a": "b"}}}', '{"query": {"term": {"a": " "}}}', '{"query": {"term": {"a": "b"}, "match": {"a": "b"}}}'):
        with pytest.raises(DslError):
            decode(bad)


def test_distances():
    assert distance.distance("kitten", "sitting") == 3
    assert distance.distance("flaw", "lawn") == 2
    assert distance.distance("kubernets", "kubernetes") == 1
    assert [distance.distance(a, b, True) for a, b in (("ab", "ba"), ("ca", "abc"), ("abcd", "badc"))] == [1, 3, 2]
    steps = distance.trace("kitten", "sitting")
    assert sum(s[0] != "match" for s in steps) == 3


def test_automaton_against_table():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdek u", k=rng.randint(0, 9))) for _ in range(120)]
    for a, b in itertools.islice(zip(words, reversed(words), strict=True), 120):
        for k, swap in itertools.product((1, 2), (False, True)):
            assert distance.LevenshteinAutomaton(a, k, swap).accepts(b) == (distance.distance(a, b, swap) <= k)


def test_observability():
    assert percentile([1, 2, 3, 4], 50) == 2 and percentile([], 50) == 0
    assert summarize([3.0, 1.0, 2.0])["max"] == 3.0


def test_what_the_script_language_has():
    from quillon.functions.script import describe

    said = describe()
    assert said["functions"]["pow"] == 2 and said["functions"]["log1p"] == 1 and said["operators"]["*"] > said["operators"]["+"] > said["operators"]["||"]


def test_conjunction_and_ids(golden):
    t = ast.Term(1.0, "title", "kubernetes")
    assert ast.conjunction(None, t) is t
    assert ids(golden, ast.conjunction(t, ast.Ids(1.0, ("D2", "D3", "nobody")))) == ["D3"] and ids(golden, ast.Ids(1.0, ())) == []
