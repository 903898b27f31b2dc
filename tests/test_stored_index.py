"""The stored index against the computed one, and the edges of the compiler."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillon.functions.analysis import DEFAULT, ENGLISH
from quillon.operators import index as module
from quillon.operators.expand import expand
from quillon.operators.index import Index, Mapping, RepeatedKey, latest
from quillon.operators.ordinals import ordinals
from quillon.operators.ranking import explain_document
from quillon.plans import ast
from quillon.plans.compile import Compiler, coerced, phrase_count

MAPPING = Mapping("id", {"t": DEFAULT, "e": ENGLISH}, ("k", "tags"), ("n",))
T = lambda v, boost=1.0: ast.Term(boost, "t", v)


@pytest.fixture(scope="module")
def docs(spark):
    rng, vocabulary = random.Random(4), [f"w{i}" for i in range(40)] + ["the", "running", "cats"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)))
        rows.append((i, text if i % 17 else None, text, f"k{i % 4}", [f"g{i % 3}", f"g{i % 5}"], float(i)))
    rows.append((None, "w1 w2", "w1", "k1", [], 1.0))
    return spark.createDataFrame(rows, "id long, t string, e string, k string, tags array<string>, n double").cache()


@pytest.fixture(scope="module")
def both(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    made = Index(docs, MAPPING).write(path, 5)
    assert made.docs is docs
    return Index(docs, MAPPING), Index.read(docs, MAPPING, path)


QUERIES = [
    T("w1"), T("nothing"), ast.Terms(2.0, "t", ("w1", "w2", "zz")), ast.Match(1.0, "e", "running cat"), ast.Phrase(1.0, "t", "w1 w2", 3), ast.Phrase(1.0, "t", "w1 nothing"),
    ast.Prefix(1.0, "t", "w"), ast.Prefix(1.0, "t", "w", most=3), ast.Regexp(1.0, "t", "w[1-3]"), ast.Fuzzy(1.0, "t", "w11", edits=1, transpositions=True),
    ast.Term(1.0, "k", "k2"), ast.Term(1.0, "tags", "g1"), ast.Range(1.0, "k", gte="k1", lt="k3"), ast.Range(1.0, "n", gte=3, lt="50"), ast.MatchAll(3.0), ast.MatchNone(),
    ast.Bool(2.0, must=(T("w1"), ast.Range(1.0, "n", lt=90)), should=(T("w2", 3.0), ast.Term(1.0, "k", "k1")), must_not=(T("w3"), ast.Range(1.0, "k", gte="k3"))),
    ast.Bool(should=(T("w1"), T("w2"), ast.Prefix(1.0, "t", "w3")), minimum=2), ast.Bool(must_not=(T("w1"),)), ast.Bool(must=(ast.MatchAll(1.0),), filter=(ast.Prefix(1.0, "t", "w"),)),
    ast.Script(2.0, ast.Match(1.0, "t", "w1 w2"), "_score + n / 100"), ast.Term(1.0, "n", "7"), ast.Range(1.0, "nowhere", gte=1), ast.Bool(must_not=(ast.Range(1.0, "k", gte="zz"),)),
]


def result(index, q):
    return sorted((r.doc_id, round(r.score, 9)) for r in Compiler(index).compile(q).frame.collect())


@pytest.mark.parametrize("q", QUERIES, ids=str)
def test_stored_equals_computed(both, q):
    lazy, stored = both
    assert result(stored, q) == result(lazy, q)


def test_stored_tables(both):
    lazy, stored = both
    for table in ("postings", "norms", "dictionary", "field_stats"):
        columns = getattr(lazy, table).columns
        assert sorted(map(str, getattr(stored, table).select(columns).collect())) == sorted(map(str, getattr(lazy, table).collect())), table
    assert stored.num_docs == lazy.num_docs == 120 and stored.averages == pytest.approx(lazy.averages)
    some = {("t", "w1"), ("t", "zz"), ("k", "k1"), ("e", "cat")}
    assert stored.doc_freqs(some) == lazy.doc_freqs(some) and stored.doc_freqs(some)["t", "zz"] == 0
    assert {r.term for r in expand(stored.dictionary, ast.Prefix(1.0, "t", "w1", most=4)).collect()} == {"w1", "w10", "w11", "w12"}


def test_only_the_buckets_of_the_terms_are_read(both):
    _, stored = both
    plan = stored.lookup({("t", "w1")})._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "bucket#" in filters and str(module.bucket_of("w1", 5)) in filters and "field#" in filters


def test_postings_stay_with_their_documents(spark, tmp_path, monkeypatch):
    """Only documents are shuffled, so a file has all postings of a range of keys; nulls among terms and repeated words count."""
    rows = [(i, f"a b a w{i}", ["x", None, "x"] if i % 2 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, t string, tags array<string>").coalesce(1)
    monkeypatch.setattr(module, "TASK_BYTES", 100)
    monkeypatch.setattr(module, "BATCH_ROWS", 7)
    mapping = Mapping("id", {"t": DEFAULT}, ("tags",))
    stored = Index(docs, mapping).write(str(tmp_path / "i"), 1)
    ranges = sorted((min(ids), max(ids)) for ids in (r.ids for r in stored.postings.where("field = 't'").groupBy(F.input_file_name()).agg(F.collect_set("doc_id").alias("ids")).collect()))
    assert len(ranges) > 3 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    for table in ("postings", "norms", "dictionary"):
        columns = getattr(Index(docs, mapping), table).columns
        assert sorted(map(str, getattr(stored, table).select(columns).collect())) == sorted(map(str, getattr(Index(docs, mapping), table).collect())), table


def test_phrases_in_a_long_document(spark):
    """Places are found by bisection: every word of a long document repeated takes no longer than its length."""
    docs = spark.createDataFrame([(1, "x y z " * 2000), (2, "z y x y z z"), (3, "x"), (4, None), (5, "x z y z")], "id long, t string")
    began = time.monotonic()
    got = {slop: result(Index(docs, Mapping("id", {"t": DEFAULT})), ast.Phrase(1.0, "t", "x y z", slop)) for slop in (0, 1)}
    assert [[d for d, _ in got[k]] for k in (0, 1)] == [[1, 2], [1, 2, 5]] and time.monotonic() - began < 60
    lists = spark.createDataFrame([([0, 3, 6], [1, 4], [2, 9]), ([0], None, [2]), ([1, 2], [3], [5])], "a array<int>, b array<int>, c array<int>")
    counts = lambda slop: [r[0] for r in lists.select(phrase_count([F.col(c) for c in "abc"], slop)).collect()]
    assert counts(0) == [1, 0, 0] and counts(1) == [1, 0, 1] and counts(2) == [1, 0, 2] and counts(4) == [2, 0, 2]


def test_null_ids_are_no_documents_and_repeated_ones_are_refused(spark, tmp_path, docs):
    assert result(Index(docs, MAPPING), ast.MatchAll(1.0)) == [(i, 1.0) for i in range(120)]
    twice = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id long, t string, v long")
    with pytest.raises(RepeatedKey):
        Index(twice, Mapping("id", {"t": DEFAULT})).write(str(tmp_path / "x"))
    kept = Index(latest(twice, "id", "v"), Mapping("id", {"t": DEFAULT})).write(str(tmp_path / "y"))
    assert [result(kept, T(x)) and 1 for x in "abc"] == [[], 1, 1]


def test_names_of_columns_cannot_clash(spark):
    rows = [(7, 1, "a b", 1.0, 2.0, 5.0, "x"), (8, 2, "b", 1.0, 2.0, 6.0, "y")]
    docs = spark.createDataFrame(rows, "key long, doc_id long, t string, `_m0` double, s0 double, score double, `a.b` string")
    index = Index(docs, Mapping("key", {"t": DEFAULT}, ("a.b",), ("score", "s0", "_m0")))
    q = ast.Bool(must=(T("b"), ast.Range(1.0, "score", gte=6), ast.Range(1.0, "_m0", lte=1)), should=(ast.Term(1.0, "a.b", "y"),))
    assert [d for d, _ in result(index, q)] == [8]
    assert [d for d, _ in result(index, ast.Script(1.0, T("a"), "_score + s0"))] == [7]


def test_an_empty_index(spark, tmp_path):
    docs = spark.createDataFrame([], "id long, t string, n double")
    mapping = Mapping("id", {"t": DEFAULT}, (), ("n",))
    for index in (Index(docs, mapping), Index(docs, mapping).write(str(tmp_path / "empty"))):
        for q in (T("a"), ast.MatchAll(1.0), ast.Phrase(1.0, "t", "a b"), ast.Prefix(1.0, "t", ""), ast.Bool(must_not=(T("a"),))):
            assert result(index, q) == []
        assert index.num_docs == 0 and index.average("t") == 0


def test_a_pattern_that_the_matching_engine_refuses_has_no_terms(docs):
    for pattern in ("(?P<n>w1)", "[", "*"):
        assert result(Index(docs, MAPPING), ast.Regexp(1.0, "t", pattern)) == []


def test_bounds_are_coerced(spark):
    rows = spark.sql("SELECT id, DATE'2024-01-01' + CAST(id AS INT) AS d, TIMESTAMP'2024-01-01 12:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS ts, CAST(19723 + id AS DOUBLE) AS days FROM range(10)")
    index = Index(rows, Mapping("id", {}, (), ("d", "ts", "days")))
    of = lambda f, **b: [d for d, _ in result(index, ast.Range(1.0, f, **b))]
    assert of("d", gte="2024-01-03", lt="2024-01-05") == [2, 3] == of("days", gte="2024-01-03", lt="2024-01-05") == of("d", gte=19725, lt=19727)
    assert of("ts", gt="2024-01-02T12:00:00Z", lte="2024-01-03T12:00:00+00:00") == [2] and of("ts", lt="2024-01-02") == [0]
    assert of("days", gte="19730.5") == [8, 9]
    for kind in ("date", "double"):
        with pytest.raises(ValueError):
            coerced("soon", kind)


def total(node):
    return sum(x["value"] for x in node["details"])


def test_explanations_add_up(docs):
    index = Index(docs, MAPPING)
    q = ast.Bool(2.0, must=(T("w1", 3.0),), should=(ast.Bool(0.5, should=(T("w2"), T("w3", 2.0))), ast.Phrase(1.0, "t", "w1 w2", 5)), must_not=(T("nothing"),), filter=(ast.Range(1.0, "n", gte=0),))
    for doc, score in result(index, q)[:6]:
        tree = explain_document(index, q, doc)
        assert tree["value"] == pytest.approx(score) and tree["value"] == pytest.approx(2.0 * total(tree))
        for node in tree["details"]:
            if node["description"].startswith("bool"):
                assert node["value"] == pytest.approx(0.5 * total(node))
            if node["description"].startswith("term t:w1"):
                idf, saturation = (x["value"] for x in node["details"][:2])
                assert node["value"] == pytest.approx(3.0 * idf * saturation)
    assert explain_document(index, q, -1) == {"value": 0.0, "description": f"-1 doesn't match {q}", "details": []}


def test_ordinals(spark):
    rng = random.Random(2)
    values = [(rng.randint(0, 9), i) for i in range(500)]
    got = ordinals(spark.createDataFrame(values, "v long, i long").repartition(7), "v", "i").collect()
    assert [(r.v, r.i) for r in sorted(got, key=lambda r: r.ordinal)] == sorted(values) and sorted(r.ordinal for r in got) == list(range(500))
    assert ordinals(spark.createDataFrame([], "v long"), "v").count() == 0
