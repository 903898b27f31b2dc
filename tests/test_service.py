"""The engine behind requests: documents in, searches, explanations, errors; and the command line that asks it."""

import json
import threading

import pytest

from quillon.__main__ import main
from quillon.engine import Engine, moment, number, place, server, texts

DOCS = [
    {"id": "d1", "title": "Kubernetes Deployments", "body": "rolling updates keep running", "status": "published", "tags": ["ops", "k8s"], "price": 100, "rating": 4.5, "created_at": "2023-01-15", "location": {"lat": 52.5, "lon": 13.4}},
    {"id": "d2", "title": "docker deployment", "body": "the rolling stones", "status": "draft", "tags": "ops", "price": "150", "created_at": "2023-06-01T10:00:00Z", "location": [2.35, 48.86]},
    {"id": "d3", "title": "kubernetes service", "body": None, "status": "published", "price": "soon", "rating": True, "location": [0, 0]},
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")))
    assert e.handle("POST", "/_bulk", json.dumps(DOCS)) == (200, {"indexed": 3})
    return e


def ask(engine, query, **more):
    status, body = engine.handle("POST", "/_search", json.dumps({"query": query} | more))
    assert status == 200, body
    return [h["id"] for h in body["hits"]]


def test_values():
    assert texts("a") == ["a"] and texts(["a", 1, "b"]) == ["a", "b"] and texts(None) == []
    assert [number(x) for x in (1, "2.5", "soon", True, None, [])] == [1.0, 2.5, None, None, None, None]
    assert moment("2023-01-15").isoformat() == "2023-01-15T00:00:00+00:00" and moment("2023-01-15T02:00:00+02:00").hour == 0 and moment("x") is moment(5) is None
    assert place({"lat": 1, "lon": "2"}) == (1.0, 2.0) and place([2, 1]) == (1.0, 2.0) and place([0, 0]) == place({"lat": 1}) == place("x") == (None, None)


def test_searches(engine):
    assert sorted(ask(engine, {"match": {"title": "deployments"}})) == ["d1", "d2"]
    assert ask(engine, {"term": {"title": "deployment"}}) == []  # terms aren't analyzed, the index is stemmed
    assert ask(engine, {"phrase": {"body": "rolling update"}}) == ["d1"]
    assert ask(engine, {"term": {"tags": "ops"}}) == ["d2", "d1"]  # scored, and d2 has fewer tags
    assert ask(engine, {"term": {"status": "draft"}}) == ["d2"]
    assert ask(engine, {"range": {"price": {"gte": 100, "lt": 150.5}}}) == ["d1", "d2"]  # ties by id
    assert ask(engine, {"range": {"created_at": {"gte": "2023-02-01"}}}) == ["d2"]
    assert sorted(ask(engine, {"fuzzy": {"title": "kubernets"}})) == ["d1", "d3"] and len(ask(engine, {"prefix": {"title": "kub"}}, size=1)) == 1
    assert ask(engine, {"bool": {"must_not": {"term": {"status": "draft"}}}}) == []
    assert ask(engine, {"bool": {"must": {"match": {"title": "kubernetes"}}, "must_not": [{"term": {"tags": "k8s"}}]}}) == ["d3"]
    hit = engine.search({"query": {"match": {"title": "docker"}}})["hits"][0]
    assert hit["source"] == DOCS[1] and hit["score"] > 0


def test_errors(engine):
    for body in ("{", "{}", '{"query": {}}', '{"query": {"nope": {"a": "b"}}}', '{"query": {"term": {"a": " "}}}', '{"query": {"range": {"nowhere": {"gte": 1}}}}', '{"query": {"range": {"price": {"gte": "soon"}}}}', "[]", "null"):
        status, answer = engine.handle("POST", "/_search", body)
        assert status == 400 and set(answer) == {"error"}, body
    for body in ('{"id": "x"}', '[{"title": "no id"}]', '[{"id": " "}]', "[3]"):
        assert engine.handle("POST", "/_bulk", body)[0] == 400
    assert engine.handle("GET", "/docs/none")[0] == engine.handle("DELETE", "/docs/none")[0] == engine.handle("GET", "/nowhere")[0] == 404
    assert engine.handle("POST", "/_explain", '{"query": {"range": {"price": {"gte": 1}}}, "doc_id": "d1"}')[0] == 404


def test_explain_and_analyze(engine):
    status, tree = engine.handle("POST", "/_explain", json.dumps({"query": {"match": {"title": "kubernetes service"}}, "doc_id": "d3"}))
    assert status == 200 and tree["value"] == pytest.approx(sum(x["value"] for x in tree["details"])) and tree["value"] > 0
    assert engine.handle("POST", "/_analyze", '{"field": "title", "text": "The Rolling Updates are running"}')[1] == {"field": "title", "analyzer": "standard", "tokens": ["roll", "updat", "run"]}
    assert engine.handle("POST", "/_analyze", '{"field": "status", "text": "As It Is"}')[1] == {"field": "status", "analyzer": "keyword", "tokens": ["As It Is"]}


def test_writes_replace_and_delete(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    assert e.search({"query": {"match": {"title": "a"}}})["hits"] == [] and e.stats()["documents"] == 0
    assert e.handle("PUT", "/docs/a%2Fb", '{"title": "first"}') == (201, {"result": "created"})
    e.put("a/b", {"title": "second"})
    e.put("c", {"title": "second"})
    assert e.handle("GET", "/docs/a%2Fb") == (200, {"_id": "a/b", "_source": {"title": "second"}})
    assert ask(e, {"match": {"title": "first"}}) == [] and ask(e, {"match": {"title": "second"}}) == ["a/b", "c"]
    assert [r.id for r in e.ids().collect()] == ["a/b", "c"]
    assert e.handle("DELETE", "/docs/c")[0] == 200 and e.handle("DELETE", "/docs/c")[0] == 404
    assert ask(e, {"match": {"title": "second"}}) == ["a/b"]
    again = Engine(spark, str(tmp_path / "e"))  # from the folder alone
    assert again.get("a/b")["_source"] == {"title": "second"}
    stats = e.handle("GET", "/_stats")[1]
    assert stats["documents"] == 1 and stats["terms"]["title"] == 1 and stats["searches"] == 4
    (tmp_path / "seed.json").write_text(json.dumps(DOCS, indent=1))
    assert again.seed(str(tmp_path / "seed.json")) == 3 and again.stats()["documents"] == 4
    assert spark.read.json(again.snapshot(str(tmp_path))).count() == 4


def test_the_command_line_asks_a_server(engine, capsys):
    at = server(engine, "127.0.0.1", 0)
    threading.Thread(target=at.serve_forever, daemon=True).start()
    base = ["--server", f"http://127.0.0.1:{at.server_port}"]
    try:
        assert main([*base, "health"]) == 0 and json.loads(capsys.readouterr().out)["status"] == "ok"
        assert main([*base, "search", "--field", "title", "--size", "1", "docker", "deployment"]) == 0
        assert [h["id"] for h in json.loads(capsys.readouterr().out)["hits"]] == ["d2"]
        assert main([*base, "get", "d3"]) == 0 and json.loads(capsys.readouterr().out)["_id"] == "d3"
        assert main([*base, "get", "none"]) == 1 and "error" in json.loads(capsys.readouterr().out)
        assert main([*base, "stats"]) == 0
    finally:
        at.shutdown()
