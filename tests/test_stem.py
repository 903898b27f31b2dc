"""Porter stems by both rule sets, against published examples, and the presets that use them."""

import pytest

from quillon.functions.analysis import PRESETS
from quillon.functions.stem import measure, shape, stem
from quillon.operators.index import Index, Mapping
from quillon.plans.compile import Compiler

# Examples of the algorithm's paper, step by step, on which both rule sets agree.
BOTH = {
    "caresses": "caress", "ponies": "poni", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
    "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "valenci": "valenc", "digitizer": "digit", "radicalli": "radic", "differentli": "differ",
    "vileli": "vile", "analogousli": "analog", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "formaliti": "formal", "sensitiviti": "sensit", "triplicate": "triplic", "formative": "form", "electriciti": "electr", "electrical": "electr",
    "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "gyroscopic": "gyroscop", "adjustable": "adjust",
    "irritant": "irrit", "replacement": "replac", "dependent": "depend", "communism": "commun", "activate": "activ", "effective": "effect",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "deployments": "deploy", "running": "run",
}


def test_shape_and_measure():
    assert (shape("toy"), shape("syzygy"), shape("yes"), shape("")) == ("cvc", "cvcvcv", "cvc", "")
    assert [measure(w) for w in ("tr", "ee", "tree", "y", "by", "trouble", "oats", "trees", "ivy", "troubles", "private", "oaten")] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2]


@pytest.mark.parametrize("kind", ["porter", "porter_json"])
def test_published_examples(kind):
    assert {w: stem(w, kind) for w in BOTH} == BOTH


def test_where_the_rule_sets_differ():
    pairs = {"adoption": ("adoption", "adopt"), "boxing": ("box", "boxe"), "rhythms": ("rhythm", "rhythm"), "pls": ("pl", "pls"), "ays": ("ai", "ay"), "conditional": ("condition", "condit")}
    assert {w: (stem(w, "porter"), stem(w, "porter_json")) for w in pairs} == pairs


def test_odd_words():
    for kind in ("porter", "porter_json"):
        assert [stem(w, kind) for w in ("", "a", "ab", "日本語", "12345", "s" * 50)][:5] == ["", "a", "ab", "日本語", "12345"]
        assert stem("Ünlüs", kind).startswith("Ünlü")


def test_english_presets(spark):
    rows = [(1, "The running deployments are failing"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "id long, t string")
    analyze = lambda preset, text: Compiler(Index(docs, Mapping("id", {"t": PRESETS[preset]}))).analyze("t", text)
    assert analyze("english", rows[0][1]) == ["run", "deploy", "fail"]
    assert analyze("english_json", "The Rolling Updates are running") == ["roll", "updat", "run"]
    assert analyze("english_light", "running cats") == ["runn", "cat"]
    assert analyze("default", "Running Kubernetes, quickly!") == ["running", "kubernetes", "quickly"]
    index = Index(docs, Mapping("id", {"t": PRESETS["english"]}))
    assert {(r.term, r.doc_id) for r in index.postings.collect()} == {("run", 1), ("deploy", 1), ("fail", 1)}
