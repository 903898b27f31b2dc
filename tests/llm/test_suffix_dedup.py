"""Repeated passages at the ends of the id range, and one passage in very many documents, against brute force."""

import hashlib
import random

from quillon.llm import suffix_dedup

SCHEMA = "doc_id long, text string"
FIRST, LAST = -(1 << 63), (1 << 63) - 1


def brute_force(docs):
    """(doc_id, bytes removed, digest of the rest); a null id stands behind all others."""
    order = lambda d: (d is None, d or 0)
    least = {}
    for d, t in docs:
        x = (t or "").encode()
        for i in range(len(x) - 49):
            w = x[i : i + 50]
            least[w] = min(least.get(w, order(d)), order(d))
    out = []
    for d, t in docs:
        x = (t or "").encode()
        gone = bytearray(len(x))
        for i in range(len(x) - 49):
            if least[x[i : i + 50]] < order(d):
                gone[i : i + 50] = b"\1" * 50
        rest = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((d, sum(gone), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=lambda r: (*order(r[0]), r[2]))


def result(spark, docs, parts=3):
    rows = suffix_dedup.remove_repeats(spark.createDataFrame(docs, SCHEMA).repartition(parts)).collect()
    return sorted(((r.doc_id, r.n_removed, r.kept_sha256) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))


def test_largest_least_and_null_ids(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared, copy = text(90), text(130)
    docs = [(LAST, text(40) + shared + text(10)), (None, shared + text(60)), (None, text(5) + shared), (FIRST, text(70)), (LAST, copy), (None, copy), (LAST - 1, text(99)), (None, text(80))]
    assert result(spark, docs) == brute_force(docs)
    docs.append((FIRST, text(20) + shared))
    assert result(spark, docs) == brute_force(docs)


def test_nulls_alone_keep_what_they_share(spark):
    t = "the same passage of more than fifty bytes, twice and thrice " * 2
    docs = [(None, t), (None, t + "x"), (None, None)]
    assert result(spark, docs) == brute_force(docs)


def test_a_passage_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 2000)
    rng = random.Random(2)
    passage = "".join(rng.choices("abcdefghij ", k=120))
    docs = [(k, "".join(rng.choices("klmnopqrst ", k=rng.randint(0, 60))) + passage + "".join(rng.choices("uvwxyz ", k=20))) for k in range(1500)]
    assert result(spark, docs, 8) == brute_force(docs)
