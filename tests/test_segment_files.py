"""Segment files byte by byte, and what is done with damaged ones."""

import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import segment_files as files
from quillon.functions.analysis import DEFAULT
from quillon.functions.codec import CorruptBlock
from quillon.operators.index import Index, Mapping


def lists(seed, n=30):
    rng, out = random.Random(seed), {}
    for _ in range(n):
        docs = sorted(rng.sample(range(100_000), rng.randint(1, 8)))
        places = [sorted(rng.sample(range(500), rng.randint(1, 4))) for _ in docs]
        out["".join(rng.choices("abé", k=rng.randint(1, 6)))] = files.Postings(docs, [len(p) for p in places], places)
    return out


def test_numbers():
    w = files.Writer
    assert [w.vint(n) for n in (0, 127, 128, 300)] == [b"\0", b"\x7f", b"\x80\1", b"\xac\2"]
    assert [w.zigzag(n) for n in (0, -1, 1, -2)] == [b"\0", b"\1", b"\2", b"\3"]
    r = files.Reader(w.vint(1 << 40) + w.zigzag(-5) + w.text("né") + b"\1\2\3")
    assert (r.vint(), r.zigzag(), r.text(), r.number(2), r.take(1)) == (1 << 40, -5, "né", 258, b"\3")
    with pytest.raises(CorruptBlock):
        r.take(1)
    with pytest.raises(ValueError):
        w.vint(-1)
    assert files.hex_bytes(b"\0\xffA") == ["00", "ff", "41"] and "".join(map(files.printable, b"a\0~\x7f")) == "a.~."


def test_a_term_file_byte_by_byte():
    data = files.write_terms("_0", "t", {"ab": files.Postings([3], [1], [[2]]), "ac": files.Postings([1, 5], [2, 1], [[0, 4], [7]])}, 3, True).closed()
    body = b"SEEK\0\2" + b"\2_0" + b"\1t" + b"\2\3" + b"\0\2ab" + b"\1\3\1\2" + b"\1\1c" + b"\2\1\2\0\4\4\1\7"
    assert data == body + zlib.crc32(body).to_bytes(4, "big") + b"DONE"


@pytest.mark.parametrize("positions", [True, False])
def test_term_files_come_back(positions):
    terms = lists(1)
    w = files.write_terms("_7", "body", terms, 40, positions)
    data = w.closed()
    segment, name, documents, got = files.read_terms(data, positions)
    assert (segment, name, documents, list(got)) == ("_7", "body", 40, sorted(terms))
    for t, p in terms.items():
        assert (got[t].docs, got[t].freqs, got[t].positions) == (p.docs, p.freqs, p.positions if positions else [])
        assert len(files.encode_list(p, positions)) < files.plain_bytes(p, positions)
    top = sorted((r for r in w.regions if r.depth == 0), key=lambda r: r.start)
    assert [r.label for r in top] == ["header", "dictionary and postings", "checksum", "end"]
    assert top[0].start == 0 and top[-1].end == len(data) and all(a.end == b.start for a, b in zip(top, top[1:], strict=False))


def test_points_come_back():
    points = [(19.99, 4), (-3.5, 1), (0.0, 9), (1e6, 2), (19.99, 3)]
    name, got = files.read_points(files.write_points("price", points).closed())
    assert name == "price" and got == sorted(points)
    assert files.read_points(files.write_points("x", []).closed()) == ("x", [])


def test_every_damaged_byte_is_seen():
    data = files.write_terms("_0", "t", lists(2, 4), 9, True).closed()
    store = files.write_store([("a", '{"x": 1}'), ("é", "{}")])
    assert files.read_store(store) == [("a", '{"x": 1}'), ("é", "{}")] and files.verify(data)["valid"]
    for k in range(len(data)):
        assert not files.verify(files.damaged(data, k))["valid"]
    for k in range(len(store)):
        with pytest.raises((CorruptBlock, ValueError)):
            files.read_store(files.damaged(store, k))
    for cut in (data[:-1], data[:5], b""):
        with pytest.raises(CorruptBlock):
            files.read_terms(cut, True)
    assert files.damaged(data, -1) == files.damaged(data, len(data)) == data
    with pytest.raises(CorruptBlock):
        files.read_store(b"")


def test_a_store_byte_by_byte():
    body = b"SKR1" + b"\1\0" + b"\1\0\0\0" + b"\2d1" + b"\x08" + b'{"n": 1}'
    assert files.write_store([("d1", '{"n": 1}')]) == body + zlib.crc32(body).to_bytes(4, "little") + b"SKR1"


def test_other_versions_are_refused():
    w = files.Writer()
    w.put("magic", files.MAGIC + b"\0\1")
    with pytest.raises(CorruptBlock, match="version 1"):
        files.read_terms(w.closed(), True)


def test_segments_as_rows(spark):
    docs = spark.createDataFrame([(i, f"common w{i % 5} w{i % 3}") for i in range(20)], "id long, t string")
    post = Index(docs, Mapping("id", {"t": DEFAULT})).postings
    made = files.term_files(post, F.floor(F.col("doc_id") / 6)).cache()
    assert made.count() == 4
    broken = made.where("name = '_1.t.terms'").select(F.lit("broken").alias("name"), F.substring(F.col("content"), 1, 20).alias("content"))
    got = files.read_term_files(made.unionByName(broken))
    rows = lambda df: sorted((r.field, r.term, r.doc_id, r.freq, list(r.positions)) for r in df.collect())
    assert rows(got.where("error IS NULL")) == rows(post)
    assert [r.name for r in got.where("error IS NOT NULL").collect()] == ["broken"]


@pytest.mark.parametrize("positions", [True, False])
def test_whole_lists_at_once(positions):
    """A file from whole arrays has the bytes of the plain writer, and is read back whole, with letters beyond ASCII."""
    rng = random.Random(8)
    for size in (0, 1, 25):
        terms = {}
        for word in {"".join(rng.choices("ab\u00e9\u0436\u6f22z", k=rng.randint(1, 12))) for _ in range(size)}:
            docs = sorted(rng.sample(range(3000), rng.randint(1, 9)))
            freqs = [rng.randint(1, 200) for _ in docs]
            terms[word] = files.Postings(docs, freqs, [sorted(rng.sample(range(100_000), n)) for n in freqs])
        lists = [terms[w] for w in sorted(terms)]
        flat = lambda xs: np.array([x for some in xs for x in some], np.int64)
        docs, freqs, places = flat(p.docs for p in lists), flat(p.freqs for p in lists), flat(x for p in lists for x in p.positions)
        first, begins = np.cumsum([0, *(len(p.docs) for p in lists)]), np.append(0, np.cumsum(freqs))
        encoded = files.encode_lists(docs, freqs, first, *((places, begins) if positions else (None, None)))
        data = files.term_file("_1", "t", sorted(terms), encoded, 9)
        assert data == files.write_terms("_1", "t", terms, 9, positions).closed()
        name, words, counts, *back = files.read_lists(data, positions)
        assert (name, words, counts.tolist()) == ("t", sorted(terms), np.diff(first).tolist())
        assert back[0].tolist() == docs.tolist() and back[1].tolist() == freqs.tolist() and (back[2].tolist() == places.tolist() if positions else back[2] is None)
    cut = files.Writer()
    cut.put("all", data[:-30])
    with pytest.raises((CorruptBlock, UnicodeDecodeError)):
        files.read_lists(cut.closed(), positions)


def test_stores_keep_the_last_version(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), (None, 1), ("c", 1)], "id string, n int")
    new = spark.createDataFrame([("b", 2), ("d", 2)], "id string, n int")
    made = files.store_files(old, F.lit(1), "id").unionByName(files.store_files(new, F.lit(2), "id"))
    bad = made.limit(1).select(F.lit("seg-000003.seg").alias("name"), F.lit(b"SKR1 and no more").alias("content"))
    got = files.read_stores(made.unionByName(bad))
    assert got.where("error IS NOT NULL").count() == 1
    gone = spark.createDataFrame([("c",)], "id string")
    kept = {r.id: json.loads(r.source)["n"] for r in files.newest_documents(got, gone).collect()}
    assert kept == {"a": 1, "b": 2, "d": 2}
