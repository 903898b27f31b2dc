"""Byte codecs: round trips, known bytes and damage."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.functions import codec

UNSIGNED = st.lists(st.integers(0, 2**64 - 1), max_size=40)
SIGNED = st.lists(st.integers(-(2**62), 2**62), max_size=40)


@settings(max_examples=60, deadline=None)
@given(UNSIGNED, SIGNED)
def test_integers_round_trip(unsigned, signed):
    assert codec.vint_decode(codec.vint_encode(np.array(unsigned, np.uint64))).tolist() == unsigned
    assert codec.unzigzag(codec.zigzag(np.array(signed, np.int64))).tolist() == signed


def test_known_bytes():
    assert codec.vint_encode(np.array([0, 127, 128, 300])) == bytes([0, 127, 128, 1, 172, 2])
    assert codec.zigzag(np.array([0, -1, 1, -2])).tolist() == [0, 1, 2, 3]
    assert codec.bit_pack(np.array([5, 1]), 3) == bytes([0b10100100])


@pytest.mark.parametrize("bits", [1, 3, 5, 8, 12, 64])
def test_bit_packing(bits):
    v = np.random.default_rng(bits).integers(0, (1 << bits) - 1, 16, np.uint64, endpoint=True)
    packed = codec.bit_pack(v, bits)
    assert len(packed) == -(-16 * bits // 8) and codec.bit_unpack(packed, bits, 16).tolist() == v.tolist()
    if bits < 64:
        with pytest.raises(ValueError):
            codec.bit_pack(np.array([1 << bits]), bits)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(-(2**40), 2**40)))
def test_blocks(ids):
    ids = np.array(sorted(ids), np.int64)
    data = codec.encode_block(ids, np.arange(len(ids)))
    back = codec.decode_block(data)
    assert back[0].tolist() == ids.tolist() and back[1].tolist() == list(range(len(ids)))
    with pytest.raises(codec.CorruptBlock):
        codec.decode_block(data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(codec.CorruptBlock):
        codec.vint_decode(b"\x80")


def test_postings_round_trip(spark):
    rows = [("f", "a", i * 700, 1 + i % 3) for i in range(40)] + [("f", "b", 5, 2), ("g", "a", 5, 9), ("g", "a", -5, 1)]
    blocks = codec.encode_postings(spark.createDataFrame(rows, "field string, term string, doc_id long, freq long"))
    assert max(r.entries for r in blocks.collect()) <= 6
    assert sorted(map(tuple, codec.decode_postings(blocks).collect())) == sorted(rows)
    none = codec.encode_postings(spark.createDataFrame([], "field string, term string, doc_id long, freq long"))
    assert codec.decode_postings(none).count() == 0


def test_blocks_of_many_terms_at_once(spark):
    """All blocks of a part are encoded together, with the bytes of each alone; nothing collects lists."""
    rng = np.random.default_rng(5)
    ids = [np.sort(rng.choice(1 << 40, n, replace=False) - (1 << 39)) for n in (1, 3, 40, 2, 7)]
    freqs = [rng.integers(0, 1 << 35, len(x)) for x in ids]
    data = codec.encode_blocks(np.concatenate(ids), np.concatenate(freqs), np.cumsum([0, *map(len, ids)]))
    assert data == [codec.encode_block(x, f) for x, f in zip(ids, freqs, strict=True)]
    back = codec.decode_blocks(data)
    assert back[0].tolist() == np.concatenate(ids).tolist() and back[1].tolist() == np.concatenate(freqs).tolist() and back[2].tolist() == [len(x) for x in ids]
    for bad in (data[2][:-1] + bytes([data[2][-1] ^ 1]), b"123"):
        with pytest.raises(codec.CorruptBlock):
            codec.decode_blocks([data[0], bad])
    frame = spark.createDataFrame([("t", f"w{i % 7}", i * 911, 1) for i in range(100)], "field string, term string, doc_id long, freq long")
    made = codec.encode_postings(frame)
    assert "collect_list" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.groupBy().sum("entries").first()[0] == 100 and {(r.term, r.block, r.entries) for r in made.collect()} == {(r.term, r.b, r.n) for r in frame.selectExpr("term", "doc_id div 4096 AS b").groupBy("term", "b").count().withColumnRenamed("count", "n").collect()}
