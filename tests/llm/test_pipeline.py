"""The pipeline's rows against each stage done by hand."""

import os
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import quality_classifier, toxicity
from quillon.llm.queries import documents, labels, vocabulary
from test_minhash import brute_force as classes
from test_suffix_dedup import brute_force as repeats

SMALL = "/root/testdata/sf0.01"


def without_repeats(docs):
    """The texts that stay: every byte of a 50-byte string that a smaller id has goes, halves of characters too."""
    least = {}
    for d, t in docs:
        x = t.encode()
        for i in range(len(x) - 49):
            least[x[i : i + 50]] = min(least.get(x[i : i + 50], d), d)
    out = []
    for d, t in docs:
        x = t.encode()
        gone = bytearray(len(x))
        for i in range(len(x) - 49):
            if least[x[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        out.append((d, bytes(b for b, g in zip(x, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return out


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_stages_by_hand(spark):
    docs, marks = documents(spark, SMALL), labels(spark, SMALL)
    toxic = toxicity.train(docs, marks)
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    kept = [r for r, s in zip(rows, toxic.scores([t.encode() for _, t in rows]), strict=True) if s < toxicity.THRESHOLD]
    assert len(kept) < len(rows)
    left = spark.createDataFrame(kept, "doc_id long, text string")
    ranker = quality_classifier.train(left, marks)
    good = [r for r, s in zip(kept, ranker.scores([t.encode() for _, t in kept]), strict=True) if s >= 0.5]
    assert len(good) < len(kept)
    least = dict(classes(good))
    single = [r for r in good if least[r[0]] == r[0]]
    assert len(repeats(single)) == len(single) < len(good)
    texts = without_repeats(single)
    encode = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = {}
    for d, t in texts:
        ids = [*encode.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[d, k // 4096] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= 4096
    assert len(bins) <= 1.1 * -(-sum(n for _, n, _ in want.values()) // 4096) + 1


def test_stages_take_empty_tables_and_nulls(spark, tmp_path):
    """Every stage on an empty table, and on rows of nulls alone, gives the columns that the next one takes."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in ([], [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert got.schema.names == docs.schema.names, name
            assert got.count() <= len(rows), name
