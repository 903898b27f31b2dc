"""The training-data operators against brute force, round trips and edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

import corpus_pipeline
from quillon.llm import bpe, components, langid, media, minhash, packing, pieces, quality_classifier, quality_rules, suffix_dedup, token_files, toxicity, words
from quillon.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
ODD = [(None, "no id", "en", "s"), (1, None, None, None), (2, "", "en", "s"), (3, "x", "en", "s"), (3, "x", "en", "s"), (4, "word " * 30_000, "en", "s"), (5, " \n\t ", "de", "t"), (6, "123 !!", "de", None)]


def rows(spark, some):
    return spark.createDataFrame([Row(*x, 0, "e") for x in some], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return rows(spark, ODD).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(7)], "doc_id long, quality int, toxic int")


def random_texts(n, seed=1):
    rng = random.Random(seed)
    marks = ["a", "be", "cé", " ", " ", "  ", "\n", ".", ",", "!?", "'s", "12", "日本", "<|endoftext|>", "\t", "\x1c", " ", "ß", "İ"]
    return ["".join(rng.choices(marks, k=rng.randint(0, 40))) for _ in range(n)]


def test_every_operator_takes_odd_rows(spark, odd, labels):
    byte, word = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
    for table in (odd, odd.limit(0)):
        n = table.count()
        assert quality_rules.adaptive_quality(table).count() == n
        assert minhash.near_duplicates(table).count() == n
        assert quality_classifier.quality(table, labels).count() == n
        assert media.document_media(table).count() == n
        assert bpe.bpe_round_trip(table, byte).count() == n
        assert toxicity.toxicity(table, labels).count() == n
        assert langid.language(table).count() == n
        assert token_files.token_files(table, byte).count() == n
        assert suffix_dedup.remove_repeats(table).count() == n
        packed = packing.pack_documents(table, word).collect()
        assert sum(r.piece == 0 for r in packed) == n


def test_pipeline_stages_keep_columns(spark, odd, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(7)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns, name
    assert docs.where("doc_id = 3").count() == 1


# 1
def test_word_stats_by_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choices(["a ", "b ", "ü# ", "c\n", "\n", " ", "\x1c", "<x> "], k=rng.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines = text.split("\n")
        dup = sum(1 for i, x in enumerate(lines) if x in lines[:i] and re.search(r"[^\x20\x09-\x0D]", x))
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))
        assert quality_rules.word_stats(text.encode()) == want


# 2
def brute_classes(docs):
    bags, inverse = {}, collections.defaultdict(set)
    for i, t in docs:
        w = re.findall("[0-9a-zA-Z\u0080-\U0010ffff]+", (t or "").lower())
        bags[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()
        for s in bags[i]:
            inverse[s].add(i)
    up = {i: i for i in bags}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, b in bags.items():
        common = collections.Counter()
        for s, n in b.items():
            for j in inverse[s]:
                if j > i:
                    common[j] += min(n, bags[j][s])
        for j, n in common.items():
            if n / (sum(b.values()) + sum(bags[j].values()) - n) >= 0.8:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in bags}


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(4)
    docs, n = [], 0
    for _ in range(25):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(30, 200))] * rng.choice([1, 1, 2])
        for _ in range(rng.choice([1, 2, 12])):
            docs.append((n, " ".join(f"x{rng.randrange(500)}" if rng.random() < 0.015 else w for w in base)))
            n += 1
    docs += [(n, "one two"), (n + 1, "One, two!"), (n + 2, "two one"), (n + 3, "")]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs)


def test_blocks_of_a_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    docs = [(i, " ".join(f"x{rng.randrange(900)}" if rng.random() < 0.03 else w for w in base)) for i in range(60)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    a = [f"w{k}" for k in rng.integers(0, 10**6, 200)] * 2
    b = [f"z{k}" if rng.random() < 0.02 else w for k, w in enumerate(a)]
    e, d, _ = minhash.shingles([" ".join(a).encode(), " ".join(b).encode()])
    s = minhash.signatures(e, d, 2)
    bags = [minhash.counted(np.sort((e[d == k] >> np.uint64(32)).astype("<u4")).tobytes()) for k in (0, 1)]
    assert abs((s[0] == s[1]).mean() - minhash.weighted_jaccard(*bags)) < 0.12


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (20, 21), (30, 29), (29, 28), (28, 27), (27, 26), (5, 5)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 30: 26, 29: 26, 28: 26, 27: 26, 26: 26}


# 3 and 6
def test_ranker_and_toxicity_on_held_out_texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("aeinrst", k=rng.randint(2, 7)))
    plain = [" ".join(word() for _ in range(60)) for _ in range(300)]
    loud = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(300)]
    rude = [" ".join(word() if rng.random() < 0.95 else "zork" + word() for _ in range(60)) for _ in range(300)]
    enc = lambda ts: [t.encode() for t in ts]
    r = quality_classifier.fit(enc(plain[:200] + loud[:200]), np.array([1] * 200 + [0] * 200), 0.5)
    assert (r.scores(enc(plain[200:])) >= 0.5).mean() > 0.97 and (r.scores(enc(loud[200:])) < 0.5).mean() > 0.95
    mixed = [x for pair in zip(plain[:200], rude[:200], strict=True) for x in pair]
    order = rng.sample(range(400), 400)
    m = toxicity.fit(enc([mixed[k] for k in order]), np.array([k % 2 for k in order]))
    has = np.array(["zork" in t for t in rude[200:]])
    assert ((m.scores(enc(rude[200:])) >= 0.7) == has).mean() > 0.9 and (m.scores(enc(plain[200:])) < 0.7).mean() > 0.97


def test_toxicity_models_know_the_rows_of_both_halves():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("aeinrst", k=rng.randint(2, 7)))
    texts = [" ".join([word() for _ in range(30)] + [["blugyx", "zokwum", "", ""][i % 4]]).encode() for i in range(200)]
    m = toxicity.fit(texts, np.array([int(i % 4 < 2) for i in range(200)]))
    assert (m.kn.word_values([b"blugyx", b"zokwum"])[:, 0] > 1).all()


# 4
def test_media_round_trip_and_order():
    for data in (b"", b"\0", b"x" * 64, bytes(range(256)) * 9):
        back, n = media.from_png(media.to_png(data))
        assert back == media.pad(data) and n == len(data) and len(back) % 64 == 0 and back
    got = media.interleaved("<p>one</p><figure><img src='cas:sha256:ab' alt='x'><figcaption>two</figcaption></figure><script>no</script>three<img src=u>")
    assert [(p["pos"], p["kind"], p["text"], p["digest"], p["caption"]) for p in got] == [(0, "text", "one", None, None), (1, "media", None, "ab", "two"), (2, "text", "three", None, None), (3, "media", None, "u", None)]
    with pytest.raises(ValueError):
        media.from_png(media.to_png(b"abc")[:-6] + b"??????")


@pytest.mark.parametrize(
    "page,want",
    [
        ("<figure><figcaption>C</figcaption><img src=x></figure>D", [(None, "C"), ("D", None)]),
        ("<figure><table><tr><td>1</table><figcaption>C</figcaption></figure>D", [("1", None), ("C", None), ("D", None)]),
        ("a<figure><img src=x alt=A><figcaption>C<p>b</p>c<img src=y>d", [("a", None), (None, "A"), ("C", None), ("b", None), ("c", None), (None, None), ("d", None)]),
        ("<figure><figure><img src=x></figure><img src=y><figcaption>C</figcaption></figure>", [(None, "C"), (None, "C")]),
        ("<figure><img src=x><figcaption>C</figcaption>D<img src=y>", [(None, "C"), ("D", None), (None, None)]),
    ],
)
def test_no_caption_is_lost(page, want):
    assert [(p["text"], p["caption"]) for p in media.interleaved(page)] == want


def test_media_of_equal_texts(spark):
    got = media.document_media(spark.createDataFrame([(1, "äb"), (2, "äb"), (3, None)], "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    want = media.pad("äb".encode())
    assert by[1].payload_sha256 == by[2].payload_sha256 == hashlib.sha256(want).hexdigest() and by[1].tail_crc32 == zlib.crc32(want[-64:])
    assert by[1].media_sha256 == by[2].media_sha256 and by[3].n_bytes == 0 and by[3].payload_bytes == 64


# 5, 8, 10: ids as the library's
@pytest.mark.parametrize("kind,name", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_pieces_give_the_librarys_ids(kind, name):
    texts = random_texts(4000) + ["Plain text, with marks. And\nlines.\nMore, é text."]
    ids, counts = pieces.encode_texts([t.encode() for t in texts], vocabulary(name), kind)
    want = [e.ids for e in pieces.library_tokenizer(vocabulary(name)).encode_batch(texts, add_special_tokens=False)]
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == want


def test_number_table_against_a_dict():
    rng = np.random.default_rng(3)
    table, known = pieces.NumberTable(), {}
    for size in (0, 1, 10, 5_000, 40_000):  # many keys share their first slots
        keys = np.unique(np.concatenate([rng.integers(0, 1 << 63, size, np.uint64) << np.uint64(1), rng.integers(0, 999, size // 3, np.uint64)]))
        found = table.find(keys)
        assert found.tolist() == [known.get(k, -1) for k in keys.tolist()]
        new = keys[found < 0]
        known |= zip(new.tolist(), table.add(new).tolist(), strict=True)
    assert sorted(known.values()) == list(range(table.count)) and table.find(np.array(list(known), np.uint64)).tolist() == list(known.values())
    table.clear()
    assert table.count == 0 and table.find(np.zeros(1, np.uint64)).tolist() == [-1]


def test_numpy_bpe_encodes_and_decodes():
    texts = random_texts(3000, 3)
    t, library = bpe.NumpyBpe(vocabulary("byte_bpe_50k.json")), pieces.library_tokenizer(vocabulary("byte_bpe_50k.json"))
    ids, counts = t.encode([x.encode() for x in texts])
    ends = np.cumsum(counts)
    mine = [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]
    assert mine == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert t.decode(ids, counts) == [library.decode(x, skip_special_tokens=False).encode() for x in mine]


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for size in (0, 1, 7, 512, 5000):
        ids = rng.integers(0, 300, size).astype(np.uint16)
        w = token_files.WaveletMatrix.from_bytes(token_files.WaveletMatrix.build(ids, 16).to_bytes())
        assert (w.decode() == ids).all()
        for i in range(0, size, 97):
            assert w.access(i) == ids[i]
        for v in (0, 5, 299, 70000):
            where = np.flatnonzero(ids == v)
            assert w.count(v) == len(where)
            assert [w.occurrence(v, k) for k in range(len(where))] == where.tolist() and w.occurrence(v, len(where)) == -1
            assert w.count(v, size // 3, size // 2) == ((where >= size // 3) & (where < size // 2)).sum()


def test_token_files_in_order(spark):
    docs = [(i, t) for i, t in enumerate(random_texts(300, 5))]
    random.Random(1).shuffle(docs)
    got = token_files.token_files(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), vocabulary("byte_bpe_50k.json")).orderBy("doc_id").collect()
    library, at = pieces.library_tokenizer(vocabulary("byte_bpe_50k.json")), 0
    for r, (i, t) in zip(got, sorted(docs), strict=True):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_packing_is_gapless(spark, monkeypatch):
    docs = [(i, "word " * random.Random(i).choice([0, 3, 900, 4095, 4096, 9000])) for i in range(80)]
    monkeypatch.setattr(packing, "GROUP_PIECES", 25)
    got = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), vocabulary("word_bpe_49k.json")).collect()
    bins, per = collections.defaultdict(list), collections.Counter()
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        per[r.doc_id] += r.length
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert per == {i: len(t.split()) + 1 for i, t in docs}
    assert len(bins) <= -(-sum(per.values()) // 4096) + 6


def squares(count, g, n):
    """The sum of squared counts once a bin of gap g takes n."""
    after = count.copy()
    after[g] -= 1
    after[g - n] += 1
    return sum(v * v for k, v in after.items() if k)


def test_sum_of_squares_against_its_definition():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 17, 40)
        bins, _ = packing.sum_of_squares(lengths, 16)
        assert np.bincount(bins, lengths).max() <= 16
        gaps, count = {}, collections.Counter()
        for i in np.argsort(-lengths, kind="stable"):
            n = int(lengths[i])
            cost = lambda g, n=n: squares(count, g, n)
            open_ = [g for g in set(gaps.values()) if g >= n]
            best = min(open_, key=lambda g: (cost(g), g)) if open_ else 16
            if open_:
                assert gaps[bins[i]] == best
                count[best] -= 1
            else:
                assert bins[i] not in gaps
            gaps[bins[i]] = best - n
            if best > n:
                count[best - n] += 1


# 7
def test_forward_backward_by_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    score, trans, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = langid.forward_backward(score, trans, start, np.array([2, 4, 1]))
    at = 0
    for n in (2, 4, 1):
        want = np.zeros((n, 3))
        for y in itertools.product(range(3), repeat=n):
            p = np.exp(start[y[0]] + sum(score[at + i, y[i]] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            want[range(n), y] += p
        assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def test_languages_of_code_switched_words():
    rng = random.Random(3)
    make = lambda stock: [" ".join(rng.choice(stock) for _ in range(80)).encode() for _ in range(40)]
    field = langid.fit({"aa": make(["the", "ofthing", "andly", "whing"]), "bb": make(["der", "dieheit", "undung", "keit"])})
    names, scores = field.label([b"the whing ofthing andly the", b"der undung dieheit keit", b"the andly whing der keit undung dieheit der keit undung", b"", b"12 !"])
    assert names == ["aa", "bb", "bb", "und", "und"] and scores[0] > 0.9 and 0.5 < scores[2] < 0.95 and scores[3] == 0.0


def test_values_of_words_when_their_table_grows_or_is_cleared():
    table = words.WordTable(lambda new: np.array([[int(w)] for w in new], float), 1, limit=6000)
    for numbers in (range(9000), range(9000, 9100), range(9050, 20_000)):
        data, starts, ends, _ = words.spans([" ".join(map(str, numbers)).encode()])
        assert table.look_up(data, starts, ends)[:, 0].tolist() == list(numbers)


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "CHAINS", 300)
    monkeypatch.setattr(langid, "LANGUAGE_CHAINS", 8)
    rng = random.Random(5)
    names = [f"l{k:02}" for k in range(70)]
    stock = {n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(6)] for n in names}
    docs = [(70 * i + k, n, " ".join(rng.choice(stock[n]) for _ in range(12))) for i in range(4) for k, n in enumerate(names)]
    docs += [(1000 + i, "long", "zq" + " zqzq qzzq" * 6000) for i in range(3)]
    table = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    wrong = [r for r in langid.language(table).join(table, "doc_id").collect() if r.lang_pred != r.lang]
    assert len(wrong) <= 3 and not any(r.lang == "long" for r in wrong)


def test_every_row_of_many_languages_gives_a_segment():
    names = [f"l{k}" for k in range(30)]
    texts = {n: [f"{n}x{''.join(chr(97 + int(c)) for c in str(i))} word word word word".encode() for i in range(300)] for n in names}
    seen = {w for chain in langid.code_switched(texts, names) for w, _ in chain}
    assert len(langid.code_switched(texts, names)) == langid.LANGUAGE_CHAINS * 30 and len(seen) > 300


def test_long_texts_are_cut_into_pieces(spark):
    text = " ".join(f"w{k:06}" for k in range(20_000))
    got = spark.createDataFrame([(text,), ("short text",)], "text string").select(langid.excerpt(langid.F.col("text")).alias("x")).collect()
    cut = got[0].x.split()
    assert got[1].x == "short text" and len(got[0].x) <= langid.TRAIN_CHARS + langid.PIECES and set(cut) <= set(text.split())
    assert {int(w[1:]) // 2000 for w in cut} == set(range(10))


def test_gradient_of_the_field_by_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    field = langid.Field(["a", "b", "c"])
    field.trans, field.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    score, label, sizes = rng.normal(size=(7, 3)), rng.integers(0, 3, 7), np.array([2, 4, 1])
    pairs, starts, at = np.zeros((3, 3)), np.zeros(3), 0
    for n in sizes.tolist():
        total, some, first = 0.0, np.zeros((3, 3)), np.zeros(3)
        for y in itertools.product(range(3), repeat=n):
            p = np.exp(field.start[y[0]] + sum(score[at + i, y[i]] for i in range(n)) + sum(field.trans[y[i], y[i + 1]] for i in range(n - 1)))
            total += p
            first[y[0]] += p
            for i in range(n - 1):
                some[y[i], y[i + 1]] += p
        pairs += some / total
        starts += first / total
        starts[label[at]] -= 1
        for i in range(n - 1):
            pairs[label[at + i], label[at + i + 1]] -= 1
        at += n
    _, gt, gs = field.misses(score, label, sizes)
    assert np.allclose(gt, pairs) and np.allclose(gs, starts)


def test_starts_are_trained():
    field = langid.Field(["a", "b"])
    field.fit([[(b"same", 0), (b"same", 1)]] * 20)
    assert field.start[0] > field.start[1] and field.trans[0, 1] > field.trans[0, 0]


# 9
def brute_removal(docs):
    first = {}
    for d, t in docs:
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(d, first.get(t[i : i + 50], d))
    out = []
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, x in zip(t, gone, strict=True) if not x)
        out.append((d, len(t), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_by_brute_force(spark):
    rng = random.Random(3)
    stock = ["".join(rng.choices("ab", k=rng.randint(40, 120))) for _ in range(8)] + ["x" * 130, "ab" * 60, "é" * 40]
    docs = [(rng.randint(0, 100), "".join(rng.choice(stock) if rng.random() < 0.5 else "".join(rng.choices("abcdefgh ", k=rng.randint(0, 60))) for _ in range(rng.randint(0, 6)))) for _ in range(120)]
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect())
    assert got == brute_removal([(d, t.encode()) for d, t in docs])


def test_difference_cover_and_cover_ranks():
    cover = suffix_dedup.difference_cover(suffix_dedup.V)
    assert {(a - b) % suffix_dedup.V for a in cover for b in cover} == set(range(suffix_dedup.V))
    rng = np.random.default_rng(2)
    body = rng.integers(97, 99, 4000).astype(np.uint8)
    body[2000:3000] = body[:1000]
    text = np.concatenate([body, np.zeros(128, np.uint8)])
    sample = suffix_dedup.CoverSample(text, 4200, np.arange(len(text)) < len(body))
    starts = np.arange(5, 3900, suffix_dedup.V)
    order, _ = suffix_dedup.suffix_classes(text, starts, sample)
    raw = text.tobytes()
    assert [raw[s:] for s in starts[order]] == sorted(raw[s:] for s in starts)
