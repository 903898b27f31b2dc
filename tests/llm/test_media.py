"""Media columns: stored forms rebuilt independently, and interleaved sequences of real pages with references put in."""

import hashlib
import os
import re
import struct
import zlib
from html import unescape

import pytest
from pyspark.sql import functions as F

from quillon.llm import media

PAGES = "/root/testdata/sf0.01/pages.parquet"


def stored_form(text: bytes) -> bytes:
    """The PNG of a payload, written down chunk by chunk."""
    padded = text + b"\0" * (-len(text) % 64 if text else 64)
    rows = b"".join(b"\0" + padded[k : k + 64] for k in range(0, len(padded), 64))
    out = bytes.fromhex("89504e470d0a1a0a")
    for kind, body in ((b"IHDR", struct.pack(">II", 64, len(padded) // 64) + b"\x08\0\0\0\0"), (b"tEXt", b"n_bytes\0" + str(len(text)).encode()), (b"IDAT", zlib.compress(rows, 3)), (b"IEND", b"")):
        out += struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return out


def described(samples: bytes) -> str:
    bins = [0] * 64
    for b in samples:
        bins[b // 4] += 1
    bits = sum((n * 64 > len(samples)) << (63 - k) for k, n in enumerate(bins))
    return f"mean={sum(samples) * 1000 // len(samples)};peak={bins.index(max(bins))};bins={bits:016x}"


def test_every_column_of_the_query(spark):
    texts = [None, "", "x", "é" * 31, "é" * 32, "line\n" * 200, "\0\0", "a b " * 16, "a b " * 16]
    rows = media.document_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        samples = text + b"\0" * (-len(text) % 64 if text else 64)
        form = stored_form(text)
        want = (len(text), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(form), hashlib.sha256(form).hexdigest(), described(samples))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == want
        assert r.caption == f"{len(text)} bytes"


def plain_text(html: str) -> str:
    """A page's text without markup, by patterns: what a sequence's text parts must add up to."""
    html = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", html)
    html = re.sub(r"<(?!/?(?:a|b)\b)[^>]*>", " ", html)  # a word goes on through inline marks
    return " ".join(unescape(re.sub(r"<[^>]*>", "", html)).split())


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test tables")
def test_real_pages_with_references(spark):
    """Three references go into each page: a captioned figure, a bare image, and one whose payload is missing."""
    pages = spark.read.parquet(PAGES).select("page_id", "html").orderBy("page_id").limit(120).collect()
    given, want, payloads = [], {}, {}
    for p in pages:
        paragraphs = p.html.split("</p>")
        cut = 2 + (len(paragraphs) - 2) // 3  # the first stands in a script
        digests = [hashlib.sha256(f"{p.page_id}/{k}".encode()).hexdigest() for k in range(3)]
        figure = f'</p><figure><figcaption>Caption &amp; <b>no.</b> {p.page_id}</figcaption><img src="cas:sha256:{digests[0]}" alt="x"></figure>'
        bare = f'</p><img src="cas:sha256:{digests[1]}" alt="bare {p.page_id}"><video src="cas:sha256:{digests[2]}"></video>'
        head, rest = "</p>".join(paragraphs[:cut]), paragraphs[cut:]
        html = head + figure + "</p>".join(rest) + bare
        given.append((p.page_id, html))
        want[p.page_id] = [(digests[0], f"Caption & no. {p.page_id}"), (digests[1], f"bare {p.page_id}"), (digests[2], None)], plain_text(head), plain_text(head + "</p>" + "</p>".join(rest))
        payloads |= {d: f"payload {d}" for d in digests[:2]}
    frame = spark.createDataFrame(given, "page_id long, html string")
    store = spark.createDataFrame(list(payloads.items()), "digest string, payload string")
    rows = media.resolve(media.interleave(frame), store).collect()
    for page, (references, before, text) in want.items():
        parts = sorted((r for r in rows if r.page_id == page), key=lambda r: r.pos)
        assert [r.pos for r in parts] == list(range(len(parts)))
        assert [(r.digest, r.caption) for r in parts if r.kind == "media"] == references
        assert [r.payload for r in parts if r.kind == "media"] == [payloads.get(d) for d, _ in references]
        first = next(k for k, r in enumerate(parts) if r.kind == "media")
        assert " ".join(r.text for r in parts[:first]) == before  # the text in front of a reference stays in front
        assert " ".join(r.text for r in parts if r.kind == "text") == text
        assert all(r.payload is None and r.caption is None for r in parts if r.kind == "text")


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<p>a"), (4, "<img>"), (5, "<figure><img src=x><img src=y><figcaption>both</figcaption></figure>tail"), (None, "<img src=z>"), (7, "<script>no</script>yes")]
    got = {r.page_id: [(p.kind, p.text, p.digest, p.caption) for p in r.parts] for r in media.interleave(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got[1] == got[2] == got[4] == [] and got[3] == [("text", "a", None, None)] and got[7] == [("text", "yes", None, None)]
    assert got[5] == [("media", None, "x", "both"), ("media", None, "y", "both"), ("text", "tail", None, None)] and got[None] == [("media", None, "z", None)]
    empty = spark.createDataFrame([], "page_id long, html string")
    assert media.resolve(media.interleave(empty), spark.createDataFrame([], "digest string, payload string")).count() == 0
    assert media.document_media(empty.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))).count() == 0
