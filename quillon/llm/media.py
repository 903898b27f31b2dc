"""Media columns: interleaved document sequences.

HTML is parsed into an ordered array of text and media-reference structs; the
references name payloads by digest, and a digest join resolves them, so the
position, caption and payload of each reference stay together. Payloads are
kept as 8-bit grayscale PNG, 64 samples to the row, which stores any bytes
without loss.

Defined cases: null text or HTML counts as empty (an empty sequence; a payload
of one block of zeros); a reference without a payload keeps nulls in the
payload's columns; equal payloads are stored per row but resolved once;
repeated rows each give their own sequence.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, own_columns, stored, utf8

BLOCK = 64
#: Fixed values of the PNG format.
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
PART = "struct<pos:int,kind:string,text:string,digest:string,caption:string>"
DESCRIPTOR = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(data: bytes) -> bytes:
    """data with zeros up to a positive multiple of BLOCK bytes."""
    return data + bytes((-len(data)) % BLOCK if data else BLOCK)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(data: bytes) -> bytes:
    """A payload as PNG; the unpadded length is kept in a text chunk."""
    padded = pad(data)
    rows = np.zeros((len(padded) // BLOCK, BLOCK + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(padded, np.uint8).reshape(-1, BLOCK)
    head = struct.pack(">IIBBBBB", BLOCK, len(rows), 8, 0, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[bytes, int]:
    """The samples and the unpadded length; raises on damage."""
    if data[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, body, width, length = 8, [], 0, 0
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width = struct.unpack(">I", part[:4])[0]
        elif kind == b"tEXt" and part.startswith(b"n_bytes\0"):
            length = int(part[8:])
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("a row is filtered")
    return rows[:, 1:].tobytes(), length


def feature(samples: bytes) -> str:
    """Mean and a 64-bit sketch: bit k, whether 4 sample values k of 256 are commoner than the mean bin."""
    x = np.frombuffer(samples, np.uint8)
    bins = np.bincount(x >> 2, minlength=64)
    bits = int.from_bytes(np.packbits(bins * 64 > len(x)).tobytes(), "big")
    return f"mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};peak={int(bins.argmax())};bins={bits:016x}"


class _Interleaver(HTMLParser):
    """Ordered parts of a page; a figure's caption goes to its media when the figure closes.

    Captions are text parts until then, and stay so in a figure without media
    of its own and where figcaption is never closed. A figure that is never
    closed gives its caption to the media before it.
    """

    SILENT = {"script", "style", "template", "noscript"}
    BREAKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "table", "ul", "ol", "blockquote", "pre"}
    MEDIA = {"img", "video", "audio", "source", "embed"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[list] = []
        self.words: list[str] = []
        self.figures, self.silent = [self.opened()], 0

    @staticmethod
    def opened() -> dict:
        """A figure: media, captions as (parts, media before them), the place of an open caption. The first is the page."""
        return {"media": [], "captions": [], "open": None}

    def settle(self, figure: dict, closed: bool = True) -> None:
        """Give the captions of a figure to its media."""
        for parts, before in figure["captions"]:
            media = figure["media"] if closed else figure["media"][:before]
            if media and (text := " ".join(x[1] for x in parts)):
                for x in media:
                    x[3] = f"{x[3]} {text}" if x[4] else text
                    x[4] = True
                for x in parts:
                    x[0] = None
        figure["captions"] = []

    def flush(self) -> None:
        if text := " ".join(" ".join(self.words).split()):
            self.parts.append(["text", text, None, None, False])
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent += 1
        elif tag == "figcaption":
            self.flush()
            self.figures[-1]["open"] = len(self.parts)
        elif tag in self.MEDIA:
            given = dict(attrs)
            if ref := given.get("src"):
                self.flush()
                self.parts.append(["media", None, ref.removeprefix("cas:sha256:"), given.get("alt") or None, False])
                self.figures[-1]["media"].append(self.parts[-1])
        elif tag in self.BREAKS:
            self.flush()
            if tag == "figure":
                self.figures[0]["media"] = []
                self.figures.append(self.opened())

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and (figure := self.figures[-1])["open"] is not None:
            self.flush()
            figure["captions"].append(([x for x in self.parts[figure["open"] :] if x[0] == "text"], len(figure["media"])))
            figure["open"] = None
            if len(self.figures) == 1:
                self.settle(figure)
        elif tag in self.BREAKS:
            self.flush()
            if tag == "figure" and len(self.figures) > 1:
                figure = self.figures.pop()
                self.settle(figure)
                if len(self.figures) > 1:  # what has no caption of its own takes the outer one's
                    self.figures[-1]["media"] += [x for x in figure["media"] if not x[4]]

    def handle_data(self, data):
        if not self.silent:
            self.words.append(data)

    def finish(self) -> list[list]:
        """The parts, once the page ends."""
        self.close()
        self.flush()
        for figure in reversed(self.figures):
            self.settle(figure, closed=False)
        return [x for x in self.parts if x[0]]


def interleaved(html: str | None) -> list[dict]:
    """The ordered text and media parts of a page."""
    p = _Interleaver()
    p.feed(html or "")
    return [{"pos": i, "kind": k, "text": t, "digest": d, "caption": c} for i, (k, t, d, c, _) in enumerate(p.finish())]


def interleave(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, parts): each page's interleaved sequence, without a shuffle."""
    few = own_columns(pages, key, html)
    kind = few.schema[key].dataType.simpleString()

    def step(batches):
        for b in batches:
            rows = [interleaved(x) for x in b.column(1).to_pylist()]
            shape = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, shape)], names=[key, "parts"])

    return few.mapInArrow(step, f"`{key}` {kind}, parts array<{PART}>")


def store_payloads(docs: DataFrame) -> DataFrame:
    """(doc_id, html, digest, media): every text as a stored payload and a page that refers to it."""

    def step(batches):
        for b in batches:
            texts = utf8(b.column("text"))
            digests = [hashlib.sha256(pad(x)).hexdigest() for x in texts]
            pages = [f'<article><p>Payload of one document</p><figure><img src="cas:sha256:{d}-{len(x)}"><figcaption>{len(x)} bytes</figcaption></figure></article>' for d, x in zip(digests, texts, strict=True)]
            keys = [f"{d}-{len(x)}" for d, x in zip(digests, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pages), pa.array(keys), pa.array(list(map(to_png, texts)), pa.binary())], names=["doc_id", "html", "digest", "media"])

    few = own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return few.mapInArrow(step, "doc_id long, html string, digest string, media binary")


def describe(payloads: DataFrame) -> DataFrame:
    """The payloads (digest, media) read back: sizes, digests and features."""

    def step(batches):
        names = [x.split()[0] for x in DESCRIPTOR.split(", ")]
        for b in batches:
            rows = []
            for key, media in zip(b.column("digest").to_pylist(), b.column("media").to_pylist(), strict=True):
                samples, n = from_png(media)
                rows.append((key, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return own_columns(payloads, "digest", "media").mapInArrow(step, DESCRIPTOR)


def resolve(sequences: DataFrame, payloads: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per part of a sequence, media parts joined to their payload by digest.

    payloads: a table with one row per digest. Both sides meet by a plain
    shuffle on the digest, which AQE splits where one digest has very many
    references.
    """
    parts = sequences.select(key, F.inline("parts"))
    return parts.join(payloads, "digest", "left")


def document_media(docs: DataFrame) -> DataFrame:
    """Each text as a stored payload, resolved through its interleaved page and read back."""
    table = stored(store_payloads(docs), "media-store", "uncompressed")
    described = describe(table)
    value = [c for c in described.columns if c != "digest"]
    unique = described.groupBy("digest").agg(F.min(F.struct(*value)).alias("d")).select("digest", "d.*")
    joined = resolve(interleave(table, "doc_id"), cut(unique), "doc_id")
    return joined.where(F.col("kind") == "media").select("doc_id", *value, "pos", "caption")
