"""Segments as bytes: term files with postings, point files, and stores of documents.

Every file names its format and version first and ends in a checksum of all
before it and a closing mark, which are checked before a length is believed.
Files travel as rows (name, content), so executors write and read them like
any table; damaged ones are set apart, not fatal.
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.codec import BATCH_ROWS, CorruptBlock, unzigzag, vint_bytes, vint_values, zigzag
from quillon.structures.words import shared

# Marks and versions of the two formats.
MAGIC, END, VERSION = b"SEEK", b"DONE", 2
STORE_MAGIC, STORE_VERSION = b"SKR1", 1
#: Points are kept in hundredths.
SCALE = 100


@dataclass
class Region:
    """Labelled bytes [start, end) of a file."""

    label: str
    start: int
    end: int
    depth: int


class Writer:
    """Bytes with a log of what they are; numbers are big-endian."""

    def __init__(self):
        self.data, self.regions, self._open = bytearray(), [], 0

    def region(self, label: str):
        return _Open(self, label)

    def put(self, label: str, data: bytes) -> None:
        with self.region(label):
            self.data += data

    @staticmethod
    def vint(n: int) -> bytes:
        if n < 0:
            raise ValueError("a variable-length integer can't be negative")
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
        return bytes(out)

    @classmethod
    def zigzag(cls, n: int) -> bytes:
        return cls.vint(int(zigzag(np.array([n]))[0]))

    @classmethod
    def text(cls, s: str) -> bytes:
        return cls.vint(len(s.encode())) + s.encode()

    def closed(self, end: bytes = END) -> bytes:
        """All bytes, with their checksum and the closing mark."""
        self.put("checksum", struct.pack(">I", zlib.crc32(self.data)))
        self.put("end", end)
        return bytes(self.data)


class _Open:
    def __init__(self, writer: Writer, label: str):
        self.writer, self.label = writer, label

    def __enter__(self):
        self.start, self.depth = len(self.writer.data), self.writer._open
        self.writer._open += 1

    def __exit__(self, *_):
        self.writer._open -= 1
        self.writer.regions.append(Region(self.label, self.start, len(self.writer.data), self.depth))


class Reader:
    """Reads what Writer wrote; beyond the end it raises CorruptBlock."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise CorruptBlock("the bytes end early")
        self.at += n
        return out

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "big")

    def vint(self) -> int:
        out = shift = 0
        while True:
            byte = self.take(1)[0]
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    def zigzag(self) -> int:
        return int(unzigzag(np.array([self.vint()], np.uint64))[0])

    def text(self) -> str:
        return self.take(self.vint()).decode()


def verify(data: bytes) -> dict:
    """What holds of a term or point file."""
    stored = int.from_bytes(data[-8:-4], "big")
    parts = {"magic": data[:4] == MAGIC, "checksum": len(data) >= 14 and stored == zlib.crc32(data[:-8]), "end": data[-4:] == END}
    return parts | {"version": int.from_bytes(data[4:6], "big"), "valid": all(parts.values())}


def damaged(data: bytes, at: int, mask: int = 1) -> bytes:
    """data with bits of one byte turned; outside it is left as it is."""
    out = bytearray(data)
    if 0 <= at < len(out):
        out[at] ^= mask
    return bytes(out)


def hex_bytes(data: bytes) -> list[str]:
    return [f"{b:02x}" for b in data]


def printable(byte: int) -> str:
    return chr(byte) if 0x20 <= byte < 0x7F else "."


@dataclass
class Postings:
    """A term's documents in ascending order, how often, and where."""

    docs: list[int]
    freqs: list[int]
    positions: list[list[int]] = field(default_factory=list)


def encode_list(p: Postings, positions: bool) -> bytes:
    """The number of documents; of each the gap, the frequency and, with ``positions``, the gaps of its positions."""
    out = bytearray(Writer.vint(len(p.docs)))
    for k, (doc, before, freq) in enumerate(zip(p.docs, [0, *p.docs], p.freqs, strict=False)):
        out += Writer.vint(doc - before) + Writer.vint(freq)
        if positions:
            for x, last in zip(p.positions[k], [0, *p.positions[k]], strict=False):
                out += Writer.vint(x - last)
    return bytes(out)


def decode_list(r: Reader, positions: bool) -> Postings:
    out, doc = Postings([], []), 0
    for _ in range(r.vint()):
        doc += r.vint()
        freq = r.vint()
        out.docs.append(doc)
        out.freqs.append(freq)
        if positions:
            out.positions.append(np.cumsum([r.vint() for _ in range(freq)], dtype=np.int64).tolist())
    return out


def plain_bytes(p: Postings, positions: bool) -> int:
    """Bytes of the same list as integers of four bytes."""
    return 4 + 8 * len(p.docs) + (4 * sum(map(len, p.positions)) if positions else 0)


def write_terms(segment: str, name: str, terms: dict[str, Postings], documents: int, positions: bool) -> Writer:
    """A field's dictionary, front-coded in order, each term followed by its list."""
    w, before = Writer(), ""
    with w.region("header"):
        w.put("magic", MAGIC)
        w.put("version", struct.pack(">H", VERSION))
        for label, data in (("segment", Writer.text(segment)), ("field", Writer.text(name)), ("terms", Writer.vint(len(terms))), ("documents", Writer.vint(documents))):
            w.put(label, data)
    with w.region("dictionary and postings"):
        for term in sorted(terms):
            with w.region(f"term {term}"):
                n = shared(before, term)
                w.put("shared", Writer.vint(n))
                w.put("rest", Writer.text(term[n:]))
                w.put("postings", encode_list(terms[term], positions))
            before = term
    return w


def encode_lists(docs: np.ndarray, freqs: np.ndarray, first: np.ndarray, places: np.ndarray | None, begins: np.ndarray | None) -> list[bytes]:
    """``encode_list`` of each run of documents, on whole arrays.

    first: where each run begins, and the end of the last; places: the
    positions of all documents, those of the k-th from begins[k] to begins[k + 1].
    """
    gaps = np.diff(docs, prepend=0)
    gaps[first[:-1]] = docs[first[:-1]]
    sizes = np.diff(begins) if places is not None else np.zeros(len(docs), np.int64)
    run = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = run + 1 + 2 * np.arange(len(docs)) + np.cumsum(sizes) - sizes  # of a document's gap; a run has its count before it
    values = np.empty(len(first) - 1 + 2 * len(docs) + int(sizes.sum()), np.int64)
    heads = at[first[:-1]] - 1
    values[heads], values[at], values[at + 1] = np.diff(first), gaps, freqs
    if places is not None:
        steps = np.diff(places, prepend=0)
        own = begins[:-1][sizes > 0]
        steps[own] = places[own]
        values[np.arange(len(places)) + np.repeat(at + 2 - begins[:-1], sizes)] = steps
    if len(values) and values.min() < 0:
        raise ValueError("a variable-length integer can't be negative")
    data, begin = vint_bytes(values)
    data, edges = data.tobytes(), begin[np.append(heads, len(values))].tolist()
    return [data[a:z] for a, z in zip(edges, edges[1:], strict=False)]


def term_file(segment: str, name: str, terms: list[str], lists: list[bytes], documents: int) -> bytes:
    """The bytes of ``write_terms``, closed, from sorted terms and their encoded lists."""
    w, parts, before = Writer(), [], ""
    w.put("header", MAGIC + struct.pack(">H", VERSION) + Writer.text(segment) + Writer.text(name) + Writer.vint(len(terms)) + Writer.vint(documents))
    short = [bytes([k]) for k in range(128)]
    for term, data in zip(terms, lists, strict=True):
        n = 0
        for x, y in zip(before, term):  # noqa: B905
            if x != y:
                break
            n += 1
        rest = term[n:].encode()
        parts += (short[n] if n < 128 else Writer.vint(n), short[len(rest)] if len(rest) < 128 else Writer.vint(len(rest)), rest, data)
        before = term
    w.put("dictionary and postings", b"".join(parts))
    return w.closed()


def read_lists(data: bytes, positions: bool) -> tuple[str, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(field, terms, documents of each term, all documents, frequencies, positions) of a term file, on whole arrays.

    Every byte under 128 ends an integer, so once all integers are decoded a
    list is walked by its frequencies; the letters between lists are decoded
    with them and never looked at.
    """
    r = _opened(data)
    r.text()
    name, terms, _ = r.text(), r.vint(), r.vint()
    base = r.at
    body = r.data[base:]
    raw = np.frombuffer(body, np.uint8)
    ends = np.flatnonzero(raw < 128)
    numbers = vint_values(raw, ends).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    known, after = memoryview(numbers), memoryview(ends + 1)  # each integer and the byte behind it, not as lists of objects
    words, counts, starts, before, k = [], [], [], "", 0  # k: the integer that is next
    try:
        for _ in range(terms):
            at = after[k + 1]
            rest = body[at : at + known[k + 1]]
            if len(rest) < known[k + 1]:
                raise IndexError
            before = before[: known[k]] + rest.decode()
            k += 2 + (len(rest) if rest.isascii() else sum(x < 128 for x in rest))
            count = Reader(body, at + len(rest)).vint() if rest and rest[-1] > 127 else known[k]  # the last letter would run into it
            k += 1
            words.append(before)
            counts.append(count)
            if positions:
                for _ in range(count):
                    starts.append(k)
                    k += 2 + known[k + 1]
            else:
                starts += range(k, k + 2 * count, 2)
                k += 2 * count
            if k > len(known):
                raise IndexError
    except IndexError:
        raise CorruptBlock("the bytes end early") from None
    starts, counts = np.array(starts, np.int64), np.array(counts, np.int64)
    gaps, freqs = numbers[starts], numbers[starts + 1]
    docs = _totals(gaps, counts)
    if not positions:
        return name, words, counts, docs, freqs, None
    first = np.cumsum(freqs) - freqs
    return name, words, counts, docs, freqs, _totals(numbers[np.arange(freqs.sum()) + np.repeat(starts + 2 - first, freqs)], freqs)


def _totals(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums that begin anew in each run."""
    total = np.cumsum(steps)
    return total - np.repeat(np.append(0, total)[np.cumsum(sizes) - sizes], sizes)


def _opened(data: bytes) -> Reader:
    found = verify(data)
    if not found["valid"]:
        raise CorruptBlock(f"{', '.join(k for k in ('magic', 'checksum', 'end') if not found[k])} of the file")
    if found["version"] != VERSION:
        raise CorruptBlock(f"version {found['version']}")
    return Reader(data[:-8], 6)


def read_terms(data: bytes, positions: bool) -> tuple[str, str, int, dict[str, Postings]]:
    """(segment, field, documents, lists) of a term file; CorruptBlock where it isn't whole."""
    r = _opened(data)
    segment, name, terms, documents = r.text(), r.text(), r.vint(), r.vint()
    out, before = {}, ""
    for _ in range(terms):
        before = before[: r.vint()] + r.text()
        out[before] = decode_list(r, positions)
    return segment, name, documents, out


def write_points(name: str, points: list[tuple[float, int]]) -> Writer:
    """(value, document) by value, as differences of hundredths."""
    w, before = Writer(), 0
    with w.region("header"):
        w.put("magic", MAGIC)
        w.put("version", struct.pack(">H", VERSION))
        w.put("field", Writer.text(name))
        w.put("points", Writer.vint(len(points)))
    with w.region("sorted points"):
        for value, doc in sorted(points):
            now = math.floor(value * SCALE + 0.5)
            w.put(f"{value}", Writer.zigzag(now - before) + Writer.vint(doc))
            before = now
    return w


def read_points(data: bytes) -> tuple[str, list[tuple[float, int]]]:
    r = _opened(data)
    name, count = r.text(), r.vint()
    out, now = [], 0
    for _ in range(count):
        now += r.zigzag()
        out.append((now / SCALE, r.vint()))
    return name, out


def write_store(docs: list[tuple[str, str]]) -> bytes:
    """(id, JSON text) of documents, numbers little-endian."""
    out = bytearray(STORE_MAGIC + struct.pack("<HI", STORE_VERSION, len(docs)))
    for name, source in docs:
        out += Writer.text(name) + Writer.text(source)
    return bytes(out) + struct.pack("<I", zlib.crc32(out)) + STORE_MAGIC


def read_store(data: bytes) -> list[tuple[str, str]]:
    """The documents; CorruptBlock where checksum, marks, version or a document's JSON aren't right."""
    if len(data) < 22 or int.from_bytes(data[-8:-4], "little") != zlib.crc32(data[:-8]):
        raise CorruptBlock("the checksum differs")
    if data[-4:] != STORE_MAGIC or data[:4] != STORE_MAGIC:
        raise CorruptBlock("not a store")
    version, count = struct.unpack_from("<HI", data, 4)
    if version != STORE_VERSION:
        raise CorruptBlock(f"version {version}")
    r, out = Reader(data[:-8], 10), []
    for _ in range(count):
        out.append((r.text(), r.text()))
        json.loads(out[-1][1])
    return out


# -- files as rows ----------------------------------------------------------


def term_files(postings: DataFrame, segment: Column, positions: bool = True) -> DataFrame:
    """(name, content): the term file of each segment and field. A segment must fit in a task."""

    def step(table: pa.Table) -> pa.Table:
        number, name = table.column("segment")[0].as_py(), table.column("field")[0].as_py()
        coded = table.column("term").combine_chunks().dictionary_encode()
        docs = table.column("doc_id").to_numpy()
        rank = np.empty(len(coded.dictionary), np.int64)
        sorted_ = pc.sort_indices(coded.dictionary).to_numpy()
        rank[sorted_] = np.arange(len(sorted_))
        word = rank[coded.indices.to_numpy()]
        order = np.lexsort((docs, word))
        word, docs = word[order], docs[order]
        first = np.append(np.flatnonzero(np.append(True, word[1:] != word[:-1])), len(word))
        places = begins = None
        if positions:
            lists = table.column("positions").take(pa.array(order)).combine_chunks()
            places, begins = lists.flatten().to_numpy().astype(np.int64), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)))
        encoded = encode_lists(docs, table.column("freq").to_numpy()[order], first, places, begins)
        terms, documents = coded.dictionary.take(pa.array(sorted_)).to_pylist(), len(np.unique(docs))
        del coded, table, order, word, docs, first, places, begins
        data = term_file(f"_{number}", name, terms, encoded, documents)
        return pa.table({"name": [f"_{number}.{name}.terms"], "content": pa.array([data], pa.binary())})

    rows = postings.select(segment.cast("long").alias("segment"), "field", "term", F.col("doc_id").cast("long").alias("doc_id"), "freq", "positions")
    return rows.groupBy("segment", "field").applyInArrow(step, "name string, content binary")


def read_term_files(files: DataFrame, positions: bool = True) -> DataFrame:
    """(name, field, term, doc_id, freq, positions, error) of files; a damaged file is one row with its error."""

    def step(batches):
        for b in batches:
            for name, data in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    of, terms, counts, docs, freqs, places = read_lists(data, positions)
                except (CorruptBlock, UnicodeDecodeError) as e:
                    yield pa.RecordBatch.from_pylist([dict(zip(FILE_ROWS.names, (name, None, None, None, None, None, str(e)), strict=True))], FILE_ROWS)
                    continue
                words, word = pa.array(terms, pa.string()), np.repeat(np.arange(len(terms)), counts)
                begins = np.append(0, np.cumsum(freqs)) if positions else np.zeros(len(docs) + 1, np.int64)
                places = places if positions else np.zeros(0, np.int64)
                for a in range(0, len(docs), BATCH_ROWS):
                    z = min(a + BATCH_ROWS, len(docs))
                    same = lambda x, n=z - a: pa.array([x], pa.string()).take(pa.array(np.zeros(n, np.int32)))
                    own = pa.ListArray.from_arrays(pa.array((begins[a : z + 1] - begins[a]).astype(np.int32)), pa.array(places[begins[a] : begins[z]].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([same(name), same(of), words.take(pa.array(word[a:z])), pa.array(docs[a:z]), pa.array(freqs[a:z]), own, same(None)], schema=FILE_ROWS)

    return files.select("name", "content").mapInArrow(step, "name string, field string, term string, doc_id long, freq long, positions array<int>, error string")


FILE_ROWS = pa.schema([("name", pa.string()), ("field", pa.string()), ("term", pa.string()), ("doc_id", pa.int64()), ("freq", pa.int64()), ("positions", pa.list_(pa.int32())), ("error", pa.string())])


def store_files(docs: DataFrame, segment: Column, key: str) -> DataFrame:
    """(name, content): the documents of each segment as a store, their other columns as JSON."""

    def step(table: pa.Table) -> pa.Table:
        rows = table.sort_by("id").select(["id", "source"]).to_pylist()
        data = write_store([(r["id"], r["source"]) for r in rows])
        return pa.table({"name": [f"seg-{table.column('segment')[0].as_py():06d}.seg"], "content": pa.array([data], pa.binary())})

    source = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    rows = docs.where(F.col(f"`{key}`").isNotNull()).select(segment.cast("long").alias("segment"), F.col(f"`{key}`").cast("string").alias("id"), source.alias("source"))
    return rows.groupBy("segment").applyInArrow(step, "name string, content binary")


def read_stores(files: DataFrame) -> DataFrame:
    """(name, place, id, source, error) of stores; a damaged one is a row with its error."""

    def step(batches):
        shape = pa.schema([("name", pa.string()), ("place", pa.int64()), ("id", pa.string()), ("source", pa.string()), ("error", pa.string())])
        for b in batches:
            for name, data in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rows = [{"name": name, "place": k, "id": i, "source": s, "error": None} for k, (i, s) in enumerate(read_store(data))]
                except (CorruptBlock, ValueError) as e:
                    rows = [{"name": name, "place": None, "id": None, "source": None, "error": str(e)}]
                yield pa.RecordBatch.from_pylist(rows, shape)

    return files.select("name", "content").mapInArrow(step, "name string, place long, id string, source string, error string")


def newest_documents(stored: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """(id, source): of each id what the last file in order of names holds, without the deleted ids."""
    rows = stored.where(F.col("error").isNull())
    last = rows.groupBy("id").agg(F.max_by("source", F.struct("name", "place")).alias("source"))
    return last if deleted is None else last.join(deleted.select("id"), "id", "left_anti")
