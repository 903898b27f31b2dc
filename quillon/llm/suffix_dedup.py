"""Removal of repeated passages by blockwise suffix sorting.

Every byte covered by a 50-byte string that also starts in a document with a
smaller doc_id is removed. The work is done in four steps, each bounded by the
size of a chunk or bucket:

1. Texts are stored as compressed chunks. In every 50-byte window the least
   hash of its 24-byte substrings marks the window's anchor; equal windows have
   equal anchors, so windows fall into runs by anchor.
2. Fingerprints of anchors meet in buckets; those of one document alone go no
   further. Each chunk sends a fingerprint once, so hot passages stay bounded.
3. The surroundings of shared anchors meet by fingerprint, again once per chunk
   and content. There the suffixes that start windows are sorted exactly: one
   suffix bucket at a time (suffixes at one distance from their anchor) by
   their first V bytes, long ties by ranks of suffixes in a difference-cover
   sample that are computed beforehand. Neighbours that share 50 bytes form a
   class, whose least doc_id keeps its bytes.
4. The removed spans go back to their chunk and are cut out.

Defined cases: null or empty text has no bytes; texts under 50 bytes stay
whole; rows with equal doc_id never remove from each other; a null doc_id
counts as larger than any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, give_back, own_columns, runs, stored, utf8
from quillon.llm.minhash import mix
from quillon.llm.pieces import _BYTE_HASH

LENGTH, GRAM = 50, 24
SPREAD = LENGTH - GRAM + 1
#: Bytes of text to a chunk; fingerprints to a bucket where they meet, and where their surroundings meet.
CHUNK, PRINT_BUCKET, CONTEXT_BUCKET = 2 << 20, 1 << 21, 1 << 19
#: Period of the difference cover.
V = 32
#: Stands for a null doc_id, beside a flag that tells it from the id of this value; also where nothing is known yet.
LAST_ID = np.iinfo(np.int64).max
CHUNKS = "chunk long, doc_ids array<long>, sizes array<int>, digests array<binary>, texts binary, rest binary, prints binary, n_prints long"
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def squeeze(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x)


def expand(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending whole numbers as differences, byte plane by byte plane."""
    return squeeze(np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(x: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(x), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place, by doubling."""
    base = [0x9E3779B97F4A7C15]
    one = _BYTE_HASH[data]
    g, have, factor = one, 1, base[0]
    for bit in bin(GRAM)[3:]:
        g = g[: len(g) - have] * np.uint64(factor) + g[have:]
        have, factor = 2 * have, factor * factor & (1 << 64) - 1
        if bit == "1":
            g = g[:-1] * np.uint64(base[0]) + one[have : have + len(g) - 1]
            have, factor = have + 1, factor * base[0] & (1 << 64) - 1
    return mix(g)


def anchors(data: np.ndarray, sizes: np.ndarray, bits: int = 62) -> tuple[np.ndarray, ...]:
    """(place, first window, last window, fingerprint) of each anchor of the texts in data.

    Fingerprints that are equal by chance only make more candidates, so they
    have few bits.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    if len(data) < LENGTH:
        return none
    g = gram_hashes(data)
    low = (g & ~np.uint64((1 << 31) - 1)) | np.arange(len(g), dtype=np.uint64)
    have = 1
    while 2 * have <= SPREAD:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if SPREAD > have:
        low = np.minimum(low[: len(low) - (SPREAD - have)], low[SPREAD - have :])
    starts = np.cumsum(sizes) - sizes
    edge = np.zeros(len(low) + 1, np.int32)
    fit = sizes >= LENGTH
    np.add.at(edge, starts[fit], 1)
    np.add.at(edge, (starts + sizes - LENGTH + 1)[fit], -1)
    window = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    if not len(window):
        return none
    winner = (low[window] & np.uint64((1 << 31) - 1)).astype(np.int64)
    # of two documents with one behind the other, windows never share an anchor: its bytes lie inside the window
    first = np.flatnonzero(np.r_[True, winner[1:] != winner[:-1]])
    last = np.r_[first[1:], len(winner)] - 1
    place = winner[first]
    return place, window[first], window[last], g[place] & np.uint64((1 << bits) - 1)


# -- suffix sorting -------------------------------------------------------


def difference_cover(v: int) -> list[int]:
    """A small set of residues whose differences give every residue, found greedily."""
    cover, missing = [0, 1], set(range(v)) - {0, 1, v - 1}
    while missing:
        gain = lambda x: len(missing & {(s * (x - c)) % v for c in cover for s in (1, -1)})
        best = max((x for x in range(v) if x not in cover), key=gain)
        missing -= {(s * (best - c)) % v for c in cover for s in (1, -1)}
        cover.append(best)
    return sorted(cover)


def words_at(text: np.ndarray, at: np.ndarray, count: int) -> list[np.ndarray]:
    """The count 8-byte words from each place, as big-endian numbers."""
    view = np.lib.stride_tricks.sliding_window_view(text, 8)
    return [np.ascontiguousarray(view[at + 8 * k]).view(">u8").ravel().astype(np.uint64) for k in range(count)]


def dense_ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks by keys, the first counting most; equal keys share a rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


class CoverSample:
    """Ranks of the suffixes that start at places of a difference cover modulo V.

    text must end in V zeros at least and be shorter than 2 ** 31. The ranks
    compare the first ``depth`` bytes at least; places that aren't ``used``
    are padding and share the least rank.
    """

    def __init__(self, text: np.ndarray, depth: int, used: np.ndarray):
        self.cover = difference_cover(V)
        inside = np.zeros(V, bool)
        inside[self.cover] = True
        self.step = np.array([next(d for d in range(V) if inside[(r + d) % V]) for r in range(V)])
        at = np.flatnonzero(np.resize(inside, len(text)) & used)
        self.where = np.full(len(text), -1, np.int32)
        rank = dense_ranks(words_at(text, at, V // 8)) if len(at) else np.zeros(0, np.int64)
        self.where[at] = rank
        reach = V
        while reach < depth and len(at):
            later = self.where[np.minimum(at + reach, len(text) - 1)]
            rank = dense_ranks([rank, later])
            self.where[at] = rank
            reach *= 2

    def after(self, at: np.ndarray) -> np.ndarray:
        """Rank of the first sampled suffix within V bytes behind each place; places must agree modulo V."""
        return self.where[at + self.step[at % V]]


def suffix_classes(text: np.ndarray, starts: np.ndarray, sample: CoverSample) -> tuple[np.ndarray, np.ndarray]:
    """(order, class): one suffix bucket, whose starts agree modulo V, sorted; class counts the runs that share LENGTH bytes."""
    head = words_at(text, starts, V // 8)
    order = np.lexsort([sample.after(starts), *head[::-1]])
    tail = [*head, *words_at(text, starts + V, 2)]
    tail.append(words_at(text, starts + LENGTH - 8, 1)[0])
    new = np.zeros(len(order), bool)
    for k in tail:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.cumsum(new)


class Holders:
    """The least doc_id of each group, and whether the group has one at all; a null comes behind all."""

    def __init__(self, count: int):
        self.least, self.known = np.full(count, LAST_ID, np.int64), np.zeros(count, bool)

    def add(self, group: np.ndarray, least: np.ndarray, known: np.ndarray) -> Holders:
        np.minimum.at(self.least, group, np.where(known, least, LAST_ID))
        self.known[group[known]] = True
        return self

    def take(self, at) -> Holders:
        out = Holders(0)
        out.least, out.known = self.least[at], self.known[at]
        return out

    def before(self, doc: np.ndarray, null: np.ndarray) -> np.ndarray:
        """Whether each group has a smaller doc_id than the one given for it."""
        return (self.known & null) | (~null & (self.least < doc))


def repeated_windows(contexts: list[tuple[bytes, int]], holders: Holders) -> tuple[Holders, np.ndarray]:
    """(who holds each window of each context, first window of each context).

    contexts: distinct (bytes, distance from the first window to the anchor);
    holders: who holds each context.
    """
    sizes = np.array([len(c) for c, _ in contexts])
    windows = sizes - LENGTH + 1
    slot = np.cumsum(windows) - windows
    out = holders.take(np.repeat(np.arange(len(contexts)), windows))
    # a context that alone has the bytes of its anchor shares no window
    grams: dict[bytes, int] = {}
    gram = np.fromiter((grams.setdefault(c[o : o + GRAM], len(grams)) for c, o in contexts), np.int64, len(contexts))
    sort = np.flatnonzero(np.bincount(gram)[gram] > 1)
    if not len(sort):
        return out, slot
    before = np.array([contexts[k][1] for k in sort.tolist()])
    size, base_slot = sizes[sort], slot[sort]
    # every anchor stands at a multiple of V, zeros lie between contexts
    lead = -(-before // V) * V
    room = -(-(lead - before + size + V + 1) // V) * V
    base = np.cumsum(room) - room + lead - before
    text = np.zeros(int(room.sum()) + 2 * V + LENGTH, np.uint8)
    used = np.zeros(len(text), bool)
    flat = np.frombuffer(b"".join(contexts[k][0] for k in sort.tolist()), np.uint8)
    ends = np.cumsum(size)
    place = np.repeat(base - (ends - size), size) + np.arange(len(flat))
    text[place], used[place] = flat, True
    sample = CoverSample(text, LENGTH, used)
    reach = before[:, None] - np.arange(SPREAD)[None, :]  # distance of each window to its anchor
    reach[np.arange(SPREAD)[None, :] >= windows[sort][:, None]] = -1
    for distance in range(int(reach.max()) + 1):
        context, offset = np.nonzero(reach == distance)
        if len(context):
            order, group = suffix_classes(text, base[context] + offset, sample)
            mine, at = holders.take(sort[context[order]]), base_slot[context[order]] + offset[order]
            first = Holders(int(group[-1]) + 1).add(group, mine.least, mine.known).take(group)
            out.least[at], out.known[at] = first.least, first.known
    return out, slot


# -- the operator ---------------------------------------------------------


def _ipc(rows: pa.RecordBatch) -> bytes:
    """The rows in Arrow's stream format, their texts reduced to whether they are null."""
    k = rows.schema.get_field_index("text")
    rows = rows.set_column(k, pa.field("text", pa.bool_()), rows.column(k).is_null())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as to:
        to.write_batch(rows)
    return squeeze(sink.getvalue().to_pybytes())


def _chunks(batches, bits: int):
    from pyspark import TaskContext

    give_back()
    number = TaskContext.get().partitionId() << 32
    for b in batches:
        texts, ids = utf8(b.column("text")), b.column("doc_id").to_pylist()
        for lo, hi in runs([len(x) for x in texts], CHUNK):
            whole = b"".join(texts[lo:hi])
            sizes = np.array([len(x) for x in texts[lo:hi]])
            _, _, _, prints = anchors(np.frombuffer(whole, np.uint8), sizes, bits)
            kinds, count = np.unique(prints, return_counts=True)
            # the lowest bit tells whether the chunk alone holds it more than once
            packed = pack_sorted(kinds << np.uint64(1) | (count > 1).astype(np.uint64))
            values = [[number], [ids[lo:hi]], [sizes.tolist()], [[hashlib.sha256(x).digest() for x in texts[lo:hi]]], [squeeze(whole)], [_ipc(b.slice(lo, hi - lo)) if b.num_columns > 2 else None], [packed], [len(kinds)]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=[x.split()[0] for x in CHUNKS.split(", ")])
            number += 1


def _ids(doc_ids: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, which are null)."""
    return np.array([LAST_ID if i is None else i for i in doc_ids], np.int64), np.array([i is None for i in doc_ids], bool)


def bucket_of(prints: np.ndarray, buckets: int) -> np.ndarray:
    return (prints % np.uint64(buckets)).astype(np.int64)


def shared_prints(chunks: DataFrame, buckets: int) -> DataFrame:
    """(chunk, shared): per chunk the packed fingerprints that other places hold too."""

    def deal(batches):
        for b in batches:
            for chunk, packed in zip(b.column("chunk").to_pylist(), b.column("prints").to_pylist(), strict=True):
                x = unpack_sorted(packed)
                to = bucket_of(x >> np.uint64(1), buckets)
                order = np.argsort(to, kind="stable")
                there, first = np.unique(to[order], return_index=True)
                parts = [pack_sorted(p) for p in np.split(x[order], first[1:])] if len(x) else []
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([chunk] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["bucket", "chunk", "part"])

    def meet(table: pa.Table) -> pa.Table:
        names = table.column("chunk").to_pylist()
        parts = [unpack_sorted(p) for p in table.column("part").to_pylist()]
        every = np.concatenate(parts)
        kinds, inverse, count = np.unique(every >> np.uint64(1), return_inverse=True, return_counts=True)
        many = count > 1
        many[inverse[(every & np.uint64(1)) == 1]] = True
        keep = np.split(many[inverse], np.cumsum([len(p) for p in parts])[:-1])
        rows = [(n, pack_sorted(p[k] >> np.uint64(1))) for n, p, k in zip(names, parts, keep, strict=True) if k.any()]
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "shared": pa.array([r[1] for r in rows], pa.binary())})

    dealt = chunks.select("chunk", "prints").mapInArrow(deal, "bucket int, chunk long, part binary")
    return dealt.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, "chunk long, shared binary")


def copies(chunks: DataFrame) -> DataFrame:
    """(chunk, gone): the rows of each chunk that are copies of a document with a smaller doc_id."""
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("digests", "doc_ids", "sizes")).alias("row", "r")).where(F.col("r.sizes") >= LENGTH)
    each = each.select("chunk", "row", F.col("r.digests").alias("digest"), F.col("r.doc_ids").alias("doc"))
    found = each.groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count_if(F.col("doc").isNull()).alias("nulls"))
    least = cut(found.where("least < most OR (least IS NOT NULL AND nulls > 0)").select("digest", "least"))
    return each.join(least, "digest").where("doc > least OR doc IS NULL").groupBy("chunk").agg(F.collect_list("row").alias("gone"))


CONTEXT = np.dtype([("doc", "<i8"), ("row", "<i4"), ("lo", "<i4"), ("before", "<i2"), ("size", "<i2"), ("null", "?")])
SPAN = np.dtype([("row", "<i4"), ("lo", "<i4"), ("hi", "<i4")])


def contexts(chunks: DataFrame, buckets: int, bits: int) -> DataFrame:
    """(bucket, chunk, part, spans): the surroundings of shared anchors, once per chunk and content; spans that the chunk alone settles."""

    def step(batches):
        for b in batches:
            for r in b.to_pylist():
                whole = expand(r["texts"])
                sizes = np.array(r["sizes"], np.int64)
                place, lo, hi, prints = anchors(np.frombuffer(whole, np.uint8), sizes, bits)
                shared = np.sort(np.concatenate([unpack_sorted(x) for x in r["shared"]]))
                copy = np.zeros(len(sizes), bool)
                copy[r["gone"] or []] = True
                ends = np.cumsum(sizes)
                row = np.searchsorted(ends, place, "right")
                keep = ~copy[row] & (shared[np.minimum(np.searchsorted(shared, prints), len(shared) - 1)] == prints)
                place, lo, hi, prints, row = place[keep], lo[keep], hi[keep], prints[keep], row[keep]
                doc, null = _ids(r["doc_ids"])
                doc, null = doc[row], null[row]
                text = [whole[a:z] for a, z in zip(lo.tolist(), (hi + LENGTH).tolist(), strict=True)]
                before = place - lo
                kinds: dict[tuple, int] = {}
                kind = np.fromiter((kinds.setdefault(k, len(kinds)) for k in zip(text, before.tolist(), strict=True)), np.int64, len(text))
                gone = Holders(len(kinds)).add(kind, doc, ~null).take(kind).before(doc, null)
                start = lo - (ends - sizes)[row]
                spans = np.zeros(int(gone.sum() + copy.sum()), SPAN)
                whole_rows = np.flatnonzero(copy)
                spans["row"], spans["lo"] = np.r_[row[gone], whole_rows], np.r_[start[gone], 0 * whole_rows]
                spans["hi"] = np.r_[(hi - lo + LENGTH + start)[gone], sizes[whole_rows]]
                left = np.flatnonzero(~gone)
                to = bucket_of(prints[left], buckets)
                order = np.argsort(to, kind="stable")
                left, to = left[order], to[order]
                there, first = np.unique(to, return_index=True)
                parts = []
                for at in np.split(left, first[1:]) if len(left) else []:
                    head = np.zeros(len(at), CONTEXT)
                    head["doc"], head["null"], head["row"], head["lo"], head["before"] = doc[at], null[at], row[at], start[at], before[at]
                    head["size"] = hi[at] - lo[at] + LENGTH
                    parts.append(squeeze(len(at).to_bytes(4, "little") + head.tobytes() + b"".join([text[i] for i in at.tolist()])))
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*there.tolist(), r["chunk"] % buckets], pa.int32()), pa.array([r["chunk"]] * (n + 1), pa.int64()), pa.array([*parts, None], pa.binary()), pa.array([None] * n + [spans.tobytes()], pa.binary())],
                    names=["bucket", "chunk", "part", "spans"],
                )

    return chunks.mapInArrow(step, "bucket int, chunk long, part binary, spans binary")


def _settle(table: pa.Table) -> pa.Table:
    """Spans to remove, per chunk, from one bucket of contexts."""
    names, heads, kinds, owner = [], [], {}, []
    out: list[tuple[int, bytes]] = []
    for chunk, part, spans in zip(*(table.column(c).to_pylist() for c in ("chunk", "part", "spans")), strict=True):
        if part is None:
            out.append((chunk, spans))
            continue
        raw = expand(part)
        n = int.from_bytes(raw[:4], "little")
        head = np.frombuffer(raw, CONTEXT, n, 4)
        at = 4 + n * CONTEXT.itemsize
        for size, before in zip(head["size"].tolist(), head["before"].tolist(), strict=True):
            owner.append(kinds.setdefault((raw[at : at + size], before), len(kinds)))
            at += size
        names.append(chunk)
        heads.append(head)
    if heads:
        head, owner = np.concatenate(heads), np.array(owner)
        flat, begin = repeated_windows(list(kinds), Holders(len(kinds)).add(owner, head["doc"], ~head["null"]))
        windows = np.diff(np.append(begin, len(flat.least)))
        # each occurrence's windows that a smaller doc_id has
        n = windows[owner]
        which = np.repeat(np.arange(len(owner)), n)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        gone = flat.take(begin[owner][which] + offset).before(head["doc"][which], head["null"][which])
        which, offset = which[gone], offset[gone]
        new = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(which) else np.zeros(0, np.int64)
        last = np.r_[new[1:], len(which)] - 1 if len(which) else new
        spans = np.zeros(len(new), SPAN)
        spans["row"], spans["lo"] = head["row"][which[new]], head["lo"][which[new]] + offset[new]
        spans["hi"] = head["lo"][which[new]] + offset[last] + LENGTH
        chunk = np.repeat(np.arange(len(heads)), [len(h) for h in heads])[which[new]]
        cuts = np.searchsorted(chunk, np.arange(len(heads) + 1))
        out += [(c, spans[a:z].tobytes()) for c, a, z in zip(names, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if z > a]
    return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "spans": pa.array([x[1] for x in out], pa.binary())})


def removed_runs(spans: np.ndarray) -> np.ndarray:
    """The union of spans of one document as maximal runs (lo, hi)."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(spans["lo"], kind="stable")
    lo, hi = spans["lo"][order].astype(np.int64), np.maximum.accumulate(spans["hi"][order].astype(np.int64))
    new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
    return np.stack([lo[new], np.r_[hi[new[1:] - 1], hi[-1]]], axis=1)


def _cut_out(r: dict) -> list[tuple[int | None, bytes, np.ndarray]]:
    """(doc_id, text, removed runs) of each document of a chunk."""
    whole, at, rows = expand(r["texts"]), 0, []
    found = [np.frombuffer(x, SPAN) for x in r["spans"] or [] if x]
    spans = np.concatenate(found) if found else np.zeros(0, SPAN)
    spans = spans[np.argsort(spans["row"], kind="stable")]
    edge = np.searchsorted(spans["row"], np.arange(len(r["sizes"]) + 1))
    for k, (doc, n) in enumerate(zip(r["doc_ids"], r["sizes"], strict=True)):
        rows.append((doc, whole[at : at + n], removed_runs(spans[edge[k] : edge[k + 1]])))
        at += n
    return rows


def kept_bytes(text: bytes, removed: np.ndarray) -> bytes:
    out, at = [], 0
    for lo, hi in removed.tolist():
        out.append(text[at:lo])
        at = hi
    return b"".join([*out, text[at:]])


def with_spans(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Chunks of docs with the spans to remove from each of their documents; with ``carry`` all columns travel along."""
    few = docs if carry else own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    size = few.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(62, max(24, int(size // 13).bit_length() + 8))  # by chance one fingerprint of 256 is shared
    chunks = stored(few.mapInArrow(lambda batches: _chunks(batches, bits), CHUNKS), "text-chunks", "uncompressed")
    total = chunks.agg(F.coalesce(F.sum("n_prints"), F.lit(0))).first()[0]
    meet, sort = max(8, -(-total // PRINT_BUCKET)), max(8, -(-total // CONTEXT_BUCKET))
    slim = chunks.select("chunk", "doc_ids", "sizes", "texts")
    whole = chunks.select("chunk", "doc_ids", "sizes", "texts", "rest")
    shared = shared_prints(chunks, meet).groupBy("chunk").agg(F.collect_list("shared").alias("shared"))
    near = contexts(slim.join(shared, "chunk").join(copies(chunks), "chunk", "left"), sort, bits)
    spans = near.repartition(sort, "bucket").groupBy("bucket").applyInArrow(_settle, "chunk long, spans binary")
    return whole.join(spans.groupBy("chunk").agg(F.collect_list("spans").alias("spans")), "chunk", "left")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Counts of bytes and removed spans, and the digest of what stays, of each document."""

    def step(batches):
        for b in batches:
            for r in b.to_pylist():
                rows = [(d, len(t), int((x[:, 1] - x[:, 0]).sum()), len(x), hashlib.sha256(kept_bytes(t, x)).hexdigest()) for d, t, x in _cut_out(r)]
                values = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == 4 else pa.int64()) for k, v in enumerate(values)], names=[x.split()[0] for x in OUT.split(", ")])

    return with_spans(docs).mapInArrow(step, OUT)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with all columns, the repeated bytes cut out of text and n_chars, if there, counted anew.

    Bytes of a character that was cut in two are dropped; null texts stay null.
    """
    fields = {f.name: k for k, f in enumerate(docs.schema.fields)}

    def step(batches):
        for b in batches:
            for r in b.to_pylist():
                texts = [kept_bytes(t, x).decode("utf-8", "ignore") for _, t, x in _cut_out(r)]
                rows = pa.ipc.open_stream(expand(r["rest"])).read_all()
                null = rows.column("text").to_pylist()
                texts = [None if n else t for n, t in zip(null, texts, strict=True)]
                rows = rows.set_column(fields["text"], "text", pa.array(texts, pa.string()))
                if "n_chars" in fields:
                    k = fields["n_chars"]
                    rows = rows.set_column(k, "n_chars", pa.array([None if t is None else len(t) for t in texts], rows.column(k).type))
                yield from rows.to_batches()

    return with_spans(docs, carry=True).mapInArrow(step, docs.schema)
