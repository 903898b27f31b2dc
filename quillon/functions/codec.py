"""Byte codecs of postings, on whole arrays: variable-length integers, zigzag, gaps, bit packing, checked blocks."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids to a block of postings, by their value, so that no term's block grows with the corpus.
BLOCK_IDS = 1 << 12
#: Parts into which the terms of a range of ids are dealt; a task encodes a part at once.
PARTS = 8
#: Rows to a batch that goes back to Spark.
BATCH_ROWS = 1 << 16


class CorruptBlock(ValueError):
    """Bytes that are not a whole block."""


def vint_encode(values: np.ndarray) -> bytes:
    """Unsigned integers in groups of seven bits, lowest first; the top bit says that another byte follows."""
    return vint_bytes(values)[0].tobytes()


def vint_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all integers, and where each begins and the last ends."""
    v = np.asarray(values, np.uint64)
    size, more = np.ones(len(v), np.int64), []
    at = np.flatnonzero(v > np.uint64(127))
    while len(at):  # of the values that go on, ever fewer
        size[at] += 1
        more.append(at)
        at = at[v[at] >> np.uint64(7 * len(more)) > np.uint64(127)]
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[first] = v & np.uint64(127)
    for k, at in enumerate(more, 1):
        out[first[at] + k - 1] |= 128
        out[first[at] + k] = v[at] >> np.uint64(7 * k) & np.uint64(127)
    return out, np.append(first, len(out))


def vint_values(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The integers whose last bytes are at ``ends``, of ten bytes each at most: what lies beyond doesn't count."""
    first = np.append(0, ends[:-1] + 1)
    out = (raw[first] & 127).astype(np.uint64)
    at, k = np.flatnonzero(ends > first), 1
    while len(at) and k < 10:
        out[at] |= (raw[first[at] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
        k += 1
        at = at[ends[at] - first[at] >= k]
    return out


def vint_decode(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    if raw[-1] & 128:
        raise CorruptBlock("the last integer is cut off")
    ends = np.flatnonzero(raw < 128)
    if np.diff(ends, prepend=-1).max() > 10:
        raise CorruptBlock("an integer of more than 64 bits")
    return vint_values(raw, ends)


def zigzag(values: np.ndarray) -> np.ndarray:
    """Signed to unsigned: small magnitudes stay small."""
    v = np.asarray(values, np.int64)
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def unzigzag(values: np.ndarray) -> np.ndarray:
    u = np.asarray(values, np.uint64)
    return (u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64)


def bit_pack(values: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` bits of each value, highest bit first, without padding between values."""
    v = np.asarray(values, np.uint64)
    if bits < 64 and len(v) and int(v.max()) >> bits:
        raise ValueError(f"a value needs more than {bits} bits")
    planes = v[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8)).tobytes()


def bit_unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=bits * count).reshape(count, bits).astype(np.uint64)
    return (flat << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def encode_block(ids: np.ndarray, freqs: np.ndarray) -> bytes:
    """Ascending ids as gaps (the first from 0, all zigzag) and frequencies, behind a checksum."""
    body = vint_encode(np.concatenate([zigzag(np.diff(ids, prepend=0)), np.asarray(freqs, np.uint64)]))
    return zlib.crc32(body).to_bytes(4, "little") + body


def decode_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(data) < 4 or zlib.crc32(data[4:]) != int.from_bytes(data[:4], "little"):
        raise CorruptBlock("the checksum differs")
    numbers = vint_decode(data[4:])
    ids, freqs = np.split(numbers, [len(numbers) // 2])
    return np.cumsum(unzigzag(ids)), freqs.astype(np.int64)


def encode_blocks(ids: np.ndarray, freqs: np.ndarray, first: np.ndarray) -> list[bytes]:
    """``encode_block`` of each run of ids; first: where each begins, and the end of the last."""
    n = np.diff(first)
    start, size = np.repeat(first[:-1], n), np.repeat(n, n)
    gaps = np.diff(ids, prepend=0)
    gaps[first[:-1]] = ids[first[:-1]]
    at = np.arange(len(ids)) + start
    values = np.empty(2 * len(ids), np.uint64)
    values[at], values[at + size] = zigzag(gaps), np.asarray(freqs, np.uint64)
    data, begin = vint_bytes(values)
    data, edges = data.tobytes(), begin[2 * first].tolist()
    bodies = [data[a:z] for a, z in zip(edges, edges[1:], strict=False)]
    return [zlib.crc32(body).to_bytes(4, "little") + body for body in bodies]


def decode_blocks(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and frequencies of blocks, one behind the other, and the entries of each."""
    if any(len(x) < 4 or zlib.crc32(memoryview(x)[4:]) != int.from_bytes(x[:4], "little") for x in blocks):
        raise CorruptBlock("the checksum differs")
    bodies = [x[4:] for x in blocks]
    if any(body and body[-1] & 128 for body in bodies):
        raise CorruptBlock("the last integer is cut off")
    data = b"".join(bodies)
    numbers = vint_decode(data)
    ends = np.cumsum([0, *map(len, bodies)])
    counts = np.diff(np.append(0, np.cumsum(np.frombuffer(data, np.uint8) < 128))[ends])
    if (counts % 2).any():
        raise CorruptBlock("an id has no frequency")
    n = counts // 2
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(first, n)
    total = np.cumsum(unzigzag(numbers[at]))
    before = np.append(0, total)[first]
    return total - np.repeat(before, n), numbers[at + np.repeat(n, n)].astype(np.int64), n


def encode_postings(postings: DataFrame) -> DataFrame:
    """(field, term, block, entries, data): the postings in blocks of at most BLOCK_IDS ids."""
    names = ["field", "term", "block", "entries", "data"]

    def step(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, freqs = (table.column(c).to_numpy() for c in ("doc_id", "freq"))
        field, term = (table.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("field", "term"))
        word = field.indices.to_numpy().astype(np.int64) * len(term.dictionary) + term.indices.to_numpy()
        order = np.lexsort((freqs, ids, word))
        word = word[order]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        data = encode_blocks(ids[order], freqs[order], np.append(first, len(word)))
        of, what = np.divmod(word[first], len(term.dictionary))
        blocks = np.full(len(first), ids[0] // BLOCK_IDS)
        return pa.table([field.dictionary.take(pa.array(of)), term.dictionary.take(pa.array(what)), pa.array(blocks), pa.array(np.diff(np.append(first, len(word)))), pa.array(data, pa.binary())], names=names)

    part = F.floor(F.col("doc_id") / BLOCK_IDS) * PARTS + F.pmod(F.xxhash64("field", "term"), F.lit(PARTS))
    rows = postings.select(part.cast("long").alias("part"), "field", "term", "doc_id", "freq")
    return rows.groupBy("part").applyInArrow(step, "field string, term string, block long, entries long, data binary")


def decode_postings(blocks: DataFrame) -> DataFrame:
    """(field, term, doc_id, freq) of encoded blocks."""

    def step(batches):
        for b in batches:
            ids, freqs, n = decode_blocks(b.column("data").to_pylist())
            at = np.repeat(np.arange(len(n)), n)
            for k in range(0, len(at), BATCH_ROWS):
                some, here = pa.array(at[k : k + BATCH_ROWS]), slice(k, k + BATCH_ROWS)
                yield pa.RecordBatch.from_arrays([b.column("field").take(some), b.column("term").take(some), pa.array(ids[here]), pa.array(freqs[here])], names=["field", "term", "doc_id", "freq"])

    return blocks.select("field", "term", "data").mapInArrow(step, "field string, term string, doc_id long, freq long")
