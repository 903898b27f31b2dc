"""Token files: a wavelet matrix per shard.

Ids are kept as succinct bit-planes, highest bit first. A plane is packed to
bits; the counts of ones before each block are made when it is loaded, and
with them ``rank`` takes one table look-up and one popcount, and ``select`` a
binary search over places.
Access to a token, counting an id in a range and finding its k-th occurrence
go through the planes of one compressed file.

Shards are written by Spark's Parquet writer to the shared folder, one row per
shard with the planes, and the documents' lengths beside them; a lost executor
only repeats its shard. Documents are dealt by ranges of doc_id, so shards
follow each other in ascending order; rows with equal doc_id follow each other
by text.

Defined cases: null text counts as empty and still gets the end id; null
doc_id sorts first; repeated rows each have their place; an empty table gives
no shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import cut, own_columns, slices, stored, utf8
from quillon.llm.pieces import encode_texts

END_ID = 2
BLOCK = 512  # bits to a rank block
#: Text bytes encoded at once, and tokens to one wavelet matrix.
SLICE, SHARD_TOKENS = 4 << 20, 1 << 19
#: Share of a matrix's header; the format's fixed values.
MAGIC = b"WMX1"
OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"


class BitPlane:
    """Bits with constant-time rank and logarithmic select."""

    def __init__(self, packed: np.ndarray, size: int):
        self.size = size
        self.words = packed
        ones = np.bitwise_count(packed).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits)
        return np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)])

    def get(self, i):
        return (self.words[i >> 3] >> (7 - (i & 7)).astype(np.uint8)) & 1

    def rank1(self, i: int) -> int:
        """Ones before place i."""
        block, byte = i // BLOCK, i >> 3
        n = int(self.before[block]) + int(np.bitwise_count(self.words[block * (BLOCK // 8) : byte]).sum())
        return n + (int(self.words[byte] >> (8 - (i & 7))).bit_count() if i & 7 else 0)

    def rank(self, bit: int, i: int) -> int:
        return self.rank1(i) if bit else i - self.rank1(i)

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit; -1 if there is none."""
        lo, hi = 0, self.size
        if k < 0 or k >= self.rank(bit, self.size):
            return -1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.rank(bit, mid) <= k else (lo, mid)
        return lo


class WaveletMatrix:
    """A sequence of ids as bit-planes."""

    def __init__(self, size: int, zeros: list[int], planes: list[np.ndarray]):
        self.size, self.zeros, self.packed = size, zeros, planes
        self._planes: list[BitPlane] | None = None

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        zeros, planes, now = [], [], ids
        for level in range(bits - 1, -1, -1):
            bit = now & ids.dtype.type(1 << level) != 0
            planes.append(BitPlane.pack(bit))
            zeros.append(len(now) - int(np.count_nonzero(bit)))
            new = np.empty_like(now)
            np.compress(bit, now, out=new[zeros[-1] :])
            np.compress(np.logical_not(bit, out=bit), now, out=new[: zeros[-1]])
            now = new
        return cls(len(ids), zeros, planes)

    def to_bytes(self) -> bytes:
        head = np.array([self.size, len(self.packed), *self.zeros], "<i8").tobytes()
        return MAGIC + zstandard.ZstdCompressor(level=1).compress(head + b"".join(p.tobytes() for p in self.packed))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        raw = zstandard.ZstdDecompressor().decompress(data[4:])
        size, bits = np.frombuffer(raw, "<i8", 2)
        zeros = np.frombuffer(raw, "<i8", bits, 16).tolist()
        flat = np.frombuffer(raw, np.uint8, offset=16 + 8 * bits)
        return cls(int(size), zeros, list(flat.reshape(bits, -1)) if size else [flat] * int(bits))

    @property
    def planes(self) -> list[BitPlane]:
        if self._planes is None:
            self._planes = [BitPlane(p, self.size) for p in self.packed]
        return self._planes

    def decode(self) -> np.ndarray:
        """All ids: the planes undone from the lowest bit upwards."""
        ids = np.zeros(self.size, np.uint32 if len(self.packed) > 16 else np.uint16)
        for k, (zeros, packed) in enumerate(zip(self.zeros[::-1], self.packed[::-1], strict=True)):
            bit = np.unpackbits(packed, count=self.size).view(bool)
            up = np.empty_like(ids)
            up[~bit] = ids[:zeros]
            up[bit] = ids[zeros:] | ids.dtype.type(1 << k)
            ids = up
        return ids

    def access(self, i: int) -> int:
        out = 0
        for zeros, p in zip(self.zeros, self.planes, strict=True):
            bit = int(p.get(np.int64(i)))
            out, i = out << 1 | bit, (zeros if bit else 0) + p.rank(bit, i)
        return out

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for k, (zeros, p) in enumerate(zip(self.zeros, self.planes, strict=True)):
            bit = value >> (len(self.zeros) - 1 - k) & 1
            lo, hi = ((zeros if bit else 0) + p.rank(bit, x) for x in (lo, hi))
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of value in places lo to hi."""
        if value >> len(self.zeros):
            return 0
        a, b = self._range(value, lo, self.size if hi is None else hi)
        return b - a

    def occurrence(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of value; -1 if there is none."""
        if value >> len(self.zeros):
            return -1
        a, b = self._range(value, 0, self.size)
        if not 0 <= k < b - a:
            return -1
        at = a + k
        for j in range(len(self.zeros) - 1, -1, -1):
            bit = value >> (len(self.zeros) - 1 - j) & 1
            at = self.planes[j].select(bit, at - (self.zeros[j] if bit else 0))
        return at


SHARD = "partition int, part int, n_docs long, n_tokens long, doc_ids array<long>, sizes array<int>, matrix binary"


def write_shards(docs: DataFrame, vocabulary: str, kind: str, bits: int, end_id: int, shards: int | None = None) -> DataFrame:
    """The shard table, written to the shared folder and read again."""

    def step(batches):
        from pyspark import TaskContext

        partition, part = TaskContext.get().partitionId(), 0
        keys: list = []
        sizes: list[int] = []
        ids: list[np.ndarray] = []
        held = 0

        def row():
            w = WaveletMatrix.build(np.concatenate(ids), bits)
            values = [[partition], [part], [len(keys)], [w.size], [keys], [sizes], [w.to_bytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=[x.split()[0] for x in SHARD.split(", ")])

        small = np.uint16 if bits <= 16 else np.uint32
        for b in (x for whole in batches for x in slices(whole, SLICE)):
            flat, counts = encode_texts(utf8(b.column("text")), vocabulary, kind)
            flat = np.insert(flat, np.cumsum(counts), end_id).astype(small)
            keys += b.column("doc_id").to_pylist()
            sizes += (counts + 1).tolist()
            ids.append(flat)
            held += len(flat)
            if held >= SHARD_TOKENS:
                yield row()
                keys, sizes, ids, held, part = [], [], [], 0, part + 1
        if keys:
            yield row()

    few = own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    dealt = few.repartitionByRange(shards, "doc_id") if shards else few.repartitionByRange("doc_id")
    return stored(dealt.sortWithinPartitions("doc_id", "text").mapInArrow(step, SHARD), "token-files", "uncompressed")


def read_shards(table: DataFrame) -> DataFrame:
    """Per document of the shard table: place, length and digest of its ids, read back."""
    before = Window.unboundedPreceding, -1
    sums = table.groupBy("partition").agg(F.sum("n_tokens").alias("n"))  # a row per partition, so one window may order them all
    totals = cut(sums.select("partition", F.coalesce(F.sum("n").over(Window.orderBy("partition").rowsBetween(*before)), F.lit(0)).alias("base")))
    inner = F.sum("n_tokens").over(Window.partitionBy("partition").orderBy("part").rowsBetween(*before))
    parts = table.select("partition", "part", F.coalesce(inner, F.lit(0)).alias("inner"))
    starts = cut(parts.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "partition").select("partition", "part", (F.col("base") + F.col("inner")).alias("first")))

    def step(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = WaveletMatrix.from_bytes(r["matrix"]).decode().astype("<u4")
                sizes = np.array(r["sizes"], np.int64)
                ends = np.cumsum(sizes)
                raw = ids.data.cast("B") if len(ids) else b""
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(ends - sizes + r["first"]), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    few = table.select("partition", "part", "doc_ids", "sizes", "matrix")
    joined = few.join(F.broadcast(starts) if starts.count() <= 100_000 else starts, ["partition", "part"])
    return joined.mapInArrow(step, OUT)


def token_files(docs: DataFrame, vocabulary: str, kind: str = "byte", bits: int = 16, end_id: int = END_ID) -> DataFrame:
    """Write each text's ids with the end id as wavelet matrices and read them back."""
    return read_shards(write_shards(docs, vocabulary, kind, bits, end_id))
