"""Best-fit packing by sums of squares.

Pieces of documents are placed, longest first, where the sum over residual
gaps of the squared number of open bins becomes smallest; among equal choices
the tightest gap wins. The pieces are dealt evenly to groups of a bounded
number of tokens and rows, each packed by one task; bins that a group leaves
underfull are broken up and packed again together, so only the last bins of a
few groups stay unfilled.

Defined cases: null or empty text is one piece with the end id; texts beyond
the capacity are cut into full pieces and a rest; repeated rows are packed
each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, give_back, own_columns, slices, utf8
from quillon.llm.pieces import encode_texts

CAPACITY, END_ID = 4096, 1
#: Text bytes encoded at once.
SLICE = 1 << 20
#: Most tokens and pieces that one task packs.
GROUP_TOKENS, GROUP_PIECES = 8 << 20, 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
OUT = PIECES + ", sequence_id long, offset long"


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, bins numbered from 0."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by residual gap
    count = np.zeros(capacity + 1, np.int64)
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        # gap g turns into g - n: the sum changes by 2 * (count[g - n] - count[g] + 1); a bin that gets full leaves it
        change = 2 * (count[: capacity + 1 - n] - count[n:] + 1)
        change[0] = 1 - 2 * count[n]
        fits = count[n:] > 0
        if fits.any():
            change = np.where(fits, change, np.iinfo(np.int64).max)
            rest = int(change.argmin())
            bins[i] = open_bins[rest + n].pop()
            offsets[i] = capacity - rest - n
            count[rest + n] -= 1
        else:
            rest = capacity - n
            bins[i], used = used, used + 1
        if rest:
            open_bins[rest].append(int(bins[i]))
            count[rest] += 1
    return bins, offsets


def piece_table(docs: DataFrame, vocabulary: str, kind: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of each document with digests of their ids, without a shuffle."""

    def step(batches):
        give_back(drop=False)
        for part in (x for b in batches for x in slices(b, SLICE)):
            flat, counts = encode_texts(utf8(part.column("text")), vocabulary, kind)
            flat = np.insert(flat, np.cumsum(counts), end_id).astype("<u4")
            raw, at = flat.data.cast("B"), 0
            rows = []
            for name, n in zip(part.column("doc_id").to_pylist(), (counts + 1).tolist(), strict=True):
                for k, s in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - s)
                    rows.append((name, k, s, size, zlib.crc32(raw[4 * (at + s) : 4 * (at + s + size)])))
                at += n
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(step, PIECES)


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (any columns with ``length``, checkpointed) with sequence_id and offset."""
    total, rows = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-total // GROUP_TOKENS), -(-rows // GROUP_PIECES))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long, filled boolean"

    def packer(round_no: int, last: bool):
        def step(frames):
            from pyspark import TaskContext

            got = list(frames)
            if not got:
                return
            frame = pd.concat(got, ignore_index=True)
            bins, offsets = sum_of_squares(frame["length"].to_numpy(np.int64), capacity)
            fill = np.bincount(bins, weights=frame["length"].to_numpy(np.float64)) if len(bins) else np.zeros(0)
            base = (round_no << 60) | (TaskContext.get().partitionId() << 32)
            frame["sequence_id"], frame["offset"] = base + bins, offsets
            frame["filled"] = True if last else (fill >= capacity * 0.99)[bins] if len(bins) else True
            yield frame

        return step

    first = cut(pieces.repartition(groups).mapInPandas(packer(0, groups == 1), schema))
    if groups == 1:
        return first.drop("filled")
    again = first.where(~F.col("filled")).select(*pieces.columns)
    left, rest = again.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-left // GROUP_TOKENS), -(-rest // GROUP_PIECES))
    second = again.repartition(groups).mapInPandas(packer(1, True), schema)
    return first.where("filled").unionByName(second).drop("filled")


def pack_documents(docs: DataFrame, vocabulary: str, kind: str = "word", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents and their places in sequences of ``capacity`` tokens."""
    return pack_pieces(cut(piece_table(docs, vocabulary, kind, capacity, end_id)), capacity)
