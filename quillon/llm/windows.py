"""Kneser-Ney values of all words of a table, computed by tasks; the models are those of ``toxicity.KneserNey``.

What a place of a word adds to its value goes by its window alone: the symbols
up to it, ORDER at most. The distinct words of all texts, with the labelled
documents of either class and half that have them, make blocks. A block deals
its distinct windows into buckets by the two symbols before the last, so that
a bucket has all that orders of three and more count; orders one and two are
counted once for all. The buckets' results go back to the blocks, which add
them up word by word. No process holds a model or all words' windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import slices, stored, utf8
from quillon.llm.pieces import distinct
from quillon.llm.words import framed, lowered, spans, word_keys

ORDER, DISCOUNT = 10, 0.75
#: Bytes of text whose words are counted at once, words of a block, words a bucket has windows of (were they dealt evenly).
SLICE, BLOCK, SHARE = 4 << 20, 100_000, 20_000
#: Columns of counts: label and half of the documents, at 2 * label + half. A model learns from these halves.
HALVES = ((0, 1), (0,), (1,))
KINDS = [f"n{k}" for k in range(4)]


def counted(docs: DataFrame) -> DataFrame:
    """(word, n0 .. n3) of docs (text, kind): by kind, how many documents have the word; all nought where kind is null."""

    def step(batches):
        for b in (x for whole in batches for x in slices(whole, SLICE)):
            data, starts, ends, words = spans(lowered(utf8(b.column("text"))))
            if len(starts):
                keys, first, number = distinct(word_keys(data, starts, ends))
                kind = b.column("kind").fill_null(-1).to_numpy()
                text = np.repeat(np.arange(b.num_rows), words)
                known = kind[text] >= 0
                pair = np.unique(text[known] << 32 | number[known])
                n = np.bincount((pair & 0xFFFFFFFF) * 4 + kind[pair >> 32], minlength=4 * len(keys)).reshape(-1, 4)
                own = [data[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), *(pa.array(c, pa.int64()) for c in n.T)], names=["word", *KINDS])

    found = docs.mapInArrow(step, "word binary, " + ", ".join(f"{k} long" for k in KINDS))
    return found.groupBy("word").agg(*[F.sum(k).alias(k) for k in KINDS])


def blocks(words: DataFrame) -> DataFrame:
    """Rows of ``counted`` in blocks: (home, words joined by line ends, their counts)."""

    def step(batches):
        home = TaskContext.get().partitionId() << 32
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK):
                b = whole.slice(a, BLOCK)
                n = np.stack([b.column(k).to_numpy() for k in KINDS], axis=1)
                own = b"\n".join(b.column("word").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([home], pa.int64()), pa.array([own], pa.binary()), pa.array([n.astype("<i8").tobytes()], pa.binary())], names=["home", "words", "counts"])
                home += 1

    return words.mapInArrow(step, "home long, words binary, counts binary")


def unpacked(words: bytes, counts: bytes) -> tuple[list[bytes], np.ndarray]:
    return words.split(b"\n"), np.frombuffer(counts, "<i8").reshape(-1, 4)


def symbols(words: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the last eight symbols, the two before them, word) of each place's window, of which ``most`` symbols are looked at; 0 before a word."""
    raw, place, starts = framed(words)
    at = np.flatnonzero(place >= 1)
    low, high = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint16)
    for j in range(most):
        symbol = np.where(place[at] >= j, raw[np.maximum(at - j, 0)], 0)
        if j < 8:
            low |= symbol.astype(np.uint64) << np.uint64(8 * j)
        else:
            high |= symbol.astype(np.uint16) << np.uint16(8 * (j - 8))
    return low, high, np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(raw))) - 1)


def united(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows, and which of them each is."""
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return low[order][new], high[order][new], which


class Dealt:
    """A block's distinct windows by bucket, those of words learned from first."""

    def __init__(self, words: list[bytes], counts: np.ndarray, buckets: int):
        low, high, self.word = symbols(words, ORDER)
        low, high, which = united(low, high)
        n = np.stack([np.bincount(which, c[self.word], len(low)) for c in counts.T.astype(float)], axis=1)
        pair = (low >> np.uint64(8)) & np.uint64(0xFFFF)
        bucket = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)
        learned = n.any(axis=1)
        order = np.lexsort((~learned, bucket))
        self.low, self.high, self.counts = low[order], high[order], n[order].astype("<i8")
        self.edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        self.known = np.add.reduceat(np.append(learned[order], False), self.edges[:-1], dtype=np.int64) * (np.diff(self.edges) > 0)
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        self.which = where[which]


def low_orders(found: list[tuple[int, int]]) -> list[np.ndarray]:
    """By model the probability after two orders, at [symbol before the last, last]; from three-symbol ends with the halves that have them."""
    out = []
    for halves in HALVES:
        ends = np.array([g for g, bits in found if any(bits >> h & 1 for h in halves)], np.int64)
        one = np.bincount(np.unique(ends & 0xFFFF) & 0xFF, minlength=256)
        p = np.maximum(one - DISCOUNT, 0) / max(1, one.sum()) + (DISCOUNT * (one > 0).sum() / one.sum() if one.sum() else 1) / 256
        two = np.bincount(ends & 0xFFFF, minlength=1 << 16).reshape(256, 256)
        total, kinds = two.sum(1)[:, None], (two > 0).sum(1)[:, None]
        out.append(np.where(total > 0, (np.maximum(two - DISCOUNT, 0) + DISCOUNT * kinds * p) / np.maximum(total, 1), p))
    return out


def solved(low: np.ndarray, high: np.ndarray, counts: np.ndarray, lowest: list[np.ndarray]) -> list[np.ndarray]:
    """By model the toxic less ordinary log-likelihood that each distinct window of a bucket adds; of the halves, where a window was learned from."""
    at = [((low >> np.uint64(8 * j) if j < 8 else high >> np.uint16(8 * (j - 8))).astype(np.int64)) & 0xFF for j in range(ORDER)]
    size = sum((s > 0).astype(np.int8) for s in at)
    context = [None, at[1]]
    for j in range(2, ORDER):
        context.append(np.unique(context[-1] << 8 | at[j], return_inverse=True)[1])
    last, out = at[0], []
    learned = np.flatnonzero(counts.any(axis=1))
    for halves, start in zip(HALVES, lowest, strict=True):
        asked = np.arange(len(low)) if len(halves) > 1 else learned
        ordinary, toxic = (counts[:, [2 * v + h for h in halves]].sum(1).astype(float) for v in (0, 1))
        present = learned[(ordinary + toxic)[learned] > 0]
        p = start[at[1][asked], last[asked]]
        for n in range(3, ORDER):  # grams of n symbols: in how many kinds of longer ones they stand
            of = present[size[present] >= n]
            of = of[np.unique(context[n][of] << 8 | last[of], return_index=True)[1]]
            gram, count = np.unique(context[n - 1][of] << 8 | last[of], return_counts=True)
            room = int(context[n - 1].max(initial=0)) + 1
            total, kinds = np.bincount(gram >> 8, count, room), np.bincount(gram >> 8, minlength=room)
            some = np.flatnonzero((size[asked] >= n) & (total[context[n - 1][asked]] > 0))
            c = context[n - 1][asked[some]]
            key = c << 8 | last[asked[some]]
            place = np.minimum(np.searchsorted(gram, key), len(gram) - 1)
            here = np.where(gram[place] == key, count[place], 0) if len(some) else 0
            p[some] = (np.maximum(here - DISCOUNT, 0) + DISCOUNT * kinds[c] * p[some]) / total[c]
        c, sides = context[ORDER - 1], []
        for n in (ordinary, toxic):
            room = int(c.max(initial=0)) + 1
            total, kinds = np.bincount(c, n, room)[c[asked]], np.bincount(c[n > 0], minlength=room)[c[asked]]
            sides.append(np.log(np.where(total > 0, (np.maximum(n[asked] - DISCOUNT, 0) + DISCOUNT * kinds * p) / np.maximum(total, 1), p)))
        value = np.zeros(len(low), np.float32)
        value[asked] = sides[1] - sides[0]
        out.append(value)
    return out


def word_values(docs: DataFrame) -> DataFrame:
    """Of each word of docs (text, kind), stored: key (its 64-bit hash), all, h0, h1 (its value by model; the halves' for words learned from), learned."""
    table = stored(blocks(counted(docs)), "toxicity-words")

    def short_ends(batches):
        for words, counts in (r for b in batches for r in zip(b.column("words").to_pylist(), b.column("counts").to_pylist(), strict=True)):
            own, n = unpacked(words, counts)
            low, _, word = symbols(own, 3)
            bits = ((n[:, 0] + n[:, 2] > 0) + 2 * (n[:, 1] + n[:, 3] > 0))[word]
            pair = np.unique(low[bits > 0].astype(np.int64) << 2 | bits[bits > 0])
            yield pa.RecordBatch.from_arrays([pa.array(pair >> 2, pa.int64()), pa.array((pair & 3).astype(np.int32))], names=["g", "bits"])

    ends = table.mapInArrow(short_ends, "g long, bits int").groupBy("g").agg(F.bit_or("bits").alias("bits"))
    lowest = docs.sparkSession.sparkContext.broadcast(low_orders([(r.g, r.bits) for r in ends.collect()]))
    words = table.agg(F.sum(F.length("counts") / 32)).first()[0] or 0
    buckets = max(16, int(words) // SHARE)

    def deal(batches):
        for b in batches:
            for home, words, counts in zip(*(b.column(k).to_pylist() for k in ("home", "words", "counts")), strict=True):
                d = Dealt(*unpacked(words, counts), buckets)
                some = np.flatnonzero(np.diff(d.edges))
                packed = [d.low[a:z].tobytes() + d.high[a:z].tobytes() + d.counts[a : a + m].tobytes() for a, z, m in ((d.edges[k], d.edges[k + 1], d.known[k]) for k in some)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array([home] * len(some), pa.int64()), pa.array(np.diff(d.edges)[some].astype(np.int32)), pa.array(packed, pa.binary())], names=["bucket", "home", "n", "windows"]
                )

    def solve(batches):
        homes, places, sizes, packed = [], [], [], []
        for b in batches:
            for kept, name in ((homes, "home"), (places, "bucket"), (sizes, "n"), (packed, "windows")):
                kept += b.column(name).to_pylist()
        if not homes:
            return
        low = np.concatenate([np.frombuffer(x, "<u8", n) for x, n in zip(packed, sizes, strict=True)])
        high = np.concatenate([np.frombuffer(x, "<u2", n, 8 * n) for x, n in zip(packed, sizes, strict=True)])
        counts, known, at = np.zeros((len(low), 4), np.int64), [], 0
        for x, n in zip(packed, sizes, strict=True):
            c = np.frombuffer(x, "<i8", -1, 10 * n).reshape(-1, 4) if len(x) > 10 * n else counts[:0]
            counts[at : at + len(c)] = c
            known.append(len(c))
            at += n
        low, high, which = united(low, high)
        counts = np.stack([np.bincount(which, c, len(low)) for c in counts.T.astype(float)], axis=1)
        value, at = solved(low, high, counts, lowest.value), 0
        for home, place, n, m in zip(homes, places, sizes, known, strict=True):
            own = which[at : at + n]
            x = value[0][own].tobytes() + value[1][own[:m]].tobytes() + value[2][own[:m]].tobytes()
            at += n
            yield pa.RecordBatch.from_arrays([pa.array([home], pa.int64()), pa.array([place], pa.int32()), pa.array([x], pa.binary()), pa.array([None], pa.binary())], names=["home", "bucket", "words", "counts"])

    def finished(d: Dealt, words: bytes, n: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        data = words + b"\n"
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        sums = [np.bincount(d.word, v[d.which], len(ends)).astype(np.float32) for v in values]
        key = word_keys(data, np.append(0, ends[:-1] + 1), ends).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, sums), pa.array(n.any(axis=1))], names=["key", "all", "h0", "h1", "learned"])

    def add_up(batches):
        held = None
        for bucket, x, counts in (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in ("bucket", "words", "counts")), strict=True)):
            if bucket < 0:
                if held:
                    yield finished(*held)
                own, n = unpacked(x, counts)
                d = Dealt(own, n, buckets)
                held = d, x, n, np.zeros((3, len(d.low)), np.float32)
                continue
            d, values = held[0], held[3]
            a, z, m = d.edges[bucket], d.edges[bucket + 1], d.known[bucket]
            x = np.frombuffer(x, "<f4")
            values[0][a:z], values[1][a : a + m], values[2][a : a + m] = x[: z - a], x[z - a : z - a + m], x[z - a + m :]
        if held:
            yield finished(*held)

    dealt = table.mapInArrow(deal, "bucket int, home long, n int, windows binary").repartition(buckets, "bucket")
    back = dealt.mapInArrow(solve, "home long, bucket int, words binary, counts binary")
    whole = table.select("home", F.lit(-1).alias("bucket"), "words", "counts").union(back)
    whole = whole.repartition(max(16, int(words) // BLOCK), "home").sortWithinPartitions("home", "bucket")
    return stored(whole.mapInArrow(add_up, "key long, all float, h0 float, h1 float, learned boolean"), "toxicity-values")
