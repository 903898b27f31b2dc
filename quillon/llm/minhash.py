"""Near-duplicates by DartMinHash.

The elements of a document are its five-word shingles, weighted by how often
they occur. Darts fall on the plane of weight and rank of each element, region
by region of doubling weight, from hashes of element and region alone; the
darts below a document's weights and its rank bound hit, each in one of the
signature's coordinates, and the earliest of a coordinate is kept. Two
documents agree in a coordinate with the probability of their weighted Jaccard
similarity.

Bands of coordinates name buckets. In each bucket every member is compared
with the least one; links that pass the exact similarity join components, and
in buckets that still hold several components all pairs across components are
compared inside a task, screened by one-bit signatures. A large bucket is dealt
by size, as similar texts have similar numbers of shingles, and within a size
block by block. So pairs within a component that is already joined are never
compared, and no pair becomes a row.

What can be missed, by chance: a pair at exactly the similarity of 0.8 shares no
band once in 190,000 pairs, and one that no chain of other links joins fails
the one-bit screen once in 170,000; higher similarities miss less. Shingles are
compared by 32 bits of their hashes, so of two texts with a thousand different
shingles each, some pair of shingles is taken for equal once in 4,000 pairs of texts.

Texts, not ids, are compared: all rows with the same words are one node.
Defined cases: words are runs of letters and digits in lower case; texts with
the same words are one class; a text of one to four words is one shingle; texts
without a word are one class if they are the same text, null counting as
empty; rows that repeat a doc_id share its class, with different texts too; a
class is named by its least doc_id, or where it has none by a negative number
made of its text; an empty table gives an empty result; other columns are not
looked at. A text is held whole by the task that reads it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillon.llm.common import cut, give_back, own_columns, runs, stored, utf8
from quillon.llm.components import components
from quillon.llm.words import lowered, spans, word_keys

SHINGLE, SIMILARITY = 5, 0.8
#: 40 bands of 6: at similarity 0.8 one pair in 190,000 shares no band.
BANDS, ROWS = 40, 6
COORDINATES = BANDS * ROWS
#: Mean darts below the rank bound; any coordinate stays empty in 5 % of documents, which throw more.
DARTS = COORDINATES * (np.log(COORDINATES) + 3)
#: Least equal bits of 128 for a pair across components: at similarity 0.8 the mean is 115, the deviation 3.4.
SKETCH_BITS = 100
SLICE = 1 << 20
#: Members of a bucket, and bytes of their shingles, that are compared in one task with as many others.
BLOCK, BLOCK_BYTES = 1024, 8 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each shingle, its text, two hashes of each text's words)."""
    data, starts, ends, words = spans(lowered(texts))
    prints = np.zeros((len(texts), 2), np.uint64)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), prints
    w = mix(word_keys(data, starts, ends))
    last = np.cumsum(words)
    first = last - words
    text = np.repeat(np.arange(len(texts)), words)
    place = (np.arange(len(w)) - first[text]).astype(np.uint64)
    full = np.flatnonzero(words)
    for k, salt in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
        prints[full, k] = np.add.reduceat(mix(w + mix(place * np.uint64(2) + np.uint64(salt))), first[full])
    n = len(w)
    odd = [np.uint64(2 * 0x632BE59BD9B4E019 * (k + 1) + 1 & (1 << 64) - 1) for k in range(SHINGLE)]
    h = np.zeros(n, np.uint64)
    reach = np.minimum(np.repeat(last, words) - np.arange(n), SHINGLE)  # words from here in the text
    for k in range(min(SHINGLE, n)):
        h[: n - k] += np.where(reach[: n - k] > k, w[k:] * odd[k], np.uint64(0))
    keep = (reach == SHINGLE) | ((np.repeat(words, words) < SHINGLE) & (place == 0))
    return mix(h[keep]), text[keep], prints


def signatures(element: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
    """DartMinHash values, an array (count, COORDINATES); texts without elements keep the largest value."""
    none = np.iinfo(np.uint64).max
    table = np.full((count, COORDINATES), none, np.uint64)
    if not len(element):
        return table
    order = np.lexsort((element, text))
    element, text = element[order], text[order]
    new = np.flatnonzero(np.r_[True, (element[1:] != element[:-1]) | (text[1:] != text[:-1])])
    weight = np.diff(np.append(new, len(element)))
    element, text = element[new], text[new]
    total = np.bincount(text, weight, count)
    todo, bound = np.flatnonzero(total), np.zeros(count)
    bound[todo] = 1 / total[todo]
    flat = table.reshape(-1)
    chosen = np.ones(len(element), bool)
    while len(todo):
        e, d, w = element[chosen], text[chosen], weight[chosen]
        region = 0
        while len(e):
            low, width = (0, 1) if region == 0 else (1 << (region - 1), 1 << (region - 1))
            reach = w > low
            e, d, w = e[reach], d[reach], w[reach]
            _throw(flat, e, d, w, region, low, width, bound)
            region += 1
        todo = todo[(table[todo] == none).any(axis=1)]
        bound[todo] *= 2
        chosen = np.isin(text, todo)
        table[todo] = none
    return table


def _throw(flat, e, d, w, region, low, width, bound):
    """Darts of one region: ranks are the arrivals of a Poisson process, drawn from hashes."""
    seed = mix(e + np.uint64((region + 1) * 0xA0761D6478BD642F & (1 << 64) - 1))
    rank = np.zeros(len(seed))
    limit = bound[d]
    rate = 1 / (DARTS * width)
    j = 0
    while len(seed):
        j += 1
        draw = mix(seed + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        rank = rank - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
        hit = rank <= limit
        seed, rank, limit, d, w, draw = seed[hit], rank[hit], limit[hit], d[hit], w[hit], draw[hit]
        spot = mix(draw)
        inside = low + (spot >> np.uint64(40)).astype(np.float64) * (width / 2**24) < w
        key = (rank.view(np.uint64) & np.uint64(0xFFFFFFFFFFF00000)) | (draw & np.uint64(0xFFFFF))
        place = d * COORDINATES + (spot & np.uint64(0xFFFFFFFF)).astype(np.int64) % COORDINATES
        np.minimum.at(flat, place[inside], key[inside])


def bands(table: np.ndarray) -> np.ndarray:
    """Bucket keys, an array (documents, BANDS)."""
    parts = mix(table).reshape(len(table), BANDS, ROWS)
    odd = np.array([2 * 0x2545F4914F6CDD1D * (k + 1) + 1 & (1 << 64) - 1 for k in range(ROWS)], np.uint64)
    return mix((parts * odd).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xDA942042E4DD58B5)).view(np.int64)


def sketch(table: np.ndarray) -> np.ndarray:
    """One bit of each of 128 coordinates, as two longs."""
    bits = (mix(table[:, :128]) >> np.uint64(17)).astype(np.uint8) & 1
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64)


def text_prints(texts: list[bytes], prints: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The fingerprints of texts, as signed numbers; of a text without words from the text itself."""
    for k in np.flatnonzero(~some).tolist():
        prints[k] = np.frombuffer(hashlib.blake2b(texts[k], digest_size=16).digest(), np.uint64)
    return prints.view(np.int64)


SIGNED = "doc_id long, p long, q long, size int, bands array<long>, s long, t long"


def signed(docs: DataFrame) -> DataFrame:
    """Fingerprint, number of shingles, bucket keys and one-bit sketch of each document; without bands where there is no word."""

    def step(batches):
        give_back()
        for b in batches:
            texts, ids = utf8(b.column("text")), b.column("doc_id")
            for lo, hi in runs([len(x) for x in texts], SLICE):
                element, text, prints = shingles(texts[lo:hi])
                table = signatures(element, text, hi - lo)
                size = np.bincount(text, minlength=hi - lo)
                some = size > 0
                keys = bands(table)
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]), pa.int32()), pa.array(keys[some].reshape(-1)))
                two = sketch(table)
                p = text_prints(texts[lo:hi], prints, some)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(size.astype(np.int32)), values, pa.array(two[:, 0]), pa.array(two[:, 1])], names=["doc_id", "p", "q", "size", "bands", "s", "t"])

    return docs.mapInArrow(step, SIGNED)


def weights_of(docs: DataFrame) -> DataFrame:
    """(node, p, q, bag) of (node, text): the sorted 32-bit hashes of each text's shingles."""

    def step(batches):
        for b in batches:
            texts, ids = utf8(b.column("text")), b.column("node")
            for lo, hi in runs([len(x) for x in texts], SLICE):
                element, text, prints = shingles(texts[lo:hi])
                short = (element >> np.uint64(32)).astype("<u4")
                short = short[np.lexsort((short, text))]
                size = np.bincount(text, minlength=hi - lo)
                ends = np.concatenate([[0], np.cumsum(size)])
                p = text_prints(texts[lo:hi], prints, size > 0)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array([short[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["node", "p", "q", "bag"])

    return docs.select("node", "text").mapInArrow(step, "node long, p long, q long, bag binary")


def counted(bag: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(elements, how often each, all) of a sorted bag."""
    x = np.frombuffer(bag, "<u4")
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x))), len(x)


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Of two counted bags."""
    (x, n, all_a), (y, m, all_b) = a, b
    if not all_a or not all_b:
        return 0.0
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    hit = x[at] == y
    common = int(np.minimum(n[at[hit]], m[hit]).sum())
    return common / (all_a + all_b - common)


def verified(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least ``similarity``."""

    def step(batches):
        for b in batches:
            x, y = (c.to_pylist() for c in (b.column("bag_a"), b.column("bag_b")))
            ok = [
                min(len(p), len(q)) >= similarity * max(len(p), len(q)) and weighted_jaccard(counted(p), counted(q)) >= similarity
                for p, q in zip(x, y, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    left = pairs.join(bags.withColumnsRenamed({"node": "a", "bag": "bag_a"}), "a")
    both = left.join(bags.withColumnsRenamed({"node": "b", "bag": "bag_b"}), "b")
    return both.select("a", "b", "bag_a", "bag_b").mapInArrow(step, "a long, b long")


def _compare(similarity: float):
    """Links across components in one bucket, or between two of its blocks."""

    def step(table: pa.Table) -> pa.Table:
        key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
        ids, comp, block, guest = (table.column(c).to_numpy() for c in ("node", "comp", "block", "guest"))
        comp = comp.copy()
        keys = np.array(table.column("bands").to_pylist(), np.int64)
        bits = np.stack([table.column(c).to_numpy() for c in ("s", "t")], axis=1).view(np.uint64)
        bags = [counted(x) for x in table.column("bag").to_pylist()]
        size = np.array([x[2] for x in bags])
        links = []
        for x in range(len(ids)):
            # a pair belongs to the first bucket that it shares, and to one pair of blocks
            other = np.flatnonzero((comp != comp[x]) & (ids > ids[x]) & ((block != block[x]) if i != j else True) & ~(guest & guest[x]))
            other = other[np.minimum(size[other], size[x]) >= similarity * np.maximum(size[other], size[x])]
            other = other[128 - np.bitwise_count(bits[other] ^ bits[x]).sum(axis=1, dtype=np.int64) >= SKETCH_BITS]
            equal = keys[other] == keys[x]
            other = other[keys[x][equal.argmax(axis=1)] == key] if len(other) else other
            for y in other.tolist():
                if comp[y] != comp[x] and weighted_jaccard(bags[x], bags[y]) >= similarity:
                    links.append((int(ids[x]), int(ids[y])))
                    comp[comp == comp[y]] = comp[x]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return step


def across(bucketed: DataFrame, keys: DataFrame, bags: DataFrame, comp: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components that share a bucket.

    Only buckets that still hold several components come here. A bucket beyond
    BLOCK members or BLOCK_BYTES is dealt in classes of sizes, each a factor of
    1 / similarity wide: a pair lies in one class or in two neighbours, where
    the members of the larger class are guests. A class that is still too large
    is dealt in blocks that meet pairwise, so a task holds two blocks at most;
    pairs are compared where they lie and never become rows.
    """
    placed = bucketed.join(comp, "node", "left").select("key", "node", "size", "s", "t", F.coalesce("comp", "node").alias("comp"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(4.0 * F.col("size")) / BLOCK_BYTES)).cast("int")
    mixed = cut(placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), blocks.alias("large")).where("lo < hi").select("key", "large"))
    rows = placed.join(mixed, "key")
    level = F.floor(F.log(F.col("size").cast("double")) / -math.log(similarity)).cast("int")
    own = rows.withColumn("level", F.when(F.col("large") > 1, level).otherwise(-1))
    guests = own.where("large > 1 AND level > 0").withColumn("level", F.col("level") - 1)
    both = own.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True))).drop("large")
    groups = cut(both.groupBy("key", "level").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), blocks.alias("blocks")).where("lo < hi").select("key", "level", "blocks"))
    dealt = both.join(groups, ["key", "level"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "level", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "guest", "node", "comp", "s", "t")
    whole = cut(dealt).join(keys, "node").join(bags, "node")
    return whole.groupBy("key", "level", "i", "j").applyInArrow(_compare(similarity), "a long, b long")


def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends aren't joined yet."""
    left = pairs.join(comp.withColumnsRenamed({"node": "a", "comp": "x"}), "a", "left")
    both = left.join(comp.withColumnsRenamed({"node": "b", "comp": "y"}), "b", "left")
    return both.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame, bool]:
    """(rows (doc_id, p, q), names (p, q, class_id, nameless), whether a doc_id stands in several rows) of docs (doc_id, text)."""
    table = stored(signed(docs).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    repeats = table.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    # texts with the same words: one representative goes on
    first = F.min(F.struct("rid", "doc_id"))
    same = cut(table.groupBy("p", "q").agg(first.alias("r"), F.min("doc_id").alias("least")).select("p", "q", F.col("r.rid").alias("node"), F.col("r.doc_id").alias("doc_id"), "least"))
    reps = table.where(F.size("bands") > 0).join(same.select(F.col("node").alias("rid")), "rid", "left_semi").withColumnRenamed("rid", "node")
    entries = reps.select("node", "size", "s", "t", F.explode("bands").alias("key"))
    shared = cut(entries.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("most")).where("lead < most").select("key", "lead"))
    bucketed = cut(entries.join(shared, "key"))
    star = cut(bucketed.where("lead < node").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    wanted = same.join(star.select(F.col("a").alias("node")).union(star.select(F.col("b").alias("node"))).distinct(), "node", "left_semi")
    if repeats:  # an id doesn't tell which text is meant: the words do
        each = weights_of(docs.withColumnRenamed("doc_id", "node")).drop("node").join(wanted.select("node", "p", "q"), ["p", "q"])
        bags = each.groupBy("node").agg(F.max("bag").alias("bag"))
    else:
        bags = weights_of(docs.join(wanted.select("node", "doc_id"), docs["doc_id"].eqNullSafe(wanted["doc_id"]))).select("node", "bag")
    bags = stored(bags, "shingles", "uncompressed")
    least = star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = cut(verified(least, bags, similarity))
    comp = components(links)
    rest = cut(apart(star.join(least, ["a", "b"], "left_anti"), comp))
    links = links.union(cut(verified(rest, bags, similarity)))
    comp = components(links)
    found = cut(across(bucketed, reps.select("node", "bands"), bags, comp, similarity))
    more = found.limit(1).count() > 0
    links = links.union(found) if more else links
    if repeats:  # a repeated doc_id ties its texts
        of = table.where("doc_id IS NOT NULL").join(same.select("p", "q", "node"), ["p", "q"]).select("doc_id", "node").distinct()
        tie = of.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc_id", "a")
        links = links.union(of.join(tie, "doc_id").where("a < node").select("a", F.col("node").alias("b")))
    comp = components(links) if more or repeats else comp
    member = cut(same.select("p", "q", "node", "least").join(comp, "node", "left").select("p", "q", "least", F.coalesce("comp", "node").alias("comp")))
    named = member.groupBy("comp").agg(F.coalesce(F.min("least"), -1 - F.shiftrightunsigned(F.min("p"), 1)).alias("class_id"), F.min("least").isNull().alias("nameless"))
    return table.select("doc_id", "p", "q"), member.join(named, "comp").select("p", "q", "class_id", "nameless"), repeats


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of each row: the class is named by its least doc_id."""
    few = own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows, names, _ = classes(few, similarity)
    return rows.join(names, ["p", "q"]).select("doc_id", "class_id")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: that of the least doc_id, of several with it, or without any id, the least row."""
    few = own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows, names, repeats = classes(few, similarity)
    if not repeats:  # so at most one row has no id, which stays where its class has none
        keep = cut(rows.join(names, ["p", "q"]).where("doc_id = class_id OR (doc_id IS NULL AND nameless)").select(F.col("doc_id").alias("kept")))
        return docs.join(keep, docs["doc_id"].cast("long").eqNullSafe(keep["kept"]), "left_semi")
    x, y = (next(f"{n}{k}" for k in range(len(docs.columns) + 1) if f"{n}{k}" not in docs.columns) for n in "pq")

    def step(batches):
        for b in batches:
            texts = utf8(b.column("text"))
            for lo, hi in runs([len(t) for t in texts], SLICE):
                _, text, prints = shingles(texts[lo:hi])
                p = text_prints(texts[lo:hi], prints, np.bincount(text, minlength=hi - lo) > 0)
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(p[:, 0]), pa.array(p[:, 1])], names=[*b.schema.names, x, y])

    marked = docs.mapInArrow(step, StructType([*docs.schema.fields, StructField(x, LongType()), StructField(y, LongType())]))
    named = marked.join(names.withColumnsRenamed({"p": x, "q": y}), [x, y])
    order = F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "text")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return named.groupBy("class_id", "nameless").agg(F.min_by(row, order).alias("r")).select("r.*")
