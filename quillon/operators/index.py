"""The inverted index as DataFrames: postings, norms, dictionary, statistics.

Postings are a long table (field, term, doc_id, freq, length, positions), one
aggregation over the tokens. ``Index`` computes it from the documents;
``Index.write`` stores it: as a document is whole in its row, the postings of a
batch of documents are gathered where they are, and only the documents are
shuffled. A ``StoredIndex`` reads it by term: postings lie
in folders by field and by a hash of the term, sorted by term, so a look-up
opens one folder a term and skips its row groups; each posting carries its
document's length, so ranking joins nothing; frequencies, averages and counts
come from the stored dictionary and statistics.

A document has one key. Rows without a key are not indexed; ``write`` refuses
documents that repeat one (``latest`` keeps the newest version of each).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.analysis import KEYWORD, AnalyzerConfig

#: Bytes of documents to a bucket of terms, and the most buckets. Each task of ``write`` has a file a bucket.
BUCKET_BYTES, MOST_BUCKETS = 1 << 30, 1024
#: Bytes of documents to a task of ``write``: at most, and in a small table whose tasks shall be as many as cores, at least.
TASK_BYTES, LEAST_TASK_BYTES = 16 << 20, 1 << 20
#: Numbers of postings are stored as differences, not looked up in a dictionary of values.
NUMBERS = {"parquet.writer.version": "v2"} | {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "freq", "length", "positions.list.element")}
#: Rows to a batch that goes back to Spark.
BATCH_ROWS = 1 << 16


@dataclass(frozen=True)
class Mapping:
    """Names of the key and of the fields: analyzed texts, keywords, numbers."""

    key: str
    text: dict[str, AnalyzerConfig] = field(default_factory=dict)
    keyword: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()

    def analyzer_for(self, name: str) -> AnalyzerConfig:
        return self.text.get(name, KEYWORD)

    def fields(self) -> list[str]:
        return sorted([*self.text, *self.keyword, *self.numeric])

    def indexed(self) -> list[str]:
        return [*self.text, *self.keyword]


STATS = "num_docs long, buckets int, field string, docs_with_field long, sum_length long, max_length long, vocabulary long, postings long, avg_length double"


class RepeatedKey(ValueError):
    """Documents that are to be indexed share a key."""


#: A condition on the terms of a field.
TermCondition = tuple[str, Callable[[Column], Column]]


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def latest(docs: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the highest version of each key; combined before the shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max_by(row, F.col(f"`{version}`")).alias("_row")).select("_row.*")


def terms_of(postings: DataFrame) -> DataFrame:
    stats = (F.count("*").alias("doc_freq"), F.sum("freq").alias("total_term_freq"), F.max("freq").alias("max_freq"), F.min("length").alias("min_length"))
    return postings.groupBy("field", "term").agg(*stats)


def summary(norms: DataFrame, dictionary: DataFrame) -> DataFrame:
    n = norms.groupBy("field").agg(F.count("*").alias("docs_with_field"), F.sum("length").alias("sum_length"), F.max("length").alias("max_length"))
    d = dictionary.groupBy("field").agg(F.count("*").alias("vocabulary"), F.sum("doc_freq").alias("postings"))
    return n.join(d, "field").withColumn("avg_length", F.col("sum_length") / F.col("docs_with_field"))


def gathered(tokens: DataFrame, buckets: int, key_type: str) -> DataFrame:
    """The postings of (doc_id, field, terms), one row a document and field, with the bucket of each term; no shuffle.

    Batches come out in the order in which they are stored, so the sort behind merges runs.
    """

    def step(batches):
        for b in batches:
            for name in pc.unique(b.column("field")).to_pylist():
                yield from _postings(b.filter(pc.equal(b.column("field"), name)), name, buckets)

    return tokens.mapInArrow(step, f"field string, bucket int, term string, doc_id {key_type}, freq long, length long, positions array<int>")


def _postings(batch: pa.RecordBatch, name: str, buckets: int):
    batch = batch.take(pc.sort_indices(batch.column("doc_id")))
    terms = batch.column("terms")
    lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, docs = terms.flatten(), len(lengths)
    if not len(flat):
        return
    coded = flat.dictionary_encode(null_encoding="encode")
    words = coded.dictionary
    bucket = pa.array([None if w is None else zlib.crc32(w) % buckets for w in words.cast("binary").to_pylist()], pa.int32())
    order = pc.sort_indices(pa.table({"b": bucket, "w": words}), [("b", "ascending"), ("w", "ascending")]).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    doc = np.repeat(np.arange(docs), lengths)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    pair = rank[coded.indices.to_numpy()] * docs + doc
    most = int(lengths.max())
    if len(order) * docs * most < 1 << 62:  # one number a token sorts faster than places of numbers
        pair, pos = np.divmod(np.sort(pair * most + pos), most)
    else:
        at = np.argsort(pair, kind="stable")
        pair, pos = pair[at], pos[at]
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    word, doc = np.divmod(pair[first], docs)
    ends = np.append(first, len(pair))
    word = order[word]
    for a in range(0, len(first), BATCH_ROWS):
        z = min(a + BATCH_ROWS, len(first))
        places = pa.ListArray.from_arrays(pa.array((ends[a : z + 1] - ends[a]).astype(np.int32)), pa.array(pos[ends[a] : ends[z]].astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name], pa.string()).take(pa.array(np.zeros(z - a, np.int32))), bucket.take(pa.array(word[a:z])), words.take(pa.array(word[a:z])), batch.column("doc_id").take(pa.array(doc[a:z])),
                pa.array(np.diff(ends[a : z + 1])), pa.array(lengths[doc[a:z]]), places,
            ],
            names=["field", "bucket", "term", "doc_id", "freq", "length", "positions"],
        )


class Index:
    """An index over docs; all tables are lazy."""

    def __init__(self, docs: DataFrame, mapping: Mapping):
        self.docs, self.mapping = docs, mapping
        self.spark = docs.sparkSession
        self._df: dict[tuple[str, str], int] = {}

    @cached_property
    def tokens(self) -> DataFrame:
        """(doc_id, field, terms): the term list of each indexed field."""
        m = self.mapping
        each = []
        for name in m.indexed():
            many = name in m.keyword and dict(self.docs.dtypes)[name].startswith("array")
            terms = F.col(f"`{name}`") if many else m.analyzer_for(name).terms(F.col(f"`{name}`").cast("string"))
            each.append(F.struct(F.lit(name).alias("field"), terms.alias("terms")))
        if not each:
            return self.docs.select(F.col(f"`{m.key}`").alias("doc_id"), F.lit("").alias("field"), F.array().cast("array<string>").alias("terms")).where(F.lit(False))
        return self.docs.where(F.col(f"`{m.key}`").isNotNull()).select(F.col(f"`{m.key}`").alias("doc_id"), F.inline(F.array(*each)))

    @staticmethod
    def _gathered(tokens: DataFrame, fits: Column | None = None) -> DataFrame:
        rows = tokens.select("field", "doc_id", F.size("terms").cast("long").alias("length"), F.posexplode("terms").alias("pos", "term"))
        rows = rows if fits is None else rows.where(fits)
        return rows.groupBy("field", "term", "doc_id").agg(F.count("*").alias("freq"), F.max("length").alias("length"), F.array_sort(F.collect_list("pos")).alias("positions"))

    @cached_property
    def postings(self) -> DataFrame:
        return self._gathered(self.tokens)

    @cached_property
    def norms(self) -> DataFrame:
        return self.tokens.select("field", "doc_id", F.size("terms").cast("long").alias("length")).where("length > 0")

    @cached_property
    def dictionary(self) -> DataFrame:
        """(field, term, doc_freq, total_term_freq, max_freq, min_length)."""
        return terms_of(self.postings)

    @cached_property
    def field_stats(self) -> DataFrame:
        return summary(self.norms, self.dictionary)

    def lookup(self, terms: set[tuple[str, str]], conditions: list[TermCondition] = ()) -> DataFrame:
        """The postings of the terms and of all terms that meet a condition: (field, term, doc_id, freq, length, positions)."""
        fields = sorted({f for f, _ in [*terms, *conditions]})
        return self._gathered(self.tokens.where(F.col("field").isin(*fields)), wanted(terms, conditions))

    # -- a stored index ------------------------------------------------------

    def write(self, path: str, buckets: int | None = None) -> StoredIndex:
        """Store the index below path, statistics last, and give it back as read from there."""
        key = F.col(f"`{self.mapping.key}`")
        if again := self.docs.where(key.isNotNull()).groupBy(key.alias("k")).count().where("count > 1").select("k").limit(1).collect():
            raise RepeatedKey(f"several documents have the key {again[0].k}")
        size = self._bytes()
        if buckets is None:
            buckets = min(MOST_BUCKETS, max(1, -(-size // BUCKET_BYTES)))
        tasks = max(1, -(-size // TASK_BYTES), min(self.spark.sparkContext.defaultParallelism, -(-size // LEAST_TASK_BYTES)))
        # dealt by document, so a common term is spread over all tasks, and a file holds a range of keys
        whole = self.docs.where(key.isNotNull()).select(key, *[F.col(f"`{n}`") for n in self.mapping.indexed() if n != self.mapping.key]).repartitionByRange(tasks, key)
        done = StoredIndex(self.docs, self.mapping, path)
        rows = gathered(Index(whole, self.mapping).tokens, buckets, done.key_type)
        # a field that can't be null keeps Spark from sorting the rows once more
        rows = rows.withColumns({"field": F.coalesce("field", F.lit(""))}).sortWithinPartitions("field", "bucket", "term", "doc_id")
        rows.write.options(**NUMBERS).partitionBy("field", "bucket").parquet(f"{path}/postings")
        # a document that has terms has one posting at its first place
        done.postings.where(F.col("positions")[0] == 0).select("field", "doc_id", "length").write.partitionBy("field").parquet(f"{path}/norms")
        terms_of(done.postings).repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.partitionBy("field").parquet(f"{path}/dictionary")
        of_fields = summary(done.norms, done.dictionary).collect()  # a row to a field of the mapping
        total = self.docs.where(key.isNotNull()).count()
        rows = [(total, buckets, None, 0, 0, 0, 0, 0, 0.0), *((total, buckets, *r) for r in of_fields)]
        self.spark.createDataFrame(rows, STATS).coalesce(1).write.parquet(f"{path}/stats")
        return done

    def _bytes(self) -> int:
        """About the size of the documents: what the plan says, or where it knows nothing, their fields' bytes."""
        said = int(str(self.docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if said < 1 << 60:
            return said
        each = [F.octet_length(F.col(f"`{n}`").cast("string")) for n in self.mapping.indexed()]
        return self.docs.agg(F.sum(sum((F.coalesce(x, F.lit(0)) for x in each), F.lit(0)))).first()[0] or 0

    @staticmethod
    def read(docs: DataFrame, mapping: Mapping, path: str) -> StoredIndex:
        """The index stored below path, of the same documents."""
        return StoredIndex(docs, mapping, path)

    # -- numbers that queries need as literals -----------------------------

    @cached_property
    def num_docs(self) -> int:
        return self.docs.where(F.col(f"`{self.mapping.key}`").isNotNull()).count()

    @cached_property
    def averages(self) -> dict[str, float]:
        return {r.field: float(r.a) for r in self.norms.groupBy("field").agg(F.avg("length").alias("a")).collect()}

    def average(self, name: str) -> float:
        return self.averages.get(name, 0.0)

    def remember(self, name: str, freqs: dict[str, int]) -> None:
        """Document frequencies that a look-up has shown."""
        self._df |= {(name, t): n for t, n in freqs.items()}

    def doc_freqs(self, terms: set[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """Document frequencies of a bounded set of terms, in one job."""
        new = {t for t in terms if t not in self._df}
        if new:
            self._df |= dict.fromkeys(new, 0) | self._count(new)
        return {t: self._df[t] for t in terms}

    def _count(self, terms: set[tuple[str, str]]) -> dict[tuple[str, str], int]:
        rows = self.tokens.select("field", F.explode(F.array_distinct("terms")).alias("term")).where(wanted(terms))
        return {(r.field, r.term): r.n for r in rows.groupBy("field", "term").agg(F.count("*").alias("n")).collect()}


class StoredIndex(Index):
    """An index read from its stored tables."""

    def __init__(self, docs: DataFrame, mapping: Mapping, path: str):
        super().__init__(docs, mapping)
        self.path = path.rstrip("/")
        self.key_type = docs.schema[mapping.key].dataType.simpleString()

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @cached_property
    def postings(self) -> DataFrame:
        rows = self._table("postings", f"term string, doc_id {self.key_type}, freq long, length long, positions array<int>, field string, bucket int")
        return rows.select("field", "term", "doc_id", "freq", "length", "positions", "bucket")

    @cached_property
    def norms(self) -> DataFrame:
        return self._table("norms", f"doc_id {self.key_type}, length long, field string").select("field", "doc_id", "length")

    @cached_property
    def dictionary(self) -> DataFrame:
        rows = self._table("dictionary", "term string, doc_freq long, total_term_freq long, max_freq long, min_length long, field string")
        return rows.select("field", "term", "doc_freq", "total_term_freq", "max_freq", "min_length")

    @cached_property
    def field_stats(self) -> DataFrame:
        return self._table("stats", STATS).where("field IS NOT NULL").drop("num_docs", "buckets")

    def lookup(self, terms: set[tuple[str, str]], conditions: list[TermCondition] = ()) -> DataFrame:
        rows = self.postings.where(F.col("field").isin(*sorted({f for f, _ in [*terms, *conditions]})))
        if not conditions and (buckets := self._stats[0].buckets) > 1:
            rows = rows.where(F.col("bucket").isin(*sorted({bucket_of(t, buckets) for _, t in terms})))
        return rows.where(wanted(terms, conditions)).drop("bucket")

    @cached_property
    def _stats(self) -> list:
        return self._table("stats", STATS).collect()

    @cached_property
    def num_docs(self) -> int:
        return self._stats[0].num_docs

    @cached_property
    def averages(self) -> dict[str, float]:
        return {r.field: r.avg_length for r in self._stats if r.field is not None}

    def _count(self, terms: set[tuple[str, str]]) -> dict[tuple[str, str], int]:
        return {(r.field, r.term): r.doc_freq for r in self.dictionary.where(wanted(terms)).select("field", "term", "doc_freq").collect()}


def wanted(terms: set[tuple[str, str]], conditions: list[TermCondition] = ()) -> Column:
    """Whether (field, term) is one of the terms or meets a condition; simple enough to be pushed into a scan."""
    every = []
    for f in sorted({f for f, _ in terms}):
        every.append((F.col("field") == f) & F.col("term").isin(*sorted(t for g, t in terms if g == f)))
    every += [(F.col("field") == f) & fits(F.col("term")) for f, fits in conditions]
    return reduce(lambda a, b: a | b, every, F.lit(False))
