"""Quality rules with adaptive thresholds.

Per document the word statistics are counted; per (lang, source) each metric
gets a mergeable quantile sketch - a table of log-linear buckets with counts,
which merges by addition and gives every quantile within 1/32 of its value.
The upper fence of a metric is read from the sketch of the document's own
group, so no fixed cutoff decides; the fences are joined back and applied.

Defined cases: null or empty text has no words (base_failed); null lang or
source form a group of their own; repeated rows each get a row; an empty
table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import cut, own_columns, sized_join, utf8

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Metric: (numerator, denominator, slack in thousandths). Values are thousandths.
METRICS = {
    "word_length": ("word_chars", "n_words", 2000),
    "symbols": ("n_symbols", "n_words", 200),
    "dup_lines": ("n_dup_lines", "n_words", 100),
    "repeats": ("n_repeat_words", "n_words", 300),
}
#: A document fails above q75 + SPREAD * (q75 - q50) + slack.
SPREAD = 6


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that occur twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    span = 1
    while span < WINDOW:  # exact ranks of 2, 4, then 8 words
        key = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        ids, span = np.unique(key, return_inverse=True)[1], 2 * span
    again = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.zeros(n + 1, np.int64)
    edge[again] += 1
    np.subtract.at(edge, again + WINDOW, 1)
    return int(np.count_nonzero(np.cumsum(edge[:n])))


def word_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8."""
    words = text.split()  # bytes split at exactly the white space of ASCII
    joined = b"".join(words)
    chars = len(joined) - len(joined.translate(None, bytes(range(128)) + bytes(range(0xC0, 0x100))))
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += bool(line.split())
        else:
            seen.add(line)
    return len(words), chars, symbols, dup, repeated_words(words)


def _stats(batches):
    for b in batches:
        rows = [word_stats(t) for t in utf8(b.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("lang"), b.column("source"), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(5))],
            names=[x.split()[0] for x in STATS.split(", ")],
        )


def base_stats(docs: DataFrame) -> DataFrame:
    """The base counts of each document, in one pass without a shuffle."""
    few = own_columns(docs, "doc_id", "lang", "source", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return few.mapInArrow(_stats, STATS)


def bucket(v: Column) -> Column:
    """Log-linear bucket of a whole number: exact to 63, then 32 per octave."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.when(v < 64, v).otherwise(shift.cast("long") * 32 + F.floor(v / F.pow(F.lit(2.0), shift)).cast("long"))


def bucket_floor(b: Column) -> Column:
    """The least value of a bucket."""
    shift = F.floor((b - 32) / 32).cast("long")
    return F.when(b < 64, b).otherwise(((b - shift * 32) * F.pow(F.lit(2.0), shift)).cast("long"))


def permille(top: str, below: str) -> Column:
    return F.when(F.col(below) > 0, F.floor(F.col(top) * 1000 / F.col(below))).otherwise(0).cast("long")


def sketches(stats: DataFrame) -> DataFrame:
    """Sketch rows (lang, source, metric, bucket, n): merging is adding n."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(permille(a, b)).alias("bucket")) for m, (a, b, _) in METRICS.items()])
    return stats.select("lang", "source", F.inline(each)).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """The upper fence of each metric, a row per (lang, source)."""
    group = Window.partitionBy("lang", "source", "metric")
    cum = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    at = lambda q: bucket_floor(F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket"))))
    slack = F.create_map(*[x for m, (_, _, s) in METRICS.items() for x in (F.lit(m), F.lit(s))])
    fence = cum.groupBy("lang", "source", "metric").agg(at(50).alias("q50"), at(75).alias("q75"))
    fence = fence.withColumn("fence", F.col("q75") + SPREAD * (F.col("q75") - F.col("q50")) + slack[F.col("metric")])
    return fence.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(f"max_{m}") for m in METRICS])


def adaptive_quality(docs: DataFrame) -> DataFrame:
    """Counts, base verdict and adaptive verdict of each document."""
    stats = base_stats(docs).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    # Nulls as a key of their own: prefix values with '=' and mark null by ''.
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    stats = cut(stats.withColumn("lang", key("lang")).withColumn("source", key("source")))
    limits = cut(fences(sketches(stats.where(~F.col("base_failed")))))
    inside = F.lit(True)
    for m, (a, b, _) in METRICS.items():
        inside = inside & (permille(a, b) <= F.coalesce(F.col(f"max_{m}"), F.lit(2**62)))
    joined = sized_join(stats, limits, ["lang", "source"])
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"))


def _sql() -> str:
    """The same result as DuckDB SQL; only the counts stay in plain SQL."""
    value = lambda m: f"CASE WHEN {METRICS[m][1]} > 0 THEN CAST(floor({METRICS[m][0]} * 1000 / {METRICS[m][1]}) AS BIGINT) ELSE 0 END"
    inside = " AND ".join(f"({value(m)}) <= coalesce((SELECT fence FROM fences f WHERE f.lang IS NOT DISTINCT FROM s.lang AND f.source IS NOT DISTINCT FROM s.source AND f.metric = '{m}'), 4611686018427387904)" for m in METRICS)
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {s} AS slack, {value(m)} AS v FROM failed WHERE NOT base_failed" for m, (_, _, s) in METRICS.items())
    floor_of = lambda b: f"CASE WHEN {b} < 64 THEN {b} ELSE ({b} - ({b} - 32) // 32 * 32) * (1::BIGINT << (({b} - 32) // 32)::INT) END"
    return f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: struct_pack(i := i, k := array_to_string(ws[i:i + {WINDOW - 1}], ' ')))) AS x FROM w WHERE len(ws) >= {WINDOW}),
rep AS (SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.k) AS n FROM win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_rep FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM rep WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, sum(n - 1) AS n_dup FROM (SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
stats AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM stats),
long AS ({long}),
sketch AS (SELECT lang, source, metric, slack, CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)::INT) END AS b, count(*) AS n FROM long GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM sketch),
q AS (SELECT lang, source, metric, slack, min(b) FILTER (WHERE upto * 100 >= total * 50) AS b50, min(b) FILTER (WHERE upto * 100 >= total * 75) AS b75 FROM cum GROUP BY ALL),
e AS (SELECT *, {floor_of('b50')} AS q50, {floor_of('b75')} AS q75 FROM q),
fences AS (SELECT *, q75 + {SPREAD} * (q75 - q50) + slack AS fence FROM e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept FROM failed s"""


ORACLE_SQL = _sql()
