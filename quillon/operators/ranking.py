"""Ranking beside the search driver: explanations, rescoring, sharded and segmented top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.bm25 import Bm25, idf_column
from quillon.operators.index import Index
from quillon.plans import ast
from quillon.plans.compile import Compiler


def explain_terms(index: Index, name: str, terms: list[str], bm25: Bm25 = Bm25()) -> DataFrame:  # noqa: B008
    """The parts of the score of each term in each document that has it."""
    tf = index.lookup({(name, t) for t in terms}).select("doc_id", "term", F.col("freq").alias("tf"), "length")
    freqs = index.doc_freqs({(name, t) for t in terms})
    df = F.element_at(F.create_map(*[x for t in terms for x in (F.lit(t), F.lit(float(freqs[(name, t)])))]), F.col("term"))
    out = tf.withColumn("idf", idf_column(F.lit(float(index.num_docs)), df))
    out = out.withColumn("length_ratio", F.col("length") / index.average(name)).withColumn("norm", bm25.norm(F.col("length"), index.average(name)))
    out = out.withColumn("tf_component", F.col("tf") * (bm25.k1 + 1) / (F.col("tf") + F.col("norm")))
    return out.withColumn("score", F.col("idf") * F.col("tf_component"))


def explain_document(index: Index, q: ast.Query, doc_id, bm25: Bm25 = Bm25()) -> dict:  # noqa: B008
    """The score of one document as a tree of clauses, each term's with its parts; value 0 where it doesn't match."""
    compiler = Compiler(index, bm25)
    tree = compiler.explain(q, doc_id)
    asked = {t for leaf in compiler.leaves for t in leaf.terms}
    parts = {}
    for name in sorted({f for f, _ in asked}):
        for r in explain_terms(index, name, sorted(t for f, t in asked if f == name), bm25).where(F.col("doc_id") == doc_id).collect():
            parts[f"term {name}:{r.term}"] = [{"value": r.idf, "description": "idf", "details": []}, {"value": r.tf_component, "description": f"saturation of tf {r.tf}", "details": []}, {"value": r.norm, "description": "length norm", "details": []}]

    def filled(node: dict) -> dict:
        inner = [filled(x) for x in node["details"]] or parts.get(node["description"].split(", boost ")[0], [])
        return node | {"details": inner}

    return filled(tree)


def matched_terms(index: Index, ids: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, matched_terms) of the given documents."""
    hits = index.lookup(set(terms)).join(ids.select("doc_id"), "doc_id", "left_semi")
    return hits.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.concat("field", F.lit(":"), "term"))).alias("matched_terms"))


def top(frame: DataFrame, k: int) -> DataFrame:
    return frame.orderBy(F.desc("score"), F.asc("doc_id")).limit(k)


def rescore(frame: DataFrame, window: int, k: int, score: Column, docs: DataFrame | None = None) -> DataFrame:
    """The best ``window`` by the cheap score get the costly one; the best k of them stay."""
    first = top(frame, window)
    if docs is not None:
        first = first.join(docs, "doc_id")
    return top(first.select("doc_id", score.alias("score")), k)


def per_partition_top(frame: DataFrame, part: str, k: int) -> DataFrame:
    """The k best of each part, by the same order as ``top``."""
    order = Window.partitionBy(part).orderBy(F.desc("score"), F.asc("doc_id"))
    return frame.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def query_then_fetch(frame: DataFrame, docs: DataFrame, k: int, columns: list[str]) -> DataFrame:
    """Per-shard winners, global merge, and only then the winners' other columns. frame: (doc_id, shard, score)."""
    winners = top(per_partition_top(frame, "shard", k), k)
    return winners.join(docs.select("doc_id", *columns), "doc_id")


def local_scores(postings: DataFrame, norms: DataFrame, part: str, bm25: Bm25 = Bm25()) -> DataFrame:  # noqa: B008
    """(part, doc_id, score) with the statistics of each part alone. postings: (part, term, doc_id, tf, length); norms: (part, doc_id, length)."""
    stats = norms.groupBy(part).agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    df = postings.groupBy(part, "term").agg(F.count("*").alias("df"))
    rows = postings.join(df, [part, "term"]).join(stats, part)
    norm = bm25.k1 * ((1 - bm25.b) + bm25.b * F.col("length") / F.col("average"))
    value = idf_column(F.col("n").cast("double"), F.col("df").cast("double")) * F.col("tf") * (bm25.k1 + 1) / (F.col("tf") + norm)
    return rows.groupBy(part, "doc_id").agg(F.sum(value).alias("score"))


def fnv1a(key: Column) -> Column:
    """The 32-bit FNV-1a hash of the UTF-16 units of a key (ASCII keys)."""
    units = F.transform(F.filter(F.split(key, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(4294967295).cast("long")))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(fnv1a(key), F.lit(shards)).cast("int")
