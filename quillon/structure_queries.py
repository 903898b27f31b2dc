"""Queries of dictionaries as structures, points in trees, planners, segment files, clusters, lifecycle and the JSON dialect."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon import oracle
from quillon.engine import Engine
from quillon.functions import segment_files as files
from quillon.functions.codec import encode_postings
from quillon.functions.stem import stems
from quillon.operators import planner, points, ranking
from quillon.operators.cluster import Cluster, fetch_bytes
from quillon.operators.index import Index, Mapping
from quillon.operators.ordinals import ordinals
from quillon.plans import ast
from quillon.plans.compile import Compiler
from quillon.plans.dsl import decode
from quillon.queries import SHARDS, _question, _shard, documents, parts, register, scores, search, table, vocabulary
from quillon.sources.folders import fresh
from quillon.streaming import lifecycle
from quillon.structures import words

# -- documents by key, counts, dates ------------------------------------------


@register("get_document", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 17")
def get_document(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id = 17").select("doc_id", "lang", "source", "n_chars")


@register("live_counts", "SELECT CAST(count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS BIGINT) AS num_docs, CAST(count(*) AS BIGINT) AS max_docs FROM documents")
def live_counts(spark, sf_dir):
    """Documents with and without those that are deleted."""
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("gone", F.lit(True))
    return table(spark, sf_dir, "documents").join(gone, "doc_id", "left").agg(F.count_if(F.col("gone").isNull()).alias("num_docs"), F.count("*").alias("max_docs"))


@register("sorted_points", "SELECT p_partkey AS doc_id, p_retailprice AS value, CAST(row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS BIGINT) AS place FROM part WHERE p_retailprice IS NOT NULL")
def sorted_points(spark, sf_dir):
    """Points in order of their value, with their place."""
    rows = table(spark, sf_dir, "part").where("p_retailprice IS NOT NULL").select(F.col("p_partkey").alias("doc_id"), F.col("p_retailprice").alias("value"))
    return ordinals(rows, "value", "doc_id", name="place")


EVENTS = Mapping("event_id", {}, (), ("ts", "value"))


def _event_search(name: str, q: ast.Range, where: str) -> None:
    @register(name, f"SELECT event_id, {q.boost}::DOUBLE AS score FROM events WHERE {where}")
    def run(spark, sf_dir):
        return Compiler(Index(table(spark, sf_dir, "events"), EVENTS)).compile(q).frame.select(F.col("doc_id").alias("event_id"), "score")


_event_search("q_range_date", ast.Range(1.0, "ts", gte="2024-01-10", lt="2024-01-12"), "ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
_event_search("q_range_time", ast.Range(2.0, "ts", gt="2024-01-20T12:30:00Z"), "ts > TIMESTAMP '2024-01-20 12:30:00'")

# -- stems ----------------------------------------------------------------------


def _stemmed(kind: str):
    def run(spark, sf_dir):
        """Each word of the vocabulary with its stem."""
        words_ = documents(spark, sf_dir).dictionary.where("field = 'text'").select("term")
        return words_.select("term", F.element_at(stems(F.array("term"), kind), 1).alias("stem"))

    return run


register("stem_porter")(_stemmed("porter"))
register("stem_porter_json")(_stemmed("porter_json"))

# -- dictionaries -----------------------------------------------------------------
#: Words to a block of the dictionary, and blocks to a group that a task takes at once.
BLOCK, GROUP = 16, 512


def _blocks(spark, sf_dir, name="text") -> DataFrame:
    """(term, ordinal, block) of a field's dictionary."""
    rows = documents(spark, sf_dir).dictionary.where(F.col("field") == name).select("term")
    return ordinals(rows, "term").withColumn("block", F.floor(F.col("ordinal") / BLOCK))


_ordinals = f"{oracle.tables()}, o AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS ordinal, (row_number() OVER (ORDER BY term) - 1) // {BLOCK} AS block FROM dict WHERE field = 'text')"
_prefixes = "p AS (SELECT block, term, ordinal, n, left(term, n) AS prefix, substr(term, n + 1) AS rest FROM (SELECT *, unnest(range(0, length(term) + 1)) AS n FROM o))"


def _by_block(blocks: DataFrame, of, schema: str) -> DataFrame:
    """A row per block from ``of(words, first ordinal) -> dict``; a call into Python takes a run of blocks, not each alone."""
    names = [x.split()[0] for x in schema.split(", ")]

    def step(t: pa.Table) -> pa.Table:
        t = t.sort_by("ordinal")
        terms, ordinals_, blocks_ = (t.column(c).to_pylist() for c in ("term", "ordinal", "block"))
        edges = [k for k, x in enumerate(blocks_) if not k or x != blocks_[k - 1]]
        rows = [{"block": blocks_[x]} | of(terms[x:y], ordinals_[x]) for x, y in zip(edges, [*edges[1:], len(terms)], strict=True)]
        return pa.table({n: [r[n] for r in rows] for n in names})

    return blocks.withColumn("group", F.floor(F.col("block") / GROUP)).groupBy("group").applyInArrow(step, schema)


@register("dict_has", f"{oracle.tables()} SELECT w AS term, coalesce(doc_freq, 0) AS doc_freq, term IS NOT NULL AS found FROM (SELECT unnest(['the', 'pathetic', 'terraform', '']) AS w) LEFT JOIN dict ON term = w AND field = 'text'")
def dict_has(spark, sf_dir):
    asked = ["the", "pathetic", "terraform", ""]
    index = documents(spark, sf_dir)
    found = index.doc_freqs({("text", w) for w in asked})
    return spark.createDataFrame([(w, found["text", w], found["text", w] > 0) for w in asked], "term string, doc_freq long, found boolean")


@register("dict_contains", f"{oracle.tables()} SELECT term, doc_freq FROM dict WHERE field = 'text' AND contains(term, 'ath')")
def dict_contains(spark, sf_dir):
    return documents(spark, sf_dir).dictionary.where("field = 'text' AND contains(term, 'ath')").select("term", "doc_freq")


@register("dict_automata", f"{_ordinals}, {_prefixes}, s AS (SELECT block, n, prefix, list(rest ORDER BY rest) AS rights FROM p GROUP BY ALL), d AS (SELECT DISTINCT block, rights FROM s) "
          "SELECT CAST(block AS BIGINT) AS block, trie_nodes, states, arcs FROM (SELECT block, CAST(count(DISTINCT prefix) AS BIGINT) AS trie_nodes FROM p GROUP BY block) JOIN "
          "(SELECT block, CAST(count(*) AS BIGINT) AS states, CAST(sum(len(list_distinct(list_filter(list_transform(rights, lambda r: left(r, 1)), lambda c: c <> '')))) AS BIGINT) AS arcs FROM d GROUP BY block) USING (block)")  # fmt: skip
def dict_automata(spark, sf_dir):
    """Nodes of the trie, states and arcs of the minimal automaton, of each block of the dictionary."""
    counts = lambda w, first: {k: v for k, v in words.merged(w).items() if k != "trie_edges"}
    return _by_block(_blocks(spark, sf_dir), counts, "block long, trie_nodes long, states long, arcs long")


@register("dict_transducers", f"{_ordinals}, {_prefixes}, m AS (SELECT block, n, prefix, min(ordinal) AS least, list([rest, CAST(ordinal AS VARCHAR)] ORDER BY rest) AS rights FROM p GROUP BY ALL), d AS (SELECT DISTINCT block, list_transform(rights, lambda r: [r[1], CAST(CAST(r[2] AS BIGINT) - CASE WHEN n = 0 THEN 0 ELSE least END AS VARCHAR)]) AS rights FROM m) "
          "SELECT CAST(block AS BIGINT) AS block, CAST(count(*) AS BIGINT) AS states, CAST(sum(len(list_distinct(list_filter(list_transform(rights, lambda r: left(r[1], 1)), lambda c: c <> '')))) AS BIGINT) * 5 AS bytes FROM d GROUP BY block")  # fmt: skip
def dict_transducers(spark, sf_dir):
    """States and bytes of the minimal transducer of words to ordinals, of each block; every word is asked of it again."""

    def build(some, first):
        t = words.Transducer(some, list(range(first, first + len(some))))
        if [t.get(w) for w in some] != t.outputs or t.under() != list(zip(some, t.outputs, strict=True)):
            raise ValueError("the transducer doesn't give back its words")
        return {"states": len(t.states), "bytes": t.estimated_bytes()}

    return _by_block(_blocks(spark, sf_dir), build, "block long, states long, bytes long")


@register("dict_block_bytes", f"{_ordinals}, s AS (SELECT block, term, lag(term, 1, '') OVER (PARTITION BY block ORDER BY term) AS before FROM o) SELECT CAST(block AS BIGINT) AS block, min(term) AS first, "
          "CAST(sum(2 + length(term) - list_max(list_filter(range(0, least(length(term), length(before)) + 1), lambda n: left(term, n) = left(before, n)))) AS BIGINT) AS bytes, CAST(sum(1 + length(term)) AS BIGINT) AS raw_bytes FROM s GROUP BY block")  # fmt: skip
def dict_block_bytes(spark, sf_dir):
    """Bytes of each block front-coded and plain, built as a block dictionary."""

    def sizes(some, first):
        tree = words.BlockTree(some, BLOCK)
        return {"first": tree.firsts[0], "bytes": tree.bytes, "raw_bytes": sum(b.raw_bytes for b in tree.blocks)}

    return _by_block(_blocks(spark, sf_dir), sizes, "block long, first string, bytes long, raw_bytes long")


@register("automaton_scan", f"{oracle.tables('part')} SELECT term FROM dict WHERE field = 'p_name' AND levenshtein(term, 'widgit') <= 2")
def automaton_scan(spark, sf_dir):
    """Words within two edits by a distance automaton that runs over tries of the dictionary's partitions."""
    from quillon.functions.distance import LevenshteinAutomaton

    def step(batches):
        automaton = LevenshteinAutomaton("widgit", 2)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(words.Trie(b.column("term").to_pylist()).within(automaton).words, pa.string())], names=["term"])

    return vocabulary(spark, sf_dir).mapInArrow(step, "term string")


# -- points -----------------------------------------------------------------------
_box = "embedding[1] BETWEEN -0.1 AND 0.1 AND embedding[2] BETWEEN -0.05 AND 0.15"


def _plane(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def _tree_search(name: str, kind: str) -> None:
    @register(name, f"SELECT vec_id FROM embeddings WHERE {_box.replace('embedding[1]', 'embedding[1]::DOUBLE').replace('embedding[2]', 'embedding[2]::DOUBLE')}")
    def run(spark, sf_dir):
        return points.in_region(_plane(spark, sf_dir), points.Region(-0.1, 0.1, -0.05, 0.15), kind).select(F.col("id").alias("vec_id"))


_tree_search("kd_box", "kd")
_tree_search("bkd_box", "bkd")


@register("bkd_line", "SELECT p_partkey FROM part WHERE p_retailprice BETWEEN 920 AND 930")
def bkd_line(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"), F.lit(0.0).alias("y"))
    return points.in_region(rows, points.Region(920, 930), "bkd").select(F.col("id").alias("p_partkey"))


@register("bkd_leaves", "SELECT CAST(sum(n) AS BIGINT) AS points, CAST(sum(n) * 10 AS BIGINT) AS bytes FROM (SELECT count(*) AS n FROM embeddings)")
def bkd_leaves(spark, sf_dir):
    """Points and bytes of all leaf blocks."""
    return points.leaves(_plane(spark, sf_dir), 64).agg(F.sum("points").alias("points"), F.sum("bytes").alias("bytes"))


# -- plans ------------------------------------------------------------------------
_asked = ("the", "pathetic", "stupid", "worthless")


@register("wand_topk", f"{oracle.tables()} SELECT doc_id, round(sum(s), 6) AS score FROM scored WHERE field = 'text' AND term IN ({', '.join(map(oracle.quoted, _asked))}) GROUP BY doc_id ORDER BY sum(s) DESC, doc_id LIMIT 10")
def wand_topk(spark, sf_dir):
    """The ten best, each shard pruned by upper bounds."""
    index = documents(spark, sf_dir)
    hits = ranking.explain_terms(index, "text", list(_asked)).select("term", "doc_id", "score")
    return scores(ranking.top(planner.sharded_top(hits, 10, 16).select("doc_id", "score"), 10))


_costs = ast.Bool(must=(ast.Term(1.0, "text", "the"), ast.Term(1.0, "text", "pathetic")), should=(ast.Term(1.0, "lang", "en"),))


@register("plan_costs", f"{oracle.tables()}, c AS (SELECT 'text:the' AS query, doc_freq AS cost FROM dict WHERE field = 'text' AND term = 'the' UNION ALL SELECT 'text:pathetic', doc_freq FROM dict WHERE field = 'text' AND term = 'pathetic' UNION ALL SELECT 'lang:en', doc_freq FROM dict WHERE field = 'lang' AND term = 'en') SELECT query, cost FROM c UNION ALL SELECT 'all', min(cost) FROM c WHERE query <> 'lang:en'")
def plan_costs(spark, sf_dir):
    """What each clause may match at most, from the dictionary alone."""
    index = documents(spark, sf_dir)
    freqs = index.doc_freqs({("text", "the"), ("text", "pathetic"), ("lang", "en")})
    tree = planner.plan_tree(_costs, freqs, index.num_docs)
    rows = [("all", tree["cost"]), *((c["query"], c["cost"]) for c in tree["children"])]
    return spark.createDataFrame(rows, "query string, cost long")


PROFILED = {"one term": ast.Term(1.0, "text", "pathetic"), "two terms": ast.Match(1.0, "text", "pathetic the"), "conjunction": ast.Match(1.0, "text", "pathetic the", "and"), "prefix": ast.Prefix(1.0, "text", "path"), "fuzzy": ast.Fuzzy(1.0, "text", "patetic", edits=1)}


def _profile_sql() -> str:
    terms = {"one term": "term = 'pathetic'", "two terms": "term IN ('pathetic', 'the')", "conjunction": "term IN ('pathetic', 'the')", "prefix": "starts_with(term, 'path')", "fuzzy": "levenshtein(term, 'patetic') <= 1"}
    rows = [f"SELECT '{n}' AS label, CAST((SELECT count(*) FROM ({oracle.clause(q)})) AS BIGINT) AS candidates, CAST(count(*) AS BIGINT) AS terms, CAST(coalesce(sum(doc_freq), 0) AS BIGINT) AS postings FROM dict WHERE field = 'text' AND {terms[n]}" for n, q in PROFILED.items()]
    return f"{oracle.tables()} {' UNION ALL '.join(rows)}"


@register("work_profile", _profile_sql())
def work_profile(spark, sf_dir):
    """Candidates, terms and postings that queries of several kinds touch."""
    index, out = documents(spark, sf_dir), None
    for label, q in PROFILED.items():
        plan = Compiler(index).compile(q)
        freqs = index.doc_freqs(plan.terms)
        row = plan.frame.agg(F.count("*").alias("candidates")).select(F.lit(label).alias("label"), "candidates", F.lit(len(freqs)).cast("long").alias("terms"), F.lit(sum(freqs.values())).cast("long").alias("postings"))
        out = row if out is None else out.unionAll(row)
    return out


# -- segment files ------------------------------------------------------------------


@register("segment_term_files", f"{oracle.tables()} SELECT field, term, doc_id, freq, array_to_string(positions, ',') AS positions FROM post")
def segment_term_files(spark, sf_dir):
    """All postings as term files of segments, read back."""
    post = documents(spark, sf_dir).postings
    made = files.term_files(post, F.floor(F.col("doc_id") / 2048))
    back = files.read_term_files(made).where("error IS NULL")
    return back.select("field", "term", "doc_id", "freq", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@register("segment_stores", "SELECT CAST(doc_id AS VARCHAR) AS id, lang, n_chars FROM documents")
def segment_stores(spark, sf_dir):
    """Documents as store files, one of them damaged beside its whole copy; damage is set apart, and the last file of an id counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    made = files.store_files(docs, F.floor(F.col("doc_id") / 500), "doc_id")
    spoilt = made.select(F.concat("name", F.lit(".late")).alias("name"), F.concat(F.col("content"), F.lit(b"\0")).alias("content"))
    kept = files.newest_documents(files.read_stores(made.unionByName(spoilt)))
    return kept.select("id", F.from_json("source", "doc_id long, lang string, n_chars long").alias("s")).select("id", "s.lang", "s.n_chars")


@register("hex_terms", f"{oracle.tables('part')} SELECT term, lower(hex(term)) AS bytes FROM dict WHERE field = 'p_name'")
def hex_terms(spark, sf_dir):
    return vocabulary(spark, sf_dir).select("term", F.lower(F.hex(F.col("term").cast("binary"))).alias("bytes"))


@register("postings_bytes", f"{oracle.tables('part')} SELECT term, CAST(count(*) AS BIGINT) AS entries FROM post WHERE field = 'p_name' GROUP BY term")
def postings_bytes(spark, sf_dir):
    rows = parts(spark, sf_dir).postings.where("field = 'p_name'").select("field", "term", F.col("doc_id").cast("long").alias("doc_id"), "freq")
    return encode_postings(rows).groupBy("term").agg(F.sum("entries").alias("entries"))


# -- clusters -----------------------------------------------------------------------


def _dealt(spark, sf_dir):
    return Compiler(documents(spark, sf_dir)).compile(_question).frame.withColumn("shard", ranking.shard_of(F.col("doc_id").cast("string"), SHARDS))


_answers = f"{oracle.tables()}, f AS (SELECT doc_id, score, {_shard} AS shard FROM ({oracle.clause(_question)}))"


@register("cluster_partial", f"{_answers} SELECT doc_id, shard, round(score, 6) AS score, lang FROM (SELECT * FROM f WHERE shard <> 0 ORDER BY score DESC, doc_id LIMIT 10) JOIN documents USING (doc_id)")
def cluster_partial(spark, sf_dir):
    """A search after the only node of shard 0 has failed: the other shards answer."""
    cluster = Cluster(SHARDS, 0, SHARDS)
    cluster.route(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    cluster.fail(cluster.of(0)[0].node)
    hits, report = cluster.search(_dealt(spark, sf_dir), table(spark, sf_dir, "documents"), 10, ["lang"])
    if not report["partial"] or report["health"] != "red":
        raise ValueError(report)
    return hits.withColumn("score", F.round("score", 6))


@register("fetch_bytes", f"{_answers}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY score DESC, doc_id) AS r FROM f) WHERE r <= 10), w AS (SELECT doc_id FROM a ORDER BY score DESC, doc_id LIMIT 10) SELECT CAST(sum(length(CAST(doc_id AS VARCHAR)) + 8) AS BIGINT) AS query_bytes, CAST(sum(CASE WHEN doc_id IN (SELECT doc_id FROM w) THEN strlen(text) ELSE 0 END) AS BIGINT) AS fetched_bytes, CAST(sum(strlen(text)) AS BIGINT) AS everything_bytes FROM a JOIN documents USING (doc_id)")
def fetched(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("bytes"))
    return fetch_bytes(_dealt(spark, sf_dir), sizes, 10)


# -- lifecycle ------------------------------------------------------------------------
_latest = "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'"
_SCHEMA = "seq long, op string, id long, value double"


def _log(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", lifecycle.DELETE).otherwise(lifecycle.INDEX)
    return e.select(F.col("event_id").alias("seq"), kind.alias("op"), F.col("user_id").alias("id"), "value")


def _documents(spark, root) -> DataFrame:
    return lifecycle.live(spark, root, _SCHEMA).select(F.col("id").alias("user_id"), F.col("seq").alias("event_id"), "value")


@register("segment_merge", _latest)
def segment_merge(spark, sf_dir):
    """The log as eight segments in its order, merged by tier until no tier is full."""
    log, root = _log(spark, sf_dir), fresh(spark, "segments")
    lifecycle.load(log, root, max(1, -(-log.count() // 8)))
    if not lifecycle.merge(spark, root, _SCHEMA):
        raise ValueError("nothing was merged")
    while lifecycle.merge(spark, root, _SCHEMA):
        pass
    return _documents(spark, root)


@register("segment_recover", _latest)
def segment_recover(spark, sf_dir):
    """Half of the log committed, a segment then lost, and all of it recovered from the log."""
    from quillon.sources import folders

    log, root = _log(spark, sf_dir), fresh(spark, "segments")
    middle = log.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    early = log.where(F.col("seq") <= middle)
    lifecycle.load(early, root, max(1, -(-early.count() // 4)))
    lifecycle.commit(spark, root, _SCHEMA)
    folders.remove(spark, f"{root}/segments/segment_id=1")
    if lifecycle.recover(spark, root, _SCHEMA, log)["quarantined"] != [1]:
        raise ValueError("the loss wasn't seen")
    return _documents(spark, root)


# -- the JSON dialect --------------------------------------------------------------------
DSL = {
    "dsl_match": ({"match": {"text": "the pathetic the"}}, ast.Match(1.0, "text", "the pathetic")),
    "dsl_bool": ({"bool": {"must": {"term": {"text": "the"}}, "should": [{"term": {"text": "stupid"}}], "filter": [{"term": {"lang": "en"}}, {"range": {"n_chars": {"gte": 500, "lt": 4000}}}], "must_not": {"prefix": {"text": "path"}}}}, ast.Bool(must=(ast.Term(1.0, "text", "the"),), should=(ast.Term(1.0, "text", "stupid"),), filter=(ast.Term(1.0, "lang", "en"), ast.Range(0.0, "n_chars", gte=500, lt=4000)), must_not=(ast.Prefix(1.0, "text", "path", most=50),))),
    "dsl_fuzzy": ({"fuzzy": {"text": {"value": "patetic", "fuzziness": 1}}}, ast.Fuzzy(1.0, "text", "patetic", edits=1, prefix=1, most=50)),
    "dsl_wildcard": ({"wildcard": {"text": "pa*ic"}}, ast.Wildcard(1.0, "text", "pa*ic", most=50)),
    "dsl_phrase": ({"phrase": {"text": "of the"}}, ast.Phrase(0.0, "text", "of the")),
    "dsl_only_must_not": ({"bool": {"must_not": {"term": {"text": "the"}}}}, ast.MatchNone()),
}
for _name, (_body, _same) in DSL.items():

    def _decoded(spark, sf_dir, body=_body):
        return scores(Compiler(documents(spark, sf_dir)).compile(decode({"query": body})[0]).frame)

    register(_name, oracle.search(_same))(_decoded)


@register("engine_range", "SELECT id, score FROM (SELECT CAST(p_partkey AS VARCHAR) AS id, 0.0::DOUBLE AS score FROM part WHERE p_retailprice BETWEEN 920 AND 930 ORDER BY id LIMIT 25)")
def engine_range(spark, sf_dir):
    """Documents taken in and asked through the service, by a request."""
    engine = Engine(spark)
    p = table(spark, sf_dir, "part")
    engine.ingest(p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price")))
    status, body = engine.handle("POST", "/_search", '{"query": {"range": {"price": {"gte": 920, "lte": 930}}}, "size": 25}')
    if status != 200:
        raise ValueError(body)
    return spark.createDataFrame([(h["id"], h["score"]) for h in body["hits"]], "id string, score double")


search("q_ids", ast.Bool(must=(ast.Ids(2.0, (3, 17, 400, 999_999)),), should=(ast.Term(1.0, "text", "the"),)))
search("q_phrase_three", ast.Phrase(1.0, "text", "the of the", 6))
