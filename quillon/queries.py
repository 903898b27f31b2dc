"""The search engine's queries over the driver's tables, with their oracles."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon import oracle
from quillon.functions import analysis, codec
from quillon.functions.bm25 import Bm25, idf_column
from quillon.functions.script import compile_script
from quillon.operators import ranking
from quillon.operators.expand import condition
from quillon.operators.index import Index, Mapping
from quillon.operators.ordinals import ordinals
from quillon.plans import ast
from quillon.plans.compile import Compiler
from quillon.plans.parser import Parser
from quillon.sources.folders import exists, fresh, stamp
from quillon.streaming import lifecycle

DOCUMENTS = Mapping("doc_id", {"text": analysis.DEFAULT}, ("lang", "source"), ("n_chars",))
PARTS = Mapping("p_partkey", {"p_name": analysis.DEFAULT}, ("p_brand", "p_type"), ("p_size", "p_retailprice"))
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of indexes that this process has written, by application, table and the table's time of change.
_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, mapping: Mapping) -> Index:
    """The stored index of a table: written where the first query needs it, read by all others."""
    path, docs = f"{sf_dir}/{name}.parquet", table(spark, sf_dir, name)
    key = (spark.sparkContext.applicationId, path, stamp(spark, path))
    if key not in _STORED or not exists(spark, f"{_STORED[key]}/stats/_SUCCESS"):
        folder = fresh(spark, f"index-{name}")
        Index(docs, mapping).write(folder)
        _STORED[key] = folder
    return Index.read(docs, mapping, _STORED[key])


def documents(spark: SparkSession, sf_dir: str) -> Index:
    return stored(spark, sf_dir, "documents", DOCUMENTS)


def parts(spark: SparkSession, sf_dir: str) -> Index:
    return stored(spark, sf_dir, "part", PARTS)


def register(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def scores(plan_frame: DataFrame) -> DataFrame:
    return plan_frame.select("doc_id", F.round("score", 6).alias("score"))


def search(name: str, q: ast.Query, corpus: str = "documents", k: int | None = None, bm25: Bm25 = Bm25()) -> None:  # noqa: B008
    """Register a query tree; without k all matches are returned."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = documents(spark, sf_dir) if corpus == "documents" else parts(spark, sf_dir)
        frame = Compiler(index, bm25).compile(q).frame
        return scores(ranking.top(frame, k) if k else frame)

    register(name, oracle.search(q, corpus, k, bm25.k1, bm25.b))(run)


T = lambda v, boost=1.0: ast.Term(boost, "text", v)
N = lambda v, boost=1.0: ast.Term(boost, "p_name", v)
LANG = lambda v: ast.Term(1.0, "lang", v)

# -- clauses ----------------------------------------------------------------
search("q_match_all", ast.MatchAll(2.0))
search("q_match_none", ast.MatchNone())
search("q_term", T("worthless"))
search("q_term_keyword", LANG("de"))
search("q_terms", ast.Terms(1.0, "text", ("worthless", "pathetic", "stupid")))
search("q_match_or", ast.Match(1.0, "text", "the pathetic clown"))
search("q_match_and", ast.Match(1.0, "text", "the and of", "and"))
search("q_match_msm", ast.Match(1.0, "text", "the pathetic and stupid", minimum=3))
search("q_match_duplicates", ast.Match(1.0, "text", "the the pathetic", minimum=2))
search("q_phrase", ast.Phrase(1.0, "text", "of the"))
search("q_phrase_slop", ast.Phrase(1.0, "text", "the of and", 4))
search("q_phrase_part", ast.Phrase(2.0, "p_name", "small ring"), "part")
search("q_prefix", ast.Prefix(1.0, "text", "path"))
search("q_wildcard", ast.Wildcard(1.0, "text", "wor?hl*s"))
search("q_regexp", ast.Regexp(1.0, "text", "(path|stup).*(ic|id)"))
search("q_fuzzy_1", ast.Fuzzy(1.0, "text", "patetic", edits=1))
search("q_fuzzy_2", ast.Fuzzy(1.0, "text", "wrthles", edits=2))
search("q_fuzzy_prefix", ast.Fuzzy(1.0, "text", "stupit", edits=2, prefix=3))
search("q_fuzzy_auto", ast.Fuzzy(1.0, "text", "clowm"))
search("q_expansion_clip", ast.Prefix(1.0, "text", "th", most=20))
search("q_range", ast.Range(1.5, "n_chars", gte=1000, lt=3000))
search("q_range_open", ast.Range(1.0, "n_chars", gt=5000))
search("q_range_price", ast.Range(1.0, "p_retailprice", gte=920, lte=950), "part")
search("q_term_range", ast.Range(1.0, "source", gte="src1", lt="src3"))
search("q_boost", ast.Bool(2.0, should=(T("the", 3.0), T("stupid", 0.5))))
search("q_bool_must", ast.Bool(must=(T("the"), T("and"))))
search("q_bool_filter", ast.Bool(must=(T("the"),), filter=(LANG("en"), ast.Range(1.0, "n_chars", lt=2000))))
search("q_bool_should", ast.Bool(should=(T("the"), T("der"), T("que"))))
search("q_bool_should_msm", ast.Bool(should=(T("the"), T("of"), T("stupid"), T("moron")), minimum=3))
search("q_bool_required_optional", ast.Bool(must=(T("the"),), should=(T("stupid"), T("moron"))))
search("q_bool_required_msm", ast.Bool(must=(T("the"),), should=(T("stupid"), T("moron"), T("idiot")), minimum=1))
search("q_bool_must_not", ast.Bool(must=(T("the"),), must_not=(T("of"),)))
search("q_bool_only_must_not", ast.Bool(must_not=(T("the"), LANG("de"))))
search("q_bool_empty", ast.Bool())
search("q_bool_nested", ast.Bool(must=(ast.Bool(should=(T("the"), T("der"))),), should=(ast.Bool(must=(T("and"), T("of")), boost=0.5),), must_not=(ast.Bool(must=(LANG("en"), ast.Range(1.0, "n_chars", gt=4000))),)))
search("set_and", ast.Bool(must=(N("small"), N("ring"))), "part")
search("set_or", ast.Bool(should=(N("small"), N("ring"))), "part")
search("set_not", ast.Bool(must=(N("small"),), must_not=(N("ring"),)), "part")
search("set_reqopt", ast.Bool(must=(N("small"),), should=(N("ring"),)), "part")
search("topk", ast.Match(1.0, "text", "the pathetic worthless stupid"), k=10)
search("bm25_b0", ast.Match(1.0, "text", "the pathetic"), bm25=Bm25(b=0.0))
search("bm25_b1", ast.Match(1.0, "text", "the pathetic"), bm25=Bm25(k1=2.0, b=1.0))

# -- the query-string language ----------------------------------------------
PARSER = Parser(("text",), ("text",), ("n_chars",))
QUERY_STRINGS = {
    "qs_one_term": "pathetic", "qs_two_terms": "pathetic stupid", "qs_and": "pathetic AND the", "qs_fields": "text:the AND lang:en",
    "qs_phrase": '"of the"', "qs_sloppy_phrase": '"of and"~3', "qs_prefix": "worth*", "qs_wildcard": "path*ic", "qs_fuzzy": "patetic~1",
    "qs_range": "n_chars:[1000 TO 2000]", "qs_exclusion": "the -lang:en", "qs_boost": "text:stupid^3 source:src1",
    "qs_grouped": "(stupid OR moron) AND lang:en", "qs_missing": "terraform AND the", "qs_compare": "the AND n_chars:>=4000", "qs_regexp": "/stup.*/",
}
for _name, _text in QUERY_STRINGS.items():
    search(_name, PARSER.parse(_text).query)


# -- scripts -----------------------------------------------------------------
SCRIPTS = {
    "q_script_boost": ("_score * (1 + n_chars / 5000)", "s * (1 + n_chars / 5000.0)"),
    "q_script_ternary": ("n_chars > 2000 ? _score * 2 : _score", "CASE WHEN n_chars > 2000 THEN s * 2 ELSE s END"),
    "q_script_funcs": ("min(log1p(n_chars), 7) + max(sqrt(_score), floor(_score)) + round(2.5)", "least(ln(1.0 + n_chars), 7) + greatest(sqrt(s), floor(s)) + 3"),
    "q_script_divzero": ("_score / 0 + n_chars % 0 + missing + 1", "0 * s + 1.0"),
    "q_script_logic": ("(n_chars > 1000 && _score > 1) || n_chars < 100", "CASE WHEN (n_chars > 1000 AND s > 1) OR n_chars < 100 THEN 1.0 ELSE 0.0 END"),
}
for _name, (_source, _sql) in SCRIPTS.items():
    _inner = ast.Match(1.0, "text", "pathetic the")

    def _script(spark, sf_dir, source=_source, inner=_inner):
        return scores(Compiler(documents(spark, sf_dir)).compile(ast.Script(1.0, inner, source)).frame)

    register(_name, f"{oracle.tables()} SELECT doc_id, round({_sql}, 6) AS score FROM (SELECT doc_id, score AS s FROM ({oracle.clause(_inner)})) JOIN documents USING (doc_id)")(_script)


# -- the index ---------------------------------------------------------------
@register("index_postings", f"{oracle.tables()} SELECT field, term, doc_id, freq, array_to_string(positions, ',') AS positions FROM post")
def index_postings(spark, sf_dir):
    return documents(spark, sf_dir).postings.select("field", "term", "doc_id", "freq", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@register("term_postings", f"{oracle.tables()} SELECT doc_id, freq FROM post WHERE field = 'text' AND term = 'pathetic'")
def term_postings(spark, sf_dir):
    return documents(spark, sf_dir).postings.where("field = 'text' AND term = 'pathetic'").select("doc_id", "freq")


@register("term_stats", f"{oracle.tables()} SELECT field, term, doc_freq, total_term_freq FROM dict")
def term_stats(spark, sf_dir):
    return documents(spark, sf_dir).dictionary.select("field", "term", "doc_freq", "total_term_freq")


@register("field_stats", f"{oracle.tables()} SELECT field, CAST(docs_with_field AS BIGINT) AS docs_with_field, CAST(sum_length AS BIGINT) AS sum_length, round(sum_length / docs_with_field, 6) AS avg_length, max_length, CAST(vocabulary AS BIGINT) AS vocabulary, CAST(postings AS BIGINT) AS postings FROM (SELECT field, count(*) AS docs_with_field, sum(length) AS sum_length, max(length) AS max_length FROM norm GROUP BY field) JOIN (SELECT field, count(*) AS vocabulary, sum(doc_freq) AS postings FROM dict GROUP BY field) USING (field)")
def field_stats(spark, sf_dir):
    return documents(spark, sf_dir).field_stats.withColumn("avg_length", F.round("avg_length", 6))


@register("vocabulary", f"{oracle.tables('part')} SELECT DISTINCT term FROM dict WHERE field = 'p_name'")
def vocabulary(spark, sf_dir):
    return parts(spark, sf_dir).dictionary.where("field = 'p_name'").select("term")


@register("vocabulary_merged", f"{oracle.tables('part')} SELECT DISTINCT term FROM dict WHERE field IN ('p_name', 'p_brand')")
def vocabulary_merged(spark, sf_dir):
    return parts(spark, sf_dir).dictionary.where("field IN ('p_name', 'p_brand')").select("term").distinct()


@register("naive_scan", f"{oracle.tables()} SELECT doc_id FROM post WHERE field = 'text' AND term = 'stupid'")
def naive_scan(spark, sf_dir):
    return documents(spark, sf_dir).tokens.where((F.col("field") == "text") & F.array_contains("terms", "stupid")).select("doc_id")


@register("live_ids", "SELECT doc_id FROM documents")
def live_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id")


@register("upsert_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, sf_dir):
    """The last version of each key; the maximum of a struct combines before the shuffle."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("v")).select("user_id", "v.event_id", "v.event_type")


@register("delete_antijoin", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_antijoin(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("toxic = 1")
    return table(spark, sf_dir, "documents").join(gone, "doc_id", "left_anti").select("doc_id", "source")


@register("segment_ingest", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def segment_ingest(spark, sf_dir):
    """A log streamed into segments, merged, then read: errors delete their user's document, other events replace it."""
    ops = spark.readStream.schema("event_id long, user_id long, event_type string, value double").parquet(f"{sf_dir}/event[s].parquet")
    kind = F.when(F.col("event_type") == "error", lifecycle.DELETE).otherwise(lifecycle.INDEX)
    root, schema = fresh(spark, "segments"), "seq long, op string, id long, value double"
    lifecycle.ingest(ops.select(F.col("event_id").alias("seq"), kind.alias("op"), F.col("user_id").alias("id"), "value"), root).awaitTermination()
    lifecycle.merge(spark, root, schema)
    return lifecycle.live(spark, root, schema).select(F.col("id").alias("user_id"), F.col("seq").alias("event_id"), "value")


# -- analysis ----------------------------------------------------------------
def terms_query(name: str, source: str, column: str, key: str, config: analysis.AnalyzerConfig, sql: str) -> None:
    """All terms of a column by a configuration, joined by blanks. sql: a DuckDB list expression."""

    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(F.col(key).alias("id"), F.array_join(config.terms(F.col(column)), " ").alias("terms"))

    register(name, f"SELECT {key} AS id, coalesce(array_to_string({sql}, ' '), '') AS terms FROM {source}")(run)


_A = analysis.AnalyzerConfig
_words = f"regexp_extract_all(lower(text), '{oracle.WORD}')"
_stop = f"list_filter({_words}, lambda t: t NOT IN ({', '.join(map(oracle.quoted, analysis.STOPWORDS))}))"
terms_query("analyze_standard", "documents", "text", "doc_id", analysis.DEFAULT, _words)
terms_query("tok_whitespace", "documents", "text", "doc_id", _A(tokenizer="whitespace", lowercase=False), r"regexp_extract_all(text, '\S+')")
terms_query("tok_letter", "documents", "text", "doc_id", _A(tokenizer="letter", lowercase=False), r"regexp_extract_all(text, '\p{L}+')")
terms_query("tok_unicode", "documents", "text", "doc_id", _A(tokenizer="unicode", lowercase=False), r"regexp_extract_all(text, '[\p{L}\p{Nd}]+')")
terms_query("tok_keyword", "part", "p_name", "p_partkey", analysis.KEYWORD, "list_filter([p_name], lambda t: t <> '')")
terms_query("tok_path", "pages", "url", "page_id", _A(tokenizer="path", lowercase=False), "list_transform(range(1, len(list_filter(string_split(url, '/'), lambda p: p <> '')) + 1), lambda i: array_to_string(list_slice(list_filter(string_split(url, '/'), lambda p: p <> ''), 1, i), '/'))")
terms_query("stopwords", "documents", "text", "doc_id", replace(analysis.DEFAULT, stopwords=True), _stop)
_fold = "replace(replace(replace(replace(replace(translate({0}, '" + analysis.FOLDS[0] + "', '" + analysis.FOLDS[1] + "'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'Æ', 'AE'), 'Œ', 'OE')"
terms_query("fold_ascii", "documents", "text", "doc_id", replace(analysis.DEFAULT, folding=True), f"list_transform({_words}, lambda t: {_fold.format('t')})")
terms_query("split_inner", "documents", "text", "doc_id", replace(analysis.DEFAULT, split=True), f"list_filter(flatten(list_transform({_words}, lambda t: regexp_split_to_array(t, '[-_.]'))), lambda t: t <> '')")
terms_query("edge_ngram", "part", "p_name", "p_partkey", replace(analysis.DEFAULT, edge_ngram=(2, 5)), f"flatten(list_transform(list_filter({_words.replace('text', 'p_name')}, lambda t: length(t) >= 2), lambda t: list_transform(range(2, least(5, length(t)) + 1), lambda n: left(t, n))))")
_light = "t"
for _suffix, _instead in reversed(analysis.LIGHT_RULES):
    _short = f"left(t, length(t) - {len(_suffix)}) || '{_instead}'"
    _light = f"CASE WHEN suffix(t, '{_suffix}') AND length({_short}) >= 2 THEN {_short} ELSE {_light} END"
terms_query("stem_light", "documents", "text", "doc_id", replace(analysis.DEFAULT, stemmer="light"), f"list_transform({_words}, lambda t: CASE WHEN length(t) >= 4 THEN {_light} ELSE t END)")
_strip = "regexp_replace(html, '<[^>]*>', ' ', 'g')"
for _entity, _char in analysis.ENTITIES.items():
    _strip = f"replace({_strip}, '{_entity}', {oracle.quoted(_char)})"
terms_query("html_strip", "pages", "html", "page_id", _A(char_filters=("html_strip",)), f"regexp_extract_all(lower({_strip}), '{oracle.WORD}')")
_mapped = "text"
for _char, _word in analysis.SYMBOLS.items():
    _mapped = f"replace({_mapped}, '{_char}', '{_word}')"
terms_query("map_symbols", "documents", "text", "doc_id", _A(char_filters=("map_symbols",)), f"regexp_extract_all(lower({_mapped}), '{oracle.WORD}')")
terms_query("strip_punctuation", "documents", "text", "doc_id", _A(char_filters=("strip_punctuation",), tokenizer="whitespace"), r"regexp_extract_all(lower(regexp_replace(text, '\p{P}', ' ', 'g')), '\S+')")


# -- the dictionary ----------------------------------------------------------
def dictionary_query(name: str, q: ast.Expansion) -> None:
    def run(spark, sf_dir):
        d = documents(spark, sf_dir).dictionary
        return d.where((F.col("field") == q.field) & condition(q, F.col("term"))).select("term", "doc_freq").orderBy("term").limit(q.most)

    register(name, f"{oracle.tables()} SELECT term, doc_freq FROM dict WHERE field = '{q.field}' AND {oracle.fits(q)} ORDER BY term LIMIT {q.most}")(run)


dictionary_query("dict_prefix", ast.Prefix(1.0, "text", "ther", most=100))
dictionary_query("dict_wildcard", ast.Wildcard(1.0, "text", "th?r*on"))
dictionary_query("dict_regexp", ast.Regexp(1.0, "text", "(er|in)+"))
dictionary_query("dict_fuzzy", ast.Fuzzy(1.0, "text", "thering", edits=2))


@register("dict_range", f"{oracle.tables()} SELECT term, doc_freq FROM dict WHERE field = 'text' AND term >= 'pa' AND term < 'po'")
def dict_range(spark, sf_dir):
    return documents(spark, sf_dir).dictionary.where("field = 'text' AND term >= 'pa' AND term < 'po'").select("term", "doc_freq")


@register("fuzzy_auto", f"{oracle.tables('part')} SELECT term, CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END AS edits FROM dict WHERE field = 'p_name'")
def fuzzy_auto(spark, sf_dir):
    n = F.length("term")
    return vocabulary(spark, sf_dir).select("term", F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2).alias("edits"))


@register("expansion_clip", f"{oracle.tables()} SELECT CAST(least(count(*), 50) AS BIGINT) AS kept, CAST(count(*) AS BIGINT) AS total, count(*) > 50 AS clipped FROM dict WHERE field = 'text' AND starts_with(term, 'th')")
def expansion_clip(spark, sf_dir):
    d = documents(spark, sf_dir).dictionary.where("field = 'text' AND startswith(term, 'th')")
    n = F.count("*")
    return d.agg(F.least(n, F.lit(50)).alias("kept"), n.alias("total"), (n > 50).alias("clipped"))


@register("edit_distance", f"{oracle.tables('part')} SELECT term, CAST(levenshtein(term, 'polished') AS INTEGER) AS distance FROM dict WHERE field = 'p_name'")
def edit_distance(spark, sf_dir):
    return vocabulary(spark, sf_dir).select("term", F.levenshtein("term", F.lit("polished")).alias("distance"))


@register("fuzzy_osa", f"{oracle.tables()} SELECT term, doc_freq FROM dict WHERE field = 'text' AND damerau_levenshtein(term, 'patehtic') <= 1")
def fuzzy_osa(spark, sf_dir):
    """Terms within one edit, a swap of neighbours counting one. Within one edit this is the distance that SQL has."""
    q = ast.Fuzzy(1.0, "text", "patehtic", edits=1, transpositions=True)
    return documents(spark, sf_dir).dictionary.where((F.col("field") == "text") & condition(q, F.col("term"))).select("term", "doc_freq")


@register("trie_node_count", f"{oracle.tables('part')} SELECT CAST(count(DISTINCT left(term, n)) + 1 AS BIGINT) AS nodes FROM (SELECT term, unnest(range(1, length(term) + 1)) AS n FROM dict WHERE field = 'p_name')")
def trie_node_count(spark, sf_dir):
    prefixes = vocabulary(spark, sf_dir).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda n: F.left("term", n))).alias("p"))
    return prefixes.agg((F.count_distinct("p") + 1).alias("nodes"))


def _ordinals(spark, sf_dir) -> DataFrame:
    """term and ordinal."""
    return ordinals(vocabulary(spark, sf_dir), "term")


_ordinal_sql = f"{oracle.tables('part')}, o AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS ordinal FROM dict WHERE field = 'p_name')"


@register("term_ordinal", f"{_ordinal_sql} SELECT term, CAST(ordinal AS BIGINT) AS ordinal FROM o")
def term_ordinal(spark, sf_dir):
    return _ordinals(spark, sf_dir)


@register("dict_blocks", f"{_ordinal_sql} SELECT CAST(ordinal // 16 AS BIGINT) AS block, min(term) AS first, max(term) AS last, CAST(count(*) AS BIGINT) AS terms, CAST(sum(length(term)) AS BIGINT) AS raw_bytes FROM o GROUP BY ALL")
def dict_blocks(spark, sf_dir):
    o = _ordinals(spark, sf_dir).withColumn("block", F.floor(F.col("ordinal") / 16))
    return o.groupBy("block").agg(F.min("term").alias("first"), F.max("term").alias("last"), F.count("*").alias("terms"), F.sum(F.length("term")).cast("long").alias("raw_bytes"))


# -- ranking -----------------------------------------------------------------
@register("bm25_idf", f"{oracle.tables('part')} SELECT term, round(ln(1 + ((SELECT n FROM total) - doc_freq + 0.5) / (doc_freq + 0.5)), 6) AS idf FROM dict WHERE field = 'p_name'")
def bm25_idf(spark, sf_dir):
    index = parts(spark, sf_dir)
    d = index.dictionary.where("field = 'p_name'")
    return d.select("term", F.round(idf_column(F.lit(float(index.num_docs)), F.col("doc_freq").cast("double")), 6).alias("idf"))


search("bm25_score", ast.Terms(1.0, "p_name", ("small", "ring", "polished")), "part")


@register("bm25_maxscore", f"{oracle.tables('part')} SELECT term, round(max(idf) * max(freq) * 2.2 / (max(freq) + 1.2 * (0.25 + 0.75 * min(length) / max(a))), 6) AS bound FROM scored WHERE field = 'p_name' GROUP BY term")
def bm25_maxscore(spark, sf_dir):
    """The bound of each term: its largest frequency in its shortest document; the dictionary holds both."""
    index = parts(spark, sf_dir)
    rows = index.dictionary.where("field = 'p_name'")
    bound = Bm25().score(F.col("max_freq"), F.col("min_length"), index.average("p_name"), idf_column(F.lit(float(index.num_docs)), F.col("doc_freq").cast("double")))
    return rows.select("term", F.round(bound, 6).alias("bound"))


_explained = "term IN ('pathetic', 'stupid', 'the') AND field = 'text'"


@register("explain_terms", f"{oracle.tables()} SELECT doc_id, term, freq AS tf, round(idf, 6) AS idf, round(length / a, 6) AS length_ratio, round(1.2 * (0.25 + 0.75 * length / a), 6) AS norm, round(s / idf, 6) AS tf_component, round(s, 6) AS score FROM scored WHERE {_explained}")
def explain_terms(spark, sf_dir):
    out = ranking.explain_terms(documents(spark, sf_dir), "text", ["pathetic", "stupid", "the"])
    return out.select("doc_id", "term", "tf", *[F.round(c, 6).alias(c) for c in ("idf", "length_ratio", "norm", "tf_component", "score")])


@register("matched_terms", f"{oracle.tables()} SELECT doc_id, array_to_string(list(DISTINCT field || ':' || term ORDER BY field || ':' || term), ' ') AS matched FROM post WHERE field = 'text' AND term IN ('pathetic', 'stupid', 'moron') GROUP BY doc_id")
def matched_terms(spark, sf_dir):
    index = documents(spark, sf_dir)
    hits = Compiler(index).compile(ast.Terms(1.0, "text", ("pathetic", "stupid", "moron"))).frame
    out = ranking.matched_terms(index, hits, [("text", t) for t in ("pathetic", "stupid", "moron")])
    return out.select("doc_id", F.array_join("matched_terms", " ").alias("matched"))


@register("rank_signals", f"{oracle.tables()} SELECT doc_id, CAST(sum(freq) AS BIGINT) AS tf_sum, round(sum(idf), 6) AS idf_sum, round(10.0 / max(length), 6) AS brevity, round(sum(s), 6) AS bm25 FROM scored WHERE {_explained} GROUP BY doc_id")
def rank_signals(spark, sf_dir):
    rows = ranking.explain_terms(documents(spark, sf_dir), "text", ["pathetic", "stupid", "the"])
    return rows.groupBy("doc_id").agg(F.sum("tf").alias("tf_sum"), F.round(F.sum("idf"), 6).alias("idf_sum"), F.round(10 / F.max("length"), 6).alias("brevity"), F.round(F.sum("score"), 6).alias("bm25"))


@register("bm25_saturation", "SELECT CAST(tf AS BIGINT) AS tf, round(tf * 2.2 / (tf + 1.2), 6) AS saturation FROM range(0, 21) t(tf)")
def bm25_saturation(spark, sf_dir):
    return spark.range(21).select(F.col("id").alias("tf"), F.round(F.col("id") * 2.2 / (F.col("id") + 1.2), 6).alias("saturation"))


@register("bm25_idf_curve", "SELECT CAST(df AS BIGINT) AS df, round(ln(1 + (1000 - df + 0.5) / (df + 0.5)), 6) AS idf FROM range(1, 1001) t(df)")
def bm25_idf_curve(spark, sf_dir):
    return spark.range(1, 1001).select(F.col("id").alias("df"), F.round(idf_column(F.lit(1000.0), F.col("id").cast("double")), 6).alias("idf"))


_cheap = ast.Match(1.0, "text", "the of and")
_window = f"{oracle.tables()}, c AS (SELECT doc_id, score FROM ({oracle.clause(_cheap)})), w AS (SELECT * FROM c ORDER BY score DESC, doc_id LIMIT 50), dear AS (SELECT doc_id, score * (1 + n_chars / 10000.0) AS score, doc_id IN (SELECT doc_id FROM w) AS inside FROM c JOIN documents USING (doc_id))"


def _rescored(spark, sf_dir, window):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    frame = Compiler(documents(spark, sf_dir)).compile(_cheap).frame
    score = compile_script("_score * (1 + n_chars / 10000)").column({"_score": F.col("score"), "n_chars": F.col("n_chars")})
    return ranking.rescore(frame, window, 10, score, docs) if window else ranking.top(frame.join(docs, "doc_id").select("doc_id", score.alias("score")), 10)


@register("rescore_window", f"{_window} SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM dear WHERE inside ORDER BY score DESC, doc_id LIMIT 10)")
def rescore_window(spark, sf_dir):
    return scores(_rescored(spark, sf_dir, 50))


@register("rescore_missed", f"{_window} SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM dear ORDER BY score DESC, doc_id LIMIT 10) WHERE doc_id NOT IN (SELECT doc_id FROM (SELECT * FROM dear WHERE inside ORDER BY score DESC, doc_id LIMIT 10))")
def rescore_missed(spark, sf_dir):
    return scores(_rescored(spark, sf_dir, 0).join(_rescored(spark, sf_dir, 50), "doc_id", "left_anti"))


# -- points ------------------------------------------------------------------
@register("point_bounds", "SELECT CAST(count(*) FILTER (p_retailprice < 950) AS BIGINT) AS lower, CAST(count(*) FILTER (p_retailprice <= 950) AS BIGINT) AS upper FROM part")
def point_bounds(spark, sf_dir):
    v = F.col("p_retailprice")
    return table(spark, sf_dir, "part").agg(F.count_if(v < 950).alias("lower"), F.count_if(v <= 950).alias("upper"))


@register("geo_box", "SELECT vec_id FROM embeddings WHERE embedding[1] BETWEEN -0.1 AND 0.1 AND embedding[2] BETWEEN -0.05 AND 0.15")
def geo_box(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].alias("lat"), F.col("embedding")[1].alias("lon"))
    q = ast.GeoBox(1.0, bottom=-0.1, top=0.1, left=-0.05, right=0.15)
    return Compiler(Index(points, Mapping("vec_id"))).compile(q).frame.select(F.col("doc_id").alias("vec_id"))


@register("region_ops", "SELECT a.label AS a, b.label AS b, a.lo <= b.hi AND b.lo <= a.hi AS intersects, a.lo <= b.lo AND b.hi <= a.hi AS contains FROM (SELECT label, min(embedding[1]) AS lo, max(embedding[1]) AS hi FROM embeddings GROUP BY label) a JOIN (SELECT label, min(embedding[1]) AS lo, max(embedding[1]) AS hi FROM embeddings GROUP BY label) b ON b.label = a.label + 1")
def region_ops(spark, sf_dir):
    x = F.col("embedding")[0]
    box = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    a, b = box.select(F.col("label").alias("a"), F.col("lo").alias("al"), F.col("hi").alias("ah")), box.select(F.col("label").alias("b"), F.col("lo").alias("bl"), F.col("hi").alias("bh"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", ((F.col("al") <= F.col("bh")) & (F.col("bl") <= F.col("ah"))).alias("intersects"), ((F.col("al") <= F.col("bl")) & (F.col("bh") <= F.col("ah"))).alias("contains"))


# -- codecs ------------------------------------------------------------------
_gaps = f"{oracle.tables('part')}, g AS (SELECT term, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM post WHERE field = 'p_name')"


#: Ids to a block in which gaps are taken: a block is a task's to sort, and a term has one row a block behind it.
GAP_IDS = 1 << 16


def _gap_rows(spark, sf_dir):
    """(term, doc_id, gap, place): gaps and places within blocks of ids, then joined up by a row a block."""
    post = parts(spark, sf_dir).postings.where("field = 'p_name'").select("term", "doc_id", F.floor(F.col("doc_id") / GAP_IDS).alias("part"))
    ends = post.groupBy("term", "part").agg(F.max("doc_id").alias("last"), F.count("*").alias("n"))
    order = Window.partitionBy("term").orderBy("part")
    ends = ends.select("term", "part", F.lag("last", 1, 0).over(order).alias("before"), (F.sum("n").over(order) - F.col("n")).alias("above"))
    inner = Window.partitionBy("term", "part").orderBy("doc_id")
    rows = post.select("term", "part", "doc_id", F.lag("doc_id").over(inner).alias("near"), F.row_number().over(inner).alias("row")).join(ends, ["term", "part"])
    return rows.select("term", "doc_id", (F.col("doc_id") - F.coalesce("near", "before")).alias("gap"), (F.col("above") + F.col("row") - 1).alias("place"))


@register("gap_encode", f"{_gaps} SELECT term, doc_id, CAST(gap AS BIGINT) AS gap FROM g")
def gap_encode(spark, sf_dir):
    return _gap_rows(spark, sf_dir).drop("place")


@register("vint_bytes", f"{_gaps} SELECT term, CAST(sum(CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 WHEN gap < 268435456 THEN 4 ELSE 5 END) AS BIGINT) AS bytes FROM g GROUP BY term")
def vint_bytes(spark, sf_dir):
    g = F.col("gap")
    size = F.when(g < 128, 1).when(g < 16384, 2).when(g < 2097152, 3).when(g < 268435456, 4).otherwise(5)
    return _gap_rows(spark, sf_dir).groupBy("term").agg(F.sum(size).cast("long").alias("bytes"))


@register("for_blocks", f"{_gaps}, n AS (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 128 AS block FROM g) SELECT term, CAST(block AS BIGINT) AS block, CAST(count(*) AS BIGINT) AS entries, CAST(length(bin(max(gap))) AS INTEGER) AS bits FROM n GROUP BY term, block")
def for_blocks(spark, sf_dir):
    n = _gap_rows(spark, sf_dir).withColumn("block", F.floor(F.col("place") / 128))
    return n.groupBy("term", "block").agg(F.count("*").alias("entries"), F.length(F.bin(F.max("gap"))).alias("bits"))


@register("postings_codec", f"{oracle.tables()} SELECT field, term, doc_id, freq FROM post")
def postings_codec(spark, sf_dir):
    """All postings, encoded as checked blocks of bytes and read back."""
    return codec.decode_postings(codec.encode_postings(documents(spark, sf_dir).postings.select("field", "term", F.col("doc_id").cast("long"), "freq")))


@register("postings_block_sizes", f"{oracle.tables()} SELECT field, term, CAST(doc_id // {codec.BLOCK_IDS} AS BIGINT) AS block, CAST(count(*) AS BIGINT) AS entries FROM post GROUP BY ALL")
def postings_block_sizes(spark, sf_dir):
    return codec.encode_postings(documents(spark, sf_dir).postings.select("field", "term", F.col("doc_id").cast("long"), "freq")).drop("data")


_crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(term, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda h, b: xor(xor(h, b) >> 1, 3988292384 * (xor(h, b) & 1))), 4294967295)"


@register("crc32_terms", f"{oracle.tables('part')} SELECT term, CAST({_crc} AS BIGINT) AS crc FROM dict WHERE field = 'p_name'")
def crc32_terms(spark, sf_dir):
    return vocabulary(spark, sf_dir).select("term", F.crc32(F.col("term").cast("binary")).alias("crc"))


# -- shards and segments -----------------------------------------------------
SHARDS = 3
_fnv = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
_shard = f"CAST(({_fnv}) % {SHARDS} AS INTEGER)"


def _sharded(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("shard", ranking.shard_of(F.col("doc_id").cast("string"), SHARDS))


@register("route_shard", f"SELECT doc_id, {_shard} AS shard FROM documents")
def route_shard(spark, sf_dir):
    return _sharded(spark, sf_dir).select("doc_id", "shard")


@register("shard_distribution", f"SELECT shard, CAST(count(*) AS BIGINT) AS docs FROM (SELECT {_shard} AS shard FROM documents) GROUP BY shard")
def shard_distribution(spark, sf_dir):
    return _sharded(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("docs"))


@register("shard_skew", f"SELECT round(stddev_pop(docs) / avg(docs), 6) AS skew FROM (SELECT shard, count(*) AS docs FROM (SELECT {_shard} AS shard FROM documents) GROUP BY shard)")
def shard_skew(spark, sf_dir):
    return shard_distribution(spark, sf_dir).agg(F.round(F.stddev_pop("docs") / F.avg("docs"), 6).alias("skew"))


_question = ast.Match(1.0, "text", "the pathetic stupid")


@register("query_then_fetch", f"{oracle.tables()} SELECT doc_id, {_shard} AS shard, round(score, 6) AS score, source, n_chars FROM (SELECT * FROM ({oracle.clause(_question)}) ORDER BY score DESC, doc_id LIMIT 10) JOIN documents USING (doc_id)")
def query_then_fetch(spark, sf_dir):
    hits = Compiler(documents(spark, sf_dir)).compile(_question).frame.withColumn("shard", ranking.shard_of(F.col("doc_id").cast("string"), SHARDS))
    return ranking.query_then_fetch(hits, table(spark, sf_dir, "documents"), 10, ["source", "n_chars"]).withColumn("score", F.round("score", 6))


def _local(spark, sf_dir, part):
    index = documents(spark, sf_dir)
    post = index.lookup({("text", t) for t in ("the", "pathetic", "stupid")})
    norms = index.norms.where("field = 'text'").select(part.alias("part"), "doc_id", "length")
    return ranking.local_scores(post.select(part.alias("part"), "term", "doc_id", F.col("freq").alias("tf"), "length"), norms, "part")


def _local_sql(part: str) -> str:
    return f"""{oracle.tables()}, n2 AS (SELECT {part} AS part, doc_id, length FROM norm WHERE field = 'text'), p2 AS (SELECT {part} AS part, doc_id, term, freq FROM post WHERE field = 'text' AND term IN ('the', 'pathetic', 'stupid')),
st AS (SELECT part, count(*) AS n, avg(length) AS a FROM n2 GROUP BY part), df AS (SELECT part, term, count(*) AS df FROM p2 GROUP BY part, term),
local AS (SELECT part, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * length / a))) AS score FROM p2 JOIN n2 USING (part, doc_id) JOIN df USING (part, term) JOIN st USING (part) GROUP BY part, doc_id)"""


@register("segment_local_topk", f"{_local_sql('doc_id // 250')} SELECT CAST(part AS BIGINT) AS segment, doc_id, round(score, 6) AS score FROM (SELECT * FROM local ORDER BY score DESC, doc_id LIMIT 10)")
def segment_local_topk(spark, sf_dir):
    """Each segment ranks with its own statistics; the best are merged."""
    frame = _local(spark, sf_dir, F.floor(F.col("doc_id") / 250))
    return ranking.top(ranking.per_partition_top(frame, "part", 10), 10).select(F.col("part").alias("segment"), "doc_id", F.round("score", 6).alias("score"))


@register("shard_score_skew", f"{_local_sql(_shard)}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM local), b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({oracle.clause(_question)})) SELECT doc_id, CAST(a.r AS INTEGER) AS local_rank, CAST(b.r AS INTEGER) AS global_rank FROM a JOIN b USING (doc_id) WHERE b.r <= 20")
def shard_score_skew(spark, sf_dir):
    """Ranks by shard statistics against ranks by global ones, of the global top twenty."""
    local = _local(spark, sf_dir, ranking.shard_of(F.col("doc_id").cast("string"), SHARDS))
    best = ranking.top(Compiler(documents(spark, sf_dir)).compile(_question).frame, 20).withColumn("global_rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))
    mine = best.join(local.select("doc_id", F.col("score").alias("mine")), "doc_id")
    # a rank is the number of documents before: counted against twenty rows, without sorting all
    before = local.crossJoin(F.broadcast(mine.select(F.col("doc_id").alias("d"), "mine"))).where((F.col("score") > F.col("mine")) | ((F.col("score") == F.col("mine")) & (F.col("doc_id") < F.col("d"))))
    n = before.groupBy(F.col("d").alias("doc_id")).agg(F.count("*").alias("n"))
    return mine.join(n, "doc_id", "left").select("doc_id", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("local_rank"), "global_rank")


# -- observability -----------------------------------------------------------
@register("latency_summary", "SELECT CAST(count(*) AS BIGINT) AS n, round(avg(value), 4) AS mean, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.9) WITHIN GROUP (ORDER BY value) AS p90, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, percentile_disc(0.99) WITHIN GROUP (ORDER BY value) AS p99, max(value) AS max FROM events")
def latency_summary(spark, sf_dir):
    """Nearest-rank percentiles by global places, so that no task holds all values."""
    events = table(spark, sf_dir, "events").where("value IS NOT NULL").select("value", "event_id")
    n = events.count()
    rank = {name: max(0, math.ceil(p * n) - 1) for name, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))}
    placed = ordinals(events, "value", "event_id")
    at = [F.max(F.when(F.col("ordinal") == r, F.col("value"))).alias(name) for name, r in rank.items()]
    return placed.agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), *at, F.max("value").alias("max"))


@register("histogram", "WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 24 AS w FROM events), h AS (SELECT least(23, CAST(floor((value - lo) / w) AS BIGINT)) AS bucket, count(*) AS n FROM events, b GROUP BY ALL) SELECT CAST(r.bucket AS BIGINT) AS bucket, CAST(coalesce(n, 0) AS BIGINT) AS n FROM range(24) r(bucket) LEFT JOIN h USING (bucket)")
def histogram(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    lo, hi = events.agg(F.min("value"), F.max("value")).first()
    width = (hi - lo) / 24
    counts = events.groupBy(F.least(F.lit(23), F.floor((F.col("value") - lo) / width)).alias("bucket")).agg(F.count("*").alias("n"))
    return spark.range(24).withColumnRenamed("id", "bucket").join(F.broadcast(counts), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@register("capacity_plan", "SELECT CAST(ceil(b / (1000 * 1073741824.0)) AS BIGINT) AS for_storage, CAST(ceil(400 * 12 / 1000.0 / (8 * 0.6)) AS BIGINT) AS for_cpu, CAST(ceil(b * 0.3 / (64 * 1073741824.0 * 0.5)) AS BIGINT) AS for_ram FROM (SELECT 50000000::DOUBLE * 1200 * 1.55 * 2 * 1.2 * 1.1 * 1.15 * pow(1.04, 12) AS b)")
def capacity_plan(spark, sf_dir):
    from quillon.operators.observability import Capacity

    plan = Capacity().plan()
    return spark.createDataFrame([(plan["for_storage"], plan["for_cpu"], plan["for_ram"])], "for_storage long, for_cpu long, for_ram long")
