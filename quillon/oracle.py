"""DuckDB SQL with the meaning of a query tree, written apart from the compiler."""

from __future__ import annotations

from quillon.plans import ast

WORD = r"[\p{L}\p{N}]+(?:[-_.][\p{L}\p{N}]+)*"


def quoted(s) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def tables(corpus: str = "documents", k1: float = 1.2, b: float = 0.75) -> str:
    """WITH list: terms, post, norm, dict and scored of a corpus."""
    if corpus == "documents":
        key, texts, words = "doc_id", ["text"], ["lang", "source"]
    else:
        key, texts, words = "p_partkey", ["p_name"], ["p_brand", "p_type"]
    parts = [f"SELECT '{f}' AS field, {key} AS doc_id, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT {key}, regexp_extract_all(lower({f}), '{WORD}') AS l FROM {corpus})" for f in texts]
    parts += [f"SELECT '{f}', {key}, {f}, 0 FROM {corpus} WHERE {f} <> ''" for f in words]
    return f"""WITH terms AS MATERIALIZED ({' UNION ALL '.join(parts)}),
docs AS (SELECT *{f", {key} AS doc_id" if key != "doc_id" else ""} FROM {corpus}),
post AS MATERIALIZED (SELECT field, term, doc_id, CAST(count(*) AS BIGINT) AS freq, list(pos ORDER BY pos) AS positions FROM terms GROUP BY field, term, doc_id),
norm AS MATERIALIZED (SELECT field, doc_id, CAST(count(*) AS BIGINT) AS length FROM terms GROUP BY field, doc_id),
avgl AS (SELECT field, avg(length) AS a FROM norm GROUP BY field),
total AS (SELECT count(*) AS n FROM docs),
dict AS MATERIALIZED (SELECT field, term, CAST(count(*) AS BIGINT) AS doc_freq, CAST(sum(freq) AS BIGINT) AS total_term_freq FROM post GROUP BY field, term),
scored AS MATERIALIZED (SELECT p.field, p.term, p.doc_id, p.freq, p.positions, length, a, doc_freq, ln(1 + ((SELECT n FROM total) - doc_freq + 0.5) / (doc_freq + 0.5)) AS idf,
  ln(1 + ((SELECT n FROM total) - doc_freq + 0.5) / (doc_freq + 0.5)) * freq * {k1 + 1} / (freq + {k1} * (1 - {b} + {b} * length / a)) AS s
  FROM post p JOIN norm USING (field, doc_id) JOIN avgl USING (field) JOIN dict USING (field, term))
"""


def clause(q: ast.Query, constant: bool = False, k1: float = 1.2, b: float = 0.75) -> str:
    """A SELECT of (doc_id, score)."""
    again = lambda x, c=False: clause(x, c, k1, b)
    if isinstance(q, ast.MatchAll):
        return f"SELECT doc_id, {q.boost}::DOUBLE AS score FROM docs"
    if isinstance(q, ast.MatchNone):
        return "SELECT doc_id, 0.0::DOUBLE AS score FROM docs WHERE false"
    if isinstance(q, ast.Ids):
        return f"SELECT doc_id, {0.0 if constant else q.boost}::DOUBLE AS score FROM docs WHERE doc_id IN ({', '.join(map(str, q.values))})"
    if isinstance(q, ast.Term):
        return f"SELECT doc_id, {q.boost} * s AS score FROM scored WHERE field = {quoted(q.field)} AND term = {quoted(q.value)}"
    if isinstance(q, ast.Terms):
        return f"SELECT doc_id, {q.boost} * sum(s) AS score FROM scored WHERE field = {quoted(q.field)} AND term IN ({', '.join(map(quoted, q.values))}) GROUP BY doc_id"
    if isinstance(q, ast.Match):
        terms = q.text.lower().split()
        least = len(terms) if q.operator == "and" else min(max(q.minimum or 1, 1), len(terms))
        return again(ast.Bool(should=tuple(ast.Term(q.boost, q.field, t) for t in terms), minimum=least))
    if isinstance(q, ast.Expansion):
        inner = f"SELECT term FROM dict WHERE field = {quoted(q.field)} AND {fits(q)} ORDER BY term LIMIT {q.most}"
        return f"SELECT doc_id, {q.boost} * sum(s) AS score FROM scored WHERE field = {quoted(q.field)} AND term IN ({inner}) GROUP BY doc_id"
    if isinstance(q, ast.Phrase):
        terms = q.text.lower().split()
        rows = f"SELECT doc_id, unnest(positions) AS p0 FROM post WHERE field = {quoted(q.field)} AND term = {quoted(terms[0])}"
        for i, t in enumerate(terms[1:], 1):
            rows = f"SELECT r.*, list_min(list_filter(x.positions, lambda y: y > r.p{i - 1})) AS p{i} FROM ({rows}) r JOIN post x ON x.doc_id = r.doc_id AND x.field = {quoted(q.field)} AND x.term = {quoted(t)}"
        n = len(terms)
        idf = " + ".join(f"(SELECT ln(1 + ((SELECT n FROM total) - doc_freq + 0.5) / (doc_freq + 0.5)) FROM dict WHERE field = {quoted(q.field)} AND term = {quoted(t)})" for t in terms)
        return f"SELECT doc_id, {q.boost} * ({idf}) * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * length / a)) AS score FROM (SELECT doc_id, count(*) AS tf FROM ({rows}) WHERE p{n - 1} - p0 - {n - 1} <= {q.slop} GROUP BY doc_id) JOIN norm USING (doc_id) JOIN avgl USING (field) WHERE field = {quoted(q.field)}"
    if isinstance(q, ast.Range):
        bounds = [f"{{}} {op} {v if isinstance(v, (int, float)) else quoted(v)}" for op, v in ((">=", q.gte), (">", q.gt), ("<=", q.lte), ("<", q.lt)) if v is not None]
        if q.field in ("lang", "source", "p_brand", "p_type"):
            return f"SELECT DISTINCT doc_id, 0.0 AS score FROM post WHERE field = {quoted(q.field)} AND {' AND '.join(x.format('term') for x in bounds)}"
        return f"SELECT doc_id, {0.0 if constant else q.boost}::DOUBLE AS score FROM docs WHERE {' AND '.join(x.format(q.field) for x in bounds) or q.field + ' IS NOT NULL'}"
    if isinstance(q, ast.Bool):
        held = [f"SELECT doc_id, score FROM ({again(x)})" for x in q.must] + [f"SELECT doc_id, 0.0 AS score FROM ({again(x, True)})" for x in q.filter]
        should = " UNION ALL ".join(f"SELECT doc_id, score FROM ({again(x)})" for x in q.should)
        if held:
            out = f"SELECT doc_id, sum(score) AS score FROM ({' UNION ALL '.join(held)}) GROUP BY doc_id HAVING count(*) = {len(held)}"
            if should:
                least = min(q.minimum or 0, len(q.should))
                out = f"SELECT r.doc_id, r.score + coalesce(o.score, 0) AS score FROM ({out}) r LEFT JOIN (SELECT doc_id, sum(score) AS score, count(*) AS c FROM ({should}) GROUP BY doc_id) o USING (doc_id) WHERE coalesce(c, 0) >= {least}"
        elif should:
            least = min(max(1 if q.minimum is None else q.minimum, 1), len(q.should))
            out = f"SELECT doc_id, sum(score) AS score FROM ({should}) GROUP BY doc_id HAVING count(*) >= {least}"
        elif q.must_not:
            out = "SELECT doc_id, 1.0 AS score FROM docs"
        else:
            out = "SELECT doc_id, 0.0 AS score FROM docs WHERE false"
        for x in q.must_not:
            out = f"SELECT doc_id, score FROM ({out}) WHERE doc_id NOT IN (SELECT doc_id FROM ({again(x, True)}))"
        return f"SELECT doc_id, {q.boost} * score AS score FROM ({out})"
    raise TypeError(q)


def fits(q: ast.Expansion) -> str:
    if isinstance(q, ast.Prefix):
        return f"starts_with(term, {quoted(q.value)})"
    if isinstance(q, ast.Wildcard):
        return f"term GLOB {quoted(q.value)}"
    if isinstance(q, ast.Regexp):
        return f"regexp_full_match(term, {quoted(q.value)})"
    k = q.edits if q.edits is not None else (0 if len(q.value) <= 2 else 1 if len(q.value) <= 5 else 2)
    return f"levenshtein(term, {quoted(q.value)}) <= {k} AND starts_with(term, {quoted(q.value[: q.prefix])})"


def search(q: ast.Query, corpus: str = "documents", k: int | None = None, k1: float = 1.2, b: float = 0.75) -> str:
    """Full SQL of a query; with k its best hits."""
    end = f" ORDER BY x.score DESC, doc_id LIMIT {k}" if k else ""
    return f"{tables(corpus, k1, b)} SELECT doc_id, round(x.score, 6) AS score FROM ({clause(q, k1=k1, b=b)}) x{end}"
