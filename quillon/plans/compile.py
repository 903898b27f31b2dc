"""Query trees to DataFrames in one pass over the postings.

All leaves are known once expansions are looked up. The postings of the wanted
terms are read and aggregated once per document into one match and one score
per leaf; the tree of clauses is then an expression over these columns.
However deep the tree, there is one shuffle. Ranges of terms stay conditions on
the postings, whatever their number of terms. Clauses on columns (ranges,
boxes, match-all) are expressions over the docs, of which only the needed
columns are read, under names of their own, and only where the tree needs them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date, datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.bm25 import Bm25, idf
from quillon.functions.script import compile_script
from quillon.operators.expand import expand
from quillon.operators.index import Index
from quillon.plans import ast

#: Terms that are written into the plan as literals; beyond this they are joined as a broadcast table.
INLINE_TERMS = 64


@dataclass
class _Leaf:
    """Weighted terms whose scores add up; or a phrase."""

    terms: list[tuple[str, str]]
    boost: float
    phrase: list[str] | None = None
    slop: int = 0
    span: tuple | None = None  # (field, condition): matches by any term that meets it, without a score


@dataclass
class _Node:
    match: Column
    score: Column
    inside: bool  # every match has a posting among the leaves


@dataclass
class _Seen:
    """A clause and what it became, for explanations."""

    query: ast.Query
    node: _Node | None = None
    children: list[_Seen] = field(default_factory=list)
    barred: bool = False


@dataclass
class Plan:
    """The result of compiling: (doc_id, score) and what was resolved."""

    frame: DataFrame
    terms: set[tuple[str, str]] = field(default_factory=set)

    def top(self, k: int = 10) -> DataFrame:
        return self.frame.orderBy(F.desc("score"), F.asc("doc_id")).limit(k)


class Compiler:
    def __init__(self, index: Index, bm25: Bm25 = Bm25()):  # noqa: B008
        self.index, self.bm25 = index, bm25

    # -- analysis and expansion --------------------------------------------

    def analyze(self, name: str, text: str) -> list[str]:
        """The terms of a query text, by the field's own analyzer; the optimizer folds it, no job runs."""
        one = self.index.spark.sql("SELECT * FROM VALUES (1)")
        return list(one.select(self.index.mapping.analyzer_for(name).terms(F.lit(text)).alias("t")).collect()[0].t)

    def resolve(self, q: ast.Query) -> ast.Query:
        """The tree with texts analyzed and expansions replaced by their terms."""
        if isinstance(q, ast.Match):
            terms = self.analyze(q.field, q.text)
            terms = list(dict.fromkeys(terms)) if q.distinct else terms
            if not terms:
                return ast.MatchNone()
            least = len(terms) if q.operator == "and" else min(max(q.minimum or 1, 1), len(terms))
            if len(terms) == 1:
                return ast.Term(q.boost, q.field, terms[0])
            return ast.Bool(1.0, should=tuple(ast.Term(q.boost, q.field, t) for t in terms), minimum=least)
        if isinstance(q, ast.Phrase):
            terms = self.analyze(q.field, q.text)
            if not terms:
                return ast.MatchNone()
            return ast.Term(q.boost, q.field, terms[0]) if len(terms) == 1 else replace(q, text="\0".join(terms))
        if isinstance(q, ast.Expansion):
            found = {r.term: r.doc_freq for r in expand(self.index.dictionary, q).collect()}
            self.index.remember(q.field, found)
            return ast.Terms(q.boost, q.field, tuple(found))
        if isinstance(q, ast.Bool):
            of = lambda qs: tuple(self.resolve(x) for x in qs)
            return replace(q, must=of(q.must), filter=of(q.filter), should=of(q.should), must_not=of(q.must_not))
        if isinstance(q, ast.Script):
            return replace(q, query=self.resolve(q.query))
        return q

    # -- compiling ----------------------------------------------------------

    def compile(self, q: ast.Query) -> Plan:
        rows, node, known = self._rows(self.resolve(q))
        return Plan(rows.where(node.match).select("doc_id", node.score.cast("double").alias("score")), known)

    def explain(self, q: ast.Query, doc_id) -> dict:
        """The clauses of a query with the score that each has in one document, as a tree; what doesn't match is left out.

        A clause's value is its boost times the sum of its details, but for
        scripts, phrases and terms, whose details say where the value is from.
        """
        rows, node, _ = self._rows(self.resolve(q))
        seen: list[_Seen] = []
        todo = [self.seen]
        while todo:
            seen.append(todo.pop())
            todo += seen[-1].children
        columns = [F.struct(s.node.match.alias("m"), s.node.score.cast("double").alias("s")).alias(f"n{k}") for k, s in enumerate(seen)]
        hit = rows.where((F.col("doc_id") == doc_id) & node.match).select(*columns).first()
        if hit is None:
            return {"value": 0.0, "description": f"{doc_id} doesn't match {q}", "details": []}
        values = {id(s): hit[k] for k, s in enumerate(seen)}

        def tree(s: _Seen) -> dict:
            kind = type(s.query).__name__.lower()
            text = str(s.query).replace("\0", " ")
            boost = f", boost {s.query.boost}" if s.query.boost != 1 else ""
            inner = [tree(c) for c in s.children if values[id(c)].m] if not s.barred else []
            return {"value": values[id(s)].s, "description": f"{kind} {text}{boost}", "details": inner}

        return tree(self.seen)

    def _rows(self, q: ast.Query) -> tuple[DataFrame, _Node, set]:
        """Rows with a match and a score for each leaf of a resolved query, its root, and the terms found."""
        self.leaves: list[_Leaf] = []
        self.columns: dict[str, str] = {}
        self._open = [_Seen(q)]
        node = self._node(q)
        self.seen = self._open[0].children[0]
        asked = {t for leaf in self.leaves for t in leaf.terms}
        freqs = self.index.doc_freqs(asked) if asked else {}
        known = {t for t in asked if freqs[t]}
        key = F.col(f"`{self.index.mapping.key}`")
        docs = self.index.docs.where(key.isNotNull()).select(key.alias("doc_id"), *[F.col(f"`{c}`").alias(v) for c, v in self.columns.items()])
        if known or any(leaf.span for leaf in self.leaves):
            hits = self._hits(known, freqs)
            rows = hits if node.inside and not self.columns else docs.join(hits, "doc_id", "inner" if node.inside else "left")
        else:
            rows = docs.where(F.lit(not node.inside))
            for k in range(len(self.leaves)):
                rows = rows.withColumn(f"_m{k}", F.lit(False)).withColumn(f"_s{k}", F.lit(0.0))
        return rows, node, known

    def value(self, name: str) -> Column | None:
        """A column of the docs, under a name that can't clash; None where they have none."""
        if name not in self.index.docs.columns:
            return None
        return F.col(self.columns.setdefault(name, f"_v{len(self.columns)}"))

    def _hits(self, known, freqs) -> DataFrame:
        index = self.index
        spans = [leaf.span for leaf in self.leaves if leaf.span]
        if len(known) <= INLINE_TERMS:
            rows = index.lookup(known, spans)
            weight = F.lit(0.0)
            for f in sorted({f for f, _ in known}):
                table = F.create_map(*[x for g, t in sorted(known) if g == f for x in (F.lit(t), F.lit(idf(index.num_docs, freqs[f, t])))])
                weight = F.when(F.col("field") == f, F.element_at(table, F.col("term"))).otherwise(weight)
            rows = rows.withColumn("idf", F.coalesce(weight, F.lit(0.0)))
        else:  # the weights and the leaves of each term come with a broadcast table; expansions are capped, so it is bounded
            of = [(f, t, idf(index.num_docs, freqs[f, t]), [k for k, x in enumerate(self.leaves) if (f, t) in x.terms]) for f, t in sorted(known)]
            table = index.spark.createDataFrame(of, "field string, term string, idf double, leaves array<int>")
            rows = index.lookup(known, spans).join(F.broadcast(table), ["field", "term"], "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
        base = F.lit(0.0)
        for f in sorted({f for f, _ in known}):
            base = F.when(F.col("field") == f, self.bm25.score(F.col("freq"), F.col("length"), index.average(f), F.col("idf"))).otherwise(base)
        rows = rows.withColumn("base", base)
        out, phrases = [], []
        for k, leaf in enumerate(self.leaves):
            if leaf.span:
                f, fits = leaf.span
                out += [F.coalesce(F.max((F.col("field") == f) & fits(F.col("term"))), F.lit(False)).alias(f"_m{k}"), F.lit(0.0).alias(f"_s{k}")]
                continue
            terms = [t for t in leaf.terms if t in known]
            if not terms or (leaf.phrase and len(terms) < len(leaf.terms)):
                out += [F.lit(False).alias(f"_m{k}"), F.lit(0.0).alias(f"_s{k}")]
                continue
            here = F.col("field") == terms[0][0]
            if leaf.phrase:
                phrases.append(k)
                out += [F.max(F.when(here & (F.col("term") == t), F.col("positions"))).alias(f"_p{k}_{i}") for i, t in enumerate(leaf.phrase)]
                out.append(F.max(F.when(here, F.col("length"))).alias(f"_n{k}"))
                continue
            mine = here & F.col("term").isin(*[t for _, t in terms]) if len(known) <= INLINE_TERMS else F.coalesce(F.array_contains("leaves", k), F.lit(False))
            out += [F.coalesce(F.max(mine), F.lit(False)).alias(f"_m{k}"), (F.coalesce(F.sum(F.when(mine, F.col("base"))), F.lit(0.0)) * leaf.boost).alias(f"_s{k}")]
        plain = rows.groupBy("doc_id").agg(*out)
        for k in phrases:  # they become counts behind the aggregation
            leaf = self.leaves[k]
            total = sum(idf(index.num_docs, freqs[leaf.terms[0][0], t]) for t in leaf.phrase)
            score = self.bm25.score(F.col(f"_t{k}"), F.col(f"_n{k}"), index.average(leaf.terms[0][0]), total, leaf.boost)
            plain = plain.withColumn(f"_t{k}", phrase_count([F.col(f"_p{k}_{i}") for i in range(len(leaf.phrase))], leaf.slop))
            plain = plain.withColumn(f"_m{k}", F.col(f"_t{k}") > 0).withColumn(f"_s{k}", F.when(F.col(f"_m{k}"), score).otherwise(0.0))
        return plain.select("doc_id", *[f"_{x}{k}" for k in range(len(self.leaves)) for x in "ms"])

    def _leaf(self, leaf: _Leaf) -> _Node:
        k = len(self.leaves)
        self.leaves.append(leaf)
        return _Node(F.coalesce(F.col(f"_m{k}"), F.lit(False)), F.coalesce(F.col(f"_s{k}"), F.lit(0.0)), True)

    def _node(self, q: ast.Query, scoring: bool = True, barred: bool = False) -> _Node:
        mine = _Seen(q, barred=barred)
        self._open[-1].children.append(mine)
        self._open.append(mine)
        mine.node = self._made(q, scoring)
        self._open.pop()
        return mine.node

    def _made(self, q: ast.Query, scoring: bool) -> _Node:
        none = _Node(F.lit(False), F.lit(0.0), True)
        if isinstance(q, ast.MatchNone):
            return none
        if isinstance(q, ast.MatchAll):
            return _Node(F.lit(True), F.lit(float(q.boost)), False)
        if isinstance(q, ast.Term):
            if q.field in self.index.mapping.numeric:  # equality on a number
                return self._made(ast.Range(q.boost, q.field, gte=q.value, lte=q.value), scoring)
            return self._leaf(_Leaf([(q.field, q.value)], q.boost))
        if isinstance(q, ast.Terms):
            return self._leaf(_Leaf([(q.field, v) for v in dict.fromkeys(q.values)], q.boost)) if q.values else none
        if isinstance(q, ast.Phrase):
            terms = q.text.split("\0")
            return self._leaf(_Leaf([(q.field, t) for t in dict.fromkeys(terms)], q.boost, terms, q.slop))
        if isinstance(q, ast.Range) and q.field in self.index.mapping.keyword:
            return self._leaf(_Leaf([], 0.0, span=(q.field, lambda term: bounded(term, q, str))))
        if isinstance(q, ast.Range):
            if (value := self.value(q.field)) is None:
                return none
            return _Node(range_condition(q, value, dict(self.index.docs.dtypes)[q.field]), F.lit(float(q.boost) if scoring else 0.0), False)
        if isinstance(q, ast.Ids):
            return _Node(F.col("doc_id").isin(*q.values) if q.values else F.lit(False), F.lit(float(q.boost) if scoring else 0.0), False)
        if isinstance(q, ast.GeoBox):
            lat, lon = self.value(q.lat), self.value(q.lon)
            if lat is None or lon is None:
                return none
            fits = lat.between(q.bottom, q.top) & lon.between(q.left, q.right)
            return _Node(F.coalesce(fits, F.lit(False)), F.lit(float(q.boost)), False)
        if isinstance(q, ast.Script):
            inner = self._node(q.query)
            script = compile_script(q.source)
            values = {n: v for n in sorted(script.variables()) if n != "_score" and (v := self.value(n)) is not None}
            return _Node(inner.match, script.column(values | {"_score": inner.score}) * q.boost, inner.inside)
        if isinstance(q, ast.Bool):
            return self._bool(q, scoring)
        raise TypeError(q)

    def _bool(self, q: ast.Bool, scoring: bool) -> _Node:
        must, held = [self._node(x, scoring) for x in q.must], [self._node(x, False) for x in q.filter]
        should, barred = [self._node(x, scoring) for x in q.should], [self._node(x, False, True) for x in q.must_not]
        score, match, inside = F.lit(0.0), F.lit(True), False
        for n in [*must, *held]:
            match, inside = match & n.match, inside or n.inside
        for n in must:
            score = score + n.score
        hits = sum((n.match.cast("int") for n in should), F.lit(0))
        extra = sum((F.when(n.match, n.score).otherwise(0.0) for n in should), F.lit(0.0))
        if must or held:
            least = min(q.minimum or 0, len(should))
            if should:
                score = score + extra
                match = match & (hits >= least) if least > 0 else match
        elif should:
            least = min(max(1 if q.minimum is None else q.minimum, 1), len(should))
            match, score, inside = hits >= least, extra, all(n.inside for n in should)
        elif barred:  # everything but; a constant score, the boost applied once
            score = F.lit(1.0)
        else:
            return _Node(F.lit(False), F.lit(0.0), True)
        for n in barred:
            match = match & ~n.match
        return _Node(match, score * float(q.boost), inside)


BOUNDS = (("gte", "__ge__"), ("gt", "__gt__"), ("lte", "__le__"), ("lt", "__lt__"))


def bounded(value: Column, q: ast.Range, edge) -> Column:
    """All bounds hold."""
    out = F.lit(True)
    for bound, op in BOUNDS:
        if (v := getattr(q, bound)) is not None:
            out = out & getattr(value, op)(edge(v))
    return out


def range_condition(q: ast.Range, value: Column, kind: str) -> Column:
    """All bounds hold; a null never does. Bounds are coerced to the column's type, text by ``coerced``."""
    return F.coalesce(bounded(value, q, lambda v: coerced(v, kind)) & value.isNotNull(), F.lit(False))


def coerced(bound, kind: str) -> Column:
    """A bound as a value of a column's type.

    Dates and times take ISO text, numbers take numbers or text that is one; on
    a numeric column a date stands for its days since 1970. Text that is
    neither bounds nothing and raises ValueError.
    """
    if kind in ("date", "timestamp", "timestamp_ntz"):
        if isinstance(bound, (int, float)):
            return F.date_add(F.lit("1970-01-01").cast("date"), F.lit(int(bound))).cast(kind)
        try:
            return F.lit(datetime.fromisoformat(str(bound).replace("Z", "+00:00")).isoformat()).cast(kind)
        except ValueError:
            raise ValueError(f"'{bound}' is no date") from None
    if isinstance(bound, str):
        try:
            return F.lit(float(bound))
        except ValueError:
            pass
        try:
            return F.lit(float(date.fromisoformat(bound[:10]).toordinal() - date(1970, 1, 1).toordinal()))
        except ValueError:
            raise ValueError(f"'{bound}' is neither a number nor a date") from None
    return F.lit(float(bound))


def phrase_count(positions: list[Column], slop: int) -> Column:
    """Starts from which all terms follow in order, earliest first, with at most ``slop`` places between them.

    The places of a batch of documents are one ascending list a term, in which
    each term's next places are found by bisection: no document's pairs of
    places are compared.
    """
    n = len(positions)

    def count(*lists: pa.Array) -> pa.Array:
        rows = len(lists[0])

        def places(a: pa.Array) -> np.ndarray:
            sizes = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
            return (np.repeat(np.arange(rows, dtype=np.int64), sizes) << 32) + a.flatten().to_numpy(zero_copy_only=False)

        start = at = places(lists[0])
        for a in lists[1:]:
            found = places(a)
            k = np.searchsorted(found, at, "right")
            start, at = start[k < len(found)], found[k[k < len(found)]]
            same = start >> 32 == at >> 32
            start, at = start[same], at[same]
        hit = start[at - start - (n - 1) <= slop] >> 32
        return pa.array(np.bincount(hit, minlength=rows).astype(np.int32))

    return F.arrow_udf(count, "int")(*positions)


def search(index: Index, q: ast.Query, k: int = 10, bm25: Bm25 = Bm25()) -> DataFrame:  # noqa: B008
    """The k best documents: score descending, then key."""
    return Compiler(index, bm25).compile(q).top(k)
