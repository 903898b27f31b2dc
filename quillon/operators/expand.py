"""Dictionary expansion: prefix, wildcard, regexp, fuzzy and term ranges.

Each is a filter over the dictionary, sorted by term and clipped to the cap;
what reaches the driver is at most that many terms.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.distance import osa_within
from quillon.plans import ast


def auto_edits(value: str) -> int:
    return 0 if len(value) <= 2 else 1 if len(value) <= 5 else 2


def like_pattern(pattern: str) -> str:
    """A wildcard pattern ('*' any run, '?' one character) as a LIKE pattern with '\\' as escape."""
    return "".join({"*": "%", "?": "_", "%": r"\%", "_": r"\_", "\\": r"\\"}.get(c, c) for c in pattern)


def literal_prefix(pattern: str) -> str:
    return re.split(r"[*?]", pattern, maxsplit=1)[0]


def valid_pattern(pattern: str) -> bool:
    """Whether the engine that matches it takes a pattern."""
    spark = SparkSession.getActiveSession()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def condition(q: ast.Expansion, term: Column) -> Column:
    """Whether a term fits an expansion."""
    if isinstance(q, ast.Prefix):
        return term.startswith(q.value)
    if isinstance(q, ast.Wildcard):
        narrow = literal_prefix(q.value)
        fits = term.like(like_pattern(q.value))
        return term.startswith(narrow) & fits if narrow else fits
    if isinstance(q, ast.Regexp):
        return term.rlike(rf"\A(?:{q.value})\z") if valid_pattern(q.value) else F.lit(False)
    if isinstance(q, ast.Fuzzy):
        k = auto_edits(q.value) if q.edits is None else q.edits
        band = F.length(term).between(len(q.value) - k, len(q.value) + k) & term.startswith(q.value[: q.prefix])
        if q.transpositions:  # a swap is two plain edits, so twice the edits narrow the terms without Python
            within = F.pandas_udf(lambda s, v=q.value, k=k: pd.Series([osa_within(v, t, k) for t in s]), "boolean")
            return band & (F.levenshtein(term, F.lit(q.value), 2 * k) >= 0) & within(term)
        return band & (F.levenshtein(term, F.lit(q.value), k) >= 0)
    raise TypeError(q)


@dataclass(frozen=True)
class ExpansionRecord:
    terms: tuple[str, ...]
    method: str
    clipped: bool
    total: int


def expand(dictionary: DataFrame, q: ast.Expansion) -> DataFrame:
    """(term, doc_freq) of the terms that fit, the first ``most`` in order."""
    rows = dictionary.where((F.col("field") == q.field) & condition(q, F.col("term")))
    return rows.select("term", "doc_freq").orderBy("term").limit(q.most)


def expand_record(dictionary: DataFrame, q: ast.Expansion) -> ExpansionRecord:
    """The expansion with its size before the cap."""
    total = dictionary.where((F.col("field") == q.field) & condition(q, F.col("term"))).count()
    terms = tuple(r.term for r in expand(dictionary, q).collect())
    return ExpansionRecord(terms, type(q).__name__.lower(), total > len(terms), total)
