"""Query trees."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass


@dataclass(frozen=True)
class Query:
    boost: float = 1.0


@dataclass(frozen=True)
class MatchAll(Query):
    def __str__(self):
        return "*:*"


@dataclass(frozen=True)
class MatchNone(Query):
    def __str__(self):
        return "-*:*"


@dataclass(frozen=True)
class Term(Query):
    field: str = ""
    value: str = ""

    def __str__(self):
        return f"{self.field}:{self.value}"


@dataclass(frozen=True)
class Terms(Query):
    field: str = ""
    values: tuple[str, ...] = ()

    def __str__(self):
        return f"{self.field}:({' '.join(self.values)})"


@dataclass(frozen=True)
class Match(Query):
    field: str = ""
    text: str = ""
    operator: str = "or"
    minimum: int | None = None
    distinct: bool = dataclasses.field(default=False, compare=False)  # whether a term that the text repeats counts once

    def __str__(self):
        return f"{self.field}:{self.operator}({self.text})"


@dataclass(frozen=True)
class Phrase(Query):
    field: str = ""
    text: str = ""
    slop: int = 0

    def __str__(self):
        return f'{self.field}:"{self.text}"' + (f"~{self.slop}" if self.slop else "")


@dataclass(frozen=True)
class Expansion(Query):
    """A query that stands for the terms of the dictionary that fit."""

    field: str = ""
    value: str = ""
    most: int = 1024


@dataclass(frozen=True)
class Prefix(Expansion):
    def __str__(self):
        return f"{self.field}:{self.value}*"


@dataclass(frozen=True)
class Wildcard(Expansion):
    def __str__(self):
        return f"{self.field}:{self.value}"


@dataclass(frozen=True)
class Regexp(Expansion):
    def __str__(self):
        return f"{self.field}:/{self.value}/"


@dataclass(frozen=True)
class Fuzzy(Expansion):
    edits: int | None = None  # None: by length
    prefix: int = 0
    transpositions: bool = False

    def __str__(self):
        return f"{self.field}:{self.value}~{'' if self.edits is None else self.edits}"


@dataclass(frozen=True)
class Range(Query):
    """Bounds all hold; on a keyword field they compare terms and score nothing."""

    field: str = ""
    gte: object = None
    gt: object = None
    lte: object = None
    lt: object = None

    def __str__(self):
        return f"{self.field}:{'[' if self.gt is None else '{'}{self.gte if self.gt is None else self.gt} TO {self.lte if self.lt is None else self.lt}{']' if self.lt is None else '}'}"


@dataclass(frozen=True)
class Ids(Query):
    """The documents with the given keys; a constant score."""

    values: tuple = ()

    def __str__(self):
        return f"id:({' '.join(map(str, self.values))})"


@dataclass(frozen=True)
class GeoBox(Query):
    """Rows inside a rectangle, edges included; a constant score."""

    lat: str = "lat"
    lon: str = "lon"
    bottom: float = -90.0
    left: float = -180.0
    top: float = 90.0
    right: float = 180.0

    def __str__(self):
        return f"geo({self.bottom},{self.left} {self.top},{self.right})"


@dataclass(frozen=True)
class Bool(Query):
    must: tuple[Query, ...] = ()
    filter: tuple[Query, ...] = ()
    should: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()
    minimum: int | None = None

    def __str__(self):
        parts = [*(f"+{q}" for q in self.must), *(f"#{q}" for q in self.filter), *map(str, self.should), *(f"-{q}" for q in self.must_not)]
        return f"({' '.join(parts)})" + (f"~{self.minimum}" if self.minimum else "")


@dataclass(frozen=True)
class Script(Query):
    """The inner query's score replaced by an expression."""

    query: Query = MatchAll()
    source: str = "_score"

    def __str__(self):
        return f"script({self.query}, {self.source})"


def conjunction(*queries: Query) -> Query:
    """All of some clauses, their scores added; those that are None are left out, a single one is itself."""
    some = tuple(q for q in queries if q is not None)
    return some[0] if len(some) == 1 else Bool(must=some)
