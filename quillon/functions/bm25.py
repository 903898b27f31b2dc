"""BM25 as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75

    def norm(self, length: Column, average: float) -> Column:
        ratio = length / F.lit(float(average)) if average else F.lit(1.0)
        return self.k1 * ((1 - self.b) + self.b * ratio)

    def score(self, tf: Column, length: Column, average: float, idf: Column | float, boost: float = 1.0) -> Column:
        idf = idf if isinstance(idf, Column) else F.lit(float(idf))
        return F.lit(float(boost)) * idf * (tf * (self.k1 + 1)) / (tf + self.norm(length, average))


def idf(docs: float, df: float) -> float:
    return math.log(1 + (docs - df + 0.5) / (df + 0.5))


def idf_column(docs: Column, df: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))
