"""Global row numbers without a global task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.folders import fresh

#: Rows of a partition that a generated id can number.
_PLACE_BITS = 33


def ordinals(rows: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """rows with their place, from 0, in ascending order of the named columns, which must not tie.

    Rows are dealt into ranges and stored with their place in the range; what
    the driver sees is one count a range. No task sorts more than its range.
    """
    spark = rows.sparkSession
    path = fresh(spark, "ordinals")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    part = F.shiftright("_place", _PLACE_BITS)
    counts = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = [0, *accumulate(n for _, n in counts)]
    table = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "_part long, _before long")
    numbered = placed.withColumn("_part", part).join(F.broadcast(table), "_part")
    return numbered.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))).alias(name))
