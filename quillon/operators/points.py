"""Points in trees, a shard at a time.

A shard is what a task reads of the points inside a box's bounds, which the
scan checks first (a table that was written in ranges of x or y skips the row
groups apart from the box), at most SHARD points to a tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.structures.points import BkdTree, KdTree, Region

#: Points that a task builds a tree of at once.
SHARD = 1 << 18


def _planes(batches):
    """(ids, points) of at most SHARD rows each; points with a null or NaN are left out."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= SHARD:
            yield _plane(held)
            held, n = [], 0
    if held:
        yield _plane(held)


def _plane(batches):
    t = pa.Table.from_batches(batches)
    xy = np.stack([t.column(c).to_numpy() for c in ("x", "y")], axis=1)
    ok = ~np.isnan(xy).any(axis=1)
    return t.column("id").to_numpy()[ok], xy[ok]


def in_region(points: DataFrame, region: Region, kind: str = "bkd", leaf: int = 64) -> DataFrame:
    """(id) of the points (id long, x, y double) inside a box, edges included, by trees."""

    def step(batches):
        for ids, xy in _planes(batches):
            tree = KdTree(xy, ids) if kind == "kd" else BkdTree(xy, ids, leaf)
            yield pa.RecordBatch.from_arrays([pa.array(tree.search(region).ids, pa.int64())], names=["id"])

    near = points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    for c, low, high in (("x", region.min_x, region.max_x), ("y", region.min_y, region.max_y)):
        near = near if low == -np.inf else near.where(F.col(c) >= low)
        near = near if high == np.inf else near.where(F.col(c) <= high)
    return near.mapInArrow(step, "id long")


def leaves(points: DataFrame, leaf: int) -> DataFrame:
    """(depth, min_x, max_x, min_y, max_y, points, bytes) of the leaf blocks of all shards."""

    def step(batches):
        for ids, xy in _planes(batches):
            rows = [(n.depth, n.bounds.min_x, n.bounds.max_x, n.bounds.min_y, n.bounds.max_y, n.hi - n.lo, n.bytes) for n in BkdTree(xy, ids, leaf).leaves()]
            kinds = [pa.int64(), *[pa.float64()] * 4, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["depth", "min_x", "max_x", "min_y", "max_y", "points", "bytes"])

    few = points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return few.mapInArrow(step, "depth long, min_x double, max_x double, min_y double, max_y double, points long, bytes long")
