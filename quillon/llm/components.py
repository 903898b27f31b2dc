"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_ROWS, cut, stored


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component) of the edges (a, b), contracted as in ``components``."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        hook = np.arange(len(nodes))
        np.minimum.at(hook, x, y)
        np.minimum.at(hook, y, x)
        while (hook[hook] != hook).any():
            hook = hook[hook]
        label, x, y = hook[label], hook[x], hook[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[label]


def solved(edges: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of a few edges, found in the driver; to be broadcast."""
    got = edges.toArrow()
    node, comp = least_nodes(*(got.column(c).to_numpy() for c in ("a", "b")))
    table = pa.table({"node": pa.array(node, pa.int64()), "comp": pa.array(comp, pa.int64())})
    return F.broadcast(stored(edges.sparkSession.createDataFrame(table), "components"))


def components(links: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(node, comp) of every node in links (a, b); comp is the least node of the component.

    In each round every node hooks onto its least neighbour and the graph is
    contracted to the hooks, so stars collapse at once and any other graph at
    least halves. Minima are aggregated before the shuffle, and joins to hubs
    are plain equi-joins of written tables, which AQE can split. What is left
    of the graph once it has ``limit`` edges at most is solved in the driver:
    rounds of shuffles over so little cost more files than they hold rows.
    """
    edges = cut(links.select("a", "b").where("a <> b").distinct())
    label = None
    while (count := edges.count()) > limit:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("comp")))
        label = hook if label is None else relabelled(label, hook)
        left = edges.join(hook.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a")
        near = left.join(hook.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b").where("x <> y")
        edges = cut(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if label is None:
        return solved(edges)
    return relabelled(label, solved(edges)) if count else label


def relabelled(label: DataFrame, hook: DataFrame) -> DataFrame:
    """label with the components that hook joins."""
    return cut(label.join(hook.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")))
