"""Labelled rows for the classifiers, all of them, and sums over their features."""

from __future__ import annotations

import pickle
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_ROWS, own_columns, slices, stored

#: Bytes of text whose features are computed at once; tasks that a pass over features has at most, so many sums reach the driver.
BLOCK, PARTS = 4 << 20, 64
#: Of a text beyond TRAIN_CHARS, PIECES pieces with so many characters together are learned from (op7; all of it is scored).
TRAIN_CHARS, PIECES = 50_000, 10


def excerpt(text: Column) -> Column:
    """text, or of one beyond TRAIN_CHARS, PIECES pieces evenly over its length without the words cut at their ends."""
    size = TRAIN_CHARS // PIECES
    far = (F.length(text) - size).cast("double") / (PIECES - 1)
    ends = {0: r"\s\S{0,64}$", PIECES - 1: r"^\S{0,64}\s"}
    pieces = [F.regexp_replace(F.substring(text, F.floor(far * k).cast("int") + 1, F.lit(size)), ends.get(k, r"^\S{0,64}\s|\s\S{0,64}$"), " ") for k in range(PIECES)]
    return F.when(F.length(text) <= TRAIN_CHARS, text).otherwise(F.concat_ws(" ", *pieces))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, how: str = "inner") -> DataFrame:
    """doc_id, label and whole text (null: empty) of every labelled row for learning (crc32 modulo 3 not 1).

    With ``how`` left the other rows stay, their label null. An id that is labelled repeatedly has its largest label. Only so many labels
    as BROADCAST_ROWS are broadcast; with more of them the texts are shuffled.
    """
    rows = own_columns(labels, "doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    rows = rows.where(remainder(F.col("doc_id"), 3) != 1).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    texts = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if how == "inner":
        texts = texts.where(remainder(F.col("doc_id"), 3) != 1)
    return texts.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, "doc_id", how)


def feature_table(rows: DataFrame, features, width: int, name: str):
    """rows with ``features(record batch) -> array (n, width)``, stored; gives ``totals(f)``.

    f(x, label) gives a dictionary of arrays for a block of rows, and totals(f)
    the sums by key over all blocks: added up in each task, then in the driver.
    """

    def step(batches):
        for b in (x for whole in batches for x in slices(whole, BLOCK)):
            x = np.ascontiguousarray(features(b), "<f8")
            yield pa.RecordBatch.from_arrays([b.column("label").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    table = stored(rows.mapInArrow(step, "label int, x binary"), name).coalesce(PARTS)

    def totals(f) -> dict:
        def run(batches):
            sums: dict = {}
            for b in batches:
                if b.num_rows:
                    x = np.frombuffer(b"".join(b.column("x").to_pylist()), "<f8").reshape(-1, width)
                    add(sums, f(x, b.column("label").to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(sums)], pa.binary())], names=["sums"])

        sums: dict = {}
        for part in table.mapInArrow(run, "sums binary").toArrow().column("sums").to_pylist():
            add(sums, pickle.loads(part))
        return sums

    return totals


def add(sums: dict, more: dict) -> None:
    for key, value in more.items():
        sums[key] = sums[key] + value if key in sums else value


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30, weights: np.ndarray | None = None) -> np.ndarray:
    """Newton's method for ridge logistic regression; x holds its own constant column."""
    w = np.zeros(x.shape[1])
    r = np.ones(len(y)) if weights is None else weights
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (r * (p - y)) + ridge * w
        h = (x * (r * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def slope(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict:
    """What a step of ``logistic`` sums over rows."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {"g": x.T @ (p - y), "h": (x * (p * (1 - p) + 1e-9)[:, None]).T @ x}


def logistic_of(totals, width: int, ridge: float, steps: int = 30) -> np.ndarray:
    """``logistic`` over the rows of a feature table."""
    w = np.zeros(width)
    for _ in range(steps):
        sums = totals(partial(slope, w))
        step = np.linalg.solve(sums["h"] + ridge * np.eye(width), sums["g"] + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w
