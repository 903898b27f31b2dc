"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side whose size has been counted may be broadcast.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is missing on a single machine, as in tests, a
    temporary folder takes its place; on a cluster that is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not given:
        given = context.getCheckpointDir()
        if not given:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
            given = context.getCheckpointDir()
    elif not context.getCheckpointDir():
        context.setCheckpointDir(given)
    return given.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet in the shared folder and read again."""
    path = workspace(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized_join(left: DataFrame, right: DataFrame, keys: list[str], limit: int = BROADCAST_ROWS, how: str = "left") -> DataFrame:
    """left joined to a right side with one row per key.

    right must be cheap to count (checkpointed). Up to ``limit`` rows it is
    broadcast, beyond that the join is salted, so that a key with a third of
    all rows is spread over many tasks.
    """
    if right.count() <= limit:
        return left.join(F.broadcast(right), keys, how)
    salts = 32
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int"))
    return dealt.join(spread, [*keys, "_salt"], how).drop("_salt")


def utf8(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null gives b''."""
    return [x or b"" for x in column.cast("binary").to_pylist()]


def runs(sizes, limit: int):
    """Consecutive index ranges whose sizes sum to about limit at most."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def slices(batch: pa.RecordBatch, limit: int):
    """batch in consecutive parts of about limit bytes of text at most, so that only a part is copied at once."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    for lo, hi in runs(sizes.tolist(), limit):
        yield batch.slice(lo, hi - lo)


#: What a worker keeps between the tasks of a stage.
KEPT: list[dict] = []


def give_back(drop: bool = True) -> None:
    """Return memory that this worker no longer uses to the system; with ``drop`` what it keeps for other stages goes too."""
    if drop:
        for kept in KEPT:
            kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices values[s : s + n], one behind the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return values[:0]
    out = np.empty(ends[-1], values.dtype)
    shift = starts - (ends - lengths)
    for a in range(0, len(ends), 1 << 14):  # in blocks that stay in the CPU's cache
        z = min(a + (1 << 14), len(ends))
        lo, hi = int(ends[a] - lengths[a]), int(ends[z - 1])
        out[lo:hi] = values[np.repeat(shift[a:z], lengths[a:z]) + np.arange(lo, hi)]
    return out


def own_columns(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash."""
    return docs.select(*[F.col(f"`{n}`") for n in names])
