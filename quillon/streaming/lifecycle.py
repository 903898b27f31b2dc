"""Write path: a log of operations becomes immutable segments, batch by batch.

An operation has ``seq`` (its place in the log, unique), ``op`` ('index' or 'delete'),
``id`` and the fields of the document. The log is the durable record; what a
refresh hasn't read is pending and can't be searched. A refresh writes the
operations of one micro-batch as the segment of that batch's number, replacing
what an interrupted attempt left, so a restart from the checkpoint repeats no
operation. What is searchable follows from the segments alone: the operation
with the highest ``seq`` of each id counts, and deletes of ids never seen are
kept until a merge of all segments drops them.

A manifest says which segments are committed, with their checksums and spans
of the log, and which ones a merge has replaced; each change is a new
generation, and readers take the last complete one. ``recover`` checks the
committed segments, sets damaged ones apart and replays the log from the first
operation that is missing. One writer merges, commits or recovers at a time,
while no stream runs. Merging keeps the number of segments logarithmic, so
their names are the driver's to list.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.ordinals import ordinals
from quillon.sources import folders

INDEX, DELETE = "index", "delete"
#: Segments of a tier from which on it is merged, and most of them merged at once.
TIER_FULL, MERGE_MOST = 3, 4
#: Numbers of segments that no stream has written: replayed ones, and merged ones behind them.
REPLAYED, MERGED = 1 << 39, 1 << 40


@dataclass(frozen=True)
class Sealed:
    """A committed segment: its rows, a checksum over them, and the part of the log that it is from."""

    rows: int
    checksum: int
    first_seq: int
    last_seq: int


@dataclass(frozen=True)
class State:
    """The manifest's last generation."""

    generation: int = 0
    committed: dict[int, Sealed] = field(default_factory=dict)
    retired: tuple[int, ...] = ()
    last_seq: int = 0


def refresh(batch: DataFrame, number: int, root: str) -> None:
    """One batch of operations as the segment of that number; an empty batch leaves none."""
    latest = newest(batch)
    if not batch.isEmpty():
        latest.write.mode("overwrite").parquet(f"{root}/segments/segment_id={number}")


def newest(ops: DataFrame) -> DataFrame:
    """The operation with the highest seq of each id; combined before the shuffle, so no id gathers in one task."""
    row = F.struct("seq", *[F.col(f"`{c}`") for c in ops.columns if c != "seq"])
    return ops.groupBy(F.col("id").alias("_id")).agg(F.max_by(row, "seq").alias("_row")).select("_row.*").select(*ops.columns)


def ingest(ops: DataFrame, root: str):
    """Start refreshing segments from a stream of operations; all that is there now, then the query ends."""
    writer = ops.writeStream.foreachBatch(lambda batch, number: refresh(batch, number, root))
    return writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def load(ops: DataFrame, root: str, per_segment: int) -> None:
    """Operations, in order of seq, as segments of so many each, numbered from 0."""
    dealt = ordinals(ops, "seq", name="_ordinal").withColumn("segment_id", F.floor(F.col("_ordinal") / per_segment)).drop("_ordinal")
    # within a segment the last operation of an id counts
    row = F.struct(*[F.col(f"`{c}`") for c in ops.columns])
    latest = dealt.groupBy("segment_id", F.col("id").alias("_id")).agg(F.max_by(row, "seq").alias("_row")).select("segment_id", "_row.*")
    latest.write.partitionBy("segment_id").mode("overwrite").parquet(f"{root}/segments")


# -- what is there ----------------------------------------------------------


def state(spark: SparkSession, root: str) -> State:
    done = [n for n in folders.children(spark, f"{root}/manifest") if folders.exists(spark, f"{root}/manifest/{n}/_SUCCESS")]
    if not done:
        return State()
    last = max(done, key=lambda n: int(n.rpartition("=")[2]))
    raw = json.loads(spark.read.text(f"{root}/manifest/{last}").first().value)
    committed = {int(k): Sealed(**v) for k, v in raw["committed"].items()}
    return State(raw["generation"], committed, tuple(raw["retired"]), raw["last_seq"])


def _store(spark: SparkSession, root: str, new: State) -> None:
    """A new generation; of the older ones the last stays for its readers."""
    body = json.dumps({"generation": new.generation, "committed": {k: asdict(v) for k, v in new.committed.items()}, "retired": list(new.retired), "last_seq": new.last_seq})
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(f"{root}/manifest/generation={new.generation}")
    for n in folders.children(spark, f"{root}/manifest"):
        if int(n.rpartition("=")[2]) < new.generation - 1:
            folders.remove(spark, f"{root}/manifest/{n}")


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The searchable segments."""
    gone = set(state(spark, root).retired)
    return sorted(n for n in _written(spark, root) if n not in gone)


def _written(spark: SparkSession, root: str) -> list[int]:
    whole = folders.exists(spark, f"{root}/segments/_SUCCESS")  # of a load; a refresh marks its own folder
    every = [n for n in folders.children(spark, f"{root}/segments") if n.startswith("segment_id=")]
    return [int(n.rpartition("=")[2]) for n in every if whole or folders.exists(spark, f"{root}/segments/{n}/_SUCCESS")]


def _read(spark: SparkSession, root: str, schema: str, some: list[int]) -> DataFrame:
    whole = f"{schema}, segment_id long"
    if not some:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", f"{root}/segments").parquet(*[f"{root}/segments/segment_id={n}" for n in some])


def segments(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All operations of the searchable segments, with segment_id."""
    return _read(spark, root, schema, numbers(spark, root))


def live(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The searchable documents."""
    return newest(segments(spark, root, schema)).where(F.col("op") == INDEX).drop("op", "segment_id")


def pending(spark: SparkSession, root: str, schema: str, log: DataFrame) -> DataFrame:
    """Operations of the log behind all that was refreshed: durable, but not searchable yet."""
    last = segments(spark, root, schema).agg(F.max("seq")).first()[0] or 0
    return log.where(F.col("seq") > max(last, state(spark, root).last_seq))


def stats(spark: SparkSession, root: str, schema: str, log: DataFrame | None = None) -> dict:
    """Counts of segments, documents, operations that a merge would drop, pending operations and the generation."""
    now, rows = state(spark, root), segments(spark, root, schema)
    total, documents = rows.count(), live(spark, root, schema).count()
    some = numbers(spark, root)
    out = {"segments": len(some), "documents": documents, "reclaimable": total - documents, "generation": now.generation, "uncommitted": len(set(some) - set(now.committed))}
    return out | ({"pending": pending(spark, root, schema, log).count()} if log is not None else {})


def note(spark: SparkSession, root: str, kind: str, message: str) -> None:
    spark.createDataFrame([(time.time_ns(), kind, message)], "at long, kind string, message string").coalesce(1).write.mode("append").json(f"{root}/events")


def events(spark: SparkSession, root: str) -> DataFrame:
    """(at, kind, message): what happened to the segments, in nanoseconds since 1970."""
    schema = "at long, kind string, message string"
    return spark.read.schema(schema).json(f"{root}/events") if folders.exists(spark, f"{root}/events") else spark.createDataFrame([], schema)


# -- commit and recovery ------------------------------------------------------


def _sealed(rows: DataFrame, columns: list[str]) -> Sealed:
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0)).alias("x"), F.min("seq").alias("a"), F.max("seq").alias("z")).first()
    return Sealed(total.n, total.x, total.a or 0, total.z or 0)


def commit(spark: SparkSession, root: str, schema: str) -> State:
    """Seal all searchable segments; those sealed before aren't read again."""
    now, some = state(spark, root), numbers(spark, root)
    sealed = {n: now.committed.get(n) or _sealed(_read(spark, root, schema, [n]), _names(spark, schema)) for n in some}
    last = max([now.last_seq, *(s.last_seq for s in sealed.values())])
    new = replace(now, generation=now.generation + 1, committed=sealed, last_seq=last)
    _store(spark, root, new)
    note(spark, root, "commit", f"generation {new.generation} of {len(sealed)} segments")
    return new


def _names(spark: SparkSession, schema: str) -> list[str]:
    return spark.createDataFrame([], schema).columns


def recover(spark: SparkSession, root: str, schema: str, log: DataFrame | None = None) -> dict:
    """Check the committed segments, set damaged ones apart, and replay the log from the first operation that is missing."""
    now, columns = state(spark, root), _names(spark, schema)
    there = set(_written(spark, root))
    damaged = []
    for n, sealed in sorted(now.committed.items()):
        try:
            found = _sealed(_read(spark, root, schema, [n]), columns) if n in there else None
            whole = found is not None and (found.rows, found.checksum) == (sealed.rows, sealed.checksum)
        except Exception as e:  # whatever the reader says of the file, it can't be read
            note(spark, root, "recover", f"segment {n}: {type(e).__name__}")
            whole = False
        if not whole:
            damaged.append(n)
    for n in damaged:
        if n in there:
            folders.move(spark, f"{root}/segments/segment_id={n}", f"{root}/quarantine/segment_id={n}-{now.generation}")
    kept = {n: s for n, s in now.committed.items() if n not in damaged}
    replayed = 0
    if log is not None:
        first = min([now.last_seq + 1, *(now.committed[n].first_seq for n in damaged)])
        number = max([REPLAYED, *(n + 1 for n in there if REPLAYED <= n < MERGED)])
        missing = log.where(F.col("seq") >= first)
        replayed = missing.count()
        refresh(missing, number, root)
    _store(spark, root, replace(now, generation=now.generation + 1, committed=kept))
    note(spark, root, "recover", f"{len(kept)} segments whole, {len(damaged)} set apart, {replayed} operations replayed")
    return {"verified": sorted(kept), "quarantined": damaged, "replayed": replayed}


# -- merging -------------------------------------------------------------------


def tier_plan(sizes: dict[int, int]) -> list[list[int]]:
    """Which segments to merge: of each tier (by the power of two of its rows) with three or more, the four smallest at most."""
    tiers: dict[int, list[int]] = {}
    for segment, rows in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
        tiers.setdefault(max(1, rows).bit_length() - 1, []).append(segment)
    return [x[:MERGE_MOST] for _, x in sorted(tiers.items()) if len(x) >= TIER_FULL]


def vacuum(spark: SparkSession, root: str) -> int:
    """Remove the segments that merges have replaced, and their numbers from the manifest."""
    now = state(spark, root)
    for n in now.retired:
        folders.remove(spark, f"{root}/segments/segment_id={n}")
    if now.retired:
        _store(spark, root, replace(now, generation=now.generation + 1, retired=()))
    return len(now.retired)


def merge(spark: SparkSession, root: str, schema: str, everything: bool = False) -> int:
    """Merge full tiers, or all segments (which drops deletes); the number of merges.

    What the merge before has replaced is removed first: its readers have had
    the time between the two.
    """
    vacuum(spark, root)
    some = numbers(spark, root)
    now = _read(spark, root, schema, some)
    sizes = {r.segment_id: r["count"] for r in now.groupBy("segment_id").count().collect()}
    plan = [sorted(sizes)] if everything and len(sizes) else tier_plan(sizes)
    top = max([*some, MERGED])  # beyond any batch number
    for k, chosen in enumerate(plan, 1):
        rows = newest(now.where(F.col("segment_id").isin(chosen)).drop("segment_id"))
        if everything:
            rows = rows.where(F.col("op") == INDEX)
        rows.write.mode("overwrite").parquet(f"{root}/segments/segment_id={top + k}")
        old = state(spark, root)
        kept = {n: s for n, s in old.committed.items() if n not in chosen}
        if len(kept) < len(old.committed):  # what replaces a committed segment is committed
            part = _sealed(_read(spark, root, schema, [top + k]), _names(spark, schema))
            lost = [s for n, s in old.committed.items() if n in chosen]
            kept[top + k] = replace(part, first_seq=min(s.first_seq for s in lost))
        _store(spark, root, replace(old, generation=old.generation + 1, committed=kept, retired=(*old.retired, *chosen)))
        note(spark, root, "merge", f"{len(chosen)} segments into {top + k}")
    return len(plan)
