"""Sources, snapshots and the write path."""

import json
import random

from pyspark.sql import functions as F

from quillon.sources import documents
from quillon.streaming import lifecycle

SCHEMA = "seq long, op string, id long, body string"


def test_json_array_and_snapshot(spark, tmp_path):
    (tmp_path / "seed.json").write_text(json.dumps([{"id": 1, "title": "a"}, {"id": 2, "title": None}], indent=1))
    docs = documents.read_json(spark, str(tmp_path / "seed.json"), "id long, title string", array=True)
    path = documents.write_snapshot(docs, str(tmp_path), 17)
    assert path.endswith("snapshot-17.json")
    assert sorted(documents.read_json(spark, path, docs.schema).collect()) == [(1, "a"), (2, None)]


def test_segments_follow_the_log(spark, tmp_path):
    rng, root, seq, log = random.Random(5), str(tmp_path / "root"), 0, []
    (tmp_path / "log").mkdir()
    ops = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "log"))
    assert lifecycle.live(spark, root, SCHEMA).count() == 0
    for round_no in range(2):  # the second start goes on from the checkpoint
        for _ in range(4):
            batch = []
            for _ in range(12):
                seq += 1
                batch.append((seq, rng.choice(["index", "index", "delete"]), rng.randint(1, 20), f"v{seq}"))
            (tmp_path / "log" / f"{seq:05d}.json").write_text("\n".join(json.dumps(dict(zip(("seq", "op", "id", "body"), x, strict=True))) for x in batch))
            log += batch
        lifecycle.ingest(ops, root).awaitTermination()
        last = {i: (s, op, body) for s, op, i, body in log}
        want = sorted((s, i, body) for i, (s, op, body) in last.items() if op == "index")
        assert sorted(map(tuple, lifecycle.live(spark, root, SCHEMA).collect())) == want
        before = lifecycle.segments(spark, root, SCHEMA).select("segment_id").distinct().count()
        assert lifecycle.merge(spark, root, SCHEMA) >= 1
        assert lifecycle.segments(spark, root, SCHEMA).select("segment_id").distinct().count() < before
        assert sorted(map(tuple, lifecycle.live(spark, root, SCHEMA).collect())) == want
    lifecycle.merge(spark, root, SCHEMA, everything=True)
    assert sorted(map(tuple, lifecycle.live(spark, root, SCHEMA).collect())) == want
    assert lifecycle.segments(spark, root, SCHEMA).where(F.col("op") == "delete").count() == 0


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    batch = spark.createDataFrame([(1, "index", 1, "a"), (2, "index", 1, "b"), (3, "delete", 9, None)], SCHEMA)
    for _ in range(2):
        lifecycle.refresh(batch, 0, str(tmp_path))
    lifecycle.refresh(batch.limit(0), 1, str(tmp_path))
    assert list(map(tuple, lifecycle.live(spark, str(tmp_path), SCHEMA).collect())) == [(2, 1, "b")]


def test_tier_plan():
    assert lifecycle.tier_plan({1: 4, 2: 5, 3: 7, 4: 8, 5: 6, 6: 4}) == [[1, 6, 2, 5]]
    assert lifecycle.tier_plan({1: 4, 2: 8}) == []


def events_log(n, seed):
    rng = random.Random(seed)
    return [(s, rng.choice(["index", "index", "index", "delete"]), rng.randint(1, 25), f"v{s}") for s in range(1, n + 1)]


def expected(log):
    last = {i: (s, op, body) for s, op, i, body in log}
    return sorted((s, i, body) for i, (s, op, body) in last.items() if op == "index")


def searchable(spark, root):
    return sorted(map(tuple, lifecycle.live(spark, root, SCHEMA).collect()))


def test_segments_of_a_given_size(spark, tmp_path):
    log = events_log(100, 1)
    lifecycle.load(spark.createDataFrame(log, SCHEMA).repartition(5), str(tmp_path), 30)
    assert lifecycle.numbers(spark, str(tmp_path)) == [0, 1, 2, 3]
    spans = lifecycle.segments(spark, str(tmp_path), SCHEMA).groupBy("segment_id").agg(F.min("seq").alias("a"), F.max("seq").alias("z")).collect()
    assert all(30 * r.segment_id < r.a <= r.z <= 30 * (r.segment_id + 1) for r in spans)
    assert searchable(spark, str(tmp_path)) == expected(log)


def test_commit_crash_recover(spark, tmp_path):
    root, log = str(tmp_path), events_log(120, 2)
    ops = spark.createDataFrame(log, SCHEMA)
    part = lambda a, z: ops.where(F.col("seq").between(a, z))
    for k in range(4):
        lifecycle.refresh(part(20 * k + 1, 20 * k + 20), k, root)
    first = lifecycle.commit(spark, root, SCHEMA)
    assert (first.generation, sorted(first.committed), first.last_seq) == (1, [0, 1, 2, 3], 80)
    lifecycle.refresh(part(81, 100), 4, root)
    assert lifecycle.pending(spark, root, SCHEMA, ops).count() == 20
    before = lifecycle.stats(spark, root, SCHEMA, ops)
    assert (before["segments"], before["uncommitted"], before["pending"], before["generation"]) == (5, 1, 20, 1)
    assert before["documents"] == len(expected(log[:100])) and before["reclaimable"] > 0
    # one committed segment is changed, one is gone
    part(1, 3).write.mode("overwrite").parquet(f"{root}/segments/segment_id=1")
    lifecycle.folders.remove(spark, f"{root}/segments/segment_id=2")
    report = lifecycle.recover(spark, root, SCHEMA, ops)
    assert report["quarantined"] == [1, 2] and report["verified"] == [0, 3]
    assert report["replayed"] == 121 - first.committed[1].first_seq  # from the first operation of segment 1 that counted
    assert searchable(spark, root) == expected(log)
    assert [n.split("-")[0] for n in lifecycle.folders.children(spark, f"{root}/quarantine")] == ["segment_id=1"]
    assert lifecycle.recover(spark, root, SCHEMA, ops)["quarantined"] == []
    assert searchable(spark, root) == expected(log)
    assert {r.kind for r in lifecycle.events(spark, root).collect()} == {"commit", "recover"}


def test_an_unreadable_segment_is_set_apart(spark, tmp_path):
    root, log = str(tmp_path), events_log(40, 3)
    ops = spark.createDataFrame(log, SCHEMA)
    lifecycle.load(ops, root, 20)
    lifecycle.commit(spark, root, SCHEMA)
    for f in (tmp_path / "segments" / "segment_id=0").glob("*.parquet"):
        f.write_bytes(b"PAR1 no longer")
    assert lifecycle.recover(spark, root, SCHEMA, ops)["quarantined"] == [0]
    assert searchable(spark, root) == expected(log)


def test_merges_keep_the_manifest_small(spark, tmp_path):
    root, log = str(tmp_path), events_log(240, 4)
    lifecycle.load(spark.createDataFrame(log, SCHEMA), root, 20)
    lifecycle.commit(spark, root, SCHEMA)
    while lifecycle.merge(spark, root, SCHEMA):
        assert searchable(spark, root) == expected(log)
    now = lifecycle.state(spark, root)
    assert now.retired == () and len(lifecycle.numbers(spark, root)) <= 6
    assert set(now.committed) == set(lifecycle.numbers(spark, root)) == {int(n.split("=")[1]) for n in lifecycle.folders.children(spark, f"{root}/segments")}
    assert len(lifecycle.folders.children(spark, f"{root}/manifest")) <= 2
    assert lifecycle.recover(spark, root, SCHEMA)["quarantined"] == []


def test_nothing_there(spark, tmp_path):
    root = str(tmp_path / "none")
    assert lifecycle.numbers(spark, root) == [] and lifecycle.merge(spark, root, SCHEMA) == 0
    assert lifecycle.commit(spark, root, SCHEMA).committed == {} and lifecycle.recover(spark, root, SCHEMA)["verified"] == []
    assert lifecycle.events(spark, str(tmp_path / "other")).count() == 0
