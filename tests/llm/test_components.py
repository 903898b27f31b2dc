"""Components of link tables, by rounds and in the driver, against union-find, and what they cost."""

import random

import pytest

from quillon.llm.components import components


def union_find(links):
    root = {x: x for link in links for x in link if link[0] != link[1]}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return sorted((x, find(x)) for x in root)


def graph():
    """A long path in random order, a star, a ring, a repeated link, a loop, and pairs at random."""
    rng = random.Random(3)
    path = rng.sample(range(1000, 1 << 40), 90)
    ring = rng.sample(range(-50, 0), 11)
    links = [*zip(path[:-1], path[1:], strict=True), *((77, k) for k in range(100, 140)), *zip(ring, ring[1:] + ring[:1], strict=True), (5, 6), (6, 5), (5, 6), (9, 9)]
    return links + [(rng.randrange(200, 320), rng.randrange(200, 320)) for _ in range(60)]


@pytest.mark.parametrize("limit", [0, 20, 100_000])
def test_components_equal_union_find(spark, limit):
    links = graph()
    got = components(spark.createDataFrame(links, "a long, b long"), limit)
    assert sorted(tuple(r) for r in got.collect()) == union_find(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert components(spark.createDataFrame([(4, 4)], "a long, b long")).collect() == []


def test_few_links_take_no_rounds_of_shuffles(spark):
    """Each task of a shuffle leaves files, however few its rows: 211 partitions filled the disk on a small table."""
    context, links = spark.sparkContext, spark.createDataFrame(graph(), "a long, b long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        context.setJobGroup("components", "components")
        components(links).collect()
        tracker = context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 40 <= tasks < 300
