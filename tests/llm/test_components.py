"""Connected components: results by union-find, and what a small graph costs the driver."""

import random
import uuid

import pytest

from marlinspike.llm import components, shared


def smallest(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: r for x in list(root) if (r := find(x)) != x}


def graphs():
    rng = random.Random(3)
    yield []
    yield [(5, 5)]
    yield [(1, 2), (2, 1), (1, 2)]
    yield [(i, i + 1) for i in range(300)]
    yield [(0, i) for i in range(1, 300)]
    yield [(299, i) for i in range(299)] + [(1000, 1001), (1001, 1002)]
    yield [(rng.randrange(-500, 500), rng.randrange(-500, 500)) for _ in range(450)]


@pytest.mark.parametrize("one_task", [shared.ONE_TASK, 500, 0])
def test_components_equal_union_find(spark, monkeypatch, one_task):
    monkeypatch.setattr(shared, "ONE_TASK", one_task)
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    for pairs in graphs():
        frame = spark.createDataFrame(pairs, "a long, b long")
        got = components.connected_components(frame, shared.Scratch(spark, "cc-test")).collect()
        assert len({r.node for r in got}) == len(got)
        assert {r.node: r.component for r in got} == smallest(pairs)


def test_small_graph_takes_few_tasks(spark, tmp_path):
    """The driver keeps account of every task: with many shuffle partitions a small graph took thousands."""
    rng = random.Random(4)
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(700)]
    spark.createDataFrame(pairs, "a long, b long").write.parquet(str(tmp_path / "edges"))
    edges = spark.read.parquet(str(tmp_path / "edges"))
    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    group, sc = uuid.uuid4().hex, spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup(group, "components")
        got = components.connected_components(shared.in_one_task(edges, len(pairs)), shared.Scratch(spark, "cc-test"))
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert {r.node: r.component for r in got.collect()} == smallest(pairs)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numTasks for s in stages if (i := tracker.getStageInfo(s)))
    assert 0 < tasks < 200
