"""Small tables between the steps of a job are not read by the tasks of a large shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, ngram_join


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def tasks_of(spark, job):
    """What a job returns, and the tasks that it ran."""
    track, group = spark.sparkContext.statusTracker(), f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    out = job()
    stages = {s for j in track.getJobIdsForGroup(group) for s in track.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, sum(i.numCompletedTasks for s in stages if (i := track.getStageInfo(s)))


def test_components_of_few_edges_take_few_tasks(many_partitions):
    spark, rng = many_partitions, random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300) if i % 40] + [(1000, 1000 + i) for i in range(1, 400)] + [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(300)]
    found, tasks = tasks_of(spark, lambda: ngram_join.components(spark.createDataFrame(edges, "p long, rep long")).collect())
    least = {}
    root = lambda x: x if least.setdefault(x, x) == x else root(least[x])
    for a, b in edges:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    assert {r.id: r.component for r in found} == {x: root(x) for x in list(least)}
    assert tasks < 1000


def test_newton_steps_keep_their_partitions(many_partitions):
    spark = many_partitions
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 37 + 1).cast("int"))).alias("text"))
    cells = mixing.checkpointed(mixing.sized(docs).groupBy("key", "size").agg(F.first("source").alias("source"), F.count("*").alias("n")))
    aims = mixing.checkpointed(mixing.targets(cells))
    found, tasks = tasks_of(spark, lambda: {r.key: r.tilt for r in mixing.tilts(cells, aims).collect()})
    assert len(found) == 5 and tasks < 1200


def test_cells_of_stuck_regions_are_not_made(spark, monkeypatch):
    """One group of near copies cannot be cut: its points stay as many as they are, and its pairs are found in blocks."""
    import numpy as np

    rng, rows, made, real = np.random.default_rng(1), [], [], ngram_join.staged
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    for k in range(150):
        x = base.copy()
        x[rng.integers(0, 60, 3)] = rng.integers(0, 1 << 63, 3, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        rows.append(("a", k, 60, k, -1, True, bytearray(ngram_join._sketch(np.sort(x)))))

    def staged(df):
        out = real(df)
        if "sketch" in out.columns:
            made.append(out.where("key like '%/%'").count())
        return out

    monkeypatch.setattr(ngram_join, "TASK_POINTS", 64)
    monkeypatch.setattr(ngram_join, "staged", staged)
    assert ngram_join.recursive_join(spark.createDataFrame(rows, ngram_join.CELL), 80).count() > 0
    assert sum(made) == 0
