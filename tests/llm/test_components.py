"""Connected components against a union-find, with centres that hold most edges."""

import random

import pytest
from pyspark.sql import functions as F

from claimloom.llm.components import HOT_LEAST, components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in list(root) if any(x in e and e[0] != e[1] for e in edges)}


def random_edges():
    rng = random.Random(5)
    leaves = 5 * HOT_LEAST
    centre = [(7, 10_000 + i) for i in range(leaves)]  # a least centre, and one that is greater than its leaves
    great = [(99_999, 20_000 + i) for i in range(leaves)]
    chain = [(30_000 + i, 30_001 + i) for i in range(60)]
    loose = [(rng.randrange(40_000, 40_300), rng.randrange(40_000, 40_300)) for _ in range(150)]
    return centre + great + chain + loose + centre[:5] + [(b, a) for a, b in great[:5]]


@pytest.mark.parametrize("edges", [random_edges(), [], [(3, 3)], [(-5, 4), (4, -5), (4, 9)]])
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == brute(edges)
    assert len(got) == len({r.node for r in got})


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components_by_stars_and_in_one_task(spark, one_task):
    got = components(spark.createDataFrame(random_edges(), "a long, b long"), one_task=one_task).collect()
    assert {r.node: r.root for r in got} == brute(random_edges()) and len(got) == len({r.node for r in got})


def test_small_tables_need_few_jobs(spark):
    """What the driver keeps of each job is what filled its memory: a long chain takes no rounds."""
    group = "few-jobs"
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert components(spark.createDataFrame([(i, i + 1) for i in range(2000)], "a long, b long")).where("root = 0").count() == 2001
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 12
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_pairs_in_slices_link_alike(spark):
    """Groups do not depend on how many pairs are on disk at a time, and no slice asks for many more than it may hold."""
    from pyspark.sql import functions as F

    from claimloom.llm import linking

    rng = random.Random(9)
    keys = spark.createDataFrame([(k, h, h % 4) for h in range(400) for k in rng.sample(range(60), 3)], "key long, h long, sketch long").cache()
    asked = []

    def verified(pairs):
        asked.append(pairs.count())
        return pairs.where((F.col("x") + F.col("y")) % 17 == 0)

    def groups(**how):
        asked.clear()
        return {r.h: r.root for r in linking.linked(keys, lambda differ: differ < 2, verified, **how).collect()}

    whole, largest = groups(), max(asked)
    assert groups(slice_pairs=300, slice_keys=100) == whole
    assert len(asked) > 4 and max(asked) <= largest / 4


def test_components_without_python_on_executors(spark):
    """Stars in one task: as by union-find, with few jobs, and no Python or exchange of rows in a star's plan."""
    from claimloom.llm import components as c

    edges = random_edges()
    group = "native"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = c.components(spark.createDataFrame(edges, "a long, b long"), native=True).collect()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 60
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert {r.node: r.root for r in got} == brute(edges) and len(got) == len({r.node for r in got})
    one = spark.range(9).selectExpr("id as a", "id - 1 as b").coalesce(1)
    for star in (c._large, c._small):
        plan = star(one, None)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Arrow" not in plan


def test_lines_are_linked_without_python_on_executors(spark, monkeypatch):
    from claimloom.llm import components as c
    from claimloom.llm import line_dedup

    monkeypatch.setattr(c, "_in_one_task", lambda edges: 1 / 0)
    docs = spark.createDataFrame([(1, "one line of some words that stands here twice"), (2, "one line of some words that stands here twica")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup(docs).collect()} == {1: 0, 2: 1}


def test_exploded_probes_are_not_broadcast(spark, monkeypatch):
    """Spark sizes them like the few fingerprints that they come of."""
    from claimloom.llm import simhash

    plans, real = {}, simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or real(df, name))
    fps = real(spark.range(300).select(F.xxhash64("id").alias("fp")).unionByName(spark.range(300).select((F.xxhash64("id").bitwiseXOR(F.lit(5))).alias("fp"))), "fps")
    found = simhash.linked(fps).collect()
    assert len(found) == 600 and "SortMergeJoin" in plans["met"] and "Broadcast" not in plans["met"]


def test_rows_beyond_the_bound_are_not_broadcast(spark):
    from claimloom.llm import linking

    keys = spark.range(100)
    for n, way in ((linking.BROADCAST_ROWS, "BroadcastHashJoin"), (linking.BROADCAST_ROWS + 1, "SortMergeJoin")):
        many = linking.bounded(keys.select(F.col("id").alias("id1")), n)
        assert way in keys.join(many, F.col("id") == F.col("id1"))._jdf.queryExecution().executedPlan().toString()
