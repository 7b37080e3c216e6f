"""Connected components of an edge table, by alternating large and small stars.

Each round joins every edge with the least neighbour of its end, in two
halves; rounds are written to the shared folder, so lineage stays short and a
lost executor costs no more than its tasks.  The number of rounds grows with
the logarithm of the longest path.  No list of neighbours is ever built: only
minima are aggregated, which combine before the shuffle.  The edges of a node
with more than a ``HOT_SHARE``th of them take its minimum from a broadcast, so
the centre of a large group is no join key; of such nodes there are
2 * ``HOT_SHARE`` at most, whatever the size of the table.

Each round is a dozen Spark jobs, whose plans and figures stay in the driver's
memory.  So a table of at most ``ONE_TASK`` edges, which one task holds in some
tens of MB, is settled there without rounds; only larger ones, before a round
or after it, take stars, and the driver collects its garbage after each.  Where
no Python is wanted on the executors (``native``), small tables take stars too, each in one
task without any exchange, which is one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Step, release

#: Edges up to which one task finds the components.
ONE_TASK = 1_000_000

#: A node is hot if it has more than one in so many edges, and more than ``HOT_LEAST``.
HOT_SHARE, HOT_LEAST = 1000, 100


def _with_least(rows: DataFrame, ends: DataFrame, edges: int | None) -> DataFrame:
    """``rows`` (a, b) with m, the least neighbour of a by ``ends`` (a, b), of at most 2 * ``edges`` rows; None: all in one task."""
    if edges is None:
        known = ends.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        return rows.join(known.hint("merge"), F.col("a") == F.col("u")).select("a", "b", "m")
    least = ends.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    many = max(HOT_LEAST, edges // HOT_SHARE)
    hot = least.where(F.col("n") > many).select(F.col("a").alias("hot_a"), F.col("m").alias("hot_m"))
    cold = least.where(F.col("n") <= many).select(F.col("a").alias("u"), "m")
    told = rows.join(F.broadcast(hot), F.col("a") == F.col("hot_a"), "left")
    # rows that know their minimum are dealt out at random; where such a key hits a node, the known minimum stands
    told = told.withColumn("k", F.when(F.col("hot_a").isNull(), F.col("a")).otherwise(F.xxhash64("a", "b")))
    met = told.join(cold, F.col("k") == F.col("u"), "left")
    return met.select("a", "b", F.coalesce("hot_m", "m").alias("m"))


def _large(edges: DataFrame, n: int | None) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both if n is not None else both.coalesce(1)
    return _with_least(both.where("b > a"), both, n).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small(edges: DataFrame, n: int | None) -> DataFrame:
    moved = _with_least(edges, edges, n).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    rows = moved.unionByName(edges.groupBy("a").agg(F.min("b").alias("b")))
    return (rows if n is not None else rows.coalesce(1)).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b) and the least node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # x and y are roots: a greater one goes under a lesser
        while (root != (up := root[root])).any():
            root = up
        x, y = root[x], root[y]
        x, y = x[apart := x != y], y[apart]
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.asarray(x.column("a")), np.asarray(x.column("b"))) for x in batches if x.num_rows]
        if held:
            nodes, roots = least_reachable(*(np.concatenate(side) for side in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(run, "node long, root long")


def _stars_in_one_task(step: Step, before: tuple) -> DataFrame:
    """(node, root) by stars, each of which is one task; ``step`` goes."""
    while True:
        large = Step(_large(step.df.coalesce(1), None), "edges")
        step.drop()
        step = Step(_small(large.df.coalesce(1), None), "edges")
        large.drop()
        mark = _mark(step.df.coalesce(1))
        if mark == before:
            return _stars(step)
        before = mark


def _stars(step: Step) -> DataFrame:
    """(node, root) of edges that no round changes any more."""
    roots = step.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return step.df.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK, native: bool = False) -> DataFrame:
    """(node, root): the least node reachable from each node of ``edges`` (integers) that has another as neighbour, itself included."""
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct()
    step = Step(pairs, "edges")
    mark = _mark(step.df)
    while mark[0] > one_task:
        after = Step(_small(_large(step.df, mark[0]), mark[0]), "edges", mark[0])
        step.drop()
        step, before, mark = after, mark, _mark(after.df)
        release(step.spark)
        if mark == before:
            return _stars(step)
    if native:
        return _stars_in_one_task(step, mark)
    found = Step(_in_one_task(step.df), "components")
    step.drop()
    return found.df
