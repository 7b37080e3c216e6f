"""Revisions: ancestry as a partial order, capture under budgets, snapshot relations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.scalars import overlay_relation
from claimloom.operators.tables import written

MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES = 20_000, 4 << 20, 128 << 20
MAX_WALK, MAX_PRIORS = 100_000, 1024
# What belongs to a captured source by name or extension (in any case), and leading folders left out.
SOURCE_NAMES = ["Makefile", "makefile", "GNUmakefile", "Dockerfile", "Containerfile", "justfile", "Justfile", "Rakefile", "Gemfile", "Procfile", "Jenkinsfile", "BUILD", "WORKSPACE"]
SOURCE_EXTENSIONS = ["md", "rs", "py", "js", "jsx", "ts", "tsx", "go", "java", "kt", "c", "h", "cc", "cpp", "hpp", "toml", "yaml", "yml", "json", "sh"]
LEFT_OUT = ["target", ".git"]


def in_scope(path, extensions: list[str] = SOURCE_EXTENSIONS, names: list[str] = SOURCE_NAMES):
    """Whether a path is captured: a known name, or an extension after at least one more character of the name."""
    named = path.rlike(f"(^|/)({'|'.join(names)})$") | path.rlike(f"(?i)[^/][.]({'|'.join(extensions)})$")
    return named & ~path.rlike(f"^({'|'.join(x.replace('.', '[.]') for x in LEFT_OUT)})/")


def ancestors(parents: DataFrame, child: str = "commit", parent: str = "parent", steps: int = 64) -> DataFrame:
    """(commit, ancestor, known): all proper ancestors by doubling of paths, each round written.

    ``known`` is false where the ancestor has no row of its own: history is cut there.
    """
    edges = parents.select(F.col(child).alias("commit"), F.col(parent).alias("ancestor")).where("ancestor is not null").distinct()
    reach, before = written(edges), -1
    for _ in range(steps):
        n = reach.count()
        if n == before:
            break
        before = n
        longer = reach.alias("a").join(reach.alias("b"), F.col("a.ancestor") == F.col("b.commit")).select(F.col("a.commit").alias("commit"), F.col("b.ancestor").alias("ancestor"))
        reach = written(reach.unionByName(longer).distinct())
    have = parents.select(F.col(child).alias("_c")).distinct()
    return reach.join(have, F.col("ancestor") == F.col("_c"), "left").select("commit", "ancestor", F.col("_c").isNotNull().alias("known"))


def compare_commits(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """Pairs (a, b) with their order: same, before (a is an ancestor of b), after, unknown where history is cut, else concurrent."""
    fwd = reach.select(F.col("commit").alias("b"), F.col("ancestor").alias("a"), F.lit(True).alias("_ab"))
    back = reach.select(F.col("commit").alias("a"), F.col("ancestor").alias("b"), F.lit(True).alias("_ba"))
    cut = reach.where("!known").select(F.col("commit").alias("_cut")).distinct()
    rows = pairs.join(fwd, ["a", "b"], "left").join(back, ["a", "b"], "left").join(cut, F.col("a") == F.col("_cut"), "left").withColumnRenamed("_cut", "_cut_a").join(cut, F.col("b") == F.col("_cut"), "left")
    relation = F.when(F.col("a") == F.col("b"), "same").when(F.col("_ab"), "before").when(F.col("_ba"), "after").when(F.col("_cut_a").isNotNull() | F.col("_cut").isNotNull(), "unknown").otherwise("concurrent")
    return rows.select(*pairs.columns, relation.alias("relation"))


def snapshot_relations(new: DataFrame, priors: DataFrame, reach: DataFrame) -> DataFrame:
    """Relations of a new snapshot with the newest priors of its repository; unknown ones are not stored."""
    from claimloom.operators.search import top_per_group

    near = top_per_group(priors, ["repository_id"], [F.desc("seq")], MAX_PRIORS).drop("rn")
    p = near.select("repository_id", F.col("snapshot_id").alias("left_snapshot"), F.col("base_commit").alias("a"), F.col("dirty").alias("prior_dirty"))
    n = new.select("repository_id", F.col("snapshot_id").alias("right_snapshot"), F.col("base_commit").alias("b"), F.col("dirty").alias("new_dirty"))
    rows = compare_commits(p.join(n, "repository_id").where("left_snapshot <> right_snapshot"), reach)
    return rows.withColumn("relation", overlay_relation(F.col("relation"), F.col("prior_dirty"), F.col("new_dirty"))).where("relation <> 'unknown'").select("repository_id", "left_snapshot", "right_snapshot", "relation")


def claim_order(pairs: DataFrame, snapshots: DataFrame, facts: DataFrame) -> DataFrame:
    """Claim pairs (a, b) with the order of their snapshots: the recorded relation, else the reverse one inverted."""
    from claimloom.functions.scalars import invert_relation

    s = snapshots.select("claim_id", "snapshot_id")
    rows = pairs.join(s.select(F.col("claim_id").alias("a"), F.col("snapshot_id").alias("sa")), "a", "left").join(s.select(F.col("claim_id").alias("b"), F.col("snapshot_id").alias("sb")), "b", "left")
    f = facts.select(F.col("left_snapshot").alias("sa"), F.col("right_snapshot").alias("sb"), F.col("relation").alias("fwd"))
    g = facts.select(F.col("right_snapshot").alias("sa"), F.col("left_snapshot").alias("sb"), F.col("relation").alias("rev"))
    rows = rows.join(f, ["sa", "sb"], "left").join(g, ["sa", "sb"], "left")
    temporal = F.when(F.col("sa").isNull() | F.col("sb").isNull(), F.lit(None)).when(F.col("sa") == F.col("sb"), "same").otherwise(F.coalesce("fwd", invert_relation(F.col("rev")), F.lit("unknown")))
    return rows.select(*pairs.columns, temporal.alias("temporal"))


def capture(files: DataFrame, max_files: int = MAX_FILES, max_file_bytes: int = MAX_FILE_BYTES, max_total_bytes: int = MAX_TOTAL_BYTES) -> DataFrame:
    """Files (snapshot_id, path, mode, bytes) with ``gap``: null if captured, else why not.

    A file that is left out takes nothing from the budgets, so the fold over a
    snapshot's files is sequential; it is bounded by the listing of one snapshot.
    """

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        n = total = 0
        gaps = []
        for mode, size in zip(rows["mode"], rows["bytes"], strict=True):
            if mode != "file":
                gaps.append(f"unsupported_{mode}")
            elif size > max_file_bytes:
                gaps.append("file_too_large")
            elif n >= max_files or total + size > max_total_bytes:
                gaps.append("budget_exceeded")
            else:
                n, total = n + 1, total + size
                gaps.append(None)
        return rows.assign(gap=gaps)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.groupBy("snapshot_id").applyInPandas(lambda key, rows: run(key, rows.sort_values("path")), f"{schema}, gap string")


def read_files(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from rows
