"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Every source asks for its weight's share of all words.  Sources that would
exceed ``max_epochs`` times their own size are clamped there and what they
leave is shared out again by weight, until none is above its clamp.  A target
of e epochs takes every document floor(e) times; the fractional epoch is taken
in a seeded order of the source's documents until its words are used up, the
document at the border in part.

Defined results: null source is a source of its own, last in order; null text
has size 0; a document of size 0 is taken 0 words; documents that are equal in
id, source and size are ordered among themselves arbitrarily, their shares
form the same rows; an empty table gives an empty result; other columns of the
input are ignored.  Reruns agree, whatever the partitioning.

Scale: documents cross one shuffle as (id, source, size, seeded key); a hot
source is split over 256 or more prefixes of the seeded key.  Sources are
ranked by range partitions, and the level is found by scalar aggregates, so
the number of sources is not bound to one task either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, word_count


def rank_sources(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``sources`` (src, source_size) with the weight of each one's place by code point, null last."""
    spark = sources.sparkSession
    order = F.col("src").asc_nulls_last()
    dealt = materialize(sources.repartitionByRange(shuffle_partitions(spark), order).withColumn("part", F.spark_partition_id()), "sources")
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    place = F.row_number().over(W.partitionBy("part").orderBy(order)) - 1 + F.col("ahead")
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    return dealt.join(before, "part").select("src", "source_size", weight.cast("long").alias("weight"))


def water_level(ranked: DataFrame, max_epochs: int) -> float:
    """Words per unit of weight once clamped sources are set aside."""
    cap, level = F.col("source_size") * max_epochs, -1.0
    while True:
        clamped = cap <= F.lit(level) * F.col("weight")
        total, used, free = ranked.agg(F.sum("source_size"), F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, F.col("weight")))).first()
        if not total or not free:
            return max(level, 0.0)
        now = float(total - (used or 0)) / float(free)
        if now <= level:
            return level
        level = now


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row per document: id, size, source_size, target (its source's), taken, whole (full repetitions)."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")))
    sized = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), word_count(F.col(text_col)).alias("size"), key.alias("key")), "sizes")
    ranked = materialize(rank_sources(sized.groupBy("src").agg(F.sum("size").alias("source_size")), weights), "ranked")
    level = water_level(ranked, max_epochs)
    target = F.least((F.col("source_size") * max_epochs).cast("double"), F.lit(level) * F.col("weight"))
    many = sized.count() > 256 * 200_000
    sized = sized.withColumn("salt", F.substring("key", 1, 4 if many else 2))
    salts = sized.groupBy("src", "salt").agg(F.sum("size").alias("words"))
    ahead: Column = F.coalesce(F.sum("words").over(W.partitionBy("src").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole_words = F.floor("target").cast("long")
    sources = ranked.select(F.col("src").alias("src1"), "source_size", target.alias("target")).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(whole_words / F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long")))
    plan = salts.withColumn("ahead", ahead).join(sources, F.col("src").eqNullSafe(F.col("src1"))).select(F.col("src").alias("src2"), F.col("salt").alias("salt2"), "ahead", "source_size", "target", "whole", (whole_words - F.col("whole") * F.col("source_size")).alias("extra"))
    inside = F.coalesce(F.sum("size").over(W.partitionBy("src", "salt").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("inside", inside).join(plan, F.col("src").eqNullSafe(F.col("src2")) & (F.col("salt") == F.col("salt2")))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("extra") - F.col("ahead") - F.col("inside")))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("whole") * F.col("size") + part).alias("taken"), F.col("whole"))


#: DuckDB SQL for ``mix`` over ``documents``: the level as a closed form over sources by cap per weight.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat('mix-1|', CAST(doc_id AS VARCHAR))) AS key FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS weight FROM src),
ordered AS (
  SELECT *, 3 * source_size AS cap,
         coalesce(sum(3 * source_size) OVER w1, 0) AS used, sum(weight) OVER w2 AS free, (SELECT sum(source_size) FROM src) AS total
  FROM ranked
  WINDOW w1 AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         w2 AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lvl AS (SELECT min_by(CAST(total - used AS DOUBLE) / CAST(free AS DOUBLE), used) AS level FROM ordered
        WHERE CAST(total - used AS DOUBLE) / CAST(free AS DOUBLE) * weight <= cap),
targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM lvl) * weight) AS target FROM ordered),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, CAST(floor(p.target) AS BIGINT) - p.whole * p.source_size AS extra,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, extra - inside)) AS BIGINT) AS taken, whole FROM placed
"""
