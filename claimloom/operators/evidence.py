"""Evidence for claims, answers and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.scalars import answer_state_for_claim
from claimloom.functions.text import code_tokens
from claimloom.operators.search import top_per_group

# How far each quality of analysis reaches, best first.
QUALITY = ["precise", "syntactic", "lexical", "unavailable"]
MAX_GAPS = 256
PER_CLAIM, IN_ALL = 4, 256
#: Code occurrences that stand for one target; more are told as a gap.
MAX_STRUCTURAL, BUDGET_GAP = 200, "budget_exceeded"
LEAST_SCORE_PPM = 700_000


def evidence_rows(links: DataFrame, occurrences: DataFrame, acceptances: DataFrame) -> DataFrame:
    """Links with the last record of their occurrence and its first acceptance; ``incomplete`` where an occurrence is missing."""
    occ = occurrences.groupBy("occurrence_id").agg(F.max_by(F.struct("path", "byte_start", "line_start", "line_end"), "seq").alias("o"))
    acc = acceptances.groupBy("claim_id", "occurrence_id").agg(F.min_by(F.struct("score_ppm", "judge_fingerprint"), "seq").alias("a"))
    rows = links.join(occ, "occurrence_id", "left").join(acc, ["claim_id", "occurrence_id"], "left")
    return rows.select(*links.columns, "o.*", F.col("a.score_ppm").alias("score_ppm"), F.col("o").isNull().alias("incomplete"))


def link_sources(claims: DataFrame, captured: DataFrame) -> DataFrame:
    """Claims against captured sources by path: a row of evidence, or the gap that stands for it."""
    rows = claims.join(captured.select("path", F.col("source_id").alias("captured_id")), "path", "left")
    outcome = F.when(F.col("captured_id").isNull(), "missing_source").when(F.col("captured_id") != F.col("source_id"), "changed_source").otherwise("linked")
    return rows.withColumn("outcome", outcome)


def overlapping(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows (path, line_start, line_end) whose lines meet a range (path, ls, le): an equi-join on path with the overlap as residual."""
    return rows.join(ranges, "path").where((F.col("line_end") >= F.col("ls")) & (F.col("line_start") <= F.col("le")))


def structural_rows(code: DataFrame, targets: DataFrame, most: int = MAX_STRUCTURAL) -> DataFrame:
    """Code (occurrence_id, symbol, name, path, line_start, line_end) that each target names, and the ``gap`` where it has more than ``most``.

    A target (target_id, path, ls, le, symbol) names a path, or those lines of it
    that meet [ls, le] (null: open), or a symbol by its id or shown name.  Both are
    equi-joins; a target's first ``most`` rows by place are kept before the shuffle ends.
    """
    at_path = targets.where("path is not null").select("target_id", "path", "ls", "le")
    by_path = code.join(at_path, "path").where((F.col("ls").isNull() | (F.col("line_end") >= F.col("ls"))) & (F.col("le").isNull() | (F.col("line_start") <= F.col("le"))))
    named = targets.where("symbol is not null").select("target_id", F.col("symbol").alias("wanted"))
    spelled = code.withColumn("wanted", F.explode(F.array_distinct(F.array("symbol", "name"))))
    found = by_path.select("target_id", *code.columns).unionByName(spelled.join(named, "wanted").select("target_id", *code.columns))
    first = top_per_group(found, ["target_id"], ["path", "line_start", "line_end", "occurrence_id"], most + 1)
    over = first.where(F.col("rn") > most).select("target_id", F.lit(BUDGET_GAP).alias("gap"))
    return first.where(F.col("rn") <= most).drop("rn").join(over, "target_id", "left")


def latest_snapshots(links: DataFrame) -> DataFrame:
    """(claim_id, snapshot_id): the snapshot of each claim's last deterministic supporting link by ``link_seq``."""
    firm = links.where((F.col("method") == "deterministic") & (F.col("stance") == "supports"))
    return firm.groupBy("claim_id").agg(F.max_by("snapshot_id", "link_seq").alias("snapshot_id"))


def answers(view: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each claim's answer: its status first, then what its evidence says."""
    said = evidence.groupBy("claim_id").agg(F.bool_or(F.col("stance") == "contradicts").alias("c"), F.bool_or(F.col("stance") == "supports").alias("s"))
    rows = view.join(said, "claim_id", "left")
    return rows.withColumn("answer", answer_state_for_claim(F.col("status"), F.coalesce("c", F.lit(False)), F.coalesce("s", F.lit(False)))).drop("c", "s")


def merge_coverage(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Best quality, most sources, all occurrences, any truncation, and the distinct gaps (at most 256, in order)."""
    place = F.array_position(F.array(*map(F.lit, QUALITY)), F.col("analysis_quality"))
    gaps = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("gaps")))), 1, MAX_GAPS)
    merged = parts.groupBy(*keys).agg(F.min(place).alias("q"), F.max("sources_examined").alias("sources_examined"), F.sum("occurrences").alias("occurrences"), F.bool_or("truncated").alias("truncated"), gaps.alias("gaps"))
    return merged.select(*keys, F.element_at(F.array(*map(F.lit, QUALITY)), F.col("q").cast("int")).alias("analysis_quality"), "sources_examined", "occurrences", "truncated", "gaps")


def code_candidates(claims: DataFrame, code: DataFrame, per_claim: int = PER_CLAIM, in_all: int = IN_ALL) -> DataFrame:
    """(claim_id, occurrence_id, rank): code that shares words with a claim, 4 for each in its names and 1 in its context.

    Both sides are exploded into tokens and meet by equality, so no claim is
    compared with an occurrence it shares nothing with.
    """
    c = claims.select("claim_id", F.explode(code_tokens(F.concat_ws(" ", "text", "subject_hint", "object_hint"))).alias("token"))
    names = code.select("occurrence_id", F.explode(code_tokens(F.concat_ws(" ", "symbol", "name"))).alias("token"), F.lit(4).alias("w"))
    context = code.select("occurrence_id", F.explode(code_tokens(F.concat_ws(" ", "path", "context"))).alias("token"), F.lit(1).alias("w"))
    ranked = c.join(names.unionByName(context), "token").groupBy("claim_id", "occurrence_id").agg(F.sum("w").alias("rank"))
    return top_per_group(ranked, ["claim_id"], [F.desc("rank"), "occurrence_id"], per_claim, in_all)


def accept(proposals: DataFrame, least_ppm: int = LEAST_SCORE_PPM) -> DataFrame:
    """Proposals (relation, score_ppm) with the stance they are accepted in; null for rejected."""
    stance = F.when(F.col("relation") == "duplicate", "supports").when(F.col("relation").isin("supersedes", "conflict"), "contradicts")
    return proposals.withColumn("stance", F.when(F.col("score_ppm") >= least_ppm, stance))
