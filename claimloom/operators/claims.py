"""Claims from lines, and which of them later claims replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.functions import ids
from claimloom.functions.text import has_replacement, is_claim_line, normalize, with_hints
from claimloom.sources.lines import line_table


def new_sources(sources: DataFrame, known: DataFrame | None = None, order: str = "path") -> DataFrame:
    """Sources whose bytes are not known yet; of equal ones in the batch the first by ``order`` stays."""
    rows = sources.withColumn("body_hash", ids.digest(F.col("text")))
    if known is not None:
        rows = rows.join(known.select("body_hash").distinct(), "body_hash", "left_anti")
    first = rows.groupBy("body_hash").agg(F.min(order).alias("_first"))
    return rows.join(first, "body_hash").where(F.col(order) == F.col("_first")).drop("_first")


def extract(sources: DataFrame) -> DataFrame:
    """Claim rows of sources (source_id, path, text): a claim per claim line, with exact provenance and hints."""
    lines = line_table(sources).where(is_claim_line(F.col("line_text"))).withColumnRenamed("line_text", "text")
    rows = with_hints(lines)
    return rows.withColumn("claim_id", ids.claim_id(F.col("source_id"), F.col("line"), F.col("normalized_text"))).withColumn("char_end", F.col("char_start") + F.octet_length("text"))


def first_replacement(claims: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """(claim_id, superseded_by): the first claim of the group in ``order`` that says it replaces and reads otherwise.

    Mutual supersession is possible and kept.
    """
    return first_replacement_of(claims, claims, group, order)


def first_replacement_of(new: DataFrame, old: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """(claim_id, superseded_by) of ``old`` claims by ``new`` ones.

    Two minima per group decide every member: the first replacing claim, and the
    first whose text differs from that one's.  No claim is paired with another,
    so a group of any size costs one pass.
    """
    row = F.struct(*order, F.col("claim_id").alias("by"), F.col("normalized_text").alias("reads"))
    says = new.where(has_replacement(F.col("normalized_text"))).select(*group, row.alias("r"))
    key = [F.col(g) for g in group]
    one = says.groupBy(*key).agg(F.min("r").alias("r1"))
    same = _same(group, "s", "o")
    two = says.alias("s").join(one.alias("o"), same).where(F.col("s.r.reads") != F.col("o.r1.reads")).groupBy(*[F.col(f"s.{g}").alias(g) for g in group]).agg(F.min("s.r").alias("r2"))
    both = one.alias("s").join(two.alias("o"), same, "left").select(*[F.col(f"s.{g}").alias(g) for g in group], "r1", "r2")
    hit = old.alias("s").join(both.alias("o"), same)
    by = F.when(F.col("s.normalized_text") != F.col("o.r1.reads"), F.col("o.r1.by")).otherwise(F.col("o.r2.by"))
    return hit.select(F.col("s.claim_id").alias("claim_id"), by.alias("superseded_by")).where("superseded_by is not null")


def _same(group: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for g in group:
        out = out & F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}"))
    return out


def decide_pairs(pairs: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Proposals (old_id, new_id, temporal) where each old claim goes to the first proposal, applied or held.

    ``temporal`` is the order of the old claim's snapshot before the new one's;
    null, same and before apply, anything else is held.
    """
    first = pairs.withColumn("_n", F.row_number().over(W.partitionBy("old_id").orderBy(*order))).where("_n = 1").drop("_n")
    good = F.coalesce(F.col("temporal"), F.lit("same")).isin("same", "before")
    held = first.where(~good).withColumn("failure", F.when(F.col("temporal") == "after", "temporal_reversed").when(F.col("temporal") == "concurrent", "temporal_concurrent").otherwise("temporal_unknown"))
    return first.where(good), held


def claim_view(claims: DataFrame, supersedes: DataFrame, open_conflicts: DataFrame) -> DataFrame:
    """Claims with status, superseded_by and the sorted list of what they supersede.

    Superseded comes before conflicting, which comes before current.
    """
    old = supersedes.select("claim_id", "superseded_by")
    back = old.groupBy(F.col("superseded_by").alias("claim_id")).agg(F.sort_array(F.collect_list("claim_id")).alias("supersedes"))
    members = open_conflicts.select(F.explode(F.array("claim_a", "claim_b")).alias("claim_id")).distinct().withColumn("_open", F.lit(True))
    rows = claims.join(old, "claim_id", "left").join(back, "claim_id", "left").join(members, "claim_id", "left")
    status = F.when(F.col("superseded_by").isNotNull(), "superseded").when(F.col("_open"), "conflicting").otherwise("current")
    return rows.withColumn("status", status).withColumn("supersedes", F.coalesce("supersedes", F.array().cast("array<string>"))).drop("_open")


# Subjects where differing objects contradict.
CONTRADICTION_SUBJECTS = ["deploy-process", "release-process", "approval-process", "ownership"]
SCHEDULE_SUBJECTS = ["deploy-process", "release-process"]
CONFIDENCE_GAP_PPM = 250_000


def conflicts(claims: DataFrame, workspace: str = "workspace_id") -> DataFrame:
    """(conflict_id, claim_a, claim_b, subject, reason) for pairs of current claims on one subject that clash.

    Everything that depends on one claim alone is computed before the pairing;
    the pairing is an equi-join on workspace and subject, which Spark splits
    where a subject is hot.
    """
    from claimloom.functions.text import WEEKDAYS, contains_any

    n = F.col("normalized_text")
    day = F.coalesce(*[F.when(contains_any(F.coalesce("object_hint", F.lit("")), [d]), F.lit(d)) for d in WEEKDAYS])
    one = claims.select(
        F.col(workspace).alias("ws"),
        F.coalesce("subject_hint", F.lit("")).alias("subject"),
        "claim_id",
        F.col("text").alias("text"),
        n.alias("n"),
        (has_replacement(n) | has_replacement(F.col("text"))).alias("rep"),
        contains_any(n, ["not"]).alias("neg"),
        F.replace(F.replace(n, F.lit(" not "), F.lit(" ")), F.lit("not "), F.lit("")).alias("bare"),
        F.coalesce("predicate_hint", F.lit("")).alias("p"),
        F.coalesce("object_hint", F.lit("")).alias("o"),
        day.alias("day"),
        F.col("confidence_ppm").alias("c"),
    )
    a, b = one.alias("a"), one.alias("b")

    def x(name):
        return F.col(f"a.{name}"), F.col(f"b.{name}")

    differ = {k: x(k)[0] != x(k)[1] for k in ("n", "o", "p")}
    signal = (
        F.col("a.rep")
        | F.col("b.rep")
        | ((F.col("a.neg") != F.col("b.neg")) & (F.col("a.bare") == F.col("b.bare")))
        | (differ["p"] & ((F.col("a.p") == "changed") | (F.col("b.p") == "changed")))
        | ((F.col("a.p") == "owns") & (F.col("b.p") == "owns") & differ["o"])
        | (F.col("a.subject").isin(SCHEDULE_SUBJECTS) & F.coalesce(F.col("a.day") != F.col("b.day"), F.lit(False)))
        | (F.abs(F.col("a.c") - F.col("b.c")) > CONFIDENCE_GAP_PPM)
        | (F.col("a.subject").isin(CONTRADICTION_SUBJECTS) & differ["o"] & (F.col("a.o") != "") & (F.col("b.o") != ""))
    )
    pairs = a.join(b, (F.col("a.ws") == F.col("b.ws")) & (F.col("a.subject") == F.col("b.subject")) & (F.col("a.claim_id") < F.col("b.claim_id")) & differ["n"] & signal)
    return pairs.select(
        F.col("a.ws").alias(workspace),
        ids.conflict_id(F.col("a.claim_id"), F.col("b.claim_id")).alias("conflict_id"),
        F.col("a.claim_id").alias("claim_a"),
        F.col("b.claim_id").alias("claim_b"),
        F.col("a.subject").alias("subject_hint"),
        F.concat(F.lit('"'), F.col("a.text"), F.lit('" conflicts with "'), F.col("b.text"), F.lit('"')).alias("reason"),
    )


def stale_lines(sources: DataFrame, view: DataFrame) -> DataFrame:
    """Where superseded claims still stand in sources (source_id, path, text) of the same bytes.

    The original line is preferred, then the first one that contains the claim.
    """
    lines = line_table(sources.select("source_id", "path", "text")).select("source_id", "path", "line", normalize(F.col("line_text")).alias("reads"))
    stale = view.where("status = 'superseded' and normalized_text <> ''").select("source_id", "claim_id", F.col("line").alias("line_start"), "normalized_text", "superseded_by")
    hits = lines.join(stale, "source_id").where(F.col("reads").contains(F.col("normalized_text")))
    best = F.min(F.struct((F.col("line") != F.col("line_start")).alias("elsewhere"), F.col("line").alias("line")))
    return hits.groupBy("source_id", "path", "claim_id", "superseded_by").agg(best.alias("b")).select("path", "source_id", "claim_id", "superseded_by", F.col("b.line").alias("line"))


def drop_folded_pairs(rows: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """Of rows whose two texts are the same pair, whatever the case and order, the first by ``order``."""
    pair = F.array_sort(F.array(F.lower(a), F.lower(b)))
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(pair).orderBy(order))).where("_n = 1").drop("_n")


def faithful(claims: DataFrame, claim: str, source: str, least_ppm: int = 600_000) -> DataFrame:
    """``claims`` with recall_ppm, the share of a claim's content tokens that its source has, and whether it reaches ``least_ppm``."""
    from claimloom.functions.text import content_tokens

    mine, theirs = content_tokens(F.col(claim)), content_tokens(F.col(source))
    recall = F.when(F.size(mine) == 0, F.lit(0)).otherwise(F.floor(F.size(F.array_intersect(mine, theirs)) * 1_000_000 / F.size(mine))).cast("int")
    return claims.withColumn("recall_ppm", recall).withColumn("faithful", F.col("recall_ppm") >= least_ppm)
