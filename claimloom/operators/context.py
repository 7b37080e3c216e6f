"""Context for readers and agents: what is current, stale and in conflict, and the documents compiled from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.claims import drop_folded_pairs
from claimloom.operators.journal import Refused


def agent_context(view: DataFrame, conflicts: DataFrame, settled: bool = True, allow_unsettled: bool = False) -> DataFrame:
    """Claims that stand, stale ones with what replaced them, and conflicts without repeats, as one table of parts."""
    if not settled and not allow_unsettled:
        raise Refused("unsettled", "relations are not settled; allow_unsettled reads anyway", resume="relate")
    texts = view.select("claim_id", "text")
    current = view.where("status <> 'superseded'").select(F.lit("current").alias("part"), F.col("claim_id").alias("id"), "text", F.lit(None).cast("string").alias("other"))
    by = texts.select(F.col("claim_id").alias("superseded_by"), F.col("text").alias("by_text"))
    stale = view.where("status = 'superseded'").select("claim_id", "text", "superseded_by").join(by, "superseded_by", "left").select(F.lit("stale").alias("part"), F.col("claim_id").alias("id"), "text", F.coalesce("by_text", F.lit("")).alias("other"))
    a = texts.select(F.col("claim_id").alias("claim_a"), F.col("text").alias("ta"))
    b = texts.select(F.col("claim_id").alias("claim_b"), F.col("text").alias("tb"))
    pairs = conflicts.join(a, "claim_a", "left").join(b, "claim_b", "left").na.fill("", ["ta", "tb"])
    pairs = drop_folded_pairs(pairs, "ta", "tb", "conflict_id").select(F.lit("conflict").alias("part"), F.col("conflict_id").alias("id"), F.col("ta").alias("text"), F.col("tb").alias("other"))
    return current.unionByName(stale).unionByName(pairs)


def compile_documents(spark, context: DataFrame, folder: str, frontier: int) -> dict[str, str]:
    """Writes the context as JSON tables and one Markdown table of lines under ``folder``; returns the paths."""
    out = {}
    for part in ("current", "stale", "conflict"):
        out[part] = f"{folder}/{part}.json"
        context.where(F.col("part") == part).select("id", "text", "other").write.mode("overwrite").json(out[part])
    line = F.when(F.col("part") == "current", F.concat(F.lit("- **"), "id", F.lit("**: "), "text")).when(F.col("part") == "stale", F.concat(F.lit("- "), "id", F.lit(': "'), "text", F.lit('" superseded by "'), "other", F.lit('"'))).otherwise(F.concat(F.lit("- "), "id", F.lit(': "'), "text", F.lit('" against "'), "other", F.lit('"')))
    order = F.when(F.col("part") == "current", 1).when(F.col("part") == "stale", 2).otherwise(3)
    heads = spark.createDataFrame([(0, "", "# Onboarding"), (0, "1", f"_Replayed through sequence {frontier}._"), (1, "", "## Current claims"), (2, "", "## Stale claims (do not trust)"), (3, "", "## Conflicts")], "o int, id string, value string")
    lines = heads.unionByName(context.select(order.alias("o"), "id", line.alias("value"))).orderBy("o", "id")
    out["onboarding"] = f"{folder}/onboarding.md"
    lines.select("value").write.mode("overwrite").text(out["onboarding"])
    return out
