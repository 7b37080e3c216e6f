"""Sessions: numbered turns, transcripts and what is remembered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(turns: DataFrame, existing: DataFrame | None = None, session: str = "session_id", order: str = "observed_at_ms") -> DataFrame:
    """New turns with turn_no, going on from those a session has."""
    n = F.row_number().over(W.partitionBy(session).orderBy(order))
    if existing is None:
        return turns.withColumn("turn_no", n)
    last = existing.groupBy(session).agg(F.max("turn_no").alias("_last"))
    return turns.join(last, session, "left").withColumn("turn_no", n + F.coalesce("_last", F.lit(0))).drop("_last")


def transcript(turns: DataFrame, session: str = "session_id", no: str = "turn_no", speaker: str = "speaker", text: str = "text", speakers: list[str] | None = None) -> DataFrame:
    """One text per session, its turns in order; ``speakers`` keeps only theirs."""
    rows = turns if speakers is None else turns.where(F.col(speaker).isin(speakers))
    line = F.concat(F.col(speaker), F.lit(": "), F.col(text))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(no).alias("n"), line.alias("l"))))
    return rows.groupBy(session).agg(F.array_join(F.transform(ordered, lambda x: x["l"]), "\n").alias("transcript"), F.count("*").alias("turns"))


def memory(view: DataFrame, conflicts: DataFrame) -> DataFrame:
    """What an answer may draw on: current claims, stale ones with what replaced them, open conflicts."""
    current = view.where("status <> 'superseded'").select(F.lit("current").alias("part"), F.col("claim_id").alias("id"), "text", F.lit(None).cast("string").alias("by"))
    stale = view.where("status = 'superseded'").select(F.lit("stale").alias("part"), F.col("claim_id").alias("id"), "text", F.col("superseded_by").alias("by"))
    open_ = conflicts.select(F.lit("conflict").alias("part"), F.col("conflict_id").alias("id"), F.col("reason").alias("text"), F.lit(None).cast("string").alias("by"))
    return current.unionByName(stale).unionByName(open_)
