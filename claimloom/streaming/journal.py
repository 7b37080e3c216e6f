"""Streams over the event table: tail with a resume cursor, replica follow, and a stateful fold."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import journal
from claimloom.operators.folds import RECORDED, SUPERSEDED
from claimloom.operators.tables import exists


def events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(journal.SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def tail(spark: SparkSession, path: str, cursor: int = 0) -> DataFrame:
    """A stream of (seq, kind) of events after ``cursor``; a cursor beyond the frontier is ignored."""
    if exists(spark, path):
        frontier = spark.read.schema(journal.SCHEMA).parquet(path).agg(F.max("seq")).first()[0] or 0
        cursor = cursor if cursor <= frontier else 0
    return events(spark, path).where(F.col("seq") > cursor).select("seq", "kind", "workspace_id")


def follow(spark: SparkSession, source: str, replica: str, ledger: str, checkpoint: str, anchor: tuple[int, str] | None = None):
    """Copies what the replica lacks, batch by batch; the ledger says which source events it has, so a batch that is run again adds nothing.

    ``anchor`` (seq, event_id) must be an event of the source: another journal under the same path is refused.
    """
    if anchor:
        seq, event = anchor
        if not spark.read.schema(journal.SCHEMA).parquet(source).where((F.col("seq") == seq) & (F.col("event_id") == event)).limit(1).count():
            raise journal.Refused("anchor", "the source does not hold the anchor event", retry_safe=False)

    def add(batch: DataFrame, batch_id: int) -> None:
        have = spark.read.schema("event_id string, source_seq long, batch long").parquet(ledger) if exists(spark, ledger) else None
        new = batch.dropDuplicates(["event_id"])
        if have is not None:
            # a batch that failed between its two writes left events without their rows here
            kept = spark.read.schema(journal.SCHEMA).parquet(replica).select("event_id") if exists(spark, replica) else None
            new = new.join(have.select("event_id"), "event_id", "left_anti")
            new = new if kept is None else new.join(kept, "event_id", "left_anti")
        new = new.select(*journal.SCHEMA.names).persist()
        try:
            new.write.mode("append").partitionBy("workspace_id", "kind").parquet(replica)
            new.select("event_id", F.col("seq").alias("source_seq"), F.lit(batch_id).cast("long").alias("batch")).write.mode("append").parquet(ledger)
        finally:
            new.unpersist()

    return events(spark, source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two journals hold the same events."""
    names = journal.SCHEMA.names
    x, y = a.select(*names), b.select(*names)
    return not x.exceptAll(y).limit(1).count() and not y.exceptAll(x).limit(1).count()


def fork(spark: SparkSession, source: str, target: str, frontier: int) -> None:
    """An exact copy of the journal up to ``frontier``."""
    if exists(spark, target):
        raise journal.Refused("exists", "the target exists already")
    journal.read(spark, source, frontier, exact=True).write.partitionBy("workspace_id", "kind").parquet(target)


STATE = "phase int, text string, superseded_by string, anomalies int, seen int"
CARD = "entity string, phase int, text string, superseded_by string, anomalies int"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    phase, text, by, anomalies, seen = state.get if state.exists else (0, None, None, 0, 0)
    rows = pd.concat(list(frames)).sort_values("seq")
    for kind, value in zip(rows["kind"], rows["value"], strict=True):
        if kind == RECORDED:
            anomalies += phase != 0
            phase, text = 1, value
        elif kind == SUPERSEDED:
            anomalies += phase != 1
            if by is not None:
                anomalies += 1
            else:
                phase, by = 2, value
        seen += 1
    state.update((int(phase), text, by, int(anomalies), int(seen)))
    yield pd.DataFrame({"entity": [key[0]], "phase": [phase], "text": [text], "superseded_by": [by], "anomalies": [anomalies]})


def fold_stream(rows: DataFrame) -> DataFrame:
    """Cards of entities over a stream of (entity, seq, kind, value), each event in time linear in the delta.

    Events of an entity must arrive in the order of their sequence across batches, as an append-only journal gives them.
    """
    return rows.groupBy("entity").applyInPandasWithState(_fold, CARD, STATE, "update", "NoTimeout")


def sessions(turns: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An addition of our own: turns (session_id, ts) counted by session windows of event time, with a watermark for late ones."""
    return turns.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("turns")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns")


def watch(step: Callable[[], int], interval_ms: int, most: int) -> int:
    """Runs ``step`` at most ``most`` times, ``interval_ms`` (50 to 60,000) apart, until it reports nothing new."""
    import time

    if not 50 <= interval_ms <= 60_000:
        raise journal.Refused("interval", "the interval is 50 to 60,000 ms")
    total = 0
    for _ in range(most):
        n = step()
        total += n
        if not n:
            break
        time.sleep(interval_ms / 1000)
    return total
