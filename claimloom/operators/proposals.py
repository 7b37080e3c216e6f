"""Claims proposed by a plug-in from spans of text, each span asked for once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.claims import faithful

CLAIM = "text string, subject_hint string, predicate_hint string, object_hint string, confidence_ppm int"


def propose(spans: DataFrame, model: Callable[[str, list[str]], list[dict]], cache: DataFrame | None = None, fingerprint: str = "model", least_ppm: int = 600_000) -> DataFrame:
    """Claims of spans (text, heading_path, ...) that keep to their span; equal spans are asked for once, cached ones never."""
    key = F.sha2(F.concat_ws("\x1f", F.lit(fingerprint), F.array_join("heading_path", "\x1e"), "text").cast("binary"), 256)
    keyed = spans.withColumn("cache_key", key)
    distinct = keyed.select("cache_key", "text", "heading_path").dropDuplicates(["cache_key"])
    miss = distinct if cache is None else distinct.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [{"cache_key": k, **{c: None for c in ("subject_hint", "predicate_hint", "object_hint")}, "confidence_ppm": 500_000, **claim} for k, text, path in zip(part["cache_key"], part["text"], part["heading_path"], strict=True) for claim in model(text, list(path))]
            yield pd.DataFrame(rows, columns=["cache_key", "text", "subject_hint", "predicate_hint", "object_hint", "confidence_ppm"])

    made = miss.mapInPandas(run, f"cache_key string, {CLAIM}")
    every = made if cache is None else made.unionByName(cache.select("cache_key", "text", "subject_hint", "predicate_hint", "object_hint", "confidence_ppm"))
    rows = keyed.withColumnRenamed("text", "span").join(every, "cache_key")
    return faithful(rows, "text", "span", least_ppm)


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Claims that an extractor wrote as one JSON object a line; lines that do not parse are kept apart in ``_corrupt``."""
    return spark.read.schema(f"source_path string, line_start int, line_end int, {CLAIM}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def write_ndjson(claims: DataFrame, path: str) -> None:
    claims.write.mode("overwrite").json(path)
