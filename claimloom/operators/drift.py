"""A corpus that drifts between two versions, its oracle, and the score of a view against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of ten items, by the last digit of their number.
KINDS = ["explicit_supersede", "explicit_supersede", "implicit_supersede", "implicit_supersede", "conflict", "conflict", "duplicate", "unrelated", "unrelated", "unrelated"]


def items(spark: SparkSession, n: int) -> DataFrame:
    """(id, kind, v1_file, v1_text, v2_file, v2_text, expect_v1, expect_v2) for n items; status by replacement wording alone."""
    k = (F.col("id") % 10).cast("int")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    service = F.concat(F.lit("Service "), F.col("id").cast("string"))
    v1 = F.concat(service, F.lit(" is hosted in region north."))
    v2 = (
        F.when(kind == "explicit_supersede", F.concat(service, F.lit(" is hosted in region south now.")))
        .when(kind == "implicit_supersede", F.concat(service, F.lit(" is hosted in region south.")))
        .when(kind == "conflict", F.concat(service, F.lit(" is not hosted in region north.")))
        .when(kind == "duplicate", v1)
        .otherwise(F.concat(F.lit("Team "), F.col("id").cast("string"), F.lit(" uses the blue dashboard.")))
    )
    rows = spark.range(n).select("id", kind.alias("kind"), F.concat(F.lit("v1/"), F.col("id").cast("string"), F.lit("-v1.md")).alias("v1_file"), v1.alias("v1_text"), F.concat(F.lit("v2/"), F.col("id").cast("string"), F.lit("-v2.md")).alias("v2_file"), v2.alias("v2_text"))
    return rows.withColumn("expect_v1", F.when(F.col("kind") == "explicit_supersede", "superseded").otherwise("current")).withColumn("expect_v2", F.lit("current"))


def sources(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("v1_file").alias("path"), F.col("v1_text").alias("text")).unionByName(rows.select(F.col("v2_file").alias("path"), F.col("v2_text").alias("text")))


def score(rows: DataFrame, view: DataFrame) -> DataFrame:
    """Per kind: items, passes, recall in ppm, and stale claims that are still shown as current."""
    one = view.select(F.col("path").alias("v1_file"), F.col("status").alias("got_v1"))
    two = view.select(F.col("path").alias("v2_file"), F.col("status").alias("got_v2"))
    both = rows.join(one, "v1_file", "left").join(two, "v2_file", "left")
    # equal bytes are ingested once, so a duplicate's second file has no claim of its own
    ok = (F.col("got_v1") == F.col("expect_v1")) & F.coalesce(F.col("got_v2") == F.col("expect_v2"), F.col("kind") == "duplicate")
    leak = (F.col("expect_v1") == "superseded") & (F.col("got_v1") != "superseded")
    phantom = (F.col("expect_v1") == "current") & (F.col("got_v1") == "superseded")
    return both.groupBy("kind").agg(F.count("*").alias("total"), F.count(F.when(ok, 1)).alias("passed"), F.count(F.when(leak, 1)).alias("leaked"), F.count(F.when(phantom, 1)).alias("phantom")).withColumn("recall_ppm", F.floor(F.col("passed") * 1_000_000 / F.col("total")).cast("int"))
