"""Backups as manifests: every difference is a finding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes, hash_hex) of every file under ``folder``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = F.lit(folder.removeprefix("file://").rstrip("/") + "/")
    name = F.element_at(F.split(F.col("path"), base, -1), -1)
    return files.select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("hash_hex"))


def findings(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, name) for every file that is missing, unexpected, of another length or another content."""
    e = expected.select("name", F.col("bytes").alias("b1"), F.col("hash_hex").alias("h1"))
    f = found.select("name", F.col("bytes").alias("b2"), F.col("hash_hex").alias("h2"))
    rows = e.join(f, "name", "full")
    kind = F.when(F.col("h2").isNull(), "missing_file").when(F.col("h1").isNull(), "unexpected_file").when(F.col("b1") != F.col("b2"), "length_mismatch").when(F.col("h1") != F.col("h2"), "hash_mismatch")
    return rows.select(kind.alias("kind"), "name").where("kind is not null")


def create(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copies the tables under ``source`` and writes a manifest beside them; returns the manifest."""
    from claimloom.operators.journal import Refused
    from claimloom.operators.tables import exists

    if exists(spark, target):
        raise Refused("exists", "the backup's folder exists already")
    copy(spark, source, f"{target}/data")
    rows = manifest(spark, f"{target}/data")
    rows.coalesce(1).write.parquet(f"{target}/manifest")
    return spark.read.parquet(f"{target}/manifest")


def verify(spark: SparkSession, target: str) -> DataFrame:
    """Findings of a backup against its manifest; none means it is verified."""
    return findings(spark.read.schema("name string, bytes long, hash_hex string").parquet(f"{target}/manifest"), manifest(spark, f"{target}/data"))


def restore(spark: SparkSession, target: str, root: str) -> None:
    """Puts a verified backup under ``root``, which must not exist, by copy and rename."""
    from claimloom.operators.journal import Refused
    from claimloom.operators.tables import exists

    if exists(spark, root):
        raise Refused("exists", "the root exists already", retry_safe=False)
    if verify(spark, target).limit(1).count():
        raise Refused("unverified", "the backup differs from its manifest", retry_safe=False)
    copy(spark, f"{target}/data", f"{root}.part")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    part = path(f"{root}.part")
    part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(part, path(root))


def copy(spark: SparkSession, source: str, target: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    b.getFileSystem(conf).mkdirs(b.getParent())
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
