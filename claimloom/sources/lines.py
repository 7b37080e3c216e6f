"""Scanning texts into lines: numbers, byte offsets, and what is skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.text import MAX_LINE_BYTES, trim_white

LINES = "array<struct<line:int,char_start:bigint,text:string>>"
#: Lines that are scanned together.
CHUNK = 64


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every file under ``root`` whose name ends in .md in any case, in path order."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.where(F.lower("path").endswith(".md")).select("path", "content", F.sha2("content", 256).alias("body_hash")).orderBy("path")


def decode_sources(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources as text, and those that are no UTF-8."""
    good = F.is_valid_utf8(F.col("content"))
    return files.where(good).withColumn("text", F.decode("content", "utf-8")).drop("content"), files.where(~good).select("path", F.lit("invalid_utf8").alias("failure"))


def line_table(docs: DataFrame, text: str = "text", keep_all: bool = False) -> DataFrame:
    """``docs`` exploded into (line, char_start, text as line_text).

    Lines keep their number and byte offset; a final newline ends the last
    line.  Front matter (from a first line of three dashes to the next such
    line, or to the end), fenced code and lines over 64 KiB are left out unless
    ``keep_all``.  The scan runs inside each row, without a shuffle.
    """
    pieces = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\n\\z", ""), "\n", -1)
    parts = F.when(F.coalesce(F.col(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(pieces)

    def seen(s, i):
        """What a line is by itself, found once."""
        raw = F.when(s.endswith("\r"), F.substring(s, F.lit(1), F.char_length(s) - 1)).otherwise(s)
        long = F.octet_length(raw) > MAX_LINE_BYTES
        rule = raw.contains("---") & (trim_white(raw) == "---") & ~long
        mark = raw.contains("```") & F.ltrim(raw).startswith("```") & ~long
        return F.struct(raw.alias("raw"), (i + 1).cast("int").alias("line"), (F.octet_length(s) + 1).cast("bigint").alias("bytes"), long.alias("long"), rule.alias("rule"), mark.alias("mark"))

    numbered = F.transform(parts, seen)

    def step(s, x):
        row = F.array(F.struct(x["line"].alias("line"), s["offset"].alias("char_start"), x["raw"].alias("text")))
        offset = (s["offset"] + x["bytes"]).alias("offset")
        if keep_all:
            return F.struct(offset, s["code"].alias("code"), s["front"].alias("front"), F.concat(s["out"], row).alias("out"))
        opens = (x["line"] == 1) & x["rule"]
        fence = x["mark"] & ~s["front"]
        kept = ~x["long"] & ~s["front"] & ~opens & ~fence & ~s["code"]
        return F.struct(
            offset,
            F.when(fence, ~s["code"]).otherwise(s["code"]).alias("code"),
            F.when(opens, True).when(s["front"] & x["rule"], False).otherwise(s["front"]).alias("front"),
            F.when(kept, F.concat(s["out"], row)).otherwise(s["out"]).alias("out"),
        )

    def state(offset, code, front, out):
        return F.struct(offset.alias("offset"), code.alias("code"), front.alias("front"), out.alias("out"))

    def once(value, body):
        return F.element_at(F.transform(F.array(value), body), 1)

    # a step copies the lines kept so far, so they are taken in chunks; a chunk goes on where the last one ended
    def chunk(done, c):
        last = F.element_at(done, -1)
        return F.concat(done, F.array(F.aggregate(c, state(last["offset"], last["code"], last["front"]), step)))

    def state(offset, code, front):
        return F.struct(offset.alias("offset"), code.alias("code"), front.alias("front"), F.array().cast(LINES).alias("out"))

    chunks = F.element_at(F.transform(F.array(numbered), lambda n: F.when(F.size(n) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / CHUNK).cast("int")), lambda k: F.slice(n, k * CHUNK + 1, F.lit(CHUNK))))), 1)
    start = F.array(state(F.lit(0).cast("bigint"), F.lit(False), F.lit(False)))
    scanned = F.flatten(F.transform(F.aggregate(chunks, start, chunk), lambda r: r["out"]))
    rows = docs.withColumn("_lines", scanned)
    others = [c for c in docs.columns if c != text]
    return rows.select(*others, F.explode_outer("_lines").alias("_l")).where("_l is not null").select(*others, F.col("_l.line").alias("line"), F.col("_l.char_start").alias("char_start"), F.col("_l.text").alias("line_text"))
