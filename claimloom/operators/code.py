"""The code plane: identifiers of files as occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]{2,}"
NAMES_PER_FILE = 512
OCCURRENCES = 200_000


def lexical_index(files: DataFrame, path: str = "path", text: str = "text", most: int | None = None) -> DataFrame:
    """(path, name, ord, truncated): each identifier of a file once, whatever its case and in lower case, in order of appearance.

    All names are kept; with ``most``, so many per file, and ``truncated`` says where there are more.
    A path of one row is array work within the row; rows of one path count as one
    file, where a name has its least position in any of them, and names of equal
    position come by name.
    """
    several = files.groupBy(F.col(path).alias("_path")).count().where("count > 1").select("_path")
    of = F.col(path).eqNullSafe(F.col("_path"))
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(f"({IDENTIFIER})")), F.lower)
    rows = files.join(several, of, "left_anti").select(F.col(path).alias("path"), F.array_distinct(found).alias("names"))
    rows = rows.withColumn("truncated", F.size("names") > most if most is not None else F.lit(False))
    alone = rows.select("path", "truncated", F.posexplode(F.slice("names", 1, most) if most is not None else "names").alias("ord", "name")).select("path", "name", (F.col("ord") + 1).alias("ord"), "truncated")
    first = files.join(several, of, "left_semi").select(F.col(path).alias("path"), F.posexplode(found).alias("pos", "name")).groupBy("path", "name").agg(F.min("pos").alias("pos"))
    ranked = first.withColumn("ord", F.row_number().over(W.partitionBy("path").orderBy("pos", "name")))
    if most is None:
        return alone.unionByName(ranked.select("path", "name", "ord", F.lit(False).alias("truncated")))
    ranked = ranked.where(F.col("ord") <= most)
    sizes = first.groupBy(F.col("path").alias("_path")).agg((F.count("*") > most).alias("truncated"))
    return alone.unionByName(ranked.join(sizes, F.col("path").eqNullSafe(F.col("_path"))).select("path", "name", "ord", "truncated"))


# The item keywords of the syntax tagger and the kind each one makes.
RUST_ITEMS = r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait|mod|impl|macro_rules!)\s+([A-Za-z_][A-Za-z0-9_]*)"


def syntax_tags(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, item, name) of items that a line opens; labelled syntactic since no grammar stands behind it."""
    kinds, names = F.regexp_extract_all(F.col(text), F.lit(RUST_ITEMS), F.lit(1)), F.regexp_extract_all(F.col(text), F.lit(RUST_ITEMS), F.lit(2))
    rows = files.select(F.col(path).alias("path"), F.explode(F.arrays_zip(kinds.alias("item"), names.alias("name"))).alias("x"))
    return rows.select("path", "x.item", "x.name", F.lit("syntactic").alias("analysis_quality"))


def occurrences(rows: DataFrame, most: int = OCCURRENCES) -> DataFrame:
    """Occurrences without exact repeats, in their order, at most ``most`` of them."""
    return rows.distinct().orderBy("symbol", "path", "start", "end").limit(most)
