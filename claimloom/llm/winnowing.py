"""Document fingerprints by winnowing; DataFrame functions only.

A text is a row of tokens: its words, and of words of over ``PIECE`` characters
(unspaced text) each character, so that tokens do not depend on where a run
begins.  Every run of ``GRAM`` tokens has a hash, which rolls from one to the
next (cyclic polynomial: one rotation, the token that enters, the token that
leaves); of each window of
``WINDOW`` consecutive hashes the least is marked, the rightmost of equal ones.
Any passage of at least ``WINDOW + GRAM - 1`` tokens that two texts share leaves
a mark in both.  A mark keeps its position: it is a 64-bit integer of the low
32 bits of the hash (upper half) and 2^32 - 1 less the position from 1, so that
the least mark of a window is the least hash at its rightmost place.  A text with fewer hashes than a window
has one window; a text of fewer tokens than a gram has one gram, the whole.

Tokens are taken in chunks of ``CHUNK`` windows, so a long text costs time in
proportion to its length and intermediate arrays stay small.

A fingerprint reads as its marks in order, in hexadecimal.  The likeness of two
fingerprints is the share of hashes they have in common (Jaccard).

Defined results: null text is an empty text, whose one gram is empty; null ids
come first in the order of documents; rows with equal ids are ordered by the
hash of their text, then stay arbitrary among equal texts; a table of one
row has itself as its next; an empty table gives an empty result; other columns
are ignored.  Ids must be integers.

Scale: texts cross one shuffle, by ranges of ids small enough for a task; a
range takes the first document of the next one along.  What reaches the driver
is one boundary and one id for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, shuffle_partitions

GRAM, WINDOW, CHUNK, PIECE = 5, 8, 64, 16
TOKEN = rf"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{{1,{PIECE}}}(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]"
RANGE_ROWS = 100_000
NULL_ORDER = -(1 << 63)


def tokens(text: Column) -> Column:
    """Hashes of the tokens of a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def _turned(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _rolled(of: Column, size: Column, first: Column, count: Column) -> Column:
    """The marks of the ``count`` runs of tokens from place ``first`` (from 1) on, by one pass."""
    k = F.least(F.lit(GRAM), size)

    def step(state: Column, i: Column) -> Column:
        """Keeps the run that ended before place ``i``, then takes the token at ``i`` in and the first of the run out."""
        full = i >= first + k
        mark = F.shiftleft(state["h"], 32).bitwiseOR(F.lit(0xFFFFFFFF) - (i - k))
        leaves = F.when(full, _turned(F.get(of, i - k - 1), GRAM)).otherwise(F.lit(0).cast("long"))
        entered = _turned(state["h"], 1).bitwiseXOR(F.coalesce(F.get(of, i - 1), F.lit(0).cast("long")))
        return F.struct(entered.bitwiseXOR(F.coalesce(leaves, F.lit(0).cast("long"))).alias("h"), F.when(full, F.concat(state["out"], F.array(mark))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(first, first + count + k - 1), start, step)["out"]


def _windows(size: Column) -> Column:
    return F.greatest(F.lit(1), size - (GRAM + WINDOW - 2))


def _chunk(of: Column, size: Column, c: Column) -> Column:
    """The marks of the windows of chunk ``c`` of the token hashes ``of``."""
    windows = F.least(F.lit(CHUNK), _windows(size) - c * CHUNK)
    grams = F.least(windows + (WINDOW - 1), F.greatest(F.lit(1), size - (GRAM - 1)) - c * CHUNK)
    keys = _rolled(of, size, c * CHUNK + 1, grams)

    def least(marks: Column, reach: int) -> Column:
        if reach == WINDOW:
            return F.array_distinct(F.slice(marks, 1, windows))
        step = min(reach, WINDOW - reach)
        halves = F.zip_with(marks, F.slice(marks, F.lit(step + 1), F.size(marks)), lambda x, y: F.least(x, y))
        return let(halves, lambda m: least(m, reach + step))

    return let(keys, lambda m: least(m, 1))


def chunked_marks(of: Column, first: Column | None = None) -> Column:
    """array<array<bigint>>: the marks of each chunk of the tokens ``of``, from chunk ``first`` on."""
    size = F.size(of)
    first = F.lit(0) if first is None else first
    chunks = F.ceil(_windows(size) / CHUNK).cast("int")
    every = F.transform(F.sequence(first, chunks - 1), lambda c: _chunk(of, size, c))
    return F.when(chunks > first, every).otherwise(F.array().cast("array<array<bigint>>"))


def marks(chunks: Column) -> Column:
    return F.array_distinct(F.flatten(chunks))


def hashes(of: Column) -> Column:
    return F.array_distinct(F.transform(of, lambda m: F.shiftright(m, 32)))


def as_text(of: Column) -> Column:
    return F.array_join(F.transform(of, F.hex), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two arrays without repeats."""
    return let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both).cast("double"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, marks, fingerprint) of each document, without a shuffle."""
    made = docs.select(F.col(id_col), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    made = made.select(id_col, marks(chunked_marks(F.col("tokens"))).alias("marks"))
    return made.withColumn("fingerprint", as_text(F.col("marks")))


def _range_of(order: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` lie below ``order``: by every 64th, then among 64."""
    if not bounds:
        return F.lit(0)
    width = 64
    coarse = F.array(*map(F.lit, bounds[width - 1 :: width])) if len(bounds) >= width else F.array().cast("array<bigint>")
    every = F.array(*map(F.lit, bounds))
    skipped = F.size(F.filter(coarse, lambda b: b < order)) * width
    return let(skipped, lambda s: s + F.size(F.filter(F.slice(every, s + 1, F.lit(width)), lambda b: b < order)))


def with_next(docs: DataFrame, *, id_col: str, text_col: str) -> tuple[DataFrame, W]:
    """Rows (id, text, ord, tie, ghost, range) with ``next_text``, and the window that orders them.

    ``ghost`` rows repeat the first document of the next range at the end of each range.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ORDER)).alias("ord"))
    total = rows.count()
    ranges = max(4 * shuffle_partitions(spark), total // RANGE_ROWS)
    bounds: list[int] = []
    if total > ranges:
        found = rows.agg(F.percentile_approx("ord", [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges))).first()[0]
        bounds = sorted(set(found or []))
    rows = rows.withColumn("range", _range_of(F.col("ord"), bounds))
    firsts = sorted((r[0], r[1]) for r in rows.groupBy("range").agg(F.min("ord")).collect())
    before = {o: firsts[i - 1][0] for i, (_, o) in enumerate(firsts)}
    rows = rows.withColumn("tie", F.xxhash64("text"))
    lead = rows.where(F.col("ord").isin(list(before))).groupBy("ord").agg(F.min(F.struct("tie", "text", "id")).alias("x"))
    place = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    ghosts = lead.select("x.id", "x.text", "ord", F.element_at(place, F.col("ord").cast("long")).cast("int").alias("range"), "x.tie", F.lit(True).alias("ghost"))
    window = W.partitionBy("range").orderBy("ghost", "ord", "tie")
    both = rows.withColumn("ghost", F.lit(False)).withColumn("range", F.col("range").cast("int")).unionByName(ghosts)
    return both.withColumn("next_text", F.lead("text").over(window)), window


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its fingerprint, that of its edited text, and its likeness to that and to the next document's.

    The edited text has its last quarter of characters replaced by the first as many of the next document.
    """
    rows, window = with_next(docs, id_col=id_col, text_col=text_col)
    n = F.char_length("text")
    kept = (n - F.floor(n / 4)).cast("int")
    prefix = F.substring(F.col("text"), F.lit(1), kept)
    rows = rows.withColumn("n_chars", n.cast("long"))
    # all tokens of the kept part but its last stand in the edited text as they do in the text
    rows = rows.withColumn("intact", F.greatest(F.lit(0), F.regexp_count(prefix, F.lit(TOKEN)) - 1))
    rows = rows.withColumn("edited", F.concat(prefix, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), n - kept)))
    rows = rows.select("id", "ord", "tie", "ghost", "range", "n_chars", "intact", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), tokens(F.col("edited")).alias("edited"), tokens(F.col("text")).alias("own"))
    rows = rows.withColumn("chunks", chunked_marks(F.col("own"))).drop("own")
    # and so have chunks whose windows all lie in them the same marks
    rows = rows.withColumn("same", F.greatest(F.lit(0), F.floor((F.col("intact") - (GRAM + WINDOW - 2)) / CHUNK).cast("int")))
    rows = rows.withColumn("edited_marks", F.array_distinct(F.concat(F.flatten(F.slice("chunks", F.lit(1), F.col("same"))), F.flatten(chunked_marks(F.col("edited"), F.col("same"))))))
    rows = rows.withColumn("marks", marks(F.col("chunks"))).drop("chunks", "edited", "same", "intact")
    rows = rows.withColumn("own", hashes(F.col("marks")))
    rows = rows.select("id", "ord", "tie", "ghost", "range", "n_chars", "edited_sha256", as_text(F.col("marks")).alias("fingerprint"), as_text(F.col("edited_marks")).alias("edited_fingerprint"), "own", likeness(F.col("own"), hashes(F.col("edited_marks"))).alias("near_edited"))
    rows = rows.withColumn("next_own", F.lead("own").over(window)).where("!ghost")
    return rows.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", likeness(F.col("own"), F.col("next_own")).alias("near_next"))
