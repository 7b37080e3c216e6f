"""SimHash near-duplicates by pigeonring filtering.

Fingerprints have 64 bits.  Two that differ in at most ``max_bits`` bits, cut
into ``SEGMENTS`` segments on a ring, have a start from which every chain of
consecutive segments keeps within its share of the budget: the first l
segments differ in at most floor(l * max_bits / SEGMENTS) bits together.  With
five segments and four bits the first segment is equal and the second differs
in one bit at most; that is the join key (probed in all its one-bit variants),
and the longer chains prune what meets there before the full Hamming check.

Of a key's members only those are compared that can matter: first each with
one pivot; then, where a key still holds more than one component, members of
different components.  Links within a component that is already connected are
never listed, so a large group of near copies costs rows in proportion to its
size, and no link between components is lost.

Defined results: null text is an empty text; texts without words have
fingerprint 0 and are linked like any other; texts of fewer words than a
shingle hash their whole sequence; rows with null id are grouped by their text
but never name a component unless it has no other id (then null); repeated
rows give repeated results; an empty table gives an empty result; other
columns are ignored.

Scale: texts are read once, without a shuffle.  Distinct fingerprints cross
one shuffle in about 75 thin rows each.  Nothing is collected, and what comes of
those rows is joined by shuffle at any size: Spark takes an exploded table for as
small as its source, and would broadcast 1.6 GB of it for 0.5 GB of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components

SEED = 42
BITS = 64
SEGMENTS = 5
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LANES = np.uint64(0x0001000100010001)
LANE_MAX = 65_535


def shingle_hashes(text: str, words_per_shingle: int) -> np.ndarray:
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    k = min(words_per_shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]), ">u8").astype(np.uint64)


def majorities(hashes: list[np.ndarray]) -> np.ndarray:
    """A fingerprint for each array: bits set in over half of its hashes; 0 for an empty one."""
    out = np.zeros(len(hashes), np.uint64)
    pieces = [(i, h[s : s + LANE_MAX]) for i, h in enumerate(hashes) for s in range(0, len(h), LANE_MAX)]
    if not pieces:
        return out
    flat = np.concatenate([h for _, h in pieces])
    sizes = np.array([len(h) for _, h in pieces])
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.array([i for i, _ in pieces])
    total = np.zeros(len(hashes), np.int64)
    np.add.at(total, owner, sizes)
    for shift in range(16):
        lanes = np.add.reduceat((flat >> np.uint64(shift)) & LANES, heads)
        for lane in range(4):
            counts = np.zeros(len(hashes), np.int64)
            np.add.at(counts, owner, ((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))
            out |= (2 * counts > total).astype(np.uint64) << np.uint64(16 * lane + shift)
    return out


def fingerprints(docs: DataFrame, *, words_per_shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) with the fingerprint as a signed 64-bit integer."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                made = majorities([shingle_hashes(t or "", words_per_shingle) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made.astype(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, fp long")


def _segments(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    wide = BITS % segments
    widths = [BITS // segments + (i < wide) for i in range(segments)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _segment(fp: Column, at: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, at[0]).bitwiseAND(F.lit((1 << at[1]) - 1))


def _key(i: int, first: Column, second: Column, width: int) -> Column:
    return F.lit(i << 58) + F.shiftleft(first, width) + second


def chains_hold(start: Column, x: Column, y: Column, max_bits: int, segments: int) -> Column:
    """Whether the chains from ``start`` keep their budgets, up to the whole ring (the Hamming check itself)."""
    differ = x.bitwiseXOR(y)
    holds: Column = F.lit(False)
    ring = _segments(segments)
    for i in range(segments):
        good: Column = F.lit(True)
        mask = 0
        for length in range(1, segments + 1):
            first, width = ring[(i + length - 1) % segments]
            mask |= ((1 << width) - 1) << first
            signed = mask - (1 << 64) if mask >> 63 else mask
            good = good & (F.bit_count(differ.bitwiseAND(F.lit(signed))) <= length * max_bits // segments)
        holds = holds | ((start == i) & good)
    return holds


def _probes(fps: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """(key, fp, exact): every key under which a fingerprint can meet another one's exact key."""
    ring, fp = _segments(segments), F.col("fp")
    if 2 * max_bits // segments > 1 or max_bits // segments > 0:
        raise ValueError("the second segment may differ in one bit at most: take more segments")
    options = []
    for i in range(segments):
        first, (at, width) = _segment(fp, ring[i]), ring[(i + 1) % segments]
        second = _segment(fp, (at, width))
        options.append(F.struct(_key(i, first, second, width).alias("key"), F.lit(True).alias("exact")))
        if 2 * max_bits // segments == 1:
            options += [F.struct(_key(i, first, second.bitwiseXOR(F.lit(1 << b)), width).alias("key"), F.lit(False).alias("exact")) for b in range(width)]
    return fps.select("fp", F.explode(F.array(*options)).alias("x")).select("x.key", "fp", "x.exact")


def linked(fps: DataFrame, max_bits: int = 4, segments: int = SEGMENTS) -> DataFrame:
    """(fp, root) for the distinct fingerprints ``fps`` that have a link."""
    start = F.shiftrightunsigned("key", 58)
    probes = _probes(fps, max_bits, segments)
    pivots = probes.where("exact").groupBy("key").agg(F.min("fp").alias("pivot")).withColumnRenamed("key", "key1")
    met = materialize(probes.join(pivots.hint("merge"), F.col("key") == F.col("key1")).where("fp != pivot").select("key", "fp", "exact", "pivot", chains_hold(start, F.col("fp"), F.col("pivot"), max_bits, segments).alias("near")), "met")
    roots = materialize(components(met.where("near").select(F.col("fp").alias("a"), F.col("pivot").alias("b"))), "roots")

    def root(df: DataFrame, of: str, name: str) -> DataFrame:
        found = roots.select(F.col("node").alias("node1"), F.col("root").alias("root1"))
        return df.join(found, F.col(of) == F.col("node1"), "left").withColumn(name, F.coalesce("root1", of)).drop("node1", "root1")

    members = root(met.where("!near").select("key", "fp", "exact", "pivot"), "pivot", "pivot_root")
    members = root(members, "fp", "fp_root").where("fp_root != pivot_root")
    open_keys = materialize(members.select(F.col("key").alias("key1")).distinct(), "open")
    # members of open keys by component: whoever is left aside by the pivot, against everyone else there
    all_met = root(met.join(open_keys, F.col("key") == F.col("key1"), "left_semi").select("key", "fp", "exact"), "fp", "of")
    all_met = all_met.unionByName(root(met.join(open_keys, F.col("key") == F.col("key1"), "left_semi").select("key", F.col("pivot").alias("fp"), F.lit(True).alias("exact")).distinct(), "fp", "of"))
    left = all_met.where("exact").select("key", F.col("fp").alias("x"), F.col("of").alias("x_of"))
    right = all_met.select(F.col("key").alias("key2"), F.col("fp").alias("y"), F.col("of").alias("y_of"))
    rest = left.join(right.hint("merge"), (F.col("key") == F.col("key2")) & (F.col("x_of") != F.col("y_of")) & chains_hold(start, F.col("x"), F.col("y"), max_bits, segments)).select(F.col("x_of").alias("a"), F.col("y_of").alias("b"))
    joined = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest))
    return joined.select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, *, words_per_shingle: int = 4, max_bits: int = 4, segments: int = SEGMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, fingerprint (16 hex digits), component_id (the least id of its component)."""
    made = materialize(fingerprints(docs, words_per_shingle=words_per_shingle, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = materialize(made.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    groups = linked(distinct.select("fp"), max_bits, segments).withColumnRenamed("fp", "fp1")
    rooted = materialize(distinct.join(groups, F.col("fp") == F.col("fp1"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "root1")
    named = rooted.join(names, F.col("root") == F.col("root1")).select(F.col("fp").alias("fp1"), "component_id")
    out = made.join(named, F.col("fp") == F.col("fp1"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
