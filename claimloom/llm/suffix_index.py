"""Suffix-array dedup with a logarithmic index family: repeated byte strings leave every place they stand.

Suffixes are sampled by content: of the hashes of all ``GRAM``-byte strings in
a ``length``-byte string the least one, rightmost of equals, is its anchor, so
equal strings have equal anchors at equal places.  An entry of the index is a
sampled suffix: the hash of its first ``GRAM`` bytes (its key), its place, and
the strings it is the anchor of, which start at consecutive places; together
they are its region.  Suffix arrays keep entries in the order of their keys, so
that suffixes with a common beginning are neighbours.

The index is a family of levels.  A new batch of documents gets its own sorted
array, which is scanned against every level for common keys; then it becomes a
level itself, and levels of equal size merge, so that b batches make at most
log2(b) + 1 levels and every entry is merged log2(b) times.  Keys that two
entries share are the only ones where a long string can be repeated.

Entries whose whole regions are equal verify each other with one hash.  The
others, at the edges of repeated passages, are taken apart into their strings,
which meet by key and hash.

Defined results: null text is empty; texts shorter than ``length`` lose
nothing; rows with null ids and rows that repeat an id count as documents of
their own, also for matches; an empty table gives an empty result; other
columns are ignored.

Scale: about one entry for 100 bytes of text crosses shuffles; texts cross
twice, by row.  Groups of equal entries are only counted, before the shuffle
where they meet in a task; strings that repeat within a batch of texts are
settled there and sent on once; what meets under one key is dealt over eight
parts by its hash.  Nothing is collected.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Step, release, sliced, with_rows

LENGTH, GRAM = 400, 200
BATCHES = 4
#: Bytes of texts that are hashed together; a longer text is a group of its own.
GROUP_BYTES = 1 << 18
PLACE_BITS = 28
U = np.uint64
PLACES = U((1 << PLACE_BITS) - 1)
BASE = 0x9E3779B97F4A7C15
_random = np.random.default_rng(20240229)
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, up to n."""
    if len(_powers["up"]) <= n:
        size = max(n + 1, GROUP_BYTES + 1)
        for name, factor in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, U(factor), U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    return x ^ (x >> U(29))


class Hashes:
    """Hashes of any byte strings within a group of texts laid end to end."""

    def __init__(self, raw: bytes):
        self.n = len(raw)
        up, self.down = powers(self.n)
        self.sums = np.zeros(self.n + 1, U)
        np.cumsum(BYTE_VALUES[np.frombuffer(raw, np.uint8)] * up[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        n = max(0, self.n - size + 1)
        return mix((self.sums[size : size + n] - self.sums[:n]) * self.down[:n])


def entries(raw: bytes, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, key, place, lo, hi, region) of the sampled suffixes of texts laid end to end; places count from the group's start.

    The strings that start in [lo, hi] have their anchor at ``place``.
    """
    ends = np.cumsum(sizes)
    hashes = Hashes(raw)
    grams = hashes.every(gram)
    wide = length - gram + 1
    n = hashes.n - length + 1
    none = (np.empty(0, np.int64),) * 6
    if n <= 0:
        return none
    least = (grams & ~PLACES) | (PLACES - np.arange(len(grams), dtype=U))
    reach = 1
    while reach < wide:
        step = min(reach, wide - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    owner = np.repeat(np.arange(len(sizes)), sizes)[:n]
    inside = np.arange(n) + length <= ends[owner]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none
    place = (PLACES - (least[starts] & PLACES)).astype(np.int64)
    change = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (owner[starts[1:]] != owner[starts[:-1]])))
    lo, hi = starts[change], starts[np.append(change[1:], len(starts)) - 1]
    at = place[change]
    region = mix(hashes.of(lo, hi + length) + mix(((at - lo) << 20 | hi - lo).astype(U)))
    return owner[lo], grams[at], at, lo, hi, region


def _groups(batch, column: str):
    """(first row, bytes, sizes) for groups of texts of about GROUP_BYTES."""
    start, held, total = 0, [], 0
    for i, text in enumerate(batch.column(column).to_pylist()):
        held.append(text.encode())
        total += len(held[-1])
        if total >= GROUP_BYTES:
            yield start, b"".join(held), np.array([len(h) for h in held], np.int64)
            start, held, total = i + 1, [], 0
    if held:
        yield start, b"".join(held), np.array([len(h) for h in held], np.int64)


def _entry_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in sliced(batches):
            row = batch.column("row").to_numpy(zero_copy_only=False)
            for start, raw, sizes in _groups(batch, "text"):
                text, key, at, lo, hi, region = entries(raw, sizes, length, gram)
                first = (np.cumsum(sizes) - sizes)[text]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(region.view(np.int64)), pa.array(row[start + text]), pa.array((lo - first).astype(np.int32)), pa.array((hi - first).astype(np.int32))], ["key", "region", "row", "lo", "hi"])

    return rows.mapInArrow(run, "key long, region long, row long, lo int, hi int")


class IndexFamily:
    """Levels of sorted keys, each of twice as many batches as the one after it, and the keys found shared so far."""

    def __init__(self, rows: int) -> None:
        self.rows = rows
        self.levels: list[tuple[int, Step]] = []
        self.written: list[Step] = []
        self.found: list[DataFrame] = []

    def _write(self, keys: DataFrame) -> Step:
        self.written.append(Step(keys.sortWithinPartitions("key"), "level", self.rows))
        return self.written[-1]

    def add(self, batch: DataFrame) -> None:
        """Sorts a batch of entries, scans it against all levels, and lets equal levels merge."""
        level = self._write(batch.groupBy("key").agg((F.count("*") > 1).alias("again")))
        self.found.append(level.df.where("again").select("key"))
        self.found += [level.df.select("key").join(other.df.select("key"), "key") for _, other in self.levels]
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, other = self.levels.pop()
            level, size = self._write(level.df.select("key").unionByName(other.df.select("key")).distinct().withColumn("again", F.lit(False))), 2 * size
        self.levels.append((size, level))

    def shared(self) -> DataFrame:
        """Keys that at least two entries of all batches have."""
        out = self.found[0]
        for keys in self.found[1:]:
            out = out.unionByName(keys)
        return out.distinct()

    def drop(self) -> None:
        for step in self.written:
            step.drop()


def _string_rows(texts: DataFrame, length: int) -> DataFrame:
    """Strings of the entries to take apart: (key, part, row, places, hashes), or settled spans (row, start, end) with null key.

    Strings that repeat within a group of texts are settled there; one of each is sent on.
    """

    def run(batches):
        for batch in sliced(batches):
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            apart = batch.column("apart").to_pylist()
            for start, raw, sizes in _groups(batch, "text"):
                hashes = Hashes(raw)
                first = np.cumsum(sizes) - sizes
                spec = [(k, e["key"], first[k] + e["lo"], first[k] + e["hi"]) for k in range(len(sizes)) for e in apart[start + k]]
                if not spec:
                    continue
                text, key, lo, hi = (np.array(x, np.int64) for x in zip(*spec, strict=True))
                n = hi - lo + 1
                entry = np.repeat(np.arange(len(n)), n)
                place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                value = hashes.of(place, place + length).view(np.int64)
                owner, keys = text[entry], key[entry]
                order = np.lexsort((place, value, keys))
                value, keys, owner, place = value[order], keys[order], owner[order], place[order]
                again = np.append(False, (value[1:] == value[:-1]) & (keys[1:] == keys[:-1]))
                followed = np.append(again[1:], False)
                settled = again | followed
                spans = _spans(owner[settled], place[settled], length)
                yield _pack(rows[start + spans[0]], spans[1] - first[spans[0]], spans[2] - first[spans[0]])
                send = ~again
                part = (value[send] >> 61) & 7
                order = np.lexsort((place[send], part, owner[send], keys[send]))
                k, p, o, v, at = keys[send][order], part[order], owner[send][order], value[send][order], (place[send] - first[owner[send]])[order]
                heads = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (o[1:] != o[:-1]))) if len(k) else np.empty(0, np.int64)
                offsets = pa.array(np.append(heads, len(k)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(k[heads]), pa.array(p[heads].astype(np.int32)), pa.array(rows[start + o[heads]]), pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(v)), pa.nulls(len(heads), pa.int32()), pa.nulls(len(heads), pa.int32())], NAMES)

    return texts.mapInArrow(run, STRINGS)


NAMES = ["key", "part", "row", "places", "hashes", "start", "end"]
STRINGS = "key long, part int, row long, places array<int>, hashes array<long>, start int, end int"


def _pack(row, start, end) -> pa.RecordBatch:
    n = len(row)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(row), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64())), pa.array(np.asarray(start, np.int32)), pa.array(np.asarray(end, np.int32))], NAMES)


def _spans(owner: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starting places of each owner, as (owner, start, end of the last string)."""
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    heads = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (place[1:] > place[:-1] + 1))) if len(owner) else np.empty(0, np.int64)
    lasts = np.append(heads[1:], len(owner)) - 1 if len(heads) else heads
    return owner[heads], place[heads], place[lasts] + length


def _meet(strings: DataFrame, length: int) -> DataFrame:
    """Spans (row, start, end) of strings that meet an equal one under their key; rows come sorted by (key, part)."""

    def settle(held: list[tuple]) -> pa.RecordBatch | None:
        if len(held) < 2:
            return None
        row = np.repeat(np.array([h[0] for h in held]), [len(h[1]) for h in held])
        place, value = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        _, back, counts = np.unique(value, return_inverse=True, return_counts=True)
        hit = counts[back] > 1
        owner, start, end = _spans(row[hit], place[hit].astype(np.int64), length)
        return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["row", "start", "end"]) if len(owner) else None

    def run(batches):
        held, now = [], None
        for batch in batches:
            keys, parts, rows = (batch.column(c).to_pylist() for c in ("key", "part", "row"))
            places, hashes = batch.column("places"), batch.column("hashes")
            for i in range(batch.num_rows):
                if (keys[i], parts[i]) != now:
                    if done := settle(held):
                        yield done
                    held, now = [], (keys[i], parts[i])
                held.append((rows[i], places[i].values.to_numpy(), hashes[i].values.to_numpy()))
        if done := settle(held):
            yield done

    sent = strings.where("key is not null").repartition("key", "part").sortWithinPartitions("key", "part")
    met = sent.select("key", "part", "row", "places", "hashes").mapInArrow(run, "row long, start int, end int")
    return met.unionByName(strings.where("key is null").select("row", "start", "end"))


def repeated_spans(rows: DataFrame, *, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """(row, spans): the byte spans of each text of ``rows`` (row, text) that are covered by strings standing elsewhere too."""
    spark = rows.sparkSession
    whole = Step(_entry_rows(rows, length, gram).withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int")), "entries")
    total = whole.df.count()
    family = IndexFamily(total // batches)
    for b in range(batches):
        family.add(whole.df.where(F.col("batch") == b))
    candidates = Step(whole.df.drop("batch").join(family.shared(), "key"), "candidates", total)
    whole.drop()
    family.drop()
    release(spark)
    found = candidates.df
    classes = Step(found.groupBy("key", "region").agg(F.count("*").alias("n"), F.min(F.struct("row", "lo", "hi")).alias("one")), "classes", total)
    equal = found.join(classes.df.where("n > 1").select("key", "region"), ["key", "region"], "left_semi")
    spans = equal.select("row", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    open_keys = classes.df.where("n = 1").select("key").distinct()
    apart = classes.df.join(open_keys, "key").select("key", "one.*").groupBy("row").agg(F.collect_list(F.struct("key", "lo", "hi")).alias("apart"))
    strings = Step(_string_rows(rows.join(apart, "row").select("row", "text", "apart"), length), "strings")
    release(spark)
    every = spans.unionByName(_meet(strings.df, length))
    out = Step(every.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")), "spans", total)
    for step in (candidates, classes, strings):
        step.drop()
    release(spark)
    return out.df


def dedup(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, with_bytes: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_bytes (of the text as it came), n_removed, n_spans, kept_sha256, kept_bytes (their number) and, if asked for, the bytes that are kept."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_rows(rows)
    found = repeated_spans(rows.select("row", "text"), length=length, gram=gram, batches=batches)
    both = rows.join(found.withColumnRenamed("row", "row2"), F.col("row") == F.col("row2"), "left").select("id", "text", "spans")

    def run(batches_):
        for batch in sliced(batches_):
            out: list[list] = [[] for _ in range(5)]
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode()
                kept, at, n = [], 0, 0
                start, end = 0, 0
                for s in spans or ():
                    if s["start"] > end or not n:
                        if n:
                            kept.append(raw[at:start])
                            at = end
                        start, end, n = s["start"], s["end"], n + 1
                    else:
                        end = max(end, s["end"])
                if n:
                    kept.append(raw[at:start])
                    at = end
                kept.append(raw[at:])
                rest = b"".join(kept)
                for column, value in zip(out, (len(raw), len(raw) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest if with_bytes else None), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, out, kinds)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = both.mapInArrow(run, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col).withColumn("kept_bytes", F.col("n_bytes") - F.col("n_removed"))
    return done if with_bytes else done.drop("kept")

