"""Substring dedup by recompression: repeated word windows leave their first document only.

A text is a row of word symbols that rounds shorten.  In each round every
symbol tosses a coin that depends on its name and the round alone; a left one
followed by a right one is replaced by the pair's name, and what is left over
is replaced, where equal neighbours stand together, by the run's name.  Names
are 64-bit hashes of what they stand for, so all tasks give equal strings
equal names without exchanging a table of names.

Every symbol knows the words its existence depends on: a pair depends on its
parts only, a symbol that stays alone also on its neighbours.  A symbol whose
dependence lies within a window of ``size`` words is made in every occurrence of
that window, whatever stands around it; the longest such symbol (then the one
with the greatest name) is the window's anchor.  So equal windows have equal
anchors, windows that slide over the same words mostly share one, and a window
whose anchor occurs in one document only is repeated nowhere else.  The windows
of shared anchors are then verified by a 128-bit hash of their words.

Defined results: null text has no words; a document of fewer words than a
window loses none; of documents with equal windows the least id keeps them;
null ids are neither smaller nor greater than any, they lose nothing and take
nothing; rows that repeat an id lose what that id loses; an empty table gives
an empty result; other columns are ignored.

Scale: anchors cross one shuffle as 24-byte rows; one that several documents of
a batch share goes there once, its other rows are dealt evenly, so a passage
in a third of all documents does not gather in a task.  Texts cross a shuffle
twice, by id.  Exact copies are found by digest and not taken apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Step, release, sliced

SIZE = 13
ROUNDS = 5
#: Words of a batch of texts that are taken apart together.
BATCH_WORDS = 150_000
CACHE_WORDS = 400_000
U = np.uint64
MULTIPLIER = U(0x9E3779B97F4A7C15)


class _Names(dict):
    """Names of words, remembered over the batches of a Python worker and bounded."""

    def __missing__(self, word: bytes) -> int:
        name = xxhash.xxh64_intdigest(word, 7)
        if len(word) <= 48:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = name
        return name


NAMES = _Names()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_names(text: str | None) -> np.ndarray:
    words = (text or "").encode().split()
    return np.fromiter(map(NAMES.__getitem__, words), U, len(words))


def lay_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all documents in a row with a fence before, between and after them; whether fence; first place of each."""
    sizes = np.array([len(d) for d in docs], np.int64)
    first = np.cumsum(sizes + 1) - sizes
    names = np.zeros(int(sizes.sum()) + len(docs) + 1, U)
    fence = np.zeros(len(names), bool)
    fence[0] = True
    fence[first + sizes] = True
    names[~fence] = np.concatenate(docs) if docs else np.empty(0, U)
    return names, fence, first


def _round(names, fence, low, high, size, r: int):
    """One round over symbols: new names, fences, dependences [low, high), words covered, and whether made now."""
    coin = U((2 * r + 1) * int(MULTIPLIER) & (1 << 64) - 1)
    left = (mix(names ^ coin) & U(1)).astype(bool)
    n = len(names)
    pair = np.zeros(n, bool)  # with the next one
    pair[:-1] = left[:-1] & ~left[1:] & ~fence[:-1] & ~fence[1:]
    second = np.zeros(n, bool)
    second[1:] = pair[:-1]
    single = ~pair & ~second & ~fence
    glued = np.zeros(n, bool)  # to the one before, as a run
    glued[1:] = single[1:] & single[:-1] & (names[1:] == names[:-1])
    heads = np.flatnonzero(~second & ~glued)
    ends = np.append(heads[1:], n)  # symbols [head, end) make one
    made_pair = pair[heads]
    count = ends - heads
    run = (count > 1) & ~made_pair
    new = names[heads].copy()
    at = heads[made_pair]
    new[made_pair] = mix(names[at] * MULTIPLIER + mix(names[at + 1] + U(r)))
    new[run] = mix(names[heads[run]] + mix(count[run].astype(U) * MULTIPLIER + U(0x51ED)))
    new_low, new_high = np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)
    alone = ~made_pair & ~fence[heads]
    before, after = np.maximum(heads - 1, 0), np.minimum(ends, n - 1)
    new_low[alone] = np.minimum(new_low[alone], low[before[alone]])
    new_high[alone] = np.maximum(new_high[alone], high[after[alone]])
    # an equal neighbour is no part of the run only because it pairs with the symbol beyond, which then matters too
    taken = alone & second[before] & (names[before] == names[heads])
    new_low[taken] = np.minimum(new_low[taken], low[before[taken] - 1])
    taken = alone & pair[after] & (names[after] == names[heads])
    new_high[taken] = np.maximum(new_high[taken], high[after[taken] + 1])
    return new, fence[heads], new_low, new_high, np.add.reduceat(size, heads), made_pair | run


def anchors(names: np.ndarray, fence: np.ndarray, size: int = SIZE, rounds: int = ROUNDS) -> np.ndarray:
    """The anchor of the window that starts at each place (meaningless where it meets a fence)."""
    n = len(names)
    at = np.arange(n, dtype=np.int64)
    best = np.zeros((size + 1, n), U)
    short = U((1 << 60) - 1)
    best[1] = (names & short) | (U(1) << U(60))
    best[1][fence] = 0
    now, stop, low, high, words = names, fence, at, at + 1, np.ones(n, np.int64)
    for r in range(rounds):
        now, stop, low, high, words, made = _round(now, stop, low, high, words, r)
        fits = np.flatnonzero(made & (high - low <= size) & (words <= size))
        key = (now[fits] & short) | (words[fits].astype(U) << U(60))
        np.maximum.at(best, (high[fits] - low[fits], low[fits]), key)
    reach = best[1]
    for m in range(2, size + 1):
        wider = np.maximum(reach[:-1], reach[1:])
        reach = np.append(np.maximum(wider, best[m][: len(wider)]), U(0))
    return reach


def window_hashes(names: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the window that starts at each place."""
    n = len(names) - size + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, U)
    a, b = np.zeros(n, U), np.zeros(n, U)
    for j in range(size):
        part = names[j : j + n]
        a = a * MULTIPLIER + part
        b = (b ^ (part * U(0xD6E8FEB86659FD93))) * U(0xA0761D6478BD642F) + (b >> U(29))
    return mix(a), mix(b)


def _groups(texts: list[str | None]):
    """(first, names of each text) for groups of texts of about BATCH_WORDS words."""
    start, held, total = 0, [], 0
    for i, text in enumerate(texts):
        held.append(word_names(text))
        total += len(held[-1])
        if total >= BATCH_WORDS:
            yield start, held
            start, held, total = i + 1, [], 0
    if held:
        yield start, held


def _windows(docs: list[np.ndarray], first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows in the layout, and the document of each."""
    n = np.maximum(np.array([len(d) for d in docs], np.int64) - size + 1, 0)
    owner = np.repeat(np.arange(len(docs)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n), owner


def _anchor_rows(docs: DataFrame, size: int) -> DataFrame:
    """(key, id, sure) per document and distinct anchor; ``sure`` where another document of the batch stands for it in the shuffle."""

    def run(batches):
        for batch in sliced(batches, 4096):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for start, held in _groups(batch.column(1).to_pylist()):
                names, fence, first = lay_out(held)
                places, owner = _windows(held, first, size)
                keys = anchors(names, fence, size)[places]
                if not len(keys):
                    continue
                change = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))
                keys, owner = keys[change], ids[start + owner[change]]
                order = np.lexsort((owner, keys))
                keys, owner = keys[order], owner[order]
                fresh = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))
                keys, owner = keys[fresh], owner[fresh]
                again = np.append(False, keys[1:] == keys[:-1])  # an earlier document of the batch has it too
                followed = np.append(again[1:], False)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(owner), pa.array(again), pa.array(again | followed)], ["key", "id", "dealt", "sure"])

    return docs.mapInArrow(run, "key long, id long, dealt boolean, sure boolean")


def _shared(rows: DataFrame) -> DataFrame:
    """(id, key) of anchors that several documents have."""
    deal = F.when(F.col("dealt"), F.xxhash64("id", "key")).otherwise(F.col("key"))
    w = W.partitionBy("deal").orderBy("id")
    rows = rows.withColumn("deal", deal)
    near = F.lag("id").over(w).isNotNull() | F.lead("id").over(w).isNotNull()
    return rows.withColumn("near", near).where("sure or near").select("id", "key")


def _window_rows(docs: DataFrame, size: int) -> DataFrame:
    """(a, b, id) for every window of ``docs`` (id, text, keys) whose anchor is among the keys."""

    def run(batches):
        for batch in sliced(batches):
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            keys = batch.column("keys")
            for start, held in _groups(batch.column("text").to_pylist()):
                names, fence, first = lay_out(held)
                places, owner = _windows(held, first, size)
                found = anchors(names, fence, size)[places]
                keep = np.zeros(len(places), bool)
                edges = np.searchsorted(owner, np.arange(len(held) + 1))
                for k in range(len(held)):
                    own = keys[start + k].values.to_numpy(zero_copy_only=False).view(U)
                    keep[edges[k] : edges[k + 1]] = np.isin(found[edges[k] : edges[k + 1]], own)
                a, b = window_hashes(names, size)
                a, b, owner = a[places[keep]], b[places[keep]], ids[start + owner[keep]]
                order = np.lexsort((b, a, owner))
                a, b, owner = a[order], b[order], owner[order]
                fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (owner[1:] != owner[:-1]))[: len(a)]
                yield pa.RecordBatch.from_arrays([pa.array(a[fresh].view(np.int64)), pa.array(b[fresh].view(np.int64)), pa.array(owner[fresh])], ["a", "b", "id"])

    return docs.mapInArrow(run, "a long, b long, id long")


def repeated_windows(docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(id, gone) with the hashes of the windows a document must lose, and (id) of exact copies of a smaller id.

    ``docs`` has (id, text) with ids that are not null.
    """
    spark = docs.sparkSession
    digests = docs.select("id", F.unhex(F.md5("text")).alias("digest"), F.octet_length("text").alias("n"))
    least = digests.groupBy("digest", "n").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    copies = Step(digests.join(least, ["digest", "n"]).where("id > least").select("id").distinct(), "copies")
    shared = Step(_shared(_anchor_rows(docs, size)), "shared")
    release(spark)
    wanted = shared.df.join(copies.df, "id", "left_anti").groupBy("id").agg(F.collect_set("key").alias("keys"))
    windows = _window_rows(docs.join(wanted, "id").select("id", "text", "keys"), size)
    earlier = F.min("id").over(W.partitionBy("a", "b").orderBy("id").rowsBetween(W.unboundedPreceding, W.currentRow))
    gone = windows.withColumn("earlier", earlier).where("earlier < id")
    repeated = Step(gone.groupBy("id").agg(F.collect_set("a").alias("gone")), "repeated")
    shared.drop()
    release(spark)
    return repeated.df, copies.df


def dedup(docs: DataFrame, *, size: int = SIZE, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_words, n_removed, kept_sha256 and, if asked for, the text that is kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gone, copies = repeated_windows(rows.where("id is not null"), size)
    lost = gone.select("id", "gone", F.lit(False).alias("copy")).unionByName(copies.select("id", F.lit(None).cast("array<bigint>").alias("gone"), F.lit(True).alias("copy")))
    both = rows.join(lost.withColumnRenamed("id", "id2"), F.col("id") == F.col("id2"), "left").select("id", "text", "gone", "copy")

    def run(batches):
        for batch in sliced(batches):
            out: list[list] = [[], [], [], []]
            gone = batch.column("gone")
            for i, (text, copy) in enumerate(zip(batch.column("text").to_pylist(), batch.column("copy").to_pylist(), strict=True)):
                words = text.encode().split()
                n, removed = len(words), 0
                if n >= size and copy:
                    words, removed = [], n
                elif n >= size and gone[i].is_valid:
                    a, _ = window_hashes(word_names(text), size)
                    hit = np.isin(a, gone[i].values.to_numpy(zero_copy_only=False).view(U))
                    edge = np.zeros(n + 1, np.int64)
                    edge[:-size][hit] += 1
                    np.subtract.at(edge, np.flatnonzero(hit) + size, 1)
                    covered = np.cumsum(edge)[:n] > 0
                    removed = int(covered.sum())
                    words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                kept = b" ".join(words)
                for column, value in zip(out, (n, removed, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, out, kinds)], ["id", "n_words", "n_removed", "kept_sha256", "kept"])

    done = both.mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string, kept string").withColumnRenamed("id", id_col)
    return done if with_text else done.drop("kept")
