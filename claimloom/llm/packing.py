"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Documents become token pieces of at most ``capacity``.  Packing needs only how
many pieces there are of each length, so the instance is a histogram of at most
``capacity`` counts, whatever the corpus: the reduction and the best-fit run on
it exactly, in groups of equal bins, and give a plan of (length, ranks) ->
(sequences, offset).  Pieces then look their place up by their rank among the
pieces of their length.

Reduction, for the longest piece j of the instance left, with room R = capacity - j:
  * nothing fits beside it: {j} is fixed;
  * some k equals R: {j, k} dominates every other set with j and is fixed;
  * the two shortest do not fit beside it: {j, k}, k the longest that fits, is fixed;
  * at most two fit beside it and k is no shorter than any fitting pair together: {j, k} is fixed;
  * at most two fit beside it, and the longest fitting k with the longest b beside it covers,
    length for length, every fitting pair: {j, k, b} is fixed.
A fixed set leaves a smaller instance, on which the rules are tried again; what
remains is packed best-fit in decreasing length.

Defined results: null text is an empty document (one piece of the end id);
rows with null id and repeated rows are packed like any other; an empty table
gives an empty result; other columns are ignored.

Scale: one shuffle of thin rows (id, piece, length, checksum); ranks are taken
within (length, salt) groups, so a length that a third of all pieces share is
dealt over ``salts`` tasks.  What reaches the driver is the histogram, at most
``capacity`` rows; the plan has a proven bound of capacity * 3 bins groups
times the at most sqrt(2 * capacity) distinct lengths a bin can hold.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 4096
END_ID = 1
#: What the tokenizer itself must see whole: special strings, and characters whose class, case or normal form libraries could differ in.
ODD = re.compile(r"[^\t\n\r -~\xa1-\xff]|<\|")
CACHE_WORDS = 500_000
CACHED_CHARS = 40
#: Texts whose words are held at a time.
ROWS = 1024


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins across it, so plain text is
    encoded by its white-space chunks, which are remembered; their runs of
    letters are encoded many at a time and parted at the ids that end a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"]).findall
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends) != len(part):
                out += self.whole(part)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        odd, plain = [], []
        for i, text in enumerate(texts):
            if ODD.search(text):
                odd.append(i)
            else:
                plain.append((i, text.lower().split()))
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            out[i] = ids
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        new = set().union(*(words for _, words in plain)).difference(known)
        long = {w for w in new if len(w) > CACHED_CHARS}
        alone = [w for w in new if w.isalpha()]
        known.update(zip(alone, self.letters(alone), strict=True))
        mixed = {w: self.pieces(w) for w in new.difference(alone)}
        parts = set().union(*mixed.values()).difference(known)
        alone = [w for w in parts if w.isalpha()]
        known.update(zip(alone, self.letters(alone), strict=True))
        marks = list(parts.difference(alone))
        known.update(zip(marks, self.whole(marks), strict=True))
        known.update((w, b"".join(map(known.__getitem__, pieces))) for w, pieces in mixed.items())
        long |= {w for w in parts if len(w) > CACHED_CHARS}
        for i, words in plain:
            out[i] = b"".join(map(known.__getitem__, words))
        for w in long:
            del known[w]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) per piece; only documents over ``capacity`` are cut."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    id_type = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(path).encode
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for row, body in enumerate(encode(texts)):
                body += end
                n = len(body) // 4
                for k, s in enumerate(range(0, n, capacity)):
                    part = body[4 * s : 4 * (s + capacity)]
                    at.append(row)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class Instance:
    """Counts by length, and the plan so far."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 2, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.lengths = sorted(x for x, n in counts.items() if n)
        self.ranked = dict.fromkeys(self.lengths, 0)
        self.sequences = 0
        #: length, first rank, end rank, first sequence, pieces in each sequence, offset
        self.plan: list[tuple[int, int, int, int, int, int]] = []

    def place(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        r = self.ranked[length]
        self.plan.append((length, r, r + n, sequence, each, offset))
        self.ranked[length] = r + n
        self.left[length] -= n
        if not self.left[length]:
            del self.lengths[bisect_left(self.lengths, length)]

    def longest(self, room: int, *used: int) -> int:
        """The longest length up to ``room`` that is left beside the pieces ``used``; 0 if none."""
        i = bisect_left(self.lengths, room + 1)
        while i:
            i -= 1
            if self.left[self.lengths[i]] > used.count(self.lengths[i]):
                return self.lengths[i]
        return 0

    def shortest(self, many: int, *used: int) -> int:
        """The sum of the ``many`` shortest pieces left beside ``used``; more than the capacity if there are fewer."""
        total, i = 0, 0
        while many and i < len(self.lengths):
            x = self.lengths[i]
            n = min(many, int(self.left[x]) - used.count(x))
            total, many, i = total + n * x, many - n, i + 1
        return total if not many else self.capacity + 1

    def fix(self, members: tuple[int, ...]) -> None:
        """As many sequences of exactly these pieces as all of them allow."""
        n = min(int(self.left[x]) // members.count(x) for x in set(members))
        offset = 0
        for x in dict.fromkeys(members):
            each = members.count(x)
            self.place(x, n * each, self.sequences, each, offset)
            offset += each * x
        self.sequences += n

    def pairs(self, room: int, j: int):
        """For each length x up to ``room`` the longest y <= x with x + y <= room, beside j."""
        for x in self.lengths[: bisect_left(self.lengths, room + 1)]:
            if self.left[x] > (x == j) and (y := self.longest(min(x, room - x), j, x)):
                yield x, y

    def dominating(self, j: int) -> tuple[int, ...] | None:
        room = self.capacity - j
        if room <= 0 or not (k := self.longest(room, j)):
            return (j,)
        if k == room or self.shortest(2, j) > room:
            return (j, k)
        if self.shortest(3, j) <= room:
            return None
        fitting = list(self.pairs(room, j))
        if k >= max(x + y for x, y in fitting):
            return (j, k)
        if (b := self.longest(room - k, j, k)) and b >= max(y for _, y in fitting):
            return (j, k, b) if k >= b else None
        return None

    def reduce(self) -> int:
        """Fixes dominating sets until a pass over the lengths finds none; returns the sequences fixed."""
        found = True
        while found:
            found = False
            for j in self.lengths[::-1]:
                while self.left[j] and (members := self.dominating(j)):
                    self.fix(members)
                    found = True
        return self.sequences

    def best_fit(self) -> None:
        """Best-fit decreasing: each piece goes to the fullest sequence with room; equal sequences move together."""
        rooms: list[int] = []
        groups: dict[int, list[tuple[int, int]]] = {}

        def put(room: int, first: int, n: int) -> None:
            if n and room:
                if room not in groups:
                    groups[room] = []
                    insort(rooms, room)
                groups[room].append((first, n))

        for length in self.lengths[::-1]:
            while n := int(self.left[length]):
                i = bisect_left(rooms, length)
                if i < len(rooms):
                    room = rooms[i]
                    first, many = groups[room].pop()
                    if not groups[room]:
                        del groups[room]
                        rooms.pop(i)
                else:
                    room, first, many = self.capacity, self.sequences, -(-n // (self.capacity // length))
                    self.sequences += many
                each = room // length
                full = min(many, n // each)
                if full:
                    self.place(length, full * each, first, each, self.capacity - room)
                    put(room - each * length, first, full)
                if full < many:
                    rest = n - full * each if full < n // each + 1 else 0
                    rest = min(rest, each)
                    if rest:
                        self.place(length, rest, first + full, rest, self.capacity - room)
                    put(room - rest * length, first + full, 1)
                    put(room, first + full + 1, many - full - 1)


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int, int]:
    """The plan, how many sequences the reduction fixed, and how many there are in all."""
    instance = Instance(counts, capacity)
    fixed = instance.reduce()
    instance.best_fit()
    return sorted(instance.plan), fixed, instance.sequences


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, salts: int = 64) -> DataFrame:
    """``pieces`` (id, piece, start, length, ids_crc32, ...) with sequence_id, offset.  It is read three times: give a written table."""
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().toLocalIterator()}
    plan, _, _ = packing_plan(counts, capacity)
    table = np.array(plan, np.int64).reshape(-1, 6)
    span = np.int64(1) << 46
    starts = table[:, 0] * span + table[:, 1]

    salt = F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int")
    salted = pieces.withColumn("salt", salt)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    ahead = sizes.select(F.col("length").alias("length2"), F.col("salt").alias("salt2"), F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(W.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("rank", rank.cast("long")).join(ahead, (F.col("length") == F.col("length2")) & (F.col("salt") == F.col("salt2")))
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("ahead")).drop("ahead", "length2", "salt2", "salt")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(starts, length * span + rank, side="right") - 1] if len(rank) else table[:0]
            within = rank - row[:, 1]
            each = np.maximum(row[:, 4], 1)
            kept = [(n, batch.column(n)) for n in batch.schema.names if n != "rank"]
            kept += [("sequence_id", pa.array(row[:, 3] + within // each)), ("offset", pa.array(row[:, 5] + within % each * length))]
            yield pa.RecordBatch.from_arrays([c for _, c in kept], [n for n, _ in kept])

    return ranked.mapInArrow(run, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(token_pieces(docs, tokenizer=tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    return pack(pieces, capacity=capacity).withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, **options) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids, at most ``capacity`` of them."""
    capacity = options.get("capacity", CAPACITY)
    pieces = materialize(token_pieces(docs, with_ids=True, **options), "pieces-ids")
    placed = pack(pieces, capacity=capacity)
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))
