"""Token counts by heap-and-linked-list byte-pair merging.

Each piece of text between the cuts of the tokenizer's pattern is a linked
list of byte symbols; a heap holds its adjacent pairs by merge rank, the
lowest is popped and merged, and new neighbours are pushed.  The count is the
number of initial symbols less the merges done; no identifier is emitted.

Defined results: null text counts as empty (0 bytes, 0 tokens); rows with a
null id are kept; repeated rows give repeated results; an empty table gives
an empty result; other columns of the input are ignored.  One row needs memory
in proportion to its own text only.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

SPLIT = regex.compile(public_tokenizers.PATTERN)
#: Where libraries' tables of letters or white space could differ, the tokenizer's own splitter decides.
ODD = regex.compile(r"[\x1c-\x1f\x85\u0250-\u200f\u2028-\U0010ffff]")
BITS = 17
LOW = (1 << BITS) - 1
CACHE_WORDS = 400_000
CACHED_CHARS = 48


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class HeapCounter:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs.setdefault(vocab[a] << BITS | vocab[b], rank << BITS | vocab[a + b])
        alphabet = byte_alphabet()
        self.of_byte = [vocab[c] for c in alphabet]
        self.of_char = {c: vocab[c] for c in alphabet}
        special = sorted((t["content"] for t in spec["added_tokens"] if t["special"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.path = path
        self.splitter = None
        self.known = _Known(self)

    def merged(self, ids: list[int]) -> int:
        """How many symbols remain of ``ids`` when no ranked pair is left."""
        n, rank = len(ids), self.pairs.get
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << BITS | ids[i + 1])) is not None]
        heapify(heap)
        before, after, merges = list(range(-1, n - 1)), list(range(1, n + 1)), 0
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if j >= n or ids[i] < 0 or rank(ids[i] << BITS | ids[j]) != r:
                continue  # one of the two was merged since
            merges += 1
            ids[i], ids[j] = r & LOW, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := rank(ids[i] << BITS | ids[k])) is not None:
                    heappush(heap, (q, i))
            p = before[i]
            if p >= 0 and (q := rank(ids[p] << BITS | ids[i])) is not None:
                heappush(heap, (q, p))
        return n - merges

    def pieces(self, text: str) -> int:
        if ODD.search(text):
            if self.splitter is None:
                from tokenizers import Tokenizer

                self.splitter = Tokenizer.from_file(self.path).pre_tokenizer
            of_char = self.of_char
            return sum(self.merged([of_char[c] for c in piece]) for piece, _ in self.splitter.pre_tokenize_str(text))
        return sum(map(self.known.__getitem__, SPLIT.findall(text)))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.pieces(text)
        return len(self.special.findall(text)) + sum(self.pieces(part) for part in self.special.split(text) if part)


class _Known(dict):
    """Counts of short pieces, kept over the batches of a Python worker and bounded."""

    def __init__(self, counter: HeapCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        of_byte = self.counter.of_byte
        n = self.counter.merged([of_byte[b] for b in piece.encode()])
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[piece] = n
        return n


_counters: dict[str, HeapCounter] = {}


def counter(path: str) -> HeapCounter:
    if path not in _counters:
        _counters[path] = HeapCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, *, tokenizer: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).  No shuffle."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        count = counter(path).count
        for batch in sliced(batches):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t) for t in texts], pa.int64()), batch.column(2)], ["id", "n_tokens", "n_bytes"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, f"id {id_type}, n_tokens long, n_bytes long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
