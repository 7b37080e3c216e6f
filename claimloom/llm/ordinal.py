"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is one of 0, 1, 2: one point for good quality and one for
not being toxic.  One vector of weights over hashed text features gives every
document a score, ordered thresholds cut the scores into grades:
P(grade <= k) = sigmoid(threshold_k - score).  The fit gives an expected grade
and the tail probability P(grade >= 2) that selection goes by.

A document has features of its shape (length, and the shares of new,
capital and marked words) and, counted once for each distinct word: the word's
letters in lower case, their first four and first five, the marks around it and
its case.  Only those whose documents' grades stand out (``TELLING``, and at least
``MIN_DOCS`` fitted rows) carry a weight, so words of chance add no noise.

The fit reads at most ``fit_rows`` labelled rows (8,000 as delivered), those whose ids hash
lowest, so it is the same on every run; every row of the table is scored, over
its whole text.

Defined results: null text is empty and has the score of no features; rows with
null id are scored like any other; labels with a null grade or no document are
left out, of several labels of an id the worst counts; without labels of at least
two grades every document keeps tail probability 1; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.

Scale: one pass without a shuffle; the sample is bounded, and so are the
weights that go to the executors (at most ``BUCKETS``).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

BUCKETS, SHAPES = 1 << 20, 1 << 14
FIT_ROWS = 8_000
MIN_DOCS = 3
#: Standard deviations from the mean grade at which a feature is worth a weight.
TELLING = 4.0
GRADES = 3
CACHE_WORDS = 400_000
PARTS = regex.compile(r"^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$", regex.DOTALL)


def word_features(word: str) -> list[int]:
    before, core, after = PARTS.match(word[:200]).groups()
    low = core.lower()
    case = "u" if len(core) > 1 and core.isupper() else "d" if core.isdigit() else "t" if core[:1].isupper() else "l"
    names = ["m:" + before[:4] + "_" + after[:4], "c:" + case]
    if low:
        names += ["w:" + low, "4:" + low[:4], "5:" + low[:5]]
    return [SHAPES + zlib.crc32(n.encode()) % (BUCKETS - SHAPES) for n in names]


class _Features(dict):
    def __missing__(self, word: str) -> list[int]:
        found = word_features(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found
        return found


def shape_features(words: list[str], distinct: set[str]) -> list[int]:
    """A text's length, and the tenths of its words that are new, in capitals, or marked at their end, by length."""
    n = len(words)
    long = min(n.bit_length(), 8)
    tenths = {"new": len(distinct) / max(n, 1), "capitals": sum(w.isupper() for w in distinct) / max(len(distinct), 1), "marked": sum(not w[-1].isalnum() for w in distinct) / max(len(distinct), 1)}
    names = [f"long:{long}"] + [f"{k}:{long}:{int(10 * v)}" for k, v in tenths.items()] + [f"{k}:{int(20 * v)}" for k, v in tenths.items()]
    return [zlib.crc32(x.encode()) % SHAPES for x in names]


def text_features(text: str | None, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and how many of its distinct words have each; the first ``SHAPES`` are of the whole text."""
    words = (text or "").split()
    distinct = set(words)
    every = [f for w in distinct for f in known[w]]
    every += shape_features(words, distinct)
    return np.unique(np.array(every, np.int32), return_counts=True)


class Model:
    """Weights by feature, thresholds, and the score scale of a fit."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.kept = np.flatnonzero(weights).astype(np.int32)
        self.weights = weights[self.kept].astype(np.float32)
        self.thresholds = thresholds

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS)
        out[self.kept] = self.weights
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def telling(index: np.ndarray, grade_of: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Whether each feature's documents differ in grade from all by at least ``TELLING`` standard deviations."""
    seen = np.bincount(index, minlength=BUCKETS)
    out = np.zeros(BUCKETS, bool)
    for k in range(1, GRADES):
        share = (grades < k).mean()
        spread = np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
        out |= np.abs(np.bincount(index[grade_of < k], minlength=BUCKETS) - seen * share) >= TELLING * spread
    out[:SHAPES] = True
    return out & (seen >= MIN_DOCS)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, *, steps: int = 150, penalty: float = 1e-4, rate: float = 0.05) -> Model:
    """Maximum likelihood with a quadratic penalty, by Adam over all rows; thresholds are a first one and positive gaps."""
    index = np.concatenate([f for f, _ in rows])
    size = np.array([len(f) for f, _ in rows])
    value = np.log1p(np.concatenate([c for _, c in rows]), dtype=np.float32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    common = telling(index, grades.astype(np.int8)[owner], grades)[index]
    owner = owner[common]
    kept, index = np.unique(index[common], return_inverse=True)
    value = value[common].astype(np.float64)
    n, cuts = len(rows), GRADES - 1
    shares = np.clip(np.array([(grades <= k).mean() for k in range(cuts)]), 1e-3, 1 - 1e-3)
    logit = np.log(shares / (1 - shares))
    x = np.concatenate([np.zeros(len(kept)), [logit[0]], np.log(np.maximum(np.diff(logit), 0.1))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    at = np.arange(n)
    for t in range(1, steps + 1):
        w = x[: len(kept)]
        theta = np.concatenate([[x[len(kept)]], x[len(kept)] + np.cumsum(np.exp(x[len(kept) + 1 :]))])
        score = np.bincount(owner, w[index] * value, n)
        below = np.column_stack([np.zeros(n), sigmoid(theta[None, :] - score[:, None]), np.ones(n)])
        slope = below * (1 - below)
        p = np.maximum(below[at, grades + 1] - below[at, grades], 1e-12)
        up, down = slope[at, grades + 1] / p, slope[at, grades] / p
        of_score = (up - down) / n  # derivative of the negative log-likelihood
        of_theta = np.zeros(cuts)
        for k in range(cuts):
            of_theta[k] = (down[grades == k + 1].sum() - up[grades == k].sum()) / n
        grad = np.empty_like(x)
        grad[: len(kept)] = np.bincount(index, of_score[owner] * value, len(kept)) + penalty * w
        grad[len(kept)] = of_theta.sum()
        for k in range(1, cuts):
            grad[len(kept) + k] = of_theta[k:].sum() * np.exp(x[len(kept) + k])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[kept] = x[: len(kept)]
    theta = np.concatenate([[x[len(kept)]], x[len(kept)] + np.cumsum(np.exp(x[len(kept) + 1 :]))])
    return Model(weights, theta)


def score(features: tuple[np.ndarray, np.ndarray], dense: np.ndarray) -> float:
    return float(dense[features[0]] @ np.log1p(features[1])) if len(features[0]) else 0.0


def graded(labels: DataFrame, *, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(id, grade): a point for good quality and one for not toxic; the worst of an id's labels."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull() & F.col(toxic_col).isNotNull())
    grade = F.when(F.min(quality_col) > 0, 1).otherwise(0) + F.when(F.max(toxic_col) > 0, 0).otherwise(1)
    return rows.groupBy(F.col(id_col).alias("id")).agg(grade.cast("int").alias("grade"))


def fit_on(docs: DataFrame, grades: DataFrame, *, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model of at most ``fit_rows`` of the graded documents; None where they have one grade only."""
    spark = docs.sparkSession
    picked = grades.orderBy(F.xxhash64("id"), "id").limit(fit_rows).collect()
    sample = F.broadcast(spark.createDataFrame([(r["id"], r["grade"]) for r in picked], f"id {grades.schema['id'].dataType.simpleString()}, grade int"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id").select("id", "grade", "text")

    def run(batches):
        known = _Features()
        for batch in sliced(batches):
            found = [text_features(t, known) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.astype("<i4").tobytes() for f, _ in found], pa.binary()), pa.array([np.minimum(c, 65535).astype("<u2").tobytes() for _, c in found], pa.binary())], ["id", "grade", "features", "counts"])

    seen: dict = {}
    for r in rows.mapInArrow(run, f"id {grades.schema['id'].dataType.simpleString()}, grade int, features binary, counts binary").toLocalIterator():
        seen.setdefault(r["id"], (r["grade"], np.frombuffer(r["features"], "<i4"), np.frombuffer(r["counts"], "<u2")))
    kept = [seen[k] for k in sorted(seen)]
    grade = np.array([g for g, _, _ in kept], np.int64)
    if len(np.unique(grade)) < 2:
        return None
    return fit([(f, c) for _, f, c in kept], grade)


def classify(docs: DataFrame, model: Model | None, *, least_tail: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with score, expected_grade, tail_probability and keep (tail probability at least ``least_tail``)."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    schema = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))

    def run(batches):
        known = _Known(model) if model else None
        for batch in sliced(batches):
            scores = np.array([known.score(t) for t in batch.column(at).to_pylist()]) if model else np.full(batch.num_rows, np.nan)
            below = sigmoid(model.thresholds[None, :] - scores[:, None]) if model else np.zeros((batch.num_rows, GRADES - 1))
            expected = (1 - below).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(expected), pa.array(1 - below[:, -1])], [*names, "score", "expected_grade", "tail_probability"])

    rows = docs.toDF(*names).mapInArrow(run, schema + ", score double, expected_grade double, tail_probability double")
    kept = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]
    return rows.select(*kept, "score", "expected_grade", "tail_probability", (F.col("tail_probability") >= least_tail).alias("keep"))


class _Known(dict):
    """For each word the places of its weighted features among those the model kept."""

    def __init__(self, model: Model):
        super().__init__()
        self.place = {int(f): i for i, f in enumerate(model.kept)}
        self.weights = model.weights.astype(np.float64)

    def __missing__(self, word: str) -> list[int]:
        found = [self.place[f] for f in word_features(word) if f in self.place]
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found
        return found

    def score(self, text: str | None) -> float:
        words = (text or "").split()
        distinct = set(words)
        every = [p for w in distinct for p in self[w]]
        every += [self.place[f] for f in shape_features(words, distinct) if f in self.place]
        if not every:
            return 0.0
        counts = np.bincount(every, minlength=len(self.weights))
        return float(np.log1p(counts) @ self.weights)
