import random

import pytest

EXTRA = ["id", "key", "size", "h", "row", "norm", "line", "a", "b", "part", "text_1", "sim", "fp", "gone", "_c0", "target", "salt", "rank", "batch", "range", "ord"]
WORDS = [f"w{i}" for i in range(40)]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def small():
    """Rows (doc_id, text, source): passages that repeat, copies, near copies, runs, odd and empty texts."""
    rng = random.Random(7)
    passage, other = words(rng, 70), words(rng, 40)
    texts = ["", " \t\n", "one", "two words", "a" * 900, "ab" * 700, " ".join(["same"] * 60), " ".join(["x", "y"] * 40), "Ünï cödé — ‘quotes’ 12½ <|endoftext|> don't", "line one is here\nline two is there\n\nline one is here\nLine  One is here!"]
    for _ in range(40):
        head, tail = words(rng, rng.randint(0, 60)), words(rng, rng.randint(0, 60))
        middle = rng.choice([passage, other, "", passage + " " + passage])
        texts.append(rng.choice([" ", "\n"]).join(x for x in (head, middle, tail) if x))
    base = ["longer" + w for w in words(rng, 120).split()]
    for _ in range(12):
        edited = list(base)
        edited[rng.randrange(120)] = "edit" + str(rng.randrange(5))
        texts.append(" ".join(edited))
    texts += [texts[12], texts[12], texts[20]]
    return [(i, t, f"src{i % 4}" if i % 9 else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.createDataFrame(small, "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    long = " ".join(f"t{i % 977}" for i in range(60_000))
    rows = [(1, "alpha beta gamma", "s"), (1, "alpha beta gamma", "s"), (2, None, None), (None, "delta", "s"), (None, None, None), (3, "", ""), (4, long, "s"), (5, long, None), (6, "x" * 200_000, "s")]
    return spark.createDataFrame([(*r, *["clash"] * len(EXTRA)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in EXTRA))
