import time

import pytest
from pyspark.sql import functions as F

from claimloom.functions import ids, scalars
from claimloom.functions import text as T
from claimloom.sources.lines import line_table


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("x"))).collect()]


def test_claim_lines(spark):
    cases = {
        "Deploys happen on Friday.": True, "": False, "   ": False, "Welcome to the team.": False, "Decision: go": True, "decision: go": True,
        "## Release notes": True, "## Hello": False, "##": False, "# Old Release Process": True, "# is": False, "- ": False, "***": False, "- Ben owns it": True,
        "This island": False, "It is no longer true": True, "no\tlonger": True, "IS": True, " is ": True,
    }
    assert column(spark, list(cases), T.is_claim_line) == list(cases.values())


def test_words_and_phrases(spark):
    assert column(spark, ["a-b c_d  9"], T.words) == [["a", "b", "c", "d", "9"]]
    assert column(spark, ["as of today", "as-of", "has of", "NEW  process", "knowing", "now"], T.has_replacement) == [True, True, False, True, False, True]
    assert column(spark, ["  A  B\tÉ "], T.normalize) == ["a b É"]


def test_hints(spark):
    rows = spark.createDataFrame([("Deploys happen on Friday.",), ("Ben owns release approval now.",), ("This is it",), ("The platform uses RockStore for append-only event storage.",), ("Decision: deploys moved to Tuesday.",)], "text string")
    got = [tuple(r) for r in T.with_hints(rows).select("subject_hint", "predicate_hint", "object_hint", "confidence_ppm").collect()]
    assert got == [
        ("deploy-process", "unknown", "friday", 700_000),
        ("release-process", "owns", "release approval now.", 800_000),
        ("this-is-it", "is", "is it", 650_000),
        ("the-platform-uses-rockstore-for-appendonly", "uses", "rockstore for append-only event storage.", 650_000),
        ("deploy-process", "changed", "tuesday", 900_000),
    ]


def test_tokens(spark):
    assert column(spark, ["Über x 12 über"], T.content_tokens) == [["über", "12"]]
    assert sorted(column(spark, ["deployWindow the HTTPServer ab für2Go"], T.code_tokens)[0]) == ["deploy", "für2go", "httpserver", "window"]


def test_lines_keep_offsets_and_skip_blocks(spark):
    text = "---\na: is\n---\nFirst is\r\n```\ncode is\n```\nÜ is\nlast is"
    rows = line_table(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "---\nnever closed"), (5, "one\n")], "d int, text string"))
    got = [tuple(r) for r in rows.orderBy("d", "line").select("d", "line", "char_start", "line_text").collect()]
    assert got == [(1, 4, 14, "First is"), (1, 8, 40, "Ü is"), (1, 9, 46, "last is"), (5, 1, 0, "one")]
    assert line_table(spark.createDataFrame([(1, "x" * 70_000 + "\nis")], "d int, text string")).select("line").collect()[0][0] == 2


def test_ids(spark):
    one = spark.range(1).select(ids.conflict_id(F.lit("a"), F.lit("b")).alias("x"), ids.conflict_id(F.lit("b"), F.lit("a")).alias("y"), ids.session_lane(F.lit("s")).alias("l"), ids.source_id(F.lit("t")).alias("s")).first()
    assert one.x == one.y and one.x.startswith("conflict_") and len(one.x) == 21 and one.l % 2 == 1 and len(one.s) == 16


def test_scalars(spark):
    assert column(spark, [0.0, 0.5, 1.5, -1.0, float("nan"), 0.0000005], scalars.unit_to_ppm, "double") == [0, 500000, 1000000, 0, 0, 1]
    assert column(spark, ['say {"a": 1} end', "no", "} {"], scalars.json_object) == ['{"a": 1}', None, None]
    assert column(spark, ["ok-1_A", "", "a b", "x" * 65, "é", "a\n"], scalars.valid_session_id) == [True, False, False, False, False, False]
    assert column(spark, ["Duplicates ", "superseded", "CONFLICTING", " neutral", "replaces", "same"], scalars.relation_label) == ["duplicate", "supersedes", "conflict", "unrelated", None, None]
    assert column(spark, [0, 5, 64], scalars.roles_of, "int") == [["reference"], ["definition", "write"], ["reference", "forward_definition"]]
    assert [scalars.retry_delay_ms(n) for n in (1, 2, 3, 10)] == [500, 1000, 2000, 30000]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in v.select(scalars.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]
    long = "é" * 3000
    assert column(spark, [long, "short"], scalars.source_context) == ["é" * 2048, "short"]
    r = spark.createDataFrame([("same", False, True), ("before", True, False), ("after", False, True), ("before", False, True)], "b string, p boolean, n boolean")
    assert [x[0] for x in r.select(scalars.overlay_relation(F.col("b"), F.col("p"), F.col("n"))).collect()] == ["before", "concurrent", "concurrent", "before"]


@pytest.mark.parametrize("text,want", [("a<b>&\"c\"", "a&lt;b&gt;&amp;&quot;c&quot;")])
def test_escape(spark, text, want):
    assert column(spark, [text], T.html_escape) == [want]


def test_long_documents_are_scanned_in_linear_time(spark):
    n = 40_000
    text = "\n".join("```" if i % 1000 == 500 else f"line {i}" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "d int, text string")
    inside, want, at = False, [], 0
    for i, x in enumerate(text.split("\n")):
        if x == "```":
            inside = not inside
        elif not inside:
            want.append((i + 1, at, x))
        at += len(x) + 1
    began = time.time()
    assert [(r.line, r.char_start, r.line_text) for r in line_table(docs).collect()] == want
    assert line_table(docs, keep_all=True).count() == n
    assert time.time() - began < 60
