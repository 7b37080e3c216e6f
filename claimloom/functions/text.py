"""Text rules as Column expressions: everything here stays inside whole-stage code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists of the claim rules, in their order.
CLAIM_SIGNALS = ["is", "are", "uses", "use", "must", "should", "owner", "owns", "process", "decided", "decision", "moved", "changed", "replaced", "no longer", "deprecated", "deploy", "deploys", "release", "releases", "approval", "friday", "tuesday", "monday", "wednesday", "thursday"]
HEADING_SIGNALS = ["process", "deploy", "release", "owner", "approval", "policy", "decision"]
REPLACEMENT_SIGNALS = ["moved", "changed", "now", "no longer", "replaced", "instead", "new process", "as of", "decided"]
CONFIDENCE_PPM = [
    (900_000, ["decided", "decision", "changed"]),
    (800_000, ["owner", "owns", "process", "approval"]),
    (650_000, ["is", "are", "uses", "use", "must", "should", "moved", "replaced", "no longer", "deprecated", "deploy", "release"]),
    (700_000, ["friday", "tuesday", "monday", "wednesday", "thursday"]),
]
DEFAULT_CONFIDENCE_PPM = 500_000
PREDICATES = [("uses", ["uses", "use"]), ("is", ["is"]), ("must", ["must"]), ("should", ["should"]), ("owns", ["owns", "owner"]), ("changed", ["changed", "moved", "replaced"])]
SUBJECTS = [("deploy-process", ["deploy", "deploys"]), ("release-process", ["release", "releases"]), ("ownership", ["owner", "owns"]), ("approval-process", ["approval"])]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Unicode white space, in a form that Java's and RE2's patterns share.
WHITE = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
EDGES = f"^{WHITE}+|{WHITE}+$"
MAX_LINE_BYTES = 65_536


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def trim_white(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def words(text: Column) -> Column:
    """The runs of ASCII letters and digits."""
    return F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda w: w != "")


def phrase_pattern(phrases: list[str]) -> str:
    """Any of the phrases as whole words, whatever stands between the words of one; for lowered text."""
    inner = "|".join("[^a-z0-9]+".join(map(re.escape, p.split(" "))) for p in phrases)
    return f"(^|[^a-z0-9])({inner})([^a-z0-9]|$)"


def contains_any(text: Column, phrases: list[str]) -> Column:
    return ascii_lower(text).rlike(phrase_pattern(phrases))


def normalize(text: Column) -> Column:
    return F.regexp_replace(trim_white(ascii_lower(text)), f"{WHITE}+", " ")


def is_claim_line(line: Column) -> Column:
    t = trim_white(line)
    title = trim_white(F.regexp_replace(t, "^#+", ""))
    heading = (F.octet_length(title) >= 4) & ascii_lower(title).rlike("|".join(HEADING_SIGNALS))
    return (
        F.when(t == "", False)
        .when(t.startswith("##"), heading)
        .when(t.startswith("#") & (F.octet_length(title) < 4), False)
        .when(t.rlike(f"^-*\\**\\+*{WHITE}*$"), False)
        .when(t.startswith("Decision:") | t.startswith("decision:"), True)
        .otherwise(contains_any(t, CLAIM_SIGNALS))
    )


def has_replacement(text: Column) -> Column:
    return contains_any(text, REPLACEMENT_SIGNALS)


def _ladder(text: Column, steps: list[tuple], default) -> Column:
    out = None
    for value, phrases in steps:
        out = F.when(contains_any(text, phrases), value) if out is None else out.when(contains_any(text, phrases), value)
    return out.otherwise(default)


def confidence_ppm(text: Column) -> Column:
    return _ladder(text, CONFIDENCE_PPM, DEFAULT_CONFIDENCE_PPM).cast("int")


def predicate(text: Column) -> Column:
    return _ladder(text, PREDICATES, "unknown")


def slug(normalized: Column, most: int = 6) -> Column:
    first = F.slice(F.filter(F.split(normalized, f"{WHITE}+"), lambda w: w != ""), 1, most)
    return F.array_join(F.filter(F.transform(first, lambda w: F.regexp_replace(w, "[^A-Za-z0-9]", "")), lambda w: w != ""), "-")


def subject(text: Column, normalized: Column) -> Column:
    return _ladder(text, SUBJECTS, slug(normalized))


def object_hint(normalized: Column, predicate_: Column) -> Column:
    """The first weekday of the list, else what follows the first raw occurrence of the predicate."""
    out = None
    for day in WEEKDAYS:
        hit = contains_any(normalized, [day])
        out = F.when(hit, day) if out is None else out.when(hit, day)
    at = F.position(predicate_, normalized)
    rest = trim_white(F.substring(normalized, at + F.char_length(predicate_), F.char_length(normalized)))
    return out.when(predicate_ == "unknown", normalized).when((at == 0) | (rest == ""), normalized).otherwise(rest)


def with_hints(df, text: str = "text"):
    """``df`` with normalized_text, confidence_ppm, predicate_hint, subject_hint and object_hint."""
    df = df.withColumn("normalized_text", normalize(F.col(text)))
    n = F.col("normalized_text")
    df = df.withColumns({"confidence_ppm": confidence_ppm(n), "predicate_hint": predicate(n), "subject_hint": subject(n, n)})
    return df.withColumn("object_hint", object_hint(n, F.col("predicate_hint")))


def content_tokens(text: Column) -> Column:
    """Distinct lower-case Unicode letter-digit runs of two characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.char_length(t) >= 2))


# Words that carry no meaning for matching claims with code.
STOP_TOKENS = ["and", "are", "for", "from", "into", "not", "our", "the", "this", "that", "use", "uses", "with"]


def code_tokens(text: Column) -> Column:
    """Distinct lower-case words of 3 bytes or more, parted also where an ASCII capital follows a lower-case letter, without stop words."""
    parted = F.regexp_replace(text, r"(\p{Ll})([A-Z])", "$1 $2")
    found = F.filter(F.split(F.lower(parted), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= 3)
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_TOKENS)))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
