"""Scalar functions over numbers, arrays, labels and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PPM = 1_000_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for empty, unequal or zero vectors."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def unit_to_ppm(x: Column) -> Column:
    """A share as parts per million, rounded half up and clamped; 0 for NaN."""
    return F.when(F.isnan(x), 0).otherwise(F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * PPM + 0.5)).cast("int")


def ppm_to_unit(x: Column) -> Column:
    return x / F.lit(float(PPM))


def percent_to_ppm(x: Column) -> Column:
    return (F.least(F.greatest(x, F.lit(0)), F.lit(100)) * 10_000).cast("int")


# Bit of each role in an occurrence's mask.
ROLE_BITS = [(1, "definition"), (2, "import"), (4, "write"), (8, "read"), (16, "generated"), (32, "test"), (64, "forward_definition")]


def roles_of(mask: Column) -> Column:
    """Names of the bits set in ``mask``, "reference" first where it is no definition."""
    found = [F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in ROLE_BITS]
    return F.array_compact(F.array(F.coalesce(found[0], F.lit("reference")), *found[1:]))


# Labels that judges give and what they stand for.
RELATION_LABELS = {"supersedes": ["supersedes", "supersede", "superseded"], "conflict": ["conflict", "conflicts", "conflicting"], "duplicate": ["duplicate", "duplicates", "duplicated"], "unrelated": ["unrelated", "none", "neutral"]}


def relation_label(raw: Column) -> Column:
    label, out = F.lower(F.trim(raw)), F.when(F.lit(False), "")
    for name, spellings in RELATION_LABELS.items():
        out = out.when(label.isin(spellings), name)
    return out


def invert_relation(relation: Column) -> Column:
    return F.when(relation == "before", "after").when(relation == "after", "before").otherwise(relation)


def overlay_relation(base: Column, prior_dirty: Column, new_dirty: Column) -> Column:
    """Order of two snapshots from that of their base commits and whether each has changes beyond it."""
    same = F.when(~prior_dirty & ~new_dirty, "same").when(~prior_dirty & new_dirty, "before").when(prior_dirty & ~new_dirty, "after").otherwise("concurrent")
    return F.when(base == "same", same).when((base == "before") & prior_dirty, "concurrent").when((base == "after") & new_dirty, "concurrent").otherwise(base)


def claim_rank(query: Column, text: Column, subject: Column, path: Column) -> Column:
    """0 equal, 1 prefix, 2 contained, 3 in the path; null for no match.  All lowered."""
    return F.when(query == "", 0).when((text == query) | (subject == query), 0).when(text.startswith(query) | subject.startswith(query), 1).when(text.contains(query) | subject.contains(query), 2).when(path.contains(query), 3)


def code_rank(query: Column, name: Column, symbol: Column, path: Column) -> Column:
    return F.when(query == "", 1).when((name == query) | (symbol == query), 0).when(name.startswith(query), 1).when(name.contains(query) | symbol.contains(query), 2).when(path.contains(query), 3)


def answer_state_for_rows(contradicted: Column, conflicting: Column, superseded: Column, supported: Column, asserted: Column, structural: Column) -> Column:
    """Support counts where something is asserted; structural evidence counts by itself."""
    return F.when(contradicted, "contradicted").when(conflicting, "incomparable").when(superseded, "stale").when((asserted & supported) | structural, "supported").otherwise("unverified")


def answer_state_for_claim(status: Column, contradicts: Column, supports: Column) -> Column:
    return F.when(status == "superseded", "stale").when(status == "conflicting", "incomparable").when(contradicts, "contradicted").when(supports, "supported").otherwise("unverified")


def json_object(text: Column) -> Column:
    """From the first opening to the last closing brace of a chat answer."""
    start = F.instr(text, "{")
    end = F.char_length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((start > 0) & (F.instr(F.reverse(text), "}") > 0) & (end > start), F.substring(text, start, end - start + 1))


SESSION_ID = "[A-Za-z0-9_-]{1,64}"


def valid_session_id(x: Column) -> Column:
    return x.rlike(rf"^{SESSION_ID}\z")


def valid_digest(x: Column) -> Column:
    return x.rlike("^[0-9a-f]{64}$")


def redact_keys(text: Column) -> Column:
    return F.regexp_replace(text, r"(sk-|key-|Bearer )[A-Za-z0-9_\-]{8,}", "$1[redacted]")


def retry_delay_ms(attempt: int) -> int:
    return min(500 * 2 ** max(0, attempt - 1), 30_000)


def line_of_offset(text: Column, offset: Column) -> Column:
    """The line, from 1, that holds a byte offset."""
    before = F.substring(F.encode(text, "utf-8"), F.lit(1), offset.cast("int"))
    return F.size(F.split(F.decode(before, "utf-8"), "\n")).cast("int")


def source_context(line: Column, most: int = 4096) -> Column:
    """At most ``most`` bytes of a line, never inside a character: what is cut off is invalid and dropped."""
    cut = F.substring(F.encode(line, "utf-8"), F.lit(1), F.lit(most))
    return F.when(F.octet_length(line) <= most, line).otherwise(F.regexp_replace(F.decode(cut, "utf-8"), "�+$", ""))


def cursor(prefix: str, offset: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), offset.cast("string"))


def cursor_identity(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256), 1, 16)
