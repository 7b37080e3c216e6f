"""Identities derived from content: prefix and the first hex digits of a SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\x1f"


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def source_id(content: Column) -> Column:
    return F.concat(F.lit("src_"), F.substring(digest(content), 1, 12))


def claim_id(source: Column, line: Column, normalized: Column) -> Column:
    return F.concat(F.lit("claim_"), F.substring(digest(F.concat(source, line.cast("string"), normalized)), 1, 12))


def conflict_id(a: Column, b: Column) -> Column:
    """The same for both orders of a pair."""
    return F.concat(F.lit("conflict_"), F.substring(digest(F.concat(F.least(a, b), F.greatest(a, b))), 1, 12))


def relation_pair_id(workspace: Column, older: Column, newer: Column) -> Column:
    return F.concat(F.lit("pair_"), F.substring(digest(F.concat_ws(UNIT, workspace, older, newer)), 1, 12))


def derived_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(digest(F.concat_ws(UNIT, *[p.cast("string") for p in parts])), 1, 24))


def transition_id(machine: Column, entity: Column, before: Column, after: Column, causes: Column) -> Column:
    return F.substring(digest(F.concat_ws(UNIT, machine, entity, before.cast("string"), after.cast("string"), causes)), 1, 32)


def session_lane(session: Column) -> Column:
    """A lane of a session: the first 32 bits of its digest, never 0."""
    return F.conv(F.substring(digest(session), 1, 8), 16, 10).cast("long").bitwiseOR(F.lit(1))
