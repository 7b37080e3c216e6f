"""DuckDB spellings of the text rules, for the oracle queries."""

from __future__ import annotations

from claimloom.functions import text as T


def lower(e: str) -> str:
    return f"translate({e}, '{T.UPPER}', '{T.LOWER}')"


def trim(e: str) -> str:
    return f"regexp_replace({e}, '{T.EDGES}', '', 'g')"


def any_of(e: str, phrases: list[str], lowered: bool = False) -> str:
    return f"regexp_matches({e if lowered else lower(e)}, '{T.phrase_pattern(phrases)}')"


def normalize(e: str) -> str:
    return f"regexp_replace({trim(lower(e))}, '{T.WHITE}+', ' ', 'g')"


def claim_line(e: str) -> str:
    t = trim(e)
    title = trim(f"regexp_replace({t}, '^#+', '')")
    return f"""(CASE WHEN {t} = '' THEN false
      WHEN starts_with({t}, '##') THEN strlen({title}) >= 4 AND regexp_matches({lower(title)}, '{"|".join(T.HEADING_SIGNALS)}')
      WHEN starts_with({t}, '#') AND strlen({title}) < 4 THEN false
      WHEN regexp_matches({t}, '^-*\\**\\+*{T.WHITE}*$') THEN false
      WHEN starts_with({t}, 'Decision:') OR starts_with({t}, 'decision:') THEN true
      ELSE {any_of(t, T.CLAIM_SIGNALS)} END)"""


def ladder(e: str, steps: list[tuple], default: str) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "(CASE " + " ".join(f"WHEN {any_of(e, p, True)} THEN {show(v)}" for v, p in steps) + f" ELSE {default} END)"


def slug(n: str) -> str:
    first = f"list_filter(string_split_regex({n}, '{T.WHITE}+'), lambda w: w <> '')[1:6]"
    return f"array_to_string(list_filter(list_transform({first}, lambda w: regexp_replace(w, '[^A-Za-z0-9]', '', 'g')), lambda w: w <> ''), '-')"


def hints(inner: str, text: str = "text") -> str:
    """A query over ``inner`` that adds normalized_text and the hints."""
    days = " ".join(f"WHEN {any_of('normalized_text', [d], True)} THEN '{d}'" for d in T.WEEKDAYS)
    rest = trim("substr(normalized_text, instr(normalized_text, predicate_hint) + length(predicate_hint))")
    return f"""(SELECT *, CASE {days} WHEN predicate_hint = 'unknown' THEN normalized_text
        WHEN instr(normalized_text, predicate_hint) = 0 OR {rest} = '' THEN normalized_text ELSE {rest} END AS object_hint
      FROM (SELECT *, CAST({ladder('normalized_text', T.CONFIDENCE_PPM, str(T.DEFAULT_CONFIDENCE_PPM))} AS INTEGER) AS confidence_ppm,
              {ladder('normalized_text', T.PREDICATES, "'unknown'")} AS predicate_hint,
              {ladder('normalized_text', T.SUBJECTS, slug('normalized_text'))} AS subject_hint
            FROM (SELECT *, {normalize(text)} AS normalized_text FROM {inner})))"""


#: documents as lines with byte offsets (the tables have no fences or front matter; both are handled all the same)
SEGMENTS = r"""(
  SELECT doc_id, source, lang, CAST(n AS INTEGER) AS line, regexp_replace(s, '\r$', '') AS line_text,
         CAST(coalesce(sum(strlen(s) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start
  FROM (SELECT doc_id, source, lang, u.s AS s, u.n AS n
        FROM documents, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) WITH ORDINALITY AS u(s, n)
        WHERE text <> ''))"""
LINES = rf"""(
  SELECT doc_id, source, lang, line, line_text, char_start FROM (
    SELECT *, sum(CASE WHEN starts_with(ltrim(line_text), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS fences
    FROM (SELECT *, min(CASE WHEN line > 1 AND {trim('line_text')} = '---' THEN line END) OVER (PARTITION BY doc_id) AS closes,
                 bool_or(line = 1 AND {trim('line_text')} = '---') OVER (PARTITION BY doc_id) AS front FROM {SEGMENTS})
    WHERE strlen(line_text) <= {T.MAX_LINE_BYTES} AND NOT (front AND (closes IS NULL OR line <= closes)))
  WHERE fences % 2 = 0 AND NOT starts_with(ltrim(line_text), '```'))"""


def doc_claims() -> str:
    lines = f"(SELECT doc_id, source, lang, line, char_start, line_text AS text FROM {LINES} WHERE {claim_line('line_text')})"
    with_source = f"""(SELECT h.*, 'src_' || substr(sha256(d.text), 1, 12) AS source_id FROM {hints(lines)} h JOIN documents d USING (doc_id))"""
    return f"""(SELECT *, 'doc/' || CAST(doc_id AS VARCHAR) AS path, 'claim_' || substr(sha256(source_id || CAST(line AS VARCHAR) || normalized_text), 1, 12) AS claim_id FROM {with_source})"""


STATEMENT_TEXT = """CASE o_orderkey % 7
    WHEN 0 THEN concat('Customer ', o_custkey, ' deploy window is ', {day}, '.')
    WHEN 1 THEN concat('Decision: customer ', o_custkey, ' deploys moved to ', {day}, '.')
    WHEN 2 THEN concat('Customer ', o_custkey, ' release owner is team ', o_orderstatus, '.')
    WHEN 3 THEN concat('Team ', o_orderstatus, ' owns customer ', o_custkey, ' approval now.')
    WHEN 4 THEN concat('Customer ', o_custkey, ' must not use the old checklist')
    WHEN 5 THEN concat('Customer ', o_custkey, ' must use the old checklist')
    ELSE concat('Customer ', o_custkey, ' uses priority ', o_orderpriority) END"""
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"]


def statements() -> str:
    day = "[" + ", ".join(f"'{d}'" for d in DAYS) + "][o_orderkey % 5 + 1]"
    rows = f"(SELECT concat('ws_', o_custkey) AS workspace_id, CAST(o_orderkey AS BIGINT) AS seq, concat('order/', o_orderkey) AS path, CAST(1 AS INTEGER) AS line, {STATEMENT_TEXT.format(day=day)} AS text FROM orders)"
    with_source = f"(SELECT *, 'src_' || substr(sha256(path || text), 1, 12) AS source_id FROM {hints(rows)})"
    return f"(SELECT *, 'claim_' || substr(sha256(source_id || CAST(line AS VARCHAR) || normalized_text), 1, 12) AS claim_id FROM {with_source})"


def superseded() -> str:
    """(claim_id, superseded_by) over the CTE ``cl``, by the pairwise rule."""
    return f"""(SELECT claim_id, superseded_by FROM (
      SELECT o.claim_id, n.claim_id AS superseded_by, row_number() OVER (PARTITION BY o.claim_id ORDER BY n.seq, n.claim_id) AS k
      FROM cl o JOIN cl n ON o.workspace_id = n.workspace_id AND o.subject_hint IS NOT DISTINCT FROM n.subject_hint
        AND o.claim_id <> n.claim_id AND o.normalized_text <> n.normalized_text AND {any_of('n.normalized_text', T.REPLACEMENT_SIGNALS, True)})
      WHERE k = 1)"""


def conflict_signal() -> str:
    rep = lambda x: f"({any_of(x + '.normalized_text', T.REPLACEMENT_SIGNALS, True)} OR {any_of(x + '.text', T.REPLACEMENT_SIGNALS)})"
    neg = lambda x: any_of(x + ".normalized_text", ["not"], True)
    bare = lambda x: f"replace(replace({x}.normalized_text, ' not ', ' '), 'not ', '')"
    day = lambda x: "(CASE " + " ".join(f"WHEN {any_of(x + '.object_hint', [d])} THEN '{d}'" for d in T.WEEKDAYS) + " END)"
    return f"""({rep('a')} OR {rep('b')}
      OR ({neg('a')} <> {neg('b')} AND {bare('a')} = {bare('b')})
      OR (a.predicate_hint <> b.predicate_hint AND (a.predicate_hint = 'changed' OR b.predicate_hint = 'changed'))
      OR (a.predicate_hint = 'owns' AND b.predicate_hint = 'owns' AND a.object_hint <> b.object_hint)
      OR (a.subject_hint IN ('deploy-process', 'release-process') AND coalesce({day('a')} <> {day('b')}, false))
      OR abs(a.confidence_ppm - b.confidence_ppm) > 250000
      OR (a.subject_hint IN ('deploy-process', 'release-process', 'approval-process', 'ownership') AND a.object_hint <> b.object_hint AND a.object_hint <> '' AND b.object_hint <> ''))"""


def conflict_pairs(claims: str) -> str:
    """Pairs over the relation ``claims``."""
    return f"""(SELECT a.workspace_id, 'conflict_' || substr(sha256(least(a.claim_id, b.claim_id) || greatest(a.claim_id, b.claim_id)), 1, 12) AS conflict_id,
        a.claim_id AS claim_a, b.claim_id AS claim_b, a.subject_hint, '"' || a.text || '" conflicts with "' || b.text || '"' AS reason
      FROM {claims} a JOIN {claims} b ON a.workspace_id = b.workspace_id AND a.subject_hint = b.subject_hint AND a.claim_id < b.claim_id AND a.normalized_text <> b.normalized_text
      WHERE {conflict_signal()})"""


def content_tokens(e: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower({e}), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) >= 2))"


def code_tokens(e: str) -> str:
    stop = "'and', 'are', 'for', 'from', 'into', 'not', 'our', 'the', 'this', 'that', 'use', 'uses', 'with'"  # by hand, not by import
    return rf"list_distinct(list_filter(string_split_regex(lower(regexp_replace({e}, '(\p{{Ll}})([A-Z])', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda t: strlen(t) >= 3 AND NOT list_contains([{stop}], t)))"
