"""Registered queries and their DuckDB equivalents: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.functions import ids, scalars
from claimloom.functions import text as T
from claimloom.operators import claims as C
from claimloom.operators import code, evidence, folds, journal, revisions, search, sessions, similar, vectors
from claimloom.plans import sql as S
from claimloom.sources.lines import line_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), ids.source_id(F.col("text")).alias("source_id"), "text")


def document_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.extract(documents(spark, sf_dir))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements synthesised from orders: each customer's workspace says things that change over time."""
    day = "element_at(array(" + ", ".join(f"'{d}'" for d in S.DAYS) + "), int(o_orderkey % 5 + 1))"
    rows = table(spark, sf_dir, "orders").select(F.expr("concat('ws_', o_custkey)").alias("workspace_id"), F.col("o_orderkey").cast("long").alias("seq"), F.expr("concat('order/', o_orderkey)").alias("path"), F.lit(1).alias("line"), F.expr(S.STATEMENT_TEXT.format(day=day)).alias("text"))
    rows = T.with_hints(rows).withColumn("source_id", ids.source_id(F.concat("path", "text")))
    return rows.withColumn("claim_id", ids.claim_id(F.col("source_id"), F.col("line"), F.col("normalized_text")))


def statement_supersedes(rows: DataFrame) -> DataFrame:
    return C.first_replacement(rows, ["workspace_id", "subject_hint"], ["seq", "claim_id"])


# ---- sources and claims

@query("doc_lines_offsets", f"SELECT doc_id, line, char_start, CAST(strlen(line_text) AS BIGINT) AS n_bytes FROM {S.LINES}")
def doc_lines_offsets(spark, sf_dir):
    return line_table(documents(spark, sf_dir)).select("doc_id", "line", "char_start", F.octet_length("line_text").cast("long").alias("n_bytes"))


@query("claim_lines", f"SELECT doc_id, line, char_start FROM {S.LINES} WHERE {S.claim_line('line_text')}")
def claim_lines(spark, sf_dir):
    rows = line_table(documents(spark, sf_dir))
    return rows.where(T.is_claim_line(F.col("line_text"))).select("doc_id", "line", "char_start")


@query("claim_hints", f"SELECT doc_id, line, subject_hint, predicate_hint, object_hint, confidence_ppm FROM {S.doc_claims()}")
def claim_hints(spark, sf_dir):
    return document_claims(spark, sf_dir).select("doc_id", "line", "subject_hint", "predicate_hint", "object_hint", "confidence_ppm")


@query("statement_hints", f"SELECT claim_id, subject_hint, predicate_hint, object_hint, confidence_ppm FROM {S.statements()}")
def statement_hints(spark, sf_dir):
    return statements(spark, sf_dir).select("claim_id", "subject_hint", "predicate_hint", "object_hint", "confidence_ppm")


@query("claim_ids", f"SELECT doc_id, line, source_id, claim_id FROM {S.doc_claims()}")
def claim_ids(spark, sf_dir):
    return document_claims(spark, sf_dir).select("doc_id", "line", "source_id", "claim_id")


@query("source_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS body_hash FROM documents GROUP BY sha256(text)")
def source_dedup(spark, sf_dir):
    return C.new_sources(table(spark, sf_dir, "documents"), order="doc_id").select("doc_id", "body_hash")


@query("replacement_claims", f"SELECT doc_id, line, claim_id FROM {S.doc_claims()} WHERE {S.any_of('normalized_text', T.REPLACEMENT_SIGNALS, True)}")
def replacement_claims(spark, sf_dir):
    return document_claims(spark, sf_dir).where(T.has_replacement(F.col("normalized_text"))).select("doc_id", "line", "claim_id")


@query("supersession_first_wins", f"WITH cl AS MATERIALIZED (SELECT * FROM {S.statements()}) SELECT claim_id, superseded_by FROM {S.superseded()}")
def supersession_first_wins(spark, sf_dir):
    return statement_supersedes(statements(spark, sf_dir))


_VIEW = f"""WITH cl AS MATERIALIZED (SELECT * FROM {S.statements()}), sup AS MATERIALIZED (SELECT * FROM {S.superseded()}),
cur AS MATERIALIZED (SELECT * FROM cl WHERE claim_id NOT IN (SELECT claim_id FROM sup)),
con AS MATERIALIZED (SELECT * FROM {S.conflict_pairs('cur')}),
mem AS (SELECT claim_a AS claim_id FROM con UNION SELECT claim_b FROM con),
back AS (SELECT superseded_by AS claim_id, list(claim_id ORDER BY claim_id) AS supersedes FROM sup GROUP BY superseded_by),
view AS (SELECT cl.*, sup.superseded_by, CASE WHEN sup.superseded_by IS NOT NULL THEN 'superseded' WHEN mem.claim_id IS NOT NULL THEN 'conflicting' ELSE 'current' END AS status,
  CAST(coalesce(len(back.supersedes), 0) AS INTEGER) AS n_supersedes, coalesce(array_to_string(back.supersedes, ','), '') AS supersedes
  FROM cl LEFT JOIN sup USING (claim_id) LEFT JOIN mem USING (claim_id) LEFT JOIN back USING (claim_id))
"""


def statement_view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = statements(spark, sf_dir)
    sup = statement_supersedes(rows)
    con = C.conflicts(rows.join(sup, "claim_id", "left_anti"))
    return C.claim_view(rows, sup, con), con


@query("claim_status_view", _VIEW + "SELECT workspace_id, claim_id, status, superseded_by, supersedes FROM view")
def claim_status_view(spark, sf_dir):
    view, _ = statement_view(spark, sf_dir)
    return view.select("workspace_id", "claim_id", "status", "superseded_by", F.array_join("supersedes", ",").alias("supersedes"))


@query("claims_list", f"""WITH cl AS MATERIALIZED (SELECT c.*, 'all' AS workspace_id, doc_id * 100000 + line AS seq FROM {S.doc_claims()} c WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY sha256(text))), sup AS (SELECT * FROM {S.superseded()})
SELECT claim_id, CASE WHEN superseded_by IS NULL THEN 'current' ELSE 'superseded' END AS status, subject_hint, text, path, line, superseded_by FROM cl LEFT JOIN sup USING (claim_id)""")
def claims_list(spark, sf_dir):
    """The flagship: documents to claims with status, equal documents once."""
    docs = documents(spark, sf_dir)
    once = docs.join(C.new_sources(docs, order="doc_id").select("doc_id"), "doc_id")
    rows = C.extract(once).withColumns({"workspace_id": F.lit("all"), "seq": F.col("doc_id") * 100000 + F.col("line")})
    sup = C.first_replacement(rows, ["workspace_id", "subject_hint"], ["seq", "claim_id"])
    status = F.when(F.col("superseded_by").isNull(), "current").otherwise("superseded")
    return rows.join(sup, "claim_id", "left").select("claim_id", status.alias("status"), "subject_hint", "text", "path", "line", "superseded_by")


@query("heuristic_conflicts", f"WITH cl AS MATERIALIZED (SELECT * FROM {S.statements()}) SELECT * FROM {S.conflict_pairs('cl')}")
def heuristic_conflicts(spark, sf_dir):
    return C.conflicts(statements(spark, sf_dir))


@query("context_agent", _VIEW + """, pairs AS (SELECT con.conflict_id, a.text AS ta, b.text AS tb, row_number() OVER (PARTITION BY least(lower(a.text), lower(b.text)), greatest(lower(a.text), lower(b.text)) ORDER BY con.conflict_id) AS k
  FROM con JOIN cl a ON a.claim_id = con.claim_a JOIN cl b ON b.claim_id = con.claim_b)
SELECT 'current' AS part, claim_id AS id, text, NULL AS other FROM view WHERE status <> 'superseded'
UNION ALL SELECT 'stale', v.claim_id, v.text, coalesce(n.text, '') FROM view v LEFT JOIN cl n ON n.claim_id = v.superseded_by WHERE v.status = 'superseded'
UNION ALL SELECT 'conflict', conflict_id, ta, tb FROM pairs WHERE k = 1""")
def context_agent(spark, sf_dir):
    from claimloom.operators.context import agent_context

    return agent_context(*statement_view(spark, sf_dir))


@query("memory_snapshot", _VIEW + """SELECT 'current' AS part, claim_id AS id, text, NULL AS by FROM view WHERE status <> 'superseded'
UNION ALL SELECT 'stale', claim_id, text, superseded_by FROM view WHERE status = 'superseded'
UNION ALL SELECT 'conflict', conflict_id, reason, NULL FROM con""")
def memory_snapshot(spark, sf_dir):
    return sessions.memory(*statement_view(spark, sf_dir))


@query("workspace_status", _VIEW + """SELECT workspace_id, count(*) AS claims, count(*) FILTER (status = 'current') AS current, count(*) FILTER (status = 'superseded') AS superseded, count(*) FILTER (status = 'conflicting') AS conflicting, max(seq) AS frontier FROM view GROUP BY workspace_id""")
def workspace_status(spark, sf_dir):
    view, _ = statement_view(spark, sf_dir)
    n = {s: F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("current", "superseded", "conflicting")}
    return view.groupBy("workspace_id").agg(F.count("*").alias("claims"), *n.values(), F.max("seq").alias("frontier"))


@query("staleness_by_containment", f"""WITH cl AS MATERIALIZED (SELECT * FROM {S.statements()}), sup AS (SELECT * FROM {S.superseded()})
SELECT path, source_id, claim_id, superseded_by, line FROM cl JOIN sup USING (claim_id)""")
def staleness_by_containment(spark, sf_dir):
    rows = statements(spark, sf_dir)
    view = C.claim_view(rows, statement_supersedes(rows), spark.createDataFrame([], "claim_a string, claim_b string"))
    return C.stale_lines(rows.select("source_id", "path", "text"), view)


# ---- search

@query("claims_search_page", f"""SELECT claim_id, path, line, total, total > 60 AS has_more, CASE WHEN total > 60 THEN 'claims-v1:60' END AS next_cursor
FROM (SELECT claim_id, path, line, count(*) OVER () AS total FROM {S.doc_claims()} WHERE contains({S.lower("text || ' ' || path || ' ' || subject_hint")}, 'the') AND contains({S.lower("text || ' ' || path || ' ' || subject_hint")}, 'is'))
ORDER BY claim_id, path LIMIT 50 OFFSET 10""")
def claims_search_page(spark, sf_dir):
    claims = document_claims(spark, sf_dir)
    return search.claims_search(claims, "the is", 50, f"{search.CLAIMS_CURSOR}:10").select("claim_id", "path", "line", "total", "has_more", "next_cursor")


@query("knowledge_search_ranked", f"""WITH c AS (SELECT 'claim' AS plane, 'claim:' || claim_id AS key, CAST(CASE WHEN {S.lower('text')} = 'th' OR {S.lower('subject_hint')} = 'th' THEN 0 WHEN starts_with({S.lower('text')}, 'th') OR starts_with({S.lower('subject_hint')}, 'th') THEN 1 WHEN contains({S.lower('text')}, 'th') OR contains({S.lower('subject_hint')}, 'th') THEN 2 WHEN contains({S.lower('path')}, 'th') THEN 3 END AS INTEGER) AS rank, text AS shown FROM {S.doc_claims()}),
p AS (SELECT 'code' AS plane, concat_ws(':', 'code', url, url, CAST(page_id AS VARCHAR)) AS key, CAST(CASE WHEN {S.lower('name')} = 'th' OR {S.lower('url')} = 'th' THEN 0 WHEN starts_with({S.lower('name')}, 'th') THEN 1 WHEN contains({S.lower('name')}, 'th') OR contains({S.lower('url')}, 'th') THEN 2 END AS INTEGER) AS rank, name AS shown
  FROM (SELECT page_id, url, regexp_replace(url, '^.*/', '') AS name FROM pages))
SELECT DISTINCT plane, key, rank, shown FROM (SELECT * FROM c UNION ALL SELECT * FROM p) WHERE rank IS NOT NULL ORDER BY rank, key LIMIT 100""")
def knowledge_search_ranked(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^.*/", "").alias("name"), F.col("url").alias("symbol"), F.col("url").alias("path"), F.col("page_id").alias("start"))
    both = search.ranked_claims(document_claims(spark, sf_dir), "th").unionByName(search.ranked_code(pages, "th"))
    return search.page(both.distinct(), ["rank", "key"], 100, 0)


@query("faithfulness_recall", f"""SELECT doc_id, CAST(recall AS INTEGER) AS recall_ppm, recall >= 600000 AS faithful FROM (
  SELECT doc_id, CASE WHEN len(mine) = 0 THEN 0 ELSE len(list_intersect(mine, theirs)) * 1000000 // len(mine) END AS recall
  FROM (SELECT d.doc_id, {S.content_tokens('b.text')} AS mine, {S.content_tokens('d.text')} AS theirs
        FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id))""")
def faithfulness_recall(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    docs = table(spark, sf_dir, "documents").withColumn("item_id", F.col("doc_id") % bench.count())
    rows = docs.join(bench.select("item_id", F.col("text").alias("claim")), "item_id")
    return C.faithful(rows, "claim", "text").select("doc_id", "recall_ppm", "faithful")


# ---- sessions

@query("session_transcript", """SELECT conv_id AS session_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript, count(*) AS turns FROM conversations GROUP BY conv_id""")
def session_transcript(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_no"), F.col("role").alias("speaker"), "text")
    return sessions.transcript(turns)


@query("session_memory_claims", f"""SELECT conv_id, turn, line, {S.normalize('line_text')} AS normalized_text FROM (
  SELECT conv_id, turn, CAST(u.n AS INTEGER) AS line, u.s AS line_text FROM conversations, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) WITH ORDINALITY AS u(s, n) WHERE role = 'user' AND text <> '') WHERE {S.claim_line('line_text')}""")
def session_memory_claims(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return line_table(turns).where(T.is_claim_line(F.col("line_text"))).select("conv_id", "turn", "line", T.normalize(F.col("line_text")).alias("normalized_text"))


@query("session_turn_numbers", "SELECT conv_id AS session_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS turn_no FROM conversations")
def session_turn_numbers(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn")
    return sessions.numbered(turns, order="turn").select("session_id", "turn", "turn_no")


@query("session_lanes", "SELECT DISTINCT conv_id, CAST(('0x' || substr(sha256(CAST(conv_id AS VARCHAR)), 1, 8)) AS BIGINT) | 1 AS lane FROM conversations")
def session_lanes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", ids.session_lane(F.col("conv_id").cast("string")).alias("lane"))


# ---- vectors

COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("pair_cosine_page", f"""WITH v AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings), n AS (SELECT count(*) AS n FROM v),
o AS (SELECT a.idx * n - a.idx * (a.idx + 1) // 2 + (b.idx - a.idx - 1) AS ord, a.idx AS i, b.idx AS j, {COSINE} AS c FROM v a JOIN v b ON a.idx < b.idx, n)
SELECT CAST(ord AS BIGINT) AS ord, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(c, 4) AS cosine FROM o WHERE ord >= 1000 AND ord < 1000 + 50000 AND c >= 0.1""")
def pair_cosine_page(spark, sf_dir):
    v = indexed_vectors(spark, sf_dir)
    rows = vectors.cosine_page(v, v.count(), 0.1, 1000, 50_000)
    return rows.select("ord", "i", "j", F.round("cosine", 4).alias("cosine"))


def indexed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = journal.with_sequence(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), ["vec_id"], -1, "idx")
    return rows


@query("similarity_components", f"""WITH RECURSIVE e AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND {COSINE} >= 0.38),
r(id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, e.y FROM r JOIN e ON r.seen = e.x)
SELECT id AS vec_id, min(seen) AS component FROM r GROUP BY id""")
def similarity_components(spark, sf_dir):
    return similar.linked_components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 0.38)


@query("newest_successor", f"""WITH p AS (SELECT a.vec_id AS older, b.vec_id AS newer, b.label AS seq FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND {COSINE} >= 0.3)
SELECT older, newer FROM (SELECT *, row_number() OVER (PARTITION BY older ORDER BY seq DESC, newer DESC) AS k FROM p) WHERE k = 1""")
def newest_successor(spark, sf_dir):
    return similar.newest_successors(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), 0.3)


# ---- folds over events: entity = user, sequence = event

def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click", "signup"), folds.RECORDED).otherwise(folds.SUPERSEDED)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("seq"), kind.alias("kind"), "event_type", "value")


@query("event_fold_last_first", """WITH s AS (SELECT user_id, event_id, event_type IN ('view', 'click', 'signup') AS rec, value FROM events),
f AS (SELECT user_id, arg_max(value, event_id) FILTER (rec) AS last_value, max(event_id) FILTER (rec) AS lr, min(event_id) FILTER (NOT rec) AS fs, arg_min(value, event_id) FILTER (NOT rec) AS by_value, count(*) FILTER (rec) AS records FROM s GROUP BY user_id)
SELECT user_id AS entity, last_value, by_value, records, CAST(CASE WHEN fs IS NULL OR lr > fs THEN 1 ELSE 2 END AS INTEGER) AS phase FROM f""")
def event_fold_last_first(spark, sf_dir):
    rows = steps(spark, sf_dir)
    rec, sup = F.col("kind") == folds.RECORDED, F.col("kind") == folds.SUPERSEDED
    cards = rows.groupBy("entity").agg(F.max_by("value", F.when(rec, F.col("seq"))).alias("last_value"), F.max(F.when(rec, F.col("seq"))).alias("lr"), F.min(F.when(sup, F.col("seq"))).alias("fs"), F.min_by("value", F.when(sup, F.col("seq"))).alias("by_value"), F.count(F.when(rec, 1)).alias("records"))
    return cards.select("entity", "last_value", "by_value", "records", F.when(F.col("fs").isNull() | (F.col("lr") > F.col("fs")), 1).otherwise(2).alias("phase"))


@query("claim_card_fold", """WITH s AS (SELECT user_id, event_id, event_type IN ('view', 'click', 'signup') AS rec, value FROM events),
f AS (SELECT user_id, arg_max(CAST(value AS DOUBLE), event_id) FILTER (rec) AS v, min(event_id) FILTER (rec) AS first_seq, max(event_id) FILTER (rec) AS lr, min(event_id) FILTER (NOT rec) AS fs FROM s GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS claim_id, CAST(v AS VARCHAR) AS text, first_seq, CASE WHEN fs IS NOT NULL THEN 'n' || CAST(fs AS VARCHAR) END AS superseded_by, CAST(CASE WHEN fs IS NULL OR lr > fs THEN 1 ELSE 2 END AS INTEGER) AS phase FROM f""")
def claim_card_fold(spark, sf_dir):
    rows = steps(spark, sf_dir).withColumns({"workspace_id": F.lit("w"), "claim_id": F.col("entity").cast("string"), "event_id": F.col("seq").cast("string"), "text": F.col("value").cast("double").cast("string")})
    recorded = rows.where(F.col("kind") == folds.RECORDED).select("workspace_id", "entity", "seq", "event_id", "claim_id", "text")
    superseded = rows.where(F.col("kind") == folds.SUPERSEDED).select("workspace_id", "entity", "seq", F.col("claim_id").alias("old_claim_id"), F.concat(F.lit("n"), F.col("seq").cast("string")).alias("new_claim_id"), F.lit("r").alias("reason"), F.lit("d").alias("decided_by"))
    return folds.claim_cards(recorded, superseded).select("claim_id", "text", "first_seq", "superseded_by", "phase")


@query("conflict_card_fold", """WITH f AS (SELECT user_id, max(event_id) FILTER (event_type IN ('view', 'click')) AS o, arg_max(event_type, event_id) FILTER (event_type IN ('purchase', 'signup')) AS r, max(event_id) FILTER (event_type IN ('purchase', 'signup')) AS d FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS conflict_id, CAST(CASE WHEN d IS NULL OR o > d THEN 1 WHEN r = 'purchase' THEN 2 ELSE 3 END AS INTEGER) AS phase FROM f WHERE o IS NOT NULL""")
def conflict_card_fold(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.lit("w").alias("workspace_id"), F.col("user_id").cast("string").alias("conflict_id"), F.col("event_id").alias("seq"), "event_type")
    opened = ev.where("event_type in ('view', 'click')").withColumns({"claim_a": F.lit("a"), "claim_b": F.lit("b"), "reason": F.lit("r")})
    resolution = F.when(F.col("event_type") == "purchase", "resolved").when(F.col("event_type") == "signup", "ignored").otherwise("unheard")
    resolved = ev.where("event_type in ('purchase', 'signup', 'error')").withColumns({"resolution": resolution, "resolved_by": F.lit("x")})
    return folds.conflict_cards(opened, resolved).select("conflict_id", "phase")


@query("source_card_fold", "SELECT user_id AS source_id, arg_max(event_type, event_id) AS source_kind, count(*) AS observations FROM events GROUP BY user_id")
def source_card_fold(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.lit("w").alias("workspace_id"), F.col("user_id").alias("source_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("source_kind"), F.lit("p").alias("path"), F.col("props").alias("body_hash_hex"), F.lit(0).alias("observed_at_ms"))
    return folds.source_cards(ev).select("source_id", "source_kind", "observations")


@query("event_asof_view", """WITH fr AS (SELECT max(event_id) // 2 AS f FROM events) SELECT user_id AS entity, count(*) AS n, max(event_id) AS frontier, arg_max(event_type, event_id) AS last_type FROM events, fr WHERE event_id <= f GROUP BY user_id""")
def event_asof_view(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    frontier = ev.agg(F.expr("max(event_id) div 2")).first()[0]
    return ev.where(F.col("event_id") <= frontier).groupBy(F.col("user_id").alias("entity")).agg(F.count("*").alias("n"), F.max("event_id").alias("frontier"), F.max_by("event_type", "event_id").alias("last_type"))


@query("event_anomalies", """WITH s AS (SELECT user_id AS entity, event_id AS seq, event_type IN ('view', 'click', 'signup') AS rec FROM events),
b AS (SELECT *, max(seq) FILTER (rec) OVER w AS r, min(seq) FILTER (NOT rec) OVER w AS s1, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY entity ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN s1 IS NULL OR r > s1 THEN 1 ELSE 2 END AS pb FROM b)
SELECT entity, seq, 'duplicate-record' AS anomaly FROM p WHERE rec AND n > 0
UNION ALL SELECT entity, seq, 'supersede-from-' || CAST(pb AS VARCHAR) FROM p WHERE NOT rec AND pb <> 1
UNION ALL SELECT entity, seq, 'duplicate-supersede' FROM p WHERE NOT rec AND s1 IS NOT NULL""")
def event_anomalies(spark, sf_dir):
    return folds.claim_anomalies(steps(spark, sf_dir).select("entity", "seq", "kind"))


@query("event_timeline", "SELECT user_id AS entity, string_agg(CAST(event_id AS VARCHAR) || ':' || event_type, ' ' ORDER BY event_id) AS timeline FROM events GROUP BY user_id")
def event_timeline(spark, sf_dir):
    rows = folds.timeline(steps(spark, sf_dir), what="event_type")
    return rows.select("entity", F.array_join(F.transform("timeline", lambda x: F.concat_ws(":", x["seq"].cast("string"), x["what"])), " ").alias("timeline"))


@query("event_chain_check", """WITH h AS (SELECT user_id AS entity, event_id AS seq, sha256(concat_ws('|', CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR), event_type)) AS event_hash FROM events)
SELECT entity, seq, event_hash, coalesce(lag(event_hash) OVER (PARTITION BY entity ORDER BY seq), '') AS prev_hash FROM h""")
def event_chain_check(spark, sf_dir):
    return journal.with_chain(steps(spark, sf_dir), content="event_type").select("entity", "seq", "event_hash", "prev_hash")


@query("settlement_first_judgment", """WITH p AS (SELECT user_id AS older, user_id + CAST(floor(value) AS BIGINT) % 3 AS newer, event_id, event_type FROM events),
j AS (SELECT older, newer, arg_min(event_type, event_id) AS relation, min(event_id) AS settled_seq, count(*) - 1 AS later, count(DISTINCT event_type) > 1 AS disagrees FROM p WHERE event_type <> 'error' GROUP BY older, newer),
d AS (SELECT older, newer, count(*) AS deferrals FROM p WHERE event_type = 'error' GROUP BY older, newer)
SELECT older, newer, relation, settled_seq, coalesce(later, 0) AS later, coalesce(deferrals, 0) AS deferrals, coalesce(disagrees, false) AS disagrees FROM j FULL JOIN d USING (older, newer)""")
def settlement_first_judgment(spark, sf_dir):
    p = table(spark, sf_dir, "events").select(F.lit("w").alias("workspace_id"), F.col("user_id").alias("older"), (F.col("user_id") + F.floor("value").cast("long") % 3).alias("newer"), F.col("event_id").alias("seq"), F.col("event_type").alias("relation"), F.lit(1).alias("score_ppm"), F.lit("f").alias("judge_fingerprint"))
    cards = folds.settlements(p.where("relation <> 'error'"), p.where("relation = 'error'"))
    return cards.select("older", "newer", "relation", "settled_seq", "later", "deferrals", "disagrees")


@query("event_idempotent_append", """WITH a AS (SELECT user_id || ':' || event_type AS k, event_id, 0 AS batch FROM events UNION ALL SELECT user_id || ':' || event_type, event_id + 1000000, 1 FROM events),
f AS (SELECT k, event_id, row_number() OVER (PARTITION BY k ORDER BY event_id) AS n FROM a)
SELECT k AS idempotency_key, CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS seq, true AS appended FROM f WHERE n = 1""")
def event_idempotent_append(spark, sf_dir):
    """Every event offered twice under its user-and-type key: the first of a key is appended, the rest answer with it."""
    ev = table(spark, sf_dir, "events")
    again = ev.select("user_id", "event_type", F.col("event_id")).unionByName(ev.select("user_id", "event_type", (F.col("event_id") + 1_000_000).alias("event_id")))
    rows = again.select(F.lit("w").alias("workspace_id"), F.lit(1).alias("kind"), F.col("user_id").cast("string").alias("entity"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("idempotency_key"), F.lit("{}").alias("payload"), F.col("event_id").alias("offered"))
    return journal.plan_append(journal.empty(spark), rows, ["offered"]).select("idempotency_key", "seq", "appended")


@query("replica_follow_delta", """WITH m AS (SELECT max(event_id) // 2 AS f FROM events) SELECT event_id, user_id, event_type FROM events, m WHERE event_id > f OR (event_id <= f AND event_type = 'error')""")
def replica_follow_delta(spark, sf_dir):
    """What a replica still lacks that has all but errors up to half of the sequence."""
    ev = table(spark, sf_dir, "events")
    half = ev.agg(F.expr("max(event_id) div 2")).first()[0]
    ledger = ev.where((F.col("event_id") <= half) & (F.col("event_type") != "error")).select("event_id")
    return ev.join(ledger, "event_id", "left_anti").select("event_id", "user_id", "event_type")


# ---- code, evidence, coverage

@query("lexical_index", """WITH n AS (SELECT url AS path, list_transform(regexp_extract_all(html, '[A-Za-z_][A-Za-z0-9_]{2,}'), lambda x: lower(x)) AS names FROM pages),
u AS (SELECT path, x.s AS name, min(x.n) AS pos FROM n, unnest(names) WITH ORDINALITY AS x(s, n) GROUP BY path, x.s),
r AS (SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY pos) AS ord, false AS truncated FROM u)
SELECT path, name, CAST(ord AS INTEGER) AS ord, truncated FROM r""")
def lexical_index(spark, sf_dir):
    return code.lexical_index(table(spark, sf_dir, "pages"), "url", "html")


@query("reconcile_topk", f"""WITH c AS (SELECT doc_id, unnest({S.code_tokens('text')}) AS token FROM documents),
n AS (SELECT item_id, unnest({S.code_tokens('text')}) AS token, 4 AS w FROM benchmark UNION ALL SELECT item_id, unnest({S.code_tokens("'item ' || CAST(item_id AS VARCHAR)")}), 1 FROM benchmark),
r AS (SELECT doc_id, item_id, sum(w) AS rank FROM c JOIN n USING (token) GROUP BY doc_id, item_id),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, item_id) AS rn FROM r)
SELECT doc_id AS claim_id, item_id AS occurrence_id, CAST(rank AS BIGINT) AS rank, CAST(rn AS INTEGER) AS rn FROM k WHERE rn <= 4 ORDER BY doc_id, rn LIMIT 256""")
def reconcile_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), "text", F.lit("").alias("subject_hint"), F.lit("").alias("object_hint"))
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("occurrence_id"), F.lit("").alias("symbol"), F.col("text").alias("name"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("path"), F.lit("").alias("context"))
    return evidence.code_candidates(docs, bench)


@query("coverage_summary", """SELECT source, CASE WHEN bool_or(lang = 'en') THEN 'precise' ELSE 'lexical' END AS analysis_quality, max(n_chars) AS sources_examined, CAST(sum(length(text)) AS BIGINT) AS occurrences, bool_or(n_chars > 5000) AS truncated, array_to_string(list_sort(list_distinct(list(lang))), ',') AS gaps FROM documents GROUP BY source""")
def coverage_summary(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select("source", F.when(F.col("lang") == "en", "precise").otherwise("lexical").alias("analysis_quality"), F.col("n_chars").alias("sources_examined"), F.char_length("text").cast("long").alias("occurrences"), (F.col("n_chars") > 5000).alias("truncated"), F.array("lang").alias("gaps"))
    return evidence.merge_coverage(parts, ["source"]).withColumn("gaps", F.array_join("gaps", ","))


@query("label_yield", f"""WITH c AS (SELECT doc_id, count(*) AS n FROM {S.doc_claims()} GROUP BY doc_id),
d AS (SELECT l.quality, coalesce(c.n, 0) AS n FROM labels l LEFT JOIN c USING (doc_id))
SELECT quality, count(*) AS docs, CAST(sum(n) AS BIGINT) AS claims, min(n) AS least, max(n) AS most, list_sort(list(n))[count(*) // 2 + 1] AS upper_median FROM d GROUP BY quality""")
def label_yield(spark, sf_dir):
    per = document_claims(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "labels").join(per, "doc_id", "left").select("quality", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    # the middle by a histogram of counts, so that no list of a group is built
    hist = rows.groupBy("quality", "n").agg(F.count("*").alias("k"))
    w = W.partitionBy("quality").orderBy("n")
    run = hist.withColumns({"upto": F.sum("k").over(w), "all": F.sum("k").over(W.partitionBy("quality"))})
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n")))
    return run.groupBy("quality").agg(F.sum("k").alias("docs"), F.sum(F.col("n") * F.col("k")).alias("claims"), F.min("n").alias("least"), F.max("n").alias("most"), middle.alias("upper_median"))


@query("stats_row", f"""SELECT (SELECT count(*) FROM {S.doc_claims()}) AS claims, count(*) AS sources, CAST(sum(strlen(text)) AS BIGINT) AS source_bytes, max(doc_id) AS frontier FROM documents""")
def stats_row(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("sources"), F.sum(F.octet_length("text").cast("long")).alias("source_bytes"), F.max("doc_id").alias("frontier"))
    n = line_table(documents(spark, sf_dir)).where(T.is_claim_line(F.col("line_text"))).agg(F.count("*").alias("claims"))
    return docs.withColumn("_k", F.lit(1)).join(n.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("line_overlap_join", f"""WITH l AS (SELECT doc_id, line FROM {S.LINES}), r AS (SELECT doc_id, 1 + doc_id % 5 AS ls, 3 + doc_id % 7 AS le FROM documents)
SELECT doc_id, line, ls, le FROM l JOIN r USING (doc_id) WHERE line >= ls AND line <= le""")
def line_overlap_join(spark, sf_dir):
    rows = line_table(documents(spark, sf_dir)).select(F.col("doc_id").alias("path"), F.col("line").alias("line_start"), F.col("line").alias("line_end"))
    ranges = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), (1 + F.col("doc_id") % 5).alias("ls"), (3 + F.col("doc_id") % 7).alias("le"))
    return evidence.overlapping(rows, ranges).select(F.col("path").alias("doc_id"), F.col("line_start").alias("line"), "ls", "le")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, bench = (table(spark, sf_dir, t) for t in ("documents", "labels", "benchmark"))
    n = bench.count()
    links = docs.select(F.col("doc_id").alias("claim_id"), (F.col("doc_id") % (2 * n)).alias("occurrence_id"), F.when(F.col("lang") == "fr", "contradicts").otherwise("supports").alias("stance"))
    occ = bench.select(F.col("item_id").alias("occurrence_id"), F.lit("bench").alias("path"), F.col("item_id").alias("byte_start"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit(0).alias("seq"))
    acc = labels.select(F.col("doc_id").alias("claim_id"), (F.col("doc_id") % (2 * n)).alias("occurrence_id"), (F.col("quality") * 1_000_000).cast("int").alias("score_ppm"), F.lit("f").alias("judge_fingerprint"), F.lit(0).alias("seq"))
    return evidence.evidence_rows(links, occ, acc)


_EVIDENCE = """(SELECT d.doc_id AS claim_id, d.doc_id % (2 * n) AS occurrence_id, CASE WHEN d.lang = 'fr' THEN 'contradicts' ELSE 'supports' END AS stance,
  CAST(l.quality * 1000000 AS INTEGER) AS score_ppm, b.item_id IS NULL AS incomplete
  FROM documents d CROSS JOIN (SELECT count(*) AS n FROM benchmark) LEFT JOIN benchmark b ON b.item_id = d.doc_id % (2 * n)
  LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)"""


@query("evidence_left_join", f"SELECT * FROM {_EVIDENCE}")
def evidence_left_join(spark, sf_dir):
    return _evidence(spark, sf_dir).select("claim_id", "occurrence_id", "stance", "score_ppm", "incomplete")


@query("answer_state", f"""WITH e AS (SELECT claim_id, bool_or(stance = 'contradicts') AS c, bool_or(stance = 'supports') AS s FROM {_EVIDENCE} WHERE NOT incomplete GROUP BY claim_id)
SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 'stale' WHEN n_chars % 7 = 1 THEN 'incomparable' WHEN c THEN 'contradicted' WHEN s THEN 'supported' ELSE 'unverified' END AS answer FROM documents LEFT JOIN e ON claim_id = doc_id""")
def answer_state(spark, sf_dir):
    status = F.when(F.col("n_chars") % 7 == 0, "superseded").when(F.col("n_chars") % 7 == 1, "conflicting").otherwise("current")
    view = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), status.alias("status"))
    return evidence.answers(view, _evidence(spark, sf_dir).where("!incomplete")).select(F.col("claim_id").alias("doc_id"), "answer")


@query("pair_text_dedup", """WITH p AS (SELECT doc_id, lower(text) AS a, lower(source) AS b FROM documents)
SELECT min(doc_id) AS doc_id FROM p GROUP BY least(a, b), greatest(a, b)""")
def pair_text_dedup(spark, sf_dir):
    return C.drop_folded_pairs(table(spark, sf_dir, "documents"), "text", "source", "doc_id").select("doc_id")


@query("basis_digest", """WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS k, CAST(doc_id AS VARCHAR) || chr(31) || CASE WHEN lang = 'en' THEN 'true' ELSE 'false' END AS l, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 2) AS r FROM documents),
p AS (SELECT r, sha256(string_agg(l, chr(30) ORDER BY k)) AS d FROM l GROUP BY r) SELECT sha256(string_agg(d, chr(30) ORDER BY r)) AS basis FROM p""")
def basis_digest(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("claim_id"), (F.col("lang") == "en").alias("eligible"))
    return vectors.basis_digest(rows)


@query("fixed_point_ppm", "SELECT event_id, CAST(floor(least(greatest(value / 100.0, 0.0), 1.0) * 1000000 + 0.5) AS INTEGER) AS ppm FROM events")
def fixed_point_ppm(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.unit_to_ppm(F.col("value") / 100.0).alias("ppm"))


@query("bitmask_roles", """SELECT event_id, concat_ws(',', CASE WHEN event_id & 1 <> 0 THEN 'definition' ELSE 'reference' END, CASE WHEN event_id & 2 <> 0 THEN 'import' END, CASE WHEN event_id & 4 <> 0 THEN 'write' END, CASE WHEN event_id & 8 <> 0 THEN 'read' END, CASE WHEN event_id & 16 <> 0 THEN 'generated' END, CASE WHEN event_id & 32 <> 0 THEN 'test' END, CASE WHEN event_id & 64 <> 0 THEN 'forward_definition' END) AS roles FROM events""")
def bitmask_roles(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.array_join(scalars.roles_of(F.col("event_id").bitwiseAND(F.lit(127))), ",").alias("roles"))


@query("running_cap", """SELECT lang, doc_id, n_chars FROM (SELECT *, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) AS run FROM documents) WHERE run <= 100000""")
def running_cap(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("run", F.sum("n_chars").over(W.partitionBy("lang").orderBy("doc_id")))
    return rows.where("run <= 100000").select("lang", "doc_id", "n_chars")


@query("ancestry_closure", """WITH RECURSIVE e AS (SELECT conv_id || ':' || turn AS c, conv_id || ':' || lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
r(c, a) AS (SELECT c, p FROM e WHERE p IS NOT NULL UNION SELECT r.c, e.p FROM r JOIN e ON r.a = e.c WHERE e.p IS NOT NULL)
SELECT c AS commit, a AS ancestor FROM r""")
def ancestry_closure(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    back = F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn"))
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    parents = turns.withColumn("prev", back).select(name(F.col("turn")).alias("commit"), name(F.col("prev")).alias("parent"))
    return revisions.ancestors(parents).select("commit", "ancestor")


_SCOPE_PATHS = ["src/main.RS", "target/out.rs", "docs/target/notes.md", "Makefile", "tools/Dockerfile", "notes.txt", ".git/config.toml", "docs/README", "app/view.tsx", "lib/.sh", "BUILD", "a/makefile.bak", "c/x.Hpp"]


@query("page_urls_scope", f"""WITH p AS (SELECT page_id, {_SCOPE_PATHS!r}[page_id % {len(_SCOPE_PATHS)} + 1] AS path FROM pages)
SELECT page_id, path, NOT regexp_matches(path, '^(target|[.]git)/') AND (split_part(path, '/', -1) IN ('Makefile', 'makefile', 'GNUmakefile', 'Dockerfile', 'Containerfile', 'justfile', 'Justfile', 'Rakefile', 'Gemfile', 'Procfile', 'Jenkinsfile', 'BUILD', 'WORKSPACE')
  OR regexp_matches(lower(split_part(path, '/', -1)), '.[.](md|rs|py|js|jsx|ts|tsx|go|java|kt|c|h|cc|cpp|hpp|toml|yaml|yml|json|sh)$')) AS in_scope FROM p""")
def page_urls_scope(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, _SCOPE_PATHS)), (F.col("page_id") % len(_SCOPE_PATHS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("in_scope", revisions.in_scope(F.col("path")))


@query("status_yield_by_source", f"""WITH cl AS MATERIALIZED (SELECT c.*, source AS workspace_id, doc_id * 100000 + line AS seq FROM {S.doc_claims()} c WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY sha256(text))), sup AS (SELECT * FROM {S.superseded()})
SELECT workspace_id AS source, count(*) AS claims, count(superseded_by) AS superseded FROM cl LEFT JOIN sup USING (claim_id) GROUP BY workspace_id""")
def status_yield_by_source(spark, sf_dir):
    docs = documents(spark, sf_dir)
    once = docs.join(C.new_sources(docs, order="doc_id").select("doc_id"), "doc_id")
    rows = C.extract(once).withColumns({"workspace_id": F.col("source"), "seq": F.col("doc_id") * 100000 + F.col("line")})
    sup = C.first_replacement(rows, ["workspace_id", "subject_hint"], ["seq", "claim_id"])
    return rows.join(sup, "claim_id", "left").groupBy("source").agg(F.count("*").alias("claims"), F.count("superseded_by").alias("superseded"))


@query("html_escaped", "SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped_hash FROM pages")
def html_escaped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ids.digest(T.html_escape(F.col("html"))).alias("escaped_hash"))


@query("capture_budget", None)
def capture_budget(spark, sf_dir):
    """Pages as the files of one snapshot per host, under small budgets."""
    files = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("snapshot_id"), F.col("url").alias("path"), F.lit("file").alias("mode"), F.octet_length("html").cast("long").alias("bytes"))
    return revisions.capture(files, max_files=3, max_file_bytes=4000, max_total_bytes=6000)


from claimloom.plans import catalog_more  # noqa: E402, F401  registers its queries
