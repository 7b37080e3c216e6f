"""More registered queries: scalars, gates, verification and scores over the whole tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.functions import ids, scalars
from claimloom.functions import text as T
from claimloom.operators import claims as C
from claimloom.operators import code, drift, evidence, folds, journal, revisions, search, vectors
from claimloom.plans import sql as S
from claimloom.plans.catalog import document_claims, documents, query, statements, table
from claimloom.sources.lines import line_table


@query("normalized_lines", f"SELECT doc_id, line, {S.normalize('line_text')} AS normalized_text FROM {S.LINES}")
def normalized_lines(spark, sf_dir):
    return line_table(documents(spark, sf_dir)).select("doc_id", "line", T.normalize(F.col("line_text")).alias("normalized_text"))


@query("word_counts", "SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[^A-Za-z0-9]+'), lambda w: w <> '')) AS INTEGER) AS n FROM documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.words(F.col("text"))).alias("n"))


@query("content_token_counts", f"SELECT doc_id, CAST(len({S.content_tokens('text')}) AS INTEGER) AS n FROM documents")
def content_token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.content_tokens(F.col("text"))).alias("n"))


@query("slugs", f"SELECT DISTINCT line_text, {S.slug('n')} AS slug FROM (SELECT line_text, {S.normalize('line_text')} AS n FROM {S.LINES})")
def slugs(spark, sf_dir):
    rows = line_table(documents(spark, sf_dir)).select("line_text").distinct()
    return rows.select("line_text", T.slug(T.normalize(F.col("line_text"))).alias("slug"))


@query("event_props_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("chat_json_objects", r"""SELECT event_id, CASE WHEN instr(t, '{') > 0 AND instr(reverse(t), '}') > 0 AND length(t) - instr(reverse(t), '}') + 1 > instr(t, '{')
  THEN substr(t, instr(t, '{'), length(t) - instr(reverse(t), '}') + 1 - instr(t, '{') + 1) END AS body
  FROM (SELECT event_id, 'answer: ' || props || CASE WHEN event_type = 'error' THEN ' } tail' ELSE ' done' END AS t FROM events)""")
def chat_json_objects(spark, sf_dir):
    text = F.concat(F.lit("answer: "), "props", F.when(F.col("event_type") == "error", " } tail").otherwise(" done"))
    return table(spark, sf_dir, "events").select("event_id", scalars.json_object(text).alias("body"))


@query("percent_ppm", "SELECT event_id, CAST(least(greatest(CAST(floor(value) AS INTEGER), 0), 100) * 10000 AS INTEGER) AS ppm FROM events")
def percent_ppm(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.percent_to_ppm(F.floor("value").cast("int")).alias("ppm"))


@query("relation_labels", "SELECT event_id, CASE event_type WHEN 'view' THEN 'duplicate' WHEN 'click' THEN 'supersedes' WHEN 'error' THEN 'conflict' WHEN 'signup' THEN 'unrelated' END AS relation FROM events")
def relation_labels(spark, sf_dir):
    raw = F.when(F.col("event_type") == "view", " Duplicated").when(F.col("event_type") == "click", "SUPERSEDE").when(F.col("event_type") == "error", "conflicting ").when(F.col("event_type") == "signup", "Neutral").otherwise("replaces")
    return table(spark, sf_dir, "events").select("event_id", scalars.relation_label(raw).alias("relation"))


@query("cursor_identities", "SELECT event_id, 'claims-v1:' || CAST(event_id AS VARCHAR) AS cursor, substr(sha256(concat_ws(chr(31), CAST(event_id AS VARCHAR), event_type, '')), 1, 16) AS identity FROM events")
def cursor_identities(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.cursor("claims-v1", F.col("event_id")).alias("cursor"), scalars.cursor_identity(F.col("event_id"), F.col("event_type"), F.lit(None)).alias("identity"))


@query("evidence_ids", "SELECT doc_id, 'evidence_' || substr(sha256(concat_ws(chr(31), 'snap', source, CAST(n_chars AS VARCHAR))), 1, 24) AS occurrence_id FROM documents")
def evidence_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.derived_id("evidence_", F.lit("snap"), F.col("source"), F.col("n_chars")).alias("occurrence_id"))


@query("relation_pair_ids", "SELECT o_orderkey, 'pair_' || substr(sha256(concat_ws(chr(31), 'w', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR))), 1, 12) AS pair_id FROM orders")
def relation_pair_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", ids.relation_pair_id(F.lit("w"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("pair_id"))


@query("overlay_relations", """SELECT event_id, CASE WHEN b = 'same' THEN CASE WHEN NOT p AND NOT n THEN 'same' WHEN NOT p AND n THEN 'before' WHEN p AND NOT n THEN 'after' ELSE 'concurrent' END
  WHEN b = 'before' AND p THEN 'concurrent' WHEN b = 'after' AND n THEN 'concurrent' ELSE b END AS relation
  FROM (SELECT event_id, ['same', 'before', 'after', 'concurrent'][event_id % 4 + 1] AS b, event_id & 4 <> 0 AS p, event_id & 8 <> 0 AS n FROM events)""")
def overlay_relations(spark, sf_dir):
    base = F.element_at(F.array(*map(F.lit, ["same", "before", "after", "concurrent"])), (F.col("event_id") % 4 + 1).cast("int"))
    bit = lambda b: F.col("event_id").bitwiseAND(F.lit(b)) != 0
    return table(spark, sf_dir, "events").select("event_id", scalars.overlay_relation(base, bit(4), bit(8)).alias("relation"))


@query("source_link_outcomes", f"""WITH c AS (SELECT claim_id, path, source_id FROM {S.doc_claims()}), s AS (SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS path, 'src_' || substr(sha256(CASE WHEN lang = 'fr' THEN text || '!' ELSE text END), 1, 12) AS captured_id FROM documents WHERE lang <> 'de')
SELECT claim_id, path, CASE WHEN captured_id IS NULL THEN 'missing_source' WHEN captured_id <> source_id THEN 'changed_source' ELSE 'linked' END AS outcome FROM c LEFT JOIN s USING (path)""")
def source_link_outcomes(spark, sf_dir):
    now = documents(spark, sf_dir).where("lang <> 'de'")
    captured = now.select("path", ids.source_id(F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("source_id"))
    return evidence.link_sources(document_claims(spark, sf_dir), captured).select("claim_id", "path", "outcome")


@query("claim_temporal_order", """WITH p AS (SELECT event_id AS a, event_id + 1 AS b, event_id % 6 AS sa, (event_id + 1) % 6 AS sb FROM events),
f AS (SELECT user_id % 6 AS l, CAST(floor(value) AS BIGINT) % 6 AS r, arg_min(event_type, event_id) AS t FROM events GROUP BY ALL),
g AS (SELECT l, r, CASE t WHEN 'view' THEN 'before' WHEN 'click' THEN 'after' ELSE 'concurrent' END AS rel FROM f)
SELECT a, b, CASE WHEN sa = sb THEN 'same' ELSE coalesce(x.rel, CASE y.rel WHEN 'before' THEN 'after' WHEN 'after' THEN 'before' ELSE y.rel END, 'unknown') END AS temporal
FROM p LEFT JOIN g x ON x.l = sa AND x.r = sb LEFT JOIN g y ON y.l = sb AND y.r = sa""")
def claim_temporal_order(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    pairs = ev.select(F.col("event_id").alias("a"), (F.col("event_id") + 1).alias("b"))
    every = pairs.select(F.col("a").alias("claim_id")).unionByName(pairs.select(F.col("b").alias("claim_id"))).distinct().withColumn("snapshot_id", F.col("claim_id") % 6)
    raw = ev.select((F.col("user_id") % 6).alias("left_snapshot"), (F.floor("value").cast("long") % 6).alias("right_snapshot"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "before").when(F.col("event_type") == "click", "after").otherwise("concurrent").alias("relation"))
    return revisions.claim_order(pairs, every, folds.temporal_facts(raw))


@query("settlement_totals", """WITH p AS (SELECT user_id AS older, user_id + CAST(floor(value) AS BIGINT) % 3 AS newer, event_id, event_type FROM events),
j AS (SELECT older, newer, count(DISTINCT event_type) > 1 AS d FROM p WHERE event_type <> 'error' GROUP BY ALL), e AS (SELECT DISTINCT older, newer FROM p WHERE event_type = 'error')
SELECT (SELECT count(*) FROM j) AS settled, (SELECT count(*) FROM e ANTI JOIN j USING (older, newer)) AS unresolved, (SELECT count(*) FROM j WHERE d) AS contradicted""")
def settlement_totals(spark, sf_dir):
    p = table(spark, sf_dir, "events").select(F.lit("w").alias("workspace_id"), F.col("user_id").alias("older"), (F.col("user_id") + F.floor("value").cast("long") % 3).alias("newer"), F.col("event_id").alias("seq"), F.col("event_type").alias("relation"), F.lit(1).alias("score_ppm"), F.lit("f").alias("judge_fingerprint"))
    return folds.settlement_summary(folds.settlements(p.where("relation <> 'error'"), p.where("relation = 'error'"))).drop("workspace_id")


@query("journal_checks", """SELECT 'unknown_kind' AS "check", count(*) FILTER (event_type = 'error') AS n FROM events
UNION ALL SELECT 'decode_error', 0 UNION ALL SELECT 'repeated_sequence', 0
UNION ALL SELECT 'repeated_key', (SELECT count(*) FROM (SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) > 1))
UNION ALL SELECT 'illegal_edge', (WITH s AS (SELECT user_id AS entity, event_id AS seq, event_type = 'view' AS rec FROM events WHERE event_type IN ('view', 'click')),
  b AS (SELECT *, max(seq) FILTER (rec) OVER w AS r, min(seq) FILTER (NOT rec) OVER w AS s1, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY entity ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT CAST(sum((rec AND n > 0)::INT + (NOT rec AND (CASE WHEN n = 0 THEN 0 WHEN s1 IS NULL OR r > s1 THEN 1 ELSE 2 END) <> 1)::INT + (NOT rec AND s1 IS NOT NULL)::INT) AS BIGINT) FROM b)""")
def journal_checks(spark, sf_dir):
    """The verifier over events as a journal, in which errors are of no known kind."""
    ev = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 3).when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "signup", 6).otherwise(99)
    rows = ev.select(F.lit("w").alias("workspace_id"), kind.alias("kind"), F.col("user_id").cast("string").alias("entity"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("event_id"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("idempotency_key"), F.lit(None).cast("long").alias("lane"), F.lit(None).cast("string").alias("causation_id"), F.col("props").alias("payload"))
    return journal.verify(rows)


@query("drift_scores", """SELECT * FROM (VALUES ('explicit_supersede', 2, 2, 0, 0, 1000000), ('implicit_supersede', 2, 2, 0, 0, 1000000), ('conflict', 2, 2, 0, 0, 1000000), ('duplicate', 1, 1, 0, 0, 1000000), ('unrelated', 3, 3, 0, 0, 1000000)) t(kind, per, p, leaked, phantom, recall_ppm)
JOIN (SELECT count(*) // 10 AS k FROM benchmark) ON true""".replace("SELECT * FROM (VALUES", "SELECT kind, CAST(per * k AS BIGINT) AS total, CAST(p * k AS BIGINT) AS passed, CAST(leaked AS BIGINT) AS leaked, CAST(phantom AS BIGINT) AS phantom, CAST(recall_ppm AS INTEGER) AS recall_ppm FROM (VALUES"))
def drift_scores(spark, sf_dir):
    """As many drifting items as there are benchmark rows, ingested and scored by replacement wording alone."""
    rows = drift.items(spark, table(spark, sf_dir, "benchmark").count() // 10 * 10)
    src = C.new_sources(drift.sources(rows)).withColumn("source_id", ids.source_id(F.col("text")))
    found = C.extract(src.select("path", "text", "source_id")).withColumn("workspace_id", F.regexp_extract("text", "[0-9]+", 0))
    sup = C.first_replacement(found, ["workspace_id"], ["path", "line"])
    view = found.join(sup, "claim_id", "left").withColumn("status", F.when(F.col("superseded_by").isNull(), "current").otherwise("superseded"))
    return drift.score(rows, view)


@query("syntax_tags", r"""SELECT path, t[1] AS item, t[2] AS name, 'syntactic' AS analysis_quality FROM (
  SELECT path, unnest(list_zip(regexp_extract_all(code, '(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait|mod|impl|macro_rules!)\s+([A-Za-z_][A-Za-z0-9_]*)', 1), regexp_extract_all(code, '(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait|mod|impl|macro_rules!)\s+([A-Za-z_][A-Za-z0-9_]*)', 2))) AS t
  FROM (SELECT concat('src/', p_partkey, '.rs') AS path, concat('pub fn ', replace(p_name, ' ', '_'), '() {', chr(10), '  struct S', p_size, ';', chr(10), '// fn no', chr(10), 'async fn go() {}') AS code FROM part))""")
def syntax_tags(spark, sf_dir):
    code_text = F.concat(F.lit("pub fn "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("() {\n  struct S"), F.col("p_size").cast("string"), F.lit(";\n// fn no\nasync fn go() {}"))
    files = table(spark, sf_dir, "part").select(F.expr("concat('src/', p_partkey, '.rs')").alias("path"), code_text.alias("text"))
    return code.syntax_tags(files)


@query("top_claims_per_subject", f"""SELECT workspace_id, claim_id, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY confidence_ppm DESC, claim_id) AS rn FROM {S.statements()}) WHERE rn <= 4""")
def top_claims_per_subject(spark, sf_dir):
    return search.top_per_group(statements(spark, sf_dir), ["workspace_id"], [F.desc("confidence_ppm"), "claim_id"], 4).select("workspace_id", "claim_id", "rn")


@query("held_supersessions", f"""WITH cl AS MATERIALIZED (SELECT * FROM {S.statements()}), p AS (
  SELECT o.claim_id AS old_id, n.claim_id AS new_id, row_number() OVER (PARTITION BY o.claim_id ORDER BY n.seq, n.claim_id) AS k, CASE WHEN n.seq >= o.seq THEN 'before' WHEN n.seq % 2 = 0 THEN 'after' ELSE 'concurrent' END AS t
  FROM cl o JOIN cl n ON o.workspace_id = n.workspace_id AND o.subject_hint IS NOT DISTINCT FROM n.subject_hint AND o.claim_id <> n.claim_id AND o.normalized_text <> n.normalized_text AND {S.any_of('n.normalized_text', T.REPLACEMENT_SIGNALS, True)})
SELECT old_id, new_id, CASE t WHEN 'before' THEN 'applied' WHEN 'after' THEN 'temporal_reversed' ELSE 'temporal_concurrent' END AS decision FROM p WHERE k = 1""")
def held_supersessions(spark, sf_dir):
    """Supersessions under a temporal order of sources: what contradicts it is held."""
    rows = statements(spark, sf_dir)
    n = rows.where(T.has_replacement(F.col("normalized_text"))).select("workspace_id", "subject_hint", F.col("claim_id").alias("new_id"), F.col("normalized_text").alias("reads"), F.col("seq").alias("new_seq"))
    o = rows.select("workspace_id", "subject_hint", F.col("claim_id").alias("old_id"), "normalized_text", F.col("seq").alias("old_seq"))
    pairs = o.join(n, ["workspace_id", "subject_hint"]).where("old_id <> new_id and normalized_text <> reads")
    temporal = F.when(F.col("new_seq") >= F.col("old_seq"), "before").when(F.col("new_seq") % 2 == 0, "after").otherwise("concurrent")
    good, held = C.decide_pairs(pairs.withColumn("temporal", temporal), ["new_seq", "new_id"])
    return good.select("old_id", "new_id", F.lit("applied").alias("decision")).unionByName(held.select("old_id", "new_id", F.col("failure").alias("decision")))


@query("pair_orientation", """SELECT a.user_id AS i, a.event_id AS j, CASE WHEN s.older IS NOT NULL THEN a.user_id WHEN r.older IS NOT NULL THEN a.event_id WHEN a.user_id % 7 <= a.event_id % 5 THEN a.user_id ELSE a.event_id END AS older
FROM (SELECT DISTINCT user_id, event_id + 1000000 AS event_id FROM events) a
LEFT JOIN (SELECT DISTINCT user_id AS older, event_id + 1000000 AS newer FROM events WHERE event_type = 'view') s ON s.older = a.user_id AND s.newer = a.event_id
LEFT JOIN (SELECT DISTINCT event_id + 1000000 AS older, user_id AS newer FROM events WHERE event_type = 'click') r ON r.older = a.event_id AND r.newer = a.user_id""")
def pair_orientation(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("j", F.col("event_id") + 1_000_000)
    pairs = ev.select(F.col("user_id").alias("i"), "j").distinct().withColumns({"seq_i": F.col("i") % 7, "seq_j": F.col("j") % 5})
    settled = ev.where("event_type = 'view'").select(F.col("user_id").alias("older"), F.col("j").alias("newer")).unionByName(ev.where("event_type = 'click'").select(F.col("j").alias("older"), F.col("user_id").alias("newer")))
    return vectors.orient(pairs, settled).select("i", "j", "older")


@query("session_event_windows", """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS started, count(*) AS n FROM g GROUP BY user_id, k""")
def session_event_windows(spark, sf_dir):
    """An addition of our own: session windows of event time."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("started"), "n")


@query("running_event_counts", "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS nth FROM events")
def running_event_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("nth"))


@query("triangulated_targets", """WITH c AS (SELECT doc_id, lang, source, 'src/' || source AS path, n_chars % 100 AS a FROM documents),
f AS (SELECT 'path ' || source AS target_id, doc_id, path, a FROM c WHERE a + 5 >= 10 AND a <= 40
  UNION ALL SELECT 'symbol ' || lang, doc_id, path, a FROM c UNION ALL SELECT 'name ' || source, doc_id, path, a FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY path, a, doc_id) AS rn, count(*) OVER (PARTITION BY target_id) AS n FROM f)
SELECT target_id, doc_id AS occurrence_id, CASE WHEN n > 200 THEN 'budget_exceeded' END AS gap FROM r WHERE rn <= 200""")
def triangulated_targets(spark, sf_dir):
    """Code that paths with lines, symbols and shown names ask for; the cap of 200 a target is the operator's."""
    docs = table(spark, sf_dir, "documents")
    start = (F.col("n_chars") % 100).cast("int")
    code_rows = docs.select(F.col("doc_id").alias("occurrence_id"), F.col("lang").alias("symbol"), F.col("source").alias("name"), F.concat(F.lit("src/"), "source").alias("path"), start.alias("line_start"), (start + 5).alias("line_end"))
    none = F.lit(None)
    paths = docs.select(F.concat(F.lit("path "), "source").alias("target_id"), F.concat(F.lit("src/"), "source").alias("path"), F.lit(10).alias("ls"), F.lit(40).alias("le"), none.cast("string").alias("symbol"))
    symbols = [docs.select(F.concat(F.lit(word), c).alias("target_id"), none.cast("string").alias("path"), none.cast("int").alias("ls"), none.cast("int").alias("le"), F.col(c).alias("symbol")) for word, c in (("symbol ", "lang"), ("name ", "source"))]
    targets = paths.unionByName(symbols[0]).unionByName(symbols[1]).distinct()
    return evidence.structural_rows(code_rows, targets).select("target_id", "occurrence_id", "gap")


@query("latest_supporting_snapshot", """SELECT doc_id % 97 AS claim_id, arg_max(source, doc_id) AS snapshot_id FROM documents
WHERE n_chars % 3 <> 0 AND lang <> 'fr' GROUP BY doc_id % 97""")
def latest_supporting_snapshot(spark, sf_dir):
    method = F.when(F.col("n_chars") % 3 == 0, "judged").otherwise("deterministic")
    stance = F.when(F.col("lang") == "fr", "contradicts").otherwise("supports")
    links = table(spark, sf_dir, "documents").select((F.col("doc_id") % 97).alias("claim_id"), F.col("source").alias("snapshot_id"), F.col("doc_id").alias("link_seq"), method.alias("method"), stance.alias("stance"))
    return evidence.latest_snapshots(links)
