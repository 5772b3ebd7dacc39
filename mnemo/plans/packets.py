"""Queries of context packets: tasks are benchmark's items, of which every other one names a file, every fourth a project."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemo import policy
from mnemo.operators import packets as pk
from mnemo.operators import readpath as rp
from mnemo.plans.basics import case
from mnemo.plans.path import EDGES, TERMS, overlap_scorer, parts, pass_sql
from mnemo.plans.registry import query
from mnemo.schema import as_of, docs, table

LIMITS = rp.Limits(limit=8, near_copies=1.0, retry_below=0.0)
TASKS = """task AS (SELECT item_id AS packet_id, text AS task, CASE WHEN item_id % 2 = 0 THEN ['src/auth_service/loginHandler' || (item_id % 7) || '.py'] ELSE [] END AS files,
  CASE WHEN item_id % 4 = 3 THEN 'src' || (item_id % 20) END AS project FROM benchmark),
ask AS (SELECT packet_id AS query_id, task || CASE WHEN len(files) > 0 THEN ' login handler' || (packet_id % 7) || ' auth service' ELSE '' END AS text,
  CAST(NULL AS TIMESTAMP) AS start, CAST(NULL AS TIMESTAMP) AS stop, CAST(NULL AS VARCHAR) AS hint FROM task)"""
# Consecutive documents of a source and language, with the kind of link, who made it, and whether it was typed.
KINDS = """typed AS (SELECT source_id, node_id AS target_id, round(1 / (1 + gap / 40.0::DOUBLE), 3) AS weight, CASE WHEN doc_id % 13 = 4 THEN 'contradicts' WHEN before = event_type THEN 'evolution' ELSE 'temporal_cluster' END AS edge_type,
  CASE WHEN doc_id % 3 = 0 THEN 'discover_connections' WHEN doc_id % 7 = 1 THEN 'context_packet_miss_backfill' END AS source, doc_id % 2 = 0 AS typed FROM (
  SELECT *, lag(node_id) OVER w AS source_id, lag(event_type) OVER w AS before, doc_id - lag(doc_id) OVER w AS gap FROM docs WINDOW w AS (PARTITION BY project, entity_id ORDER BY doc_id, node_id)) WHERE source_id IS NOT NULL)"""
FACTOR = f"({case(policy.PACKET_EDGE, 1.0, 'edge_type')})::DOUBLE * ({case(pk.EDGE_SOURCE, 1.0, 'source')})::DOUBLE * CASE WHEN typed THEN 1.02 ELSE 1.0 END::DOUBLE"
KIND = f"({case(policy.PACKET_TYPE, 1.0)})::DOUBLE"
FACTS = "content, event_type, status, feedback_score, project"
JUDGED = f"""seed AS (SELECT query_id AS packet_id, node_id, relevance FROM xout WHERE rank <= 5),
both_ways AS (SELECT source_id AS a, target_id AS b, edge_type, weight, {FACTOR} AS factor FROM typed WHERE weight >= 0.25 UNION ALL SELECT target_id, source_id, edge_type, weight, {FACTOR} FROM typed WHERE weight >= 0.25),
g1 AS (SELECT packet_id, s.node_id AS seed_id, b AS node_id, 1 AS hop, edge_type, weight, factor FROM seed s JOIN both_ways ON a = s.node_id WHERE b <> s.node_id QUALIFY row_number() OVER (PARTITION BY packet_id, s.node_id, b ORDER BY weight DESC, factor DESC, edge_type, a) = 1),
g2 AS (SELECT packet_id, seed_id, b AS node_id, 2 AS hop, w.edge_type, w.weight, w.factor FROM g1 JOIN both_ways w ON w.a = g1.node_id WHERE b <> seed_id AND NOT EXISTS (SELECT 1 FROM g1 o WHERE o.packet_id = g1.packet_id AND o.seed_id = g1.seed_id AND o.node_id = b)
  QUALIFY row_number() OVER (PARTITION BY packet_id, seed_id, b ORDER BY w.weight DESC, w.factor DESC, w.edge_type, w.a) = 1),
gc AS (SELECT * FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2) g WHERE NOT EXISTS (SELECT 1 FROM seed s WHERE s.packet_id = g.packet_id AND s.node_id = g.node_id)
  QUALIFY row_number() OVER (PARTITION BY packet_id, seed_id ORDER BY round(greatest(0, least(weight, 1.0)) * factor, 9) DESC, weight, hop, node_id) <= 8),
items AS (SELECT * FROM (SELECT packet_id, node_id, hop, edge_type, {KIND} AS tw, round(relevance * {KIND} * CASE WHEN hop = 0 THEN 1.2 ELSE 1.0 END::DOUBLE * pow(0.55::DOUBLE, hop) * greatest(0.2::DOUBLE, least(weight, 1.0)) * factor, 4) AS score, {FACTS} FROM (
    SELECT packet_id, node_id, relevance, 0 AS hop, NULL AS edge_type, 1.0::DOUBLE AS weight, 1.0::DOUBLE AS factor FROM seed
    UNION ALL SELECT c.packet_id, c.node_id, s.relevance, hop, edge_type, weight, factor FROM gc c JOIN seed s ON s.packet_id = c.packet_id AND s.node_id = c.seed_id) JOIN docs USING (node_id))
  QUALIFY row_number() OVER (PARTITION BY packet_id, node_id ORDER BY score DESC, hop, edge_type NULLS FIRST) = 1
  UNION ALL SELECT packet_id, node_id, 0, NULL, {KIND}, round(0.35::DOUBLE * {KIND}, 4), content, event_type, status, feedback_score, d.project FROM (SELECT * FROM task WHERE packet_id NOT IN (SELECT packet_id FROM seed)) t JOIN docs d ON t.project IS NULL OR d.project = t.project
  WHERE event_type IN ('constraint', 'decision', 'error_pattern', 'lesson_learned', 'user_preference', 'user_fact') AND status = 'active' QUALIFY row_number() OVER (PARTITION BY packet_id ORDER BY priority DESC, created_at DESC, node_id) <= 8),
duel AS (SELECT s.packet_id, CASE WHEN s.tw < t.tw OR (s.tw = t.tw AND s.score < t.score) THEN s.node_id ELSE t.node_id END AS weak, CASE WHEN s.tw < t.tw OR (s.tw = t.tw AND s.score < t.score) THEN t.node_id ELSE s.node_id END AS winner
  FROM typed e JOIN items s ON s.node_id = e.source_id JOIN items t ON t.node_id = e.target_id AND t.packet_id = s.packet_id WHERE e.edge_type = 'contradicts'),
judged AS (SELECT i.*, CAST(row_number() OVER (PARTITION BY i.packet_id ORDER BY score DESC, node_id) AS INTEGER) AS place, CASE WHEN content = '' THEN 'empty' WHEN status = 'superseded' THEN 'superseded' WHEN feedback_score <= -3 THEN 'flagged_for_review'
  WHEN EXISTS (SELECT 1 FROM duel WHERE duel.packet_id = i.packet_id AND weak = node_id) OR (edge_type = 'contradicts' AND NOT EXISTS (SELECT 1 FROM duel WHERE duel.packet_id = i.packet_id AND winner = node_id)) THEN 'contradicts'
  WHEN t.project IS NOT NULL AND i.project <> t.project THEN 'project_scope' WHEN status = 'stale' THEN 'stale' END AS reason FROM items i JOIN task t USING (packet_id))"""
ALL = f"AND {TASKS}, {TERMS}, {EDGES}, {KINDS}, {pass_sql('x', 'ask', 0.50, 0.35, 0.10, 8)}, {JUDGED}"


def tasks(spark, d):
    b = table(spark, d, "benchmark")
    name = F.concat(F.lit("src/auth_service/loginHandler"), (F.col("item_id") % 7).cast("string"), F.lit(".py"))
    return b.select(
        F.col("item_id").alias("packet_id"), F.col("text").alias("task"), F.when(F.col("item_id") % 2 == 0, F.array(name)).otherwise(F.array().cast("array<string>")).alias("files"),
        F.when(F.col("item_id") % 4 == 3, F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))).alias("project"),
    )


def typed_edges(spark, d):
    m = docs(spark, d)
    w = Window.partitionBy("project", "entity_id").orderBy("doc_id", "node_id")
    e = m.select("*", F.lag("node_id").over(w).alias("source_id"), F.lag("event_type").over(w).alias("before"), (F.col("doc_id") - F.lag("doc_id").over(w)).alias("gap")).filter("source_id is not null")
    kind = F.when(F.col("doc_id") % 13 == 4, "contradicts").when(F.col("before") == F.col("event_type"), "evolution").otherwise("temporal_cluster")
    made = F.when(F.col("doc_id") % 3 == 0, "discover_connections").when(F.col("doc_id") % 7 == 1, "context_packet_miss_backfill")
    return e.select("source_id", F.col("node_id").alias("target_id"), F.round(1 / (1 + F.col("gap") / 40), 3).alias("weight"), kind.alias("edge_type"), made.alias("source"), (F.col("doc_id") % 2 == 0).alias("typed"))


def judged(spark, d):
    """Each task's candidates, from the read path and over links, with the reason why one stays out."""
    t, e = tasks(spark, d), typed_edges(spark, d)
    _, m, v, edges = parts(spark, d)
    none = {c: F.lit(None).cast(k) for c, k in (("start", "timestamp"), ("stop", "timestamp"), ("hint", "string"))}
    q = t.select(F.col("packet_id").alias("query_id"), pk.query_text(F.col("task"), F.col("files")).alias("text")).withColumns(none)
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    seeds = rp.run(q.join(vec, "query_id", "left"), m, v, edges, as_of(), LIMITS, overlap_scorer, "decision").withColumnRenamed("query_id", "packet_id")
    items = rp.written(pk.candidates(t, rp.written(seeds, "seeds"), m, e), "items")
    return t, pk.judge(items, t, e)


@query(f"{ALL} SELECT packet_id, node_id, place, hop, coalesce(edge_type, '') AS edge_type, score, reason IS NULL AS admitted, coalesce(reason, '') AS reason FROM judged", "docs")
def ctx_packet(spark, d):
    """What each task's packet considers, in order, and why an item is refused."""
    return judged(spark, d)[1].select("packet_id", "node_id", "place", "hop", F.coalesce("edge_type", F.lit("")).alias("edge_type"), "score", F.col("reason").isNull().alias("admitted"), F.coalesce("reason", F.lit("")).alias("reason"))


SECTION = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pk.SECTIONS.items()) + f" ELSE '{pk.REST}' END"
FLAT = "trim(regexp_replace(content, '[ \\t\\r\\n\\x0B\\f]+', ' ', 'g'))"


def shortened(most: int) -> str:
    return f"CASE WHEN length({FLAT}) > {most} THEN rtrim(substr({FLAT}, 1, {most - 3})) || '...' ELSE {FLAT} END"


RENDER = f"""adm AS (SELECT *, {SECTION} AS section, list_position([{', '.join(f"'{s}'" for s in pk.ORDER)}], {SECTION}) AS part, row_number() OVER (PARTITION BY packet_id ORDER BY place) AS n, row_number() OVER (PARTITION BY packet_id, {SECTION} ORDER BY place) AS seat,
  '- `' || substr(node_id, 1, 12) || '`' || CASE WHEN edge_type IS NOT NULL THEN ' (' || edge_type || ', hop ' || hop || ')' ELSE '' END || ': ' || {shortened(pk.SNIPPET)} AS line FROM judged WHERE reason IS NULL),
wr AS (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY CASE reason WHEN 'contradicts' THEN 3 WHEN 'flagged_for_review' THEN 2 ELSE 1 END DESC, score DESC, node_id) AS n FROM judged WHERE reason IN ('contradicts', 'flagged_for_review', 'stale')),
wn AS (SELECT packet_id, count(*) AS c, any_value('- top ' || reason || ': `' || substr(node_id, 1, 12) || '` ' || {shortened(pk.WARNING_SNIPPET)}) FILTER (n = 1) AS worst FROM wr GROUP BY 1),
wb AS (SELECT packet_id, string_agg(c || ' ' || reason, ', ' ORDER BY reason) AS bits FROM (SELECT packet_id, reason, count(*) AS c FROM wr GROUP BY 1, 2) GROUP BY 1),
say AS (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY part, seat) AS i FROM (
  SELECT packet_id, 0 AS part, 0 AS seat, 'heading' AS kind, section, chr(10) || section || ':' AS line FROM adm WHERE n = 1 UNION ALL SELECT packet_id, 0, 1, 'first', section, line FROM adm WHERE n = 1
  UNION ALL SELECT packet_id, part, 0, 'heading', section, chr(10) || section || ':' FROM adm WHERE seat = 1 UNION ALL SELECT packet_id, part, seat, 'item', section, line FROM adm WHERE n > 1 AND seat <= 4
  UNION ALL SELECT packet_id, 90, 0, 'warnings', '', chr(10) || 'Warnings:' FROM wn UNION ALL SELECT packet_id, 91, 1, 'note', '', '- ' || c || ' warning(s) in structured receipt: ' || bits || '.' FROM wn JOIN wb USING (packet_id)
  UNION ALL SELECT packet_id, 91, 2, 'note', '', worst FROM wn UNION ALL SELECT packet_id, 91, 3, 'note', '', '- ' || (c - 1) || ' additional warning(s) omitted from prompt; available in `warnings` payload.' FROM wn WHERE c > 1)),
fold AS (SELECT packet_id, CAST(0 AS BIGINT) AS i, '[MEMORY_CONTEXT] Context packet for ' || CASE WHEN len(files) > 0 THEN 'loginHandler' || (packet_id % 7) || '.py' ELSE substr(task, 1, 48) END AS text, 0 AS used, CAST([] AS VARCHAR[]) AS heads, '' AS ended FROM task
  UNION ALL SELECT packet_id, i, CASE WHEN head OR item OR note THEN text || chr(10) || line ELSE text END, used + CAST(item AS INT), CASE WHEN head THEN list_append(heads, section) ELSE heads END, CASE WHEN kind = 'item' AND used < 8 AND NOT fits THEN section WHEN kind = 'warnings' AND NOT fits THEN 'no warnings' ELSE ended END FROM (
    SELECT packet_id, i, text, used, heads, ended, line, kind, section, fits, kind = 'heading' AND used < 8 AND NOT list_contains(heads, section) AND fits AS head,
      (kind = 'first' AND fits) OR (kind = 'item' AND used < 8 AND ended <> section AND fits) AS item, (kind = 'warnings' AND fits) OR (kind = 'note' AND fits AND ended <> 'no warnings') AS note
    FROM (SELECT f.packet_id, s.i, text, used, heads, ended, line, kind, section, (length(text) + 1 + length(line)) // 4 <= 300 AS fits FROM fold f JOIN say s ON s.packet_id = f.packet_id AND s.i = f.i + 1) x))"""


@query(f"{ALL}, {RENDER} SELECT packet_id, text, used FROM fold QUALIFY row_number() OVER (PARTITION BY packet_id ORDER BY i DESC) = 1", "docs")
def ctx_render(spark, d):
    """Each task's packet as text within 300 tokens."""
    t, j = judged(spark, d)
    return pk.render(t, j, 300)


@query(f"AND {KINDS} SELECT source_id, target_id, round({FACTOR}, 6) AS mult FROM typed", "docs")
def ctx_edge_mult(spark, d):
    """How much a link counts by its type, by who made it, and if it was typed."""
    return typed_edges(spark, d).select("source_id", "target_id", F.round(pk.edge_factor(), 6).alias("mult"))
