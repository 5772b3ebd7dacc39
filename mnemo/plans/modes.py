"""Queries of the mode router: benchmark's items ask in every mode, documents are the memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemo.operators import readpath as rp
from mnemo.operators import router as ro
from mnemo.plans.basics import ACTIVE
from mnemo.plans.path import EDGES, TERMS, overlap_scorer, parts, pass_sql
from mnemo.plans.registry import query
from mnemo.schema import as_of, table

LIMITS = rp.Limits(limit=6, near_copies=1.0, retry_below=0.0)
KINDS = "['semantic', 'other', 'phrase', 'regex', 'timeline', 'browse', 'browse', 'unified']"

# Two words of an item are its phrase, one as a beginning its pattern; some requests lack what they need.
REQUESTS = f"""req0 AS (SELECT item_id AS query_id, {KINDS}[1 + item_id % 8] AS mode0, text AS t, regexp_extract_all(lower(text), '[a-z]+') AS w, item_id AS i FROM benchmark),
req AS (SELECT query_id, CASE mode0 WHEN 'other' THEN 'semantic' ELSE mode0 END AS mode, CASE WHEN i % 41 = 3 THEN '  ' WHEN mode0 = 'phrase' THEN CASE WHEN i % 3 = 0 THEN upper(w[2] || ' ' || w[3]) ELSE w[2] || ' ' || w[3] END
    WHEN mode0 = 'regex' THEN CASE i % 5 WHEN 4 THEN '(' || w[2] WHEN 3 THEN '(a+)+' ELSE '(^|[^a-z])' || w[2] || '[a-z]* +[a-z]' END WHEN mode0 = 'unified' THEN 'How? ' || trim(t) ELSE trim(t) END AS text,
  CASE WHEN i % 4 < 3 THEN 1 + i % 6 END AS wanted, CASE WHEN mode0 <> 'unified' AND (i % 3 = 1 OR mode0 = 'browse' AND i % 3 = 0) THEN CASE WHEN i % 2 = 0 THEN 'decision' ELSE 'lesson_learned' END END AS event_type,
  CASE WHEN i % 5 = 1 THEN 'src' || (i % 7) END AS project, 'src' || (i % 20) AS session_id, CASE WHEN mode0 = 'other' THEN 'EN' END AS tag, CASE WHEN i % 6 = 2 AND mode0 = 'semantic' THEN 'en' END AS memory_type,
  CASE WHEN mode0 = 'semantic' THEN 0.3::DOUBLE END AS strength_min, i % 9 < 3 AS case_sensitive, CASE i % 3 WHEN 0 THEN 'type' WHEN 1 THEN 'session' ELSE 'recent' END AS browse_by, 22 + i % 9 AS days FROM req0)"""
CHECKED = """bad AS (SELECT query_id, mode, CASE WHEN mode IN ('semantic', 'unified', 'phrase', 'regex') AND text = '  ' THEN 'text is required' WHEN mode = 'browse' AND browse_by = 'type' AND event_type IS NULL THEN 'event_type is required'
  WHEN mode = 'regex' AND text = '(a+)+' THEN 'nested quantifiers' WHEN mode = 'regex' AND starts_with(text, '(') AND NOT contains(text, ')') THEN 'not a pattern' END AS error FROM req),
ok AS (SELECT * REPLACE (least(coalesce(wanted, CASE mode WHEN 'browse' THEN 20 ELSE 10 END), 200) AS wanted), CASE WHEN mode = 'regex' AND error IS NULL THEN text ELSE 'x' END AS pattern FROM req JOIN bad USING (query_id, mode) WHERE error IS NULL)"""
SCOPE = "(ok.event_type IS NULL OR d.event_type = ok.event_type) AND (ok.project IS NULL OR d.project = ok.project)"
NEWEST = "row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, d.node_id)"
LISTED = f"""listed AS (SELECT query_id, mode, wanted, {NEWEST} AS place, d.node_id FROM ok JOIN docs d ON {ACTIVE.replace("status", "d.status")} AND {SCOPE} WHERE (mode = 'phrase' AND CASE WHEN case_sensitive THEN contains(content, text) ELSE contains(lower(content), lower(text)) END)
    OR (mode = 'regex' AND CASE WHEN case_sensitive THEN regexp_matches(content, pattern) ELSE regexp_matches(content, pattern, 'i') END)
  UNION ALL SELECT query_id, mode, wanted, {NEWEST}, d.node_id FROM ok JOIN docs d ON {ACTIVE.replace("status", "d.status")} AND CASE browse_by WHEN 'type' THEN d.event_type = ok.event_type WHEN 'session' THEN d.project = ok.session_id ELSE true END WHERE mode = 'browse'
  UNION ALL SELECT query_id, mode, 100000, {NEWEST}, d.node_id FROM ok JOIN (SELECT *, row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY created_at DESC, node_id) AS n FROM docs) d ON created_at >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL '1' DAY * days AND n <= wanted WHERE mode = 'timeline')"""
ASK = """ask AS (SELECT query_id, trim(coalesce(project || ' ', '') || coalesce(event_type || ' ', '') || text) AS text, CAST(NULL AS TIMESTAMP) AS start, CAST(NULL AS TIMESTAMP) AS stop, event_type AS hint, tag IS NOT NULL OR memory_type IS NOT NULL AS narrow FROM ok WHERE mode IN ('semantic', 'unified')),
plain AS (SELECT * FROM ask WHERE NOT narrow), wide AS (SELECT * FROM ask WHERE narrow)"""
PASSES = f"{pass_sql('x', 'plain', 0.50, 0.35, 0.10, LIMITS.limit)}, {pass_sql('y', 'wide', 0.50, 0.35, 0.10, ro.OVERFETCH * LIMITS.limit)}"
KEPT = """kept AS (SELECT query_id, node_id, strength, row_number() OVER (PARTITION BY query_id ORDER BY n) AS place FROM (SELECT o.*, wanted, strength_min, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM (SELECT * FROM xout UNION ALL SELECT * FROM yout) o JOIN ok USING (query_id) JOIN docs d USING (node_id)
  WHERE (ok.event_type IS NULL OR d.event_type = ok.event_type) AND (tag IS NULL OR d.entity_id = lower(tag)) AND (memory_type IS NULL OR d.entity_id = memory_type)) WHERE n <= wanted AND (strength_min IS NULL OR strength >= strength_min))"""


def sharing(name: str, kind: str, pool: int, only: str) -> str:
    said = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: length(w) > 2)"
    return f"""{name} AS (SELECT query_id, mode, {NEWEST} AS place, d.node_id FROM ok JOIN (SELECT * FROM docs WHERE event_type = '{kind}' AND {ACTIVE} ORDER BY created_at DESC, node_id LIMIT {pool}) d ON list_has_any({said("ok.text")}, {said("d.content")})
  WHERE mode IN ('semantic', 'unified') AND coalesce(ok.event_type <> '{kind}', true) AND {only} AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.query_id = ok.query_id AND k.node_id = d.node_id))"""


ASKS = f"list_has_any(list_transform(regexp_split_to_array(lower(ok.text), '\\s+'), lambda w: rtrim(w, '?.,!')), [{', '.join(repr(w) for w in ro.ASKS_PREFERENCE)}])"
ANSWERS = f"""AND {REQUESTS}, {CHECKED}, {LISTED}, {ASK}, {TERMS}, {EDGES}, {PASSES}, {KEPT}, {sharing('rules', 'lesson_learned', ro.CONSTRAINTS, 'true')}, {sharing('wishes', 'decision', ro.PREFERENCES, ASKS)},
parts AS (SELECT query_id, mode, 'result' AS part, place, node_id, strength AS score FROM kept JOIN ok USING (query_id) UNION ALL SELECT query_id, mode, 'result', place, node_id, NULL FROM listed WHERE place <= wanted
  UNION ALL SELECT query_id, mode, 'constraint', place, node_id, NULL FROM rules WHERE place <= 3 UNION ALL SELECT query_id, mode, 'preference', place, node_id, NULL FROM wishes WHERE place <= 3)
SELECT query_id, mode, part, CAST(place AS INTEGER) AS place, node_id, score, event_type"""


def requests(spark, d):
    b = table(spark, d, "benchmark")
    i, w = F.col("item_id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    kind = F.element_at(F.array(*map(F.lit, ("semantic", "other", "phrase", "regex", "timeline", "browse", "browse", "unified"))), (1 + i % 8).cast("int"))
    word = lambda n: F.try_element_at("w", F.lit(n))
    pair = F.concat(word(2), F.lit(" "), word(3))
    pattern = F.when(i % 5 == 4, F.concat(F.lit("("), word(2))).when(i % 5 == 3, "(a+)+").otherwise(F.concat(F.lit("(^|[^a-z])"), word(2), F.lit("[a-z]* +[a-z]")))
    text = F.when(i % 41 == 3, "  ").when(F.col("kind") == "phrase", F.when(i % 3 == 0, F.upper(pair)).otherwise(pair)).when(F.col("kind") == "regex", pattern).when(F.col("kind") == "unified", F.concat(F.lit("How? "), F.trim("text"))).otherwise(F.col("text"))
    typed = (i % 3 == 1) | ((F.col("kind") == "browse") & (i % 3 == 0))
    numbered = lambda n: F.concat(F.lit("src"), (i % n).cast("string"))
    r = b.withColumns({"w": w, "kind": kind}).select(
        i.alias("query_id"), F.col("kind").alias("mode"), text.alias("text"), F.when(i % 4 < 3, (1 + i % 6).cast("int")).alias("wanted"),
        F.when(typed, F.when(i % 2 == 0, "decision").otherwise("lesson_learned")).alias("event_type"), F.when(i % 5 == 1, numbered(7)).alias("project"), numbered(20).alias("session_id"),
        F.when(F.col("kind") == "other", F.array(F.lit("EN"))).alias("tags"), F.when((i % 6 == 2) & (F.col("kind") == "semantic"), "en").alias("memory_type"), F.lit(None).cast("string").alias("status"),
        F.when(F.col("kind") == "semantic", 0.3).alias("strength_min"), (i % 9 < 3).alias("case_sensitive"), F.when(i % 3 == 0, "type").when(i % 3 == 1, "session").otherwise("recent").alias("browse_by"), (22 + i % 9).cast("int").alias("days"),
    )
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    return r.join(e, "query_id", "left")


def answers(spark, d, *modes):
    _, m, v, e = parts(spark, d)
    m = m.withColumns({"session_id": F.col("project"), "memory_type": F.col("entity_id")})
    return ro.answer(requests(spark, d).filter(F.col("mode").isin(*modes)), m, v, e, as_of(), LIMITS, overlap_scorer, "lesson_learned", "decision")


@query(f"{ANSWERS}, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS preview FROM parts JOIN docs USING (node_id) WHERE mode NOT IN ('semantic', 'unified')", "docs")
def ret_unified(spark, d):
    """Phrases, patterns, timelines and lists, each request by its mode's plan, in one result schema."""
    return answers(spark, d, "phrase", "regex", "timeline", "browse")


@query(f"{ANSWERS} FROM parts JOIN docs USING (node_id) WHERE mode IN ('semantic', 'unified')", "docs")
def ret_bridge_query(spark, d):
    """Requests by meaning: type and project lead the text, filters after three times the fetch, rules and wishes beside the answers."""
    return answers(spark, d, "semantic", "other", "unified").drop("preview")


@query(f"WITH {REQUESTS}, {CHECKED} SELECT query_id, mode, error FROM bad WHERE error IS NOT NULL")
def ret_rejected(spark, d):
    """Requests that lack what their mode needs, or whose pattern can't be used."""
    return ro.rejected(requests(spark, d))
