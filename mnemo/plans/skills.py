"""Queries of the jobs around a generator, of prefetching, and of deleting with its audit."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F

from mnemo.operators import generate as ge
from mnemo.operators import lifecycle as lc
from mnemo.operators import prefetch as pf
from mnemo.plans.basics import ACTIVE, EXPIRED
from mnemo.plans.registry import query
from mnemo.schema import as_of, docs, links, mem


def workflow(prompts: pd.Series) -> pd.Series:
    """Stands for a language model: now and then it breaks off, skips, forgets a field or fails; else it tells the lines again."""

    def one(p: str) -> str:
        said = re.findall(r"^- \[(\w+)\] (.*)$", p, re.M)
        n = len(said)
        if n % 7 == 6:
            raise RuntimeError("no reply")
        if n % 5 == 4:
            return '{"skill_type": "feat'
        kinds = [k for k, _ in said]
        skill = {"skip": n % 6 == 5, "skill_type": "debugging" if "error_pattern" in kinds else "feature", "summary": "Redo " + said[0][1], "steps": kinds[:7], "key_insight": said[-1][1]}
        return "```json\n" + json.dumps(skill | ({"files_involved": ["a.py", "b.py"]} if n % 2 else {"outcome": "partial"})) + "\n```"

    return prompts.map(one)


SESSION = f"""r AS (SELECT session_id, event_type, content, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, node_id DESC) AS n FROM mem WHERE {ACTIVE} AND session_id IS NOT NULL),
s AS (SELECT session_id, count(*) AS c, bool_or(event_type = 'task_completion') AS done, list(event_type ORDER BY n DESC) AS ks, list(substr(content, 1, 200) ORDER BY n DESC) AS ts FROM r WHERE n <= 50 GROUP BY 1),
t AS (SELECT session_id, c, ks[1:20] AS ks, ts[1:20] AS ts, least(c, 20) AS n FROM s WHERE c >= 3 AND done)"""


@query(f"""AND {SESSION} SELECT session_id, CASE WHEN list_contains(ks, 'error_pattern') THEN 'debugging' ELSE 'feature' END AS skill_type, 'Redo ' || ts[1] || '. Steps: ' || array_to_string(ks[1:7], ' → ') || '. Insight: ' || ts[n] || CASE WHEN n % 2 = 1 THEN '. Files: a.py, b.py' ELSE '' END AS content,
  CASE WHEN n % 2 = 1 THEN 'success' ELSE 'partial' END AS outcome, c AS memory_count FROM t WHERE n % 7 <> 6 AND n % 5 <> 4 AND n % 6 <> 5""", "mem")
def lc_distill(spark, d):
    """Sessions' trajectories through a generator, and the skills that its usable replies make."""
    return ge.distill(mem(spark, d), workflow).select("session_id", "skill_type", "content", "outcome", "memory_count")


def questions(texts: pd.Series) -> pd.Series:
    """Stands for a language model: asks about the text's long words; fails on some texts and answers others badly."""

    def one(t: str) -> str:
        if len(t) % 9 == 1:
            raise RuntimeError("no reply")
        if len(t) % 9 == 2:
            return "Sorry"
        words = sorted(set(re.findall("[a-z0-9_]{6,}", t.lower())))[:6]
        said = json.dumps([f" about {w} " for w in words])
        return f"```\n{said}\n```" if len(t) % 9 == 3 else said

    return texts.map(one)


def lengths(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [float(len(t)), float(t.count("\n"))])


@query("""AND q AS (SELECT node_id, content, list_transform(list_slice(list_sort(list_distinct(regexp_extract_all(lower(content), '[a-z0-9_]{6,}'))), 1, 5), lambda w: 'about ' || w) AS qs FROM docs WHERE event_type IN ('user_preference', 'decision', 'lesson_learned', 'memory')
  AND length(content) >= 80 AND created_at <= TIMESTAMP '2024-01-20 23:00:00' AND doc_id % 7 <> 0 AND length(content) % 9 NOT IN (1, 2))
SELECT node_id, array_to_string(qs, '|') AS queries, length(content || chr(10) || array_to_string(qs, chr(10)))::DOUBLE AS chars, (length(content) - length(replace(content, chr(10), '')) + len(qs))::DOUBLE AS breaks FROM q WHERE len(qs) > 0""", "docs")
def lc_enrich(spark, d):
    """Memories not enriched before, at least an hour old, with the questions that they answer, and embedded again with them."""
    m = docs(spark, d)
    e = ge.enrich(m, m.filter("doc_id % 7 = 0").select("node_id"), as_of("2024-01-21 00:00:00"), questions, lengths)
    return e.select("node_id", F.array_join("queries", "|").alias("queries"), F.col("v")[0].alias("chars"), F.col("v")[1].alias("breaks"))


# Every third memory names a file of its kind and service; some belong to no project.
FILED = """filed AS (SELECT * REPLACE (CASE WHEN k % 3 = 0 THEN content || ' see src/' || event_type || '/' || event_type || (user_id % 7) || '.v' || (k % 3) || '.py, ok' ELSE content END AS content, CASE WHEN k % 10 = 9 THEN NULL ELSE project END AS project) FROM mem)"""


def filed(spark, d):
    m = mem(spark, d)
    path = F.concat(F.lit(" see src/"), "event_type", F.lit("/"), "event_type", (F.col("user_id") % 7).cast("string"), F.lit(".v"), (F.col("k") % 3).cast("string"), F.lit(".py, ok"))
    return m.withColumns({"content": F.when(F.col("k") % 3 == 0, F.concat("content", path)).otherwise(F.col("content")), "project": F.when(F.col("k") % 10 != 9, F.col("project"))})


STEMS = f"""AND {FILED}, hot AS (SELECT * FROM filed WHERE access_count > 0 AND project IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project ORDER BY access_count DESC, node_id) <= 100),
nm AS (SELECT project, regexp_replace(list_extract(string_split(f, '/'), -1), '\\.[^.]*$', '') AS stem FROM (SELECT project, unnest(regexp_extract_all(content, '\\b[\\w/.-]+\\.\\w{{1,5}}\\b')) AS f FROM hot)),
st AS (SELECT project, stem, count(*) AS n FROM nm WHERE length(stem) > 2 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY project ORDER BY count(*) DESC, stem) <= 10)"""


@query(f"""{STEMS}, hit AS (SELECT st.project, stem, f.* EXCLUDE (project), row_number() OVER (PARTITION BY st.project, stem ORDER BY access_count DESC, node_id) AS n FROM st JOIN filed f ON (f.project = st.project OR f.project IS NULL) AND contains(lower(content), lower(stem)))
SELECT project, stem, node_id, CAST(row_number() OVER (PARTITION BY project, stem ORDER BY n) AS INTEGER) AS place FROM hit WHERE n <= 10 AND NOT {EXPIRED} AND coalesce(status <> 'superseded', true)""", "mem")
def ret_prefetch(spark, d):
    """For each project the memories that name the files which its used memories name most."""
    return pf.prefetch(filed(spark, d), as_of())


ASKED = "asked AS (SELECT CASE WHEN k % 5 = 0 THEN node_id || '-gone' ELSE node_id END AS node_id FROM mem WHERE k % 10 < 2 UNION ALL SELECT node_id FROM mem WHERE k % 10 = 1)"


def asked(spark, d):
    m = mem(spark, d)
    name = F.when(F.col("k") % 5 == 0, F.concat("node_id", F.lit("-gone"))).otherwise(F.col("node_id"))
    return m.filter("k % 10 < 2").select(name.alias("node_id")).unionByName(m.filter("k % 10 = 1").select("node_id"))


@query(f"AND {ASKED} SELECT DISTINCT a.node_id, m.node_id IS NOT NULL AS success, CASE WHEN m.node_id IS NULL THEN 'Memory ' || a.node_id || ' not found' END AS error, CASE WHEN m.node_id IS NOT NULL THEN 'user_deleted' END AS reason, m.event_type, substr(m.content, 1, 200) AS preview, (SELECT count(*) FROM links l WHERE m.node_id IS NOT NULL AND (l.source_id = a.node_id OR l.target_id = a.node_id)) AS links FROM asked a LEFT JOIN mem m USING (node_id)", "mem", "links")
def hx_delete(spark, d):
    """What was asked to be deleted: its result, its line of the audit, and the links that go with it."""
    m, e, a = mem(spark, d), links(spark, d), asked(spark, d)
    gone, log = lc.deleted(m, a, as_of())
    lost = lc.lost_links(e, gone).groupBy("node_id").agg(F.count("*").alias("links"))
    facts = log.select("node_id", "reason", "event_type", F.col("content_preview").alias("preview"))
    return gone.join(facts, "node_id", "left").join(lost, "node_id", "left").withColumn("links", F.coalesce("links", F.lit(0)))


@query(f"AND {ASKED} SELECT source_id, target_id, edge_type FROM links WHERE source_id NOT IN (SELECT node_id FROM asked) AND target_id NOT IN (SELECT node_id FROM asked)", "mem", "links")
def hx_delete_links(spark, d):
    """The links that are left after deleting."""
    gone, _ = lc.deleted(mem(spark, d), asked(spark, d), as_of())
    return lc.links_left(links(spark, d), gone).select("source_id", "target_id", "edge_type")
