"""Queries of sources and sinks, edits, checks, packets, reports and streams that keep a store going."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemo import policy
from mnemo.functions import text as tx
from mnemo.operators import aggregates as ag
from mnemo.operators import context as cx
from mnemo.operators import dedup as dd
from mnemo.operators import graph as gr
from mnemo.operators import lifecycle as lc
from mnemo.operators import retrieval as rt
from mnemo.plans.registry import query
from mnemo.plans.statistics import finished, stream
from mnemo.schema import as_of, docs, links, mem, table, talk
from mnemo.sources import io
from mnemo.streaming import streams

NOW = "TIMESTAMP '2024-02-01 00:00:00'"
NODES = "node_id string, content string, event_type string, session_id string"


# Sources and sinks: what was written is read back.
@query("SELECT node_id, event_type, priority, created_at FROM mem", "mem")
def src_table(spark, d):
    return mem(spark, d).select("node_id", "event_type", "priority", "created_at")


@query("SELECT node_id, content, event_type, session_id FROM mem", "mem")
def src_import_json(spark, d):
    path = io.fresh_path(spark, "export")
    io.export_json(mem(spark, d).select("node_id", "content", "event_type", "session_id"), path)
    return io.import_json(spark, path, NODES)


@query("SELECT count(*) AS node_count, count(DISTINCT session_id) AS session_count FROM mem", "mem")
def src_export_json(spark, d):
    path = io.fresh_path(spark, "export")
    io.export_json(mem(spark, d).select("node_id", "content", "event_type", "session_id"), path)
    return spark.read.json(f"{path}/meta").select("node_count", "session_count")


@query("SELECT 'mem-' || substr(sha256(text), 1, 12) AS node_id, substr(text, 1, 2000) AS content, role AS event_type, CAST(conv_id AS VARCHAR) AS session_id FROM conversations WHERE role <> 'assistant'")
def src_reingest_jsonl(spark, d):
    path = io.fresh_path(spark, "lines")
    c = table(spark, d, "conversations")
    meta = F.struct(F.col("role").alias("event_type"), F.col("conv_id").cast("string").alias("session_id"))
    c.select(F.to_json(F.struct(F.col("text").alias("content"), meta.alias("metadata")))).write.text(path)
    rows, _ = io.read_jsonl(spark, path, ["assistant"])
    return rows.select("node_id", "content", "event_type", "session_id")


@query("SELECT node_id, min(source) AS source FROM (SELECT node_id, 0 AS source FROM docs WHERE doc_id % 3 = 0 UNION ALL SELECT node_id, 1 FROM docs WHERE doc_id % 2 = 0 UNION ALL SELECT node_id, 2 FROM docs) GROUP BY 1", "docs")
def src_migrate_graphs(spark, d):
    m = docs(spark, d)
    parts = [m.filter("doc_id % 3 = 0"), m.filter("doc_id % 2 = 0"), m]
    return io.merge_sources([p.select("node_id", F.lit(i).alias("source")) for i, p in enumerate(parts)])


@query("SELECT sha256(text) AS h, count(*) AS n FROM (SELECT text, doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT text, min(doc_id) FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0) GROUP BY 1) GROUP BY 1")
def src_migrate_into(spark, d):
    """Rows of another store are added unless their content is there."""
    m = docs(spark, d)
    both = io.merge_new(m.filter("doc_id % 2 = 0"), m.filter("doc_id % 2 = 1"))
    return both.groupBy(F.sha2("content", 256).alias("h")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, array_to_string(list(role || ': ' || text ORDER BY turn), chr(10)) AS tail FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) GROUP BY 1")
def src_session_transcript(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = table(spark, d, "conversations").withColumn("n", F.row_number().over(w)).filter("n <= 3")
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("tail"))


@query("AND l AS (SELECT source_id, array_to_string(list_sort(list_distinct(list('[[' || target_id || ']]'))), chr(10)) AS t FROM links GROUP BY 1) SELECT event_type, node_id, '# ' || node_id || chr(10) || chr(10) || content || chr(10) || chr(10) || coalesce(t, '') AS value FROM mem LEFT JOIN l ON source_id = node_id", "mem", "links")
def snk_obsidian(spark, d):
    return io.markdown(mem(spark, d), links(spark, d))


@query("AND e AS (SELECT node_id, content FROM mem WHERE event_type = 'error_pattern') SELECT event_type, count(*) AS n FROM mem GROUP BY 1", "mem")
def snk_snapshot(spark, d):
    """A snapshot is a table written once and never changed."""
    path = io.fresh_path(spark, "snapshot")
    mem(spark, d).write.parquet(path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT CAST(day AS VARCHAR) AS kept FROM (SELECT DISTINCT CAST(created_at AS DATE) AS day FROM mem) ORDER BY day DESC LIMIT 5", "mem")
def snk_backup_rotate(spark, d):
    """The newest five of the days' backups stay."""
    return mem(spark, d).select(F.to_date("created_at").cast("string").alias("kept")).distinct().orderBy(F.desc("kept")).limit(5)


@query("SELECT CAST(1 AS BIGINT) AS run, count(*) AS n FROM mem UNION ALL SELECT 2, count(*) FROM mem WHERE status = 'active'", "mem")
def snk_history_csv(spark, d):
    path = io.fresh_path(spark, "history")
    m = mem(spark, d)
    io.append_csv(m.agg(F.lit(1).alias("run"), F.count("*").alias("n")), path)
    io.append_csv(m.filter("status = 'active'").agg(F.lit(2).alias("run"), F.count("*").alias("n")), path)
    return spark.read.option("header", True).schema("run long, n long").csv(path)


@query("SELECT b.item_id AS query_id, count(d.node_id) AS result_count FROM benchmark b LEFT JOIN docs d ON contains(lower(d.content), lower(substr(b.text, 1, 20))) GROUP BY 1", "docs")
def snk_query_log(spark, d):
    """Every query with the number of its results, those without any too; the results are texts with its first words."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lower(F.substring("text", 1, 20)).alias("s"))
    hits = docs(spark, d).select(F.lower("content").alias("c")).join(F.broadcast(q), F.col("c").contains(F.col("s")), "inner")  # a benchmark's items
    n = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    path = io.fresh_path(spark, "query-log")
    q.join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("result_count")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("SELECT node_id, reason, min(t) AS deleted_at FROM (SELECT node_id, 'ttl_expired' AS reason, TIMESTAMP '2024-02-01 00:00:00' AS t FROM mem WHERE k % 3 = 0 UNION ALL SELECT node_id, 'ttl_expired', TIMESTAMP '2024-02-02 00:00:00' FROM mem WHERE k % 2 = 0) GROUP BY 1, 2", "mem")
def snk_forgetting_log(spark, d):
    m = mem(spark, d)
    first = lc.forgetting(m.filter("k % 3 = 0"), "ttl_expired", as_of())
    again = lc.forgetting(m.filter("k % 2 = 0"), "ttl_expired", as_of("2024-02-02 00:00:00"))
    return lc.append_log(first, again).select("node_id", "reason", "deleted_at")


@query("SELECT node_id, reason, count(*) AS n FROM (SELECT DISTINCT content AS node_id, CASE WHEN k % 2 = 0 THEN 'lru_evicted' ELSE 'user_deleted' END AS reason FROM mem) GROUP BY ALL", "mem")
def agg_forgetting_dedupe(spark, d):
    m = mem(spark, d).withColumn("node_id", F.col("content"))
    w = Window.partitionBy("node_id", "reason").orderBy("created_at")
    log = m.withColumn("reason", F.when(F.col("k") % 2 == 0, "lru_evicted").otherwise("user_deleted")).withColumn("n", F.row_number().over(w))
    return log.filter("n = 1").select("node_id", "reason", "n").withColumn("n", F.col("n").cast("long"))


COST = "round(({i} * CASE WHEN k % 2 = 0 THEN 1.0 ELSE 3.0 END + {o} * CASE WHEN k % 2 = 0 THEN 5.0 ELSE 15.0 END)::DOUBLE / 1000000, 6)"


def usage(spark, d):
    """Model calls: each memory's text in, a quarter of it out."""
    m = mem(spark, d).withColumn("model", F.when(F.col("k") % 2 == 0, "small").otherwise("middle"))
    n = F.length("content")
    cost = io.estimate_cost(F.col("model"), n, F.floor(n / 4), {"small": (1.0, 5.0), "middle": (3.0, 15.0)})
    return m.select("node_id", "project", "user_id", "created_at", "model", "k", cost.alias("cost"))


@query(f"SELECT node_id, {COST.format(i='length(content)', o='(length(content) // 4)')} AS cost FROM mem", "mem")
def snk_llm_usage(spark, d):
    path = io.fresh_path(spark, "usage")
    usage(spark, d).select("node_id", "cost").write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query(f"SELECT count(*) AS calls, round(sum({COST.format(i='length(content)', o='(length(content) // 4)')}), 5) AS cost FROM mem WHERE created_at >= TIMESTAMP '2024-01-15 00:00:00'", "mem")
def agg_cost_estimate(spark, d):
    u = usage(spark, d).filter("created_at >= timestamp '2024-01-15 00:00:00'")
    return u.agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 5).alias("cost"))


@query(f"SELECT project, round(sum({COST.format(i='length(content)', o='(length(content) // 4)')}), 5) AS cost, count(*) FILTER (k % 10 = 0) AS correct, CASE WHEN count(*) FILTER (k % 10 = 0) = 0 THEN 'inf' ELSE 'finite' END AS per_correct FROM mem GROUP BY 1", "mem")
def agg_cost_phase(spark, d):
    u = usage(spark, d).groupBy("project").agg(F.round(F.sum("cost"), 5).alias("cost"), F.count_if(F.col("k") % 10 == 0).alias("correct"))
    each = F.when(F.col("correct") == 0, float("inf")).otherwise(F.col("cost") / F.col("correct"))
    return u.withColumn("per_correct", F.when(each == float("inf"), "inf").otherwise("finite"))


@query("SELECT item_id AS probe_id, substr(sha256(text), 1, 16) AS digest FROM benchmark")
def snk_probe_set(spark, d):
    path = io.fresh_path(spark, "probes")
    table(spark, d, "benchmark").select(F.col("item_id").alias("probe_id"), "text", F.sha2("text", 256).alias("sha")).write.json(path)
    return spark.read.schema("probe_id long, sha string").json(path).select("probe_id", F.substring("sha", 1, 16).alias("digest"))


@query("SELECT count(*) AS probes, CAST(0 AS BIGINT) AS broken FROM benchmark")
def src_probe_set(spark, d):
    """Frozen probes are checked against their digests."""
    path = io.fresh_path(spark, "probes")
    table(spark, d, "benchmark").select("text", F.sha2("text", 256).alias("sha")).write.json(path)
    p = spark.read.schema("text string, sha string").json(path)
    return p.agg(F.count("*").alias("probes"), F.count_if(F.sha2("text", 256) != F.col("sha")).alias("broken"))


@query("SELECT item_id, CAST(min(place) AS INTEGER) AS place FROM (SELECT item_id, 0 AS place FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 1 FROM benchmark WHERE item_id % 3 = 0) GROUP BY 1")
def src_constraints_json(spark, d):
    """Rules of the whole store come before a project's own; one of both stays once."""
    b, path = table(spark, d, "benchmark"), io.fresh_path(spark, "rules")
    for i, part in enumerate((b.filter("item_id % 2 = 0"), b.filter("item_id % 3 = 0"))):
        part.select("item_id").write.json(f"{path}/{i}")
    read = lambda i: spark.read.schema("item_id long").json(f"{path}/{i}").withColumn("place", F.lit(i))
    return io.merge_sources([read(0), read(1)], "item_id")


# Edits of single memories, as batches.
@query("SELECT node_id, CASE WHEN k % 5 = 0 THEN 'edited ' || content ELSE content END AS content, sha256(CASE WHEN k % 5 = 0 THEN 'edited ' || content ELSE content END) AS h FROM mem WHERE k % 7 <> 0", "mem")
def lc_edit(spark, d):
    """Deletions by an anti-join, updates by a join; a changed text has a new hash."""
    m = mem(spark, d)
    gone = m.filter("k % 7 = 0").select("node_id")
    new = m.filter("k % 5 = 0").select("node_id", F.concat(F.lit("edited "), "content").alias("new"))
    out = m.join(gone, "node_id", "left_anti").join(new, "node_id", "left").select("node_id", F.coalesce("new", "content").alias("content"))
    return out.withColumn("h", F.sha2("content", 256))


@query("SELECT node_id FROM mem WHERE NOT (session_id LIKE '1-%' OR session_id LIKE '2-%')", "mem")
def lc_session_clear(spark, d):
    m = mem(spark, d)
    gone = m.select("session_id").distinct().filter(F.col("session_id").rlike("^[12]-"))
    return m.join(gone, "session_id", "left_anti").select("node_id")


@query("""SELECT conv_id, turn, CASE WHEN length(text) < 0.7::DOUBLE * length(old) THEN 'shortened' WHEN length(text) > 1.5::DOUBLE * length(old) THEN 'extended' WHEN len(list_filter(a, lambda w: NOT list_contains(b, w))) <= 5 THEN 'reworded' ELSE 'rewritten' END AS kind
FROM (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS a, list_distinct(regexp_extract_all(lower(old), '[a-z0-9_]+')) AS b FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM conversations) WHERE old IS NOT NULL)""")
def lc_edit_observation(spark, d):
    """What kind of edit makes one text of the other."""
    t = table(spark, d, "conversations").withColumn("old", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("old is not null")
    n, o = F.length("text"), F.length("old")
    fresh = F.size(F.array_except(tx.word_set("text", 1), tx.word_set("old", 1)))
    return t.select("conv_id", "turn", F.when(n < 0.7 * o, "shortened").when(n > 1.5 * o, "extended").when(fresh <= 5, "reworded").otherwise("rewritten").alias("kind"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def jn_backfill_vec(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left_anti").select("doc_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def jn_orphan_vec(spark, d):
    kept = table(spark, d, "documents").filter("doc_id % 2 = 0")
    return table(spark, d, "embeddings").join(kept, F.col("doc_id") == F.col("vec_id"), "left_anti").select("vec_id")


@query("SELECT doc_id, CASE WHEN vec_id IS NULL THEN 'missing' WHEN label = 0 THEN 'tainted' ELSE 'ok' END AS state FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def lc_backfill(spark, d):
    """Which vectors have to be made, and which again."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    state = F.when(F.col("label").isNull(), "missing").when(F.col("label") == 0, "tainted").otherwise("ok")
    return table(spark, d, "documents").select("doc_id").join(e, "doc_id", "left").select("doc_id", state.alias("state"))


@query("SELECT node_id FROM mem WHERE NOT (content IN ('decision always use service1 build1 step1') OR starts_with(session_id, '3-') OR (event_type = 'session_summary' AND length(content) < 45))", "mem")
def flt_exact_strings(spark, d):
    m = mem(spark, d)
    junk = F.col("content").isin("decision always use service1 build1 step1") | F.col("session_id").startswith("3-")
    return m.filter(~(junk | ((F.col("event_type") == "session_summary") & (F.length("content") < 45)))).select("node_id")


@query("SELECT node_id FROM mem WHERE (event_type = 'error_pattern' AND content LIKE 'error_pattern never%') OR (event_type = 'user_preference' AND content LIKE '%build7%')", "mem")
def flt_raw_json_errors(spark, d):
    return mem(spark, d).filter("(event_type = 'error_pattern' and content like 'error_pattern never%') or (event_type = 'user_preference' and content like '%build7%')").select("node_id")


@query("SELECT m.node_id, CASE WHEN k % 9 = 0 THEN 'superseded' ELSE status END AS status, CASE WHEN k % 9 = 0 THEN 'manual' END AS superseded_by FROM mem m", "mem")
def hx_supersede_manual(spark, d):
    m = mem(spark, d)
    by = m.filter("k % 9 = 0").select(F.col("node_id").alias("old_id"), F.lit("manual").alias("new_id"), as_of().alias("at"))
    return dd.mark_superseded(m, by).select("node_id", "status", "superseded_by")


# Links.
@query("AND n AS (SELECT source_id, target_id, edge_type, greatest(0.0::DOUBLE, least(1.0::DOUBLE, weight * 1.5::DOUBLE)) AS w FROM links) SELECT source_id, target_id, round(w, 6) AS weight FROM n", "mem", "links")
def gr_link(spark, d):
    e = links(spark, d)
    return e.select("source_id", "target_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("weight") * 1.5)), 6).alias("weight"))


HOPS = """AND e AS (SELECT source_id AS a, target_id AS b, weight AS w FROM links WHERE weight >= 0.6 UNION SELECT target_id, source_id, weight FROM links WHERE weight >= 0.6),
w AS (SELECT node_id AS start_id, node_id, 0 AS hop FROM mem WHERE CAST(substr(node_id, 5) AS BIGINT) % 20 = 0 UNION SELECT start_id, b, hop + 1 FROM w JOIN e ON a = node_id WHERE hop < 2),
r AS (SELECT start_id, node_id, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY 1, 2 HAVING min(hop) > 0)"""


def reached(spark, d):
    starts = mem(spark, d).filter("cast(substr(node_id, 5) as bigint) % 20 = 0").select(F.col("node_id").alias("start_id"))
    return gr.bfs(links(spark, d), starts, 2, 0.6)


@query(f"{HOPS} SELECT start_id, count(*) AS n, CAST(max(hop) AS INTEGER) AS deepest FROM r GROUP BY 1", "mem", "links")
def gr_traverse(spark, d):
    return reached(spark, d).groupBy("start_id").agg(F.count("*").alias("n"), F.max("hop").alias("deepest"))


@query(f"{HOPS} SELECT start_id, node_id, CAST(row_number() OVER (PARTITION BY start_id ORDER BY hop, node_id) AS INTEGER) AS place FROM r", "mem", "links")
def srt_hop_weight(spark, d):
    w = Window.partitionBy("start_id").orderBy("hop", "node_id")
    return reached(spark, d).select("start_id", "node_id", F.row_number().over(w).alias("place"))


@query(f"{HOPS} SELECT r.start_id, r.node_id FROM r WHERE hop = 2 AND NOT EXISTS (SELECT 1 FROM links l WHERE l.source_id = r.start_id AND l.target_id = r.node_id) QUALIFY row_number() OVER (PARTITION BY start_id ORDER BY r.node_id) <= 2", "mem", "links")
def gr_backfill_source(spark, d):
    """Edges that would have led to what was missed, two at most for each start."""
    far = reached(spark, d).filter("hop = 2")
    e = links(spark, d).select(F.col("source_id").alias("start_id"), F.col("target_id").alias("node_id"))
    w = Window.partitionBy("start_id").orderBy("node_id")
    return far.join(e, ["start_id", "node_id"], "left_anti").withColumn("n", F.row_number().over(w)).filter("n <= 2").select("start_id", "node_id")


# Aggregates and windows.
@query("SELECT node_id FROM (SELECT node_id, created_at FROM mem QUALIFY row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY created_at DESC, node_id) <= 10) ORDER BY created_at DESC, node_id LIMIT 15", "mem")
def agg_activity_summary(spark, d):
    w = Window.partitionBy(F.to_date("created_at")).orderBy(F.desc("created_at"), "node_id")
    m = mem(spark, d).withColumn("n", F.row_number().over(w)).filter("n <= 10")
    return m.orderBy(F.desc("created_at"), "node_id").limit(15).select("node_id")


@query("SELECT node_id FROM mem QUALIFY row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY created_at DESC, node_id) <= 10", "mem")
def win_per_day_cap(spark, d):
    w = Window.partitionBy(F.to_date("created_at")).orderBy(F.desc("created_at"), "node_id")
    return mem(spark, d).withColumn("n", F.row_number().over(w)).filter("n <= 10").select("node_id")


@query("AND x AS (SELECT DISTINCT user_id, CAST(created_at AS DATE) AS day FROM mem), y AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM x) SELECT user_id, CAST(min(day) AS VARCHAR) AS first, count(*) AS days FROM y GROUP BY user_id, island", "mem")
def win_islands(spark, d):
    days = mem(spark, d).select("user_id", F.to_date("created_at").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    return days.withColumn("island", island).groupBy("user_id", "island").agg(F.min("day").cast("string").alias("first"), F.count("*").alias("days")).drop("island")


@query("SELECT user_id, round(avg(value), 6) AS mean FROM (SELECT * FROM mem QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, node_id) <= 100) GROUP BY 1", "mem")
def win_last_n(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "node_id")
    last = mem(spark, d).withColumn("n", F.row_number().over(w)).filter("n <= 100")
    return last.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"))


BLEND = "0.45::DOUBLE * priority + 1.75::DOUBLE / (1 + (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) / 3600e6 / 72) + 0.2::DOUBLE * least(log2(1 + access_count), 5)"


@query(f"SELECT node_id, round({BLEND}, 6) AS blend FROM mem QUALIFY row_number() OVER (PARTITION BY project ORDER BY round({BLEND}, 6) DESC, node_id) <= 5", "mem")
def srt_composite(spark, d):
    from mnemo.functions import scoring as sc
    from mnemo.schema import age_days

    hours = age_days("created_at", as_of()) * 24
    blend = F.round(0.45 * F.col("priority") + 1.75 * sc.recency(hours) + 0.20 * sc.access_boost(F.col("access_count")), 6)
    return rt.top(mem(spark, d).withColumn("blend", blend), 5, "blend", "project").select("node_id", "blend")


REMINDERS = "SELECT node_id, project, created_at + INTERVAL '1' DAY * k AS remind_at, CASE WHEN k % 3 = 0 THEN 'dismissed' ELSE 'pending' END AS reminder_status FROM mem WHERE event_type = 'decision'"


@query(f"AND r AS ({REMINDERS}) SELECT node_id, CAST(row_number() OVER (PARTITION BY project ORDER BY CASE WHEN remind_at <= {NOW} THEN 0 ELSE 1 END, remind_at, node_id) AS INTEGER) AS place FROM r WHERE reminder_status = 'pending'", "mem")
def srt_overdue_first(spark, d):
    r = mem(spark, d).filter("event_type = 'decision'").select("node_id", "project", F.expr("created_at + make_dt_interval(CAST(k AS INT))").alias("remind_at"), F.when(F.col("k") % 3 == 0, "dismissed").otherwise("pending").alias("reminder_status"))
    due = lc.due_reminders(r, as_of())
    w = Window.partitionBy("project").orderBy(F.desc("overdue"), "remind_at", "node_id")
    return due.select("node_id", F.row_number().over(w).alias("place"))


@query("AND a AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(created_at)) / 3600e6 AS h FROM mem), v AS (SELECT count(*) FILTER (h BETWEEN 0 AND 24) AS n FROM a), s AS (SELECT CASE WHEN n >= 20 THEN 12 WHEN n >= 5 THEN 24 ELSE 72 END AS span FROM v) SELECT node_id, CASE WHEN h <= span THEN 'fresh' WHEN h <= 2 * span THEN 'recent' ELSE 'stale' END AS bucket FROM a, s", "mem")
def lim_velocity_sort(spark, d):
    return cx.velocity(mem(spark, d), as_of("2024-01-31 00:00:00")).select("node_id", "bucket")


# Small lookups.
@query("SELECT max(created_at) AS at FROM mem", "mem")
def hx_last_capture(spark, d):
    return mem(spark, d).agg(F.max("created_at").alias("at"))


@query("SELECT node_id, content, access_count + 1 AS access_count FROM mem WHERE node_id = 'mem-000000000007'", "mem")
def hx_get_node(spark, d):
    return mem(spark, d).filter("node_id = 'mem-000000000007'").select("node_id", "content", (F.col("access_count") + 1).alias("access_count"))


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, len(embedding) AS dim FROM embeddings WHERE vec_id = 7")
def hx_get_embedding(spark, d):
    return table(spark, d, "embeddings").filter("vec_id = 7").select("vec_id", F.round(F.get("embedding", 0).cast("double"), 6).alias("first"), F.size("embedding").cast("long").alias("dim"))


@query("SELECT count(*) AS writes, count(*) > 500 AS critical, round(count(*) FILTER (event_type = 'error_pattern')::DOUBLE / count(*), 6) AS error_rate FROM mem WHERE created_at >= TIMESTAMP '2024-01-20 00:00:00'", "mem")
def hx_backlog(spark, d):
    m = mem(spark, d).filter("created_at >= timestamp '2024-01-20 00:00:00'")
    rate = F.round(F.count_if(F.col("event_type") == "error_pattern") / F.nullif(F.count("*"), F.lit(0)), 6)
    return m.agg(F.count("*").alias("writes"), (F.count("*") > 500).alias("critical"), rate.alias("error_rate"))


@query("SELECT node_id, 'delete' AS op FROM mem WHERE status = 'superseded'", "mem")
def hx_cloud_delete(spark, d):
    return mem(spark, d).filter("status = 'superseded'").select("node_id", F.lit("delete").alias("op"))


@query("SELECT node_id, substr(content, 1, 200) AS content_preview, event_type, 'external' AS reason FROM mem WHERE k = 5", "mem")
def hx_forget_external(spark, d):
    return lc.forgetting(mem(spark, d).filter("k = 5"), "external", as_of()).select("node_id", "content_preview", "event_type", "reason")


@query("SELECT CASE WHEN count(*) FILTER (status = 'active') * 2 < count(*) THEN 'degraded' ELSE 'healthy' END AS health, count(*) AS memories FROM mem", "mem")
def hx_health_text(spark, d):
    few = F.count_if(F.col("status") == "active") * 2 < F.count("*")
    return mem(spark, d).agg(F.when(few, "degraded").otherwise("healthy").alias("health"), F.count("*").alias("memories"))


@query("SELECT 'profile' AS source, CAST(user_id AS VARCHAR) AS item FROM (SELECT DISTINCT user_id FROM mem) UNION ALL SELECT 'preference', node_id FROM (SELECT node_id FROM mem WHERE event_type = 'user_preference' ORDER BY created_at DESC, node_id LIMIT 20)", "mem")
def hx_profile(spark, d):
    m = mem(spark, d)
    newest = m.filter("event_type = 'user_preference'").orderBy(F.desc("created_at"), "node_id").limit(20)
    return m.select(F.lit("profile").alias("source"), F.col("user_id").cast("string").alias("item")).distinct().unionByName(newest.select(F.lit("preference").alias("source"), F.col("node_id").alias("item")))


@query("AND p AS (SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'always|never') THEN 1 ELSE 0 END AS n FROM talk) SELECT conv_id, CAST(sum(n) AS BIGINT) AS extracted FROM p GROUP BY 1", "talk")
def hx_pref_pipeline(spark, d):
    return talk(spark, d).groupBy("conv_id").agg(F.count_if(F.lower("text").rlike("always|never")).alias("extracted"))


@query(f"""AND dd AS (SELECT DISTINCT user_id, CAST(created_at AS DATE) AS day FROM mem), r AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM dd), l AS (SELECT user_id, max(n) AS longest FROM (SELECT user_id, run, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT user_id, longest, CAST(coalesce(list_max(list_filter([{', '.join(map(str, policy.STREAKS))}], lambda s: s <= longest)), 0) AS INTEGER) AS streak FROM l""", "mem")
def hx_streak_milestone(spark, d):
    """Each user's longest run of days and the streak it reaches, 0 before the first."""
    longest = ag.streaks(mem(spark, d), "user_id").groupBy("user_id").agg(F.max("length").alias("longest"))
    reached = F.filter(F.array(*map(F.lit, policy.STREAKS)), lambda s: s <= F.col("longest"))
    return longest.select("user_id", "longest", F.coalesce(F.array_max(reached), F.lit(0)).alias("streak"))


@query("SELECT item_id, CASE WHEN len(w) >= 2 THEN array_to_string(list_slice(w, 1, 3), ' ') END AS probe FROM (SELECT item_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{6,}'))) AS w FROM benchmark)")
def hx_keyword_probe(spark, d):
    w = F.array_sort(tx.word_set("text", 6))
    return table(spark, d, "benchmark").select("item_id", F.when(F.size(w) >= 2, F.array_join(F.slice(w, 1, 3), " ")).alias("probe"))


@query("SELECT item_id, least(3, length(text) // 100) AS grade FROM benchmark")
def hx_llm_probe(spark, d):
    """Grades of an injected judge, 0 to 3, here by length; 1 where it fails."""
    judge = F.floor(F.length("text") / 100)
    return table(spark, d, "benchmark").select("item_id", F.least(F.lit(3), F.coalesce(judge, F.lit(1))).cast("long").alias("grade"))


@query("SELECT text AS topic FROM (SELECT text, max(conv_id) AS c FROM conversations WHERE role = 'user' AND length(text) >= 12 GROUP BY 1) ORDER BY c DESC, text LIMIT 50")
def hx_querylog_topics(spark, d):
    q = table(spark, d, "conversations").filter("role = 'user' and length(text) >= 12")
    return q.groupBy(F.col("text").alias("topic")).agg(F.max("conv_id").alias("c")).orderBy(F.desc("c"), "topic").limit(50).select("topic")


@query("SELECT event_type, '| ' || event_type || ' | ' || count(*) || ' |' AS line FROM mem GROUP BY 1", "mem")
def hx_reports(spark, d):
    return mem(spark, d).groupBy("event_type").agg(F.concat_ws(" ", F.lit("|"), F.first("event_type"), F.lit("|"), F.count("*").cast("string"), F.lit("|")).alias("line"))


@query("SELECT page_id, 'fix ' || trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$'), '\\.[A-Za-z0-9]+$', ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_./-]+', ' ', 'g'))) AS query FROM pages")
def hx_packet_query(spark, d):
    """A task and the words of its file's name."""
    name = F.regexp_extract("url", "([^/]*)$", 1)
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("fix "), tx.natural_tokens(name)).alias("query"))


@query("SELECT node_id, status, entity_id, project FROM mem WHERE k < 3", "mem")
def hx_packet_scope_row(spark, d):
    m = mem(spark, d)
    return m.filter("k < 3").select("node_id").join(m.select("node_id", "status", "entity_id", "project"), "node_id")


EDGE = "CASE edge_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in policy.PACKET_EDGE.items()) + " ELSE 1.0 END::DOUBLE"


@query(f"SELECT source_id, target_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY round(weight * {EDGE}, 6) DESC, weight DESC, target_id) AS INTEGER) AS place FROM links", "mem", "links")
def hx_packet_chain_rank(spark, d):
    score = F.round(F.col("weight") * policy.by_type(policy.PACKET_EDGE, "edge_type", 1.0), 6)
    w = Window.partitionBy("source_id").orderBy(F.desc(score), F.desc("weight"), "target_id")
    return links(spark, d).select("source_id", "target_id", F.row_number().over(w).alias("place"))


# Packets: each project's memories, scored by use and priority.
REASON = f"CASE WHEN trim(content) = '' THEN 'empty' WHEN status = 'superseded' THEN 'superseded' WHEN feedback_score <= {policy.FLAGGED_AT} THEN 'flagged' WHEN (epoch_us({NOW}) - epoch_us(created_at)) / 86400e6 > 20 THEN 'stale' END"
PACKET = f"pk AS (SELECT *, {REASON} AS reason, priority + 0.1::DOUBLE * access_count AS score FROM mem)"


def packet(spark, d):
    return mem(spark, d).withColumn("reason", cx.admission(as_of(), stale_days=20)).withColumn("score", F.col("priority") + 0.1 * F.col("access_count"))


SEVERITY = "CASE reason WHEN 'contradicts' THEN 3 WHEN 'flagged' THEN 2 WHEN 'stale' THEN 1 ELSE 0 END"


@query(f"AND {PACKET} SELECT project, node_id, reason, CAST(row_number() OVER (PARTITION BY project ORDER BY {SEVERITY} DESC, score DESC, node_id) AS INTEGER) AS place FROM pk WHERE reason IN ('flagged', 'stale') QUALIFY place <= 5", "mem")
def ctx_warn_rank(spark, d):
    p = packet(spark, d).filter("reason in ('flagged', 'stale')")
    w = Window.partitionBy("project").orderBy(F.desc(F.when(F.col("reason") == "flagged", 2).otherwise(1)), F.desc("score"), "node_id")
    return p.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("project", "node_id", "reason", "place")


@query(f"AND {PACKET}, c AS (SELECT project, reason, count(*) AS n FROM pk WHERE reason IS NOT NULL GROUP BY ALL) SELECT project, array_to_string(list(n || ' ' || reason ORDER BY reason), ', ') AS text FROM c GROUP BY 1", "mem")
def hx_packet_warn_text(spark, d):
    c = packet(spark, d).filter("reason is not null").groupBy("project", "reason").agg(F.count("*").alias("n"))
    bits = F.array_sort(F.collect_list(F.struct("reason", F.concat_ws(" ", F.col("n").cast("string"), "reason").alias("b"))))
    return c.groupBy("project").agg(F.array_join(F.transform(bits, lambda x: x["b"]), ", ").alias("text"))


@query(f"AND {PACKET} SELECT node_id, round(score, 6) AS score, reason IS NULL AS admitted, coalesce(reason, '') AS reason FROM pk", "mem")
def hx_packet_receipt(spark, d):
    return packet(spark, d).select("node_id", F.round("score", 6).alias("score"), F.col("reason").isNull().alias("admitted"), F.coalesce("reason", F.lit("")).alias("reason"))


MISS = "CASE WHEN place <= 8 THEN '' WHEN reason IS NOT NULL THEN 'warning_filtered:' || reason WHEN edges IS NULL THEN 'no_source_edges' WHEN place > 40 THEN 'candidate_not_retrieved' WHEN edges >= 2 THEN 'chain_not_rendered' ELSE 'rank_or_render_cap_eviction' END"


def misses(spark, d):
    """Why a memory isn't in its project's packet."""
    n = links(spark, d).groupBy(F.col("source_id").alias("node_id")).agg(F.count("*").alias("edges"))
    w = Window.partitionBy("project").orderBy(F.col("reason").isNotNull(), F.desc("score"), "node_id")
    p = packet(spark, d).withColumn("place", F.row_number().over(w)).join(n, "node_id", "left")
    why = (
        F.when(F.col("place") <= 8, "").when(F.col("reason").isNotNull(), F.concat(F.lit("warning_filtered:"), "reason")).when(F.col("edges").isNull(), "no_source_edges")
        .when(F.col("place") > 40, "candidate_not_retrieved").when(F.col("edges") >= 2, "chain_not_rendered").otherwise("rank_or_render_cap_eviction")
    )
    return p.withColumn("why", why)


WHY = f"{PACKET}, n AS (SELECT source_id, count(*) AS edges FROM links GROUP BY 1), ms AS (SELECT *, {MISS} AS why FROM (SELECT pk.*, edges, row_number() OVER (PARTITION BY project ORDER BY reason IS NOT NULL, score DESC, node_id) AS place FROM pk LEFT JOIN n ON source_id = node_id))"


@query(f"AND {WHY} SELECT node_id, why FROM ms", "mem", "links")
def ev_miss_classify(spark, d):
    return misses(spark, d).select("node_id", "why")


@query(f"AND {WHY} SELECT event_type, count(*) AS probes, round(avg(CASE WHEN why = '' THEN 1 ELSE 0 END), 6) AS hit_rate, round(avg(CASE WHEN edges IS NOT NULL THEN 1 ELSE 0 END), 6) AS edge_coverage FROM ms GROUP BY ROLLUP (event_type)", "mem", "links")
def ev_packet(spark, d):
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return misses(spark, d).rollup("event_type").agg(F.count("*").alias("probes"), share(F.col("why") == "").alias("hit_rate"), share(F.col("edges").isNotNull()).alias("edge_coverage"))


@query(f"AND {WHY} SELECT why, count(*) AS n, CASE WHEN why = 'no_source_edges' THEN 'add edges' WHEN why = '' THEN 'none' ELSE 'tune ranking' END AS advice FROM ms GROUP BY 1", "mem", "links")
def ev_packet_diag(spark, d):
    c = misses(spark, d).groupBy("why").agg(F.count("*").alias("n"))
    return c.withColumn("advice", F.when(F.col("why") == "no_source_edges", "add edges").when(F.col("why") == "", "none").otherwise("tune ranking"))


@query("SELECT session_id, substr(array_to_string(list(content ORDER BY created_at, node_id), '; '), 1, 600) AS summary FROM (SELECT * FROM mem WHERE event_type IN ('decision', 'error_pattern', 'task_completion') QUALIFY row_number() OVER (PARTITION BY session_id, event_type ORDER BY created_at, node_id) <= 3) GROUP BY 1", "mem")
def ctx_session_summary(spark, d):
    w = Window.partitionBy("session_id", "event_type").orderBy("created_at", "node_id")
    m = mem(spark, d).filter(F.col("event_type").isin("decision", "error_pattern", "task_completion")).withColumn("n", F.row_number().over(w)).filter("n <= 3")
    rows = F.array_sort(F.collect_list(F.struct("created_at", "node_id", "content")))
    return m.groupBy("session_id").agg(F.substring(F.array_join(F.transform(rows, lambda x: x["content"]), "; "), 1, 600).alias("summary"))


@query("SELECT DISTINCT a.node_id FROM links l JOIN mem a ON a.node_id IN (l.source_id, l.target_id) JOIN mem s ON s.node_id = l.source_id JOIN mem t ON t.node_id = l.target_id WHERE edge_type = 'evolution' AND a.node_id = CASE WHEN (s.priority, s.node_id) < (t.priority, t.node_id) THEN s.node_id ELSE t.node_id END", "mem", "links")
def ctx_contradiction(spark, d):
    """Evolutions stand for contradictions, one packet holds all, and priority is the type's weight."""
    items = mem(spark, d).select(F.lit(1).alias("packet_id"), "node_id", F.col("priority").alias("type_weight"), F.lit(0).alias("score"))
    e = links(spark, d).withColumn("edge_type", F.when(F.col("edge_type") == "evolution", "contradicts").otherwise(F.col("edge_type")))
    return cx.contradiction_warnings(items, e)


@query("SELECT project, array_to_string(list(line ORDER BY created_at DESC, node_id), chr(10)) AS text FROM (SELECT *, strftime(created_at, '%Y-%m-%d') || ' ' || substr(string_split(content, chr(10))[1], 1, 200) AS line FROM mem WHERE event_type = 'decision' QUALIFY row_number() OVER (PARTITION BY project ORDER BY created_at DESC, node_id) <= 4) GROUP BY 1", "mem")
def hx_section_render(spark, d):
    w = Window.partitionBy("project").orderBy(F.desc("created_at"), "node_id")
    m = mem(spark, d).filter("event_type = 'decision'").withColumn("n", F.row_number().over(w)).filter("n <= 4")
    line = F.concat_ws(" ", F.date_format("created_at", "yyyy-MM-dd"), F.substring(F.get(F.split("content", "\n"), 0), 1, 200))
    return m.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


@query("SELECT event_type, CAST(user_id % 2 AS BIGINT) AS surface, count(*) AS calls, count(DISTINCT session_id) AS sessions FROM mem GROUP BY ALL", "mem")
def hx_telemetry(spark, d):
    return mem(spark, d).groupBy("event_type", (F.col("user_id") % 2).alias("surface")).agg(F.count("*").alias("calls"), F.countDistinct("session_id").alias("sessions"))


@query("SELECT session_id, node_id, 1 AS delta FROM mem QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, node_id) <= 10", "mem")
def hx_auto_feedback(spark, d):
    """What a session surfaced last is rated helpful at its end."""
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), "node_id")
    return mem(spark, d).withColumn("n", F.row_number().over(w)).filter("n <= 10").select("session_id", "node_id", F.lit(policy.RATINGS["helpful"]).alias("delta"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'raw' ELSE 'parsed' END AS state, CASE WHEN event_id % 5 = 0 THEN -1 ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS k FROM events")
def hx_store_guard(spark, d):
    """Metadata that is JSON text is parsed; what isn't JSON is kept raw."""
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("not json "), "props")).otherwise(F.col("props"))
    parsed = F.from_json(text, "k long")
    return table(spark, d, "events").select("event_id", F.when(parsed["k"].isNull(), "raw").otherwise("parsed").alias("state"), F.coalesce(parsed["k"], F.lit(-1)).alias("k"))


@query("SELECT node_id, CAST(row_number() OVER (PARTITION BY project ORDER BY created_at, node_id) AS INTEGER) AS number FROM mem WHERE event_type = 'task_completion'", "mem")
def hx_checkpoint(spark, d):
    w = Window.partitionBy("project").orderBy("created_at", "node_id")
    return mem(spark, d).filter("event_type = 'task_completion'").select("node_id", F.row_number().over(w).alias("number"))


@query("SELECT node_id, CASE WHEN feedback_score >= 5 THEN 'verified' WHEN access_count >= 2 THEN 'used' ELSE 'new' END AS badge FROM docs WHERE event_type = 'lesson_learned'", "docs")
def hx_lessons_view(spark, d):
    badge = F.when(F.col("feedback_score") >= 5, "verified").when(F.col("access_count") >= 2, "used").otherwise("new")
    return docs(spark, d).filter("event_type = 'lesson_learned'").select("node_id", badge.alias("badge"))


@query("SELECT conv_id, turn, CAST(ntile(4) OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS phase FROM conversations")
def hx_phase_slices(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.ntile(4).over(w).alias("phase"))


@query("SELECT 'mem' AS name, count(*) AS n FROM mem UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'embeddings', count(*) FROM embeddings", "mem", "links")
def hx_validate(spark, d):
    parts = {"mem": mem(spark, d), "links": links(spark, d), "embeddings": table(spark, d, "embeddings")}
    counts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in parts.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query("SELECT event_type, n, round(n::DOUBLE / sum(n) OVER (), 6) AS share FROM (SELECT event_type, count(*) AS n FROM mem GROUP BY 1)", "mem")
def hx_cli_stats(spark, d):
    c = mem(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("event_type", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row


@query("SELECT project, date_trunc('month', created_at)::TIMESTAMP AS month, count(*) AS n, min(node_id) AS first FROM mem WHERE event_type <> 'session_summary' GROUP BY ALL", "mem")
def hx_rollup_rows(spark, d):
    m = mem(spark, d).filter("event_type <> 'session_summary'")
    return m.groupBy("project", F.date_trunc("month", "created_at").alias("month")).agg(F.count("*").alias("n"), F.min("node_id").alias("first"))


@query("SELECT node_id, query FROM (SELECT 'doc-' || lpad(CAST(item_id * 2 AS VARCHAR), 12, '0') AS node_id, item_id AS query FROM benchmark) ORDER BY query DESC LIMIT 50")
def hx_retrieval_ctx(spark, d):
    """The last fifty retrieved."""
    b = table(spark, d, "benchmark").select(F.concat(F.lit("doc-"), F.lpad((F.col("item_id") * 2).cast("string"), 12, "0")).alias("node_id"), F.col("item_id").alias("query"))
    return b.orderBy(F.desc("query")).limit(50)


@query("SELECT files, budget FROM (SELECT CAST(least(8, n) AS BIGINT) AS files, greatest(120, least(4000, CASE WHEN n = 0 THEN 800 ELSE n * 100 END)) AS budget FROM (SELECT DISTINCT turn AS n FROM conversations))")
def hx_ctx_params(spark, d):
    n = F.col("n")
    t = table(spark, d, "conversations").select(F.col("turn").alias("n")).distinct()
    return t.select(F.least(F.lit(8), n).cast("long").alias("files"), F.greatest(F.lit(120), F.least(F.lit(4000), F.when(n == 0, 800).otherwise(n * 100))).alias("budget"))


# Evaluation by keywords, by type, and by rank.
@query("AND k AS (SELECT item_id, list_slice(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{6,}'))), 1, 3) AS ks FROM benchmark), r AS (SELECT item_id, node_id, len(list_filter(ks, lambda x: contains(lower(content), x))) > 0 AS rel FROM k JOIN docs ON doc_id % 20 = 0) SELECT item_id, round(avg(CASE WHEN rel THEN 1 ELSE 0 END), 6) AS precision, bool_or(rel) AS hit FROM r GROUP BY 1", "docs")
def ev_keyword_relevance(spark, d):
    """Whether each query's memories (here those of ids divisible by 20) have one of its keywords."""
    k = table(spark, d, "benchmark").select("item_id", F.slice(F.array_sort(tx.word_set("text", 6)), 1, 3).alias("ks"), F.lit(1).alias("one"))
    j = docs(spark, d).filter("doc_id % 20 = 0").select(F.lower("content").alias("c"), F.lit(1).alias("one")).join(F.broadcast(k), "one")  # a benchmark's items
    rel = j.select("item_id", F.exists("ks", lambda x: F.col("c").contains(x)).alias("rel"))
    return rel.groupBy("item_id").agg(F.round(F.avg(F.col("rel").cast("int")), 6).alias("precision"), F.bool_or("rel").alias("hit"))


@query("AND t AS (SELECT lang, quality, toxic FROM labels JOIN documents USING (doc_id)), p AS (SELECT lang, avg(quality) AS acc, avg(CASE WHEN toxic = 1 THEN quality END) AS abst FROM t GROUP BY 1) SELECT lang, round(acc, 6) AS accuracy, round((SELECT avg(acc) FROM p), 6) AS macro FROM p", "docs")
def ev_qa_accuracy(spark, d):
    """Accuracy of each type and the mean over types; label quality stands for correctness."""
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    p = t.groupBy("lang").agg(F.avg("quality").alias("acc"))
    return p.crossJoin(F.broadcast(p.agg(F.avg("acc").alias("macro")))).select("lang", F.round("acc", 6).alias("accuracy"), F.round("macro", 6).alias("macro"))  # one row


# Streams.
@query("SELECT count(*) AS n, count(DISTINCT 'mem-' || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS ids FROM events")
def st_ingest(spark, d):
    return finished(stream(spark, d), "st_ingest").agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("ids"))


@query("SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, least(count(*), 2) AS kept FROM events WHERE event_type = 'error' GROUP BY ALL")
def st_error_cap(spark, d):
    return finished(streams.capped(stream(spark, d).filter("event_type = 'error_pattern'"), "user_id", 2), "st_error_cap", "complete")


@query("AND e AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS start, count(*) FILTER (event_type = 'error') AS errors FROM s GROUP BY user_id, s HAVING count(*) FILTER (event_type = 'error') >= 2", "docs")
def st_burst(spark, d):
    return finished(streams.bursts(stream(spark, d), 2), "st_burst", "complete").select("user_id", "start", "errors")


@query("SELECT count(*) AS n FROM events WHERE event_type <> 'view' OR ts + INTERVAL 10 DAY > TIMESTAMP '2024-02-01 00:00:00'")
def st_ttl(spark, d):
    s = stream(spark, d).withColumn("ttl_seconds", F.when(F.col("event_type") == "view", 864_000))
    return finished(streams.expiring(s, as_of()), "st_ttl").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('month', ts)::TIMESTAMP AS month, CASE event_type WHEN 'error' THEN 'error_pattern' ELSE event_type END AS event_type, count(*) AS n FROM events GROUP BY ALL")
def st_monthly_rollup(spark, d):
    return finished(streams.months(stream(spark, d)), "st_monthly_rollup", "complete")


@query("SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 12 DAY")
def st_retention(spark, d):
    kept = lc.retained(stream(spark, d), "created_at", as_of(), 12)
    return finished(kept, "st_retention").agg(F.count("*").alias("n"))


JOB_ROWS = ", ".join(f"({i}, '{name}', {days}, {str(idle).lower()})" for i, (name, days, idle) in enumerate(lc.JOBS))
TICKS = "TIMESTAMP '2024-01-31 00:00:00'", "TIMESTAMP '2024-02-01 00:00:00'"


@query(f"""AND jobs AS (SELECT * FROM (VALUES {JOB_ROWS}) j(place, name, days, needs_idle)),
runs AS (SELECT event_no % 9 AS place, created_at FROM (SELECT CAST(regexp_extract(node_id, '[0-9]+') AS BIGINT) AS event_no, created_at FROM mem)
  WHERE event_no % 9 <> 5 AND created_at < TIMESTAMP '2024-01-22 00:00:00' + (event_no % 9) * INTERVAL 1 DAY),
a AS (SELECT j.*, last_run, NOT needs_idle AND coalesce(last_run <= {TICKS[0]} - days * INTERVAL 1 DAY, true) AS due
  FROM jobs j LEFT JOIN (SELECT place, max(created_at) AS last_run FROM runs GROUP BY 1) USING (place)),
b AS (SELECT place, name, days, CASE WHEN due THEN {TICKS[0]} ELSE last_run END AS last_run FROM a)
SELECT 1 AS tick, place, name, strftime(last_run, '%Y-%m-%d') AS last_run FROM a WHERE due
UNION ALL SELECT 2, place, name, strftime(last_run, '%Y-%m-%d') FROM b WHERE coalesce(last_run <= {TICKS[1]} - days * INTERVAL 1 DAY, true)""", "mem")
def lc_scheduler(spark, d):
    """Jobs due at two ticks a day apart, the first without idleness; what the first ran is marked before the second.
    Earlier runs are made from memories."""
    names = F.array(*(F.lit(name) for name, _, _ in lc.JOBS))
    m = mem(spark, d).withColumn("place", (F.regexp_extract("node_id", "[0-9]+", 0).cast("long") % 9).cast("int"))
    m = m.filter(F.col("place").isin(0, 1, 2, 3, 4, 6, 7) & (F.col("created_at") < as_of("2024-01-22 00:00:00") + F.make_dt_interval("place")))
    runs = m.select(F.get(names, "place").alias("name"), F.col("created_at").alias("ran_at"))
    ticks = [as_of("2024-01-31 00:00:00"), as_of("2024-02-01 00:00:00")]
    first = lc.due_jobs(runs, ticks[0], idle=False)
    second = lc.due_jobs(lc.mark_run(runs, first, ticks[0]), ticks[1])
    out = first.withColumn("tick", F.lit(1)).unionByName(second.withColumn("tick", F.lit(2)))
    return out.withColumn("last_run", F.date_format("last_run", "yyyy-MM-dd")).select("tick", "place", "name", "last_run")
