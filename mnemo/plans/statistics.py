"""Queries over statistics, lifecycle jobs, evaluation metrics and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemo import policy
from mnemo.operators import aggregates as ag
from mnemo.operators import context as cx
from mnemo.operators import evaluation as ev
from mnemo.operators import lifecycle as lc
from mnemo.plans.basics import ACTIVE, AGE, DECAY, EXPIRED, FEEDBACK, NOW, WEIGHT
from mnemo.plans.registry import query
from mnemo.schema import age_days, as_of, docs, links, mem, table
from mnemo.sources import io
from mnemo.streaming import streams

DAY = 86_400_000_000


@query("SELECT event_type, count(*) AS n FROM mem GROUP BY 1", "mem")
def agg_type_stats(spark, d):
    return ag.counts_by(mem(spark, d), "event_type")


@query("SELECT session_id, count(*) AS n FROM mem GROUP BY 1", "mem")
def agg_session_stats(spark, d):
    return ag.counts_by(mem(spark, d), "session_id")


@query("SELECT session_id, event_type, count(*) AS n FROM mem GROUP BY ALL", "mem")
def agg_session_event_counts(spark, d):
    return ag.counts_by(mem(spark, d), "session_id", "event_type")


@query("SELECT count(*) AS memories, CAST(sum(access_count) AS BIGINT) AS accesses, min(created_at) AS oldest, count(DISTINCT session_id) AS sessions, (SELECT count(*) FROM links) AS edges FROM mem", "mem", "links")
def agg_stats_card(spark, d):
    return ag.stats_card(mem(spark, d), links(spark, d))


@query("SELECT count(*) FILTER (created_at >= TIMESTAMP '2024-01-20') AS current, count(*) FILTER (created_at < TIMESTAMP '2024-01-20') AS previous, count(DISTINCT session_id) FILTER (created_at >= TIMESTAMP '2024-01-20') AS sessions, count(DISTINCT event_type) FILTER (created_at >= TIMESTAMP '2024-01-20') AS types FROM mem WHERE created_at >= TIMESTAMP '2024-01-10'", "mem")
def agg_period_stats(spark, d):
    return ag.period_stats(mem(spark, d), as_of("2024-01-20 00:00:00"), as_of("2024-01-10 00:00:00"))


@query(f"SELECT CAST(floor(min({AGE})) AS BIGINT) AS newest_days, CAST(floor(max({AGE})) AS BIGINT) AS oldest_days FROM mem WHERE last_accessed >= TIMESTAMP '2024-01-15'", "mem")
def agg_oldest_accessed(spark, d):
    age = age_days("created_at", as_of())
    return mem(spark, d).filter(F.col("last_accessed") >= as_of("2024-01-15 00:00:00")).agg(F.floor(F.min(age)).alias("newest_days"), F.floor(F.max(age)).alias("oldest_days"))


@query("SELECT event_type, count(*) AS n, round(avg(access_count), 6) AS avg_access, count(*) FILTER (access_count = 0) AS never, round(count(*) FILTER (access_count = 0)::DOUBLE / count(*), 6) AS never_share, round(avg(retrieval_count), 6) AS avg_retrieval, count(*) FILTER (retrieval_count = 0) AS never_retrieved FROM mem GROUP BY ROLLUP (event_type)", "mem")
def agg_access_rate(spark, d):
    r = ag.access_rate(mem(spark, d))
    return r.withColumns({c: F.round(c, 6) for c in ("avg_access", "never_share", "avg_retrieval")})


@query("SELECT CASE WHEN access_count = 0 THEN '0' WHEN access_count <= 2 THEN '1-2' WHEN access_count <= 9 THEN '3-9' ELSE '10+' END AS bucket, count(*) AS n FROM mem GROUP BY 1", "mem")
def prj_case_bucket(spark, d):
    return ag.access_buckets(mem(spark, d))


@query(f"SELECT *, CASE WHEN dead_share > 0.5 THEN 'stale' WHEN recent = 0 THEN 'idle' ELSE 'healthy' END AS verdict FROM (SELECT count(*) AS total, count(*) FILTER ({AGE} <= 7) AS recent, count(*) FILTER (access_count = 0 AND {AGE} > 7) AS dead, round(count(*) FILTER (access_count = 0 AND {AGE} > 7)::DOUBLE / count(*), 6) AS dead_share FROM mem)", "mem")
def agg_diagnostic(spark, d):
    return ag.diagnostic(mem(spark, d), as_of()).withColumn("dead_share", F.round("dead_share", 6))


@query(f"SELECT count(*) FILTER ({AGE} <= 7) AS new, count(*) FILTER ({AGE} > 7 AND {AGE} <= 14) AS previous, round((count(*) FILTER ({AGE} <= 7) - count(*) FILTER ({AGE} > 7 AND {AGE} <= 14)) * 100.0::DOUBLE / count(*) FILTER ({AGE} > 7 AND {AGE} <= 14), 6) AS growth_pct FROM mem", "mem")
def agg_weekly_digest(spark, d):
    return ag.weekly_digest(mem(spark, d), as_of()).withColumn("growth_pct", F.round("growth_pct", 6))


@query("SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z_]{4,}')) AS term FROM documents) WHERE term NOT IN ('that', 'with') GROUP BY 1 ORDER BY n DESC, term LIMIT 8")
def agg_topic_terms(spark, d):
    return ag.topic_terms(table(spark, d, "documents").select(F.col("text").alias("content")), ["that", "with"])


@query("SELECT node_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, CAST(r AS INTEGER) AS rank FROM (SELECT node_id, created_at, row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY created_at DESC, node_id) AS r FROM mem) WHERE r <= 10", "mem")
def agg_timeline(spark, d):
    return ag.timeline(mem(spark, d), 10).select("node_id", F.col("day").cast("string").alias("day"), "rank")


@query("AND dd AS (SELECT DISTINCT user_id, CAST(created_at AS DATE) AS day FROM mem WHERE event_type = 'decision'), r AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM dd) SELECT user_id, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS length FROM r GROUP BY user_id, run", "mem")
def agg_streak(spark, d):
    return ag.streaks(mem(spark, d).filter("event_type = 'decision'"), "user_id").withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("SELECT count(*) AS n, CAST(list_max(list_filter([1, 10, 50, 100, 500, 1000, 1500, 2000], lambda t: t <= count(*))) AS INTEGER) AS milestone FROM mem", "mem")
def agg_milestones(spark, d):
    return ag.milestones(mem(spark, d), policy.MILESTONES)


@query("SELECT session_id, round(max(value / 100) + 0.1 * avg(value / 100), 6)::DOUBLE AS score, count(*) AS hits FROM mem GROUP BY 1 ORDER BY max(value / 100) + 0.1 * avg(value / 100) DESC, session_id LIMIT 20", "mem")
def agg_session_score(spark, d):
    hits = mem(spark, d).select("session_id", (F.col("value") / 100).alias("relevance"))
    return ag.session_score(hits, 20).withColumn("score", F.round("score", 6))


@query(f"SELECT project, strftime(created_at, '%Y-%m') AS month, count(*) AS n, min(created_at) AS first_at FROM mem WHERE {AGE} >= 10 AND event_type IN ('task_completion', 'session_summary') GROUP BY 1, 2 HAVING count(*) >= 3", "mem")
def agg_rollup_windows(spark, d):
    return ag.rollup_windows(mem(spark, d), as_of(), 10)


@query("SELECT project, count(*) AS records, md5(string_agg(line, chr(10) ORDER BY created_at, node_id)) AS digest FROM (SELECT project, created_at, node_id, line, sum(length(line) + 1) OVER (PARTITION BY project ORDER BY created_at, node_id ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT project, created_at, node_id, strftime(created_at, '%Y-%m-%d') || ' ' || event_type || ': ' || substr(content, 1, 400) AS line FROM mem)) WHERE used <= 14000 GROUP BY 1", "mem")
def agg_rollup_text(spark, d):
    return lc.rollup_text(mem(spark, d), "project").select("project", "records", F.md5("text").alias("digest"))


@query("SELECT substr(text, 1, 80) AS prefix, count(*) AS n, arg_max('d' || lpad(CAST(doc_id AS VARCHAR), 9, '0'), (n_chars, doc_id)) AS keeper FROM documents GROUP BY 1 HAVING count(*) >= 2")
def agg_dedup_prefix(spark, d):
    t = table(spark, d, "documents").select(F.col("text").alias("content"), F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("node_id"), F.col("n_chars").alias("access_count"))
    return ag.dedup_prefix(t, 80, 2)


@query("SELECT lower(substr(content, 1, 80)) AS lesson, count(DISTINCT session_id) AS verified, CAST(sum(access_count) AS BIGINT) AS accesses, count(*) AS n FROM mem WHERE event_type = 'error_pattern' GROUP BY 1", "mem")
def agg_lessons_verified(spark, d):
    return ag.verified(mem(spark, d).filter("event_type = 'error_pattern'"), "session_id")


@query("SELECT lower(substr(content, 1, 80)) AS lesson, count(DISTINCT project) AS verified, CAST(sum(access_count) AS BIGINT) AS accesses, count(*) AS n FROM mem GROUP BY 1", "mem")
def agg_cross_project(spark, d):
    return ag.verified(mem(spark, d), "project")


PRICES = {"click": (3.0, 15.0), "view": (0.5, 2.0)}


@query("SELECT event_type AS model, CAST(user_id % 5 AS VARCHAR) AS grp, count(*) AS calls, CAST(sum(CAST(value AS BIGINT)) AS BIGINT) AS tokens_in, CAST(sum(CAST(value AS BIGINT) * 2) AS BIGINT) AS tokens_out, round(sum(round((CAST(value AS BIGINT) * CASE event_type WHEN 'click' THEN 3.0 WHEN 'view' THEN 0.5 ELSE 0 END + 2 * CAST(value AS BIGINT) * CASE event_type WHEN 'click' THEN 15.0 WHEN 'view' THEN 2.0 ELSE 0 END)::DOUBLE / 1e6, 6)), 4) AS cost FROM (SELECT event_type, user_id, floor(value) AS value FROM events) GROUP BY ROLLUP (event_type, grp)")
def agg_usage(spark, d):
    v = F.floor("value").cast("long")
    log = table(spark, d, "events").select(F.col("event_type").alias("model"), (F.col("user_id") % 5).cast("string").alias("grp"), v.alias("tokens_in"), (v * 2).alias("tokens_out"))
    log = log.withColumn("cost", io.estimate_cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out"), PRICES))
    return ag.usage(log, "model", "grp").withColumn("cost", F.round("cost", 4))


@query("SELECT event_type AS tool, count(*) AS calls FROM events GROUP BY 1 ORDER BY calls DESC, tool LIMIT 3")
def agg_top_tools(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "tool").limit(3)


@query(f"SELECT event_type AS tool, count(*) FILTER ({AGE} BETWEEN 0 AND 7) AS this_week, count(*) FILTER ({AGE} > 7 AND {AGE} <= 14) AS last_week FROM mem GROUP BY 1", "mem")
def agg_tool_utilization(spark, d):
    return ag.utilization(mem(spark, d).select(F.col("event_type").alias("tool"), F.col("created_at").alias("at")), as_of())


@query("SELECT edge_type, count(*) AS n, round(avg(weight), 6) AS avg_weight, count(DISTINCT source_id) AS sources FROM links GROUP BY 1", "mem", "links")
def agg_graph_stats(spark, d):
    return ag.graph_stats(links(spark, d)).withColumn("avg_weight", F.round("avg_weight", 6))


@query("AND r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY created_at DESC, node_id DESC) AS r FROM mem), l AS (SELECT event_type, list_sort(list(value)) AS v, avg(value) AS mean, count(*) AS n FROM r WHERE r <= 100 GROUP BY 1) SELECT event_type, n, round(mean, 6) AS mean, v[least(CAST(floor(n * 0.5) AS INT) + 1, n)] AS median, v[least(CAST(floor(n * 0.95) AS INT) + 1, n)] AS p95, v[least(CAST(floor(n * 0.99) AS INT) + 1, n)] AS p99 FROM l", "mem")
def agg_latency_pct(spark, d):
    log = mem(spark, d).select("event_type", F.col("created_at").alias("at"), F.col("value").alias("ms"), F.col("node_id").alias("id"))
    return ag.latency(log, "event_type").withColumn("mean", F.round("mean", 6))


@query("SELECT round(avg(feedback_score), 6) AS mean, count(*) FILTER (feedback_score <= -3) AS flagged FROM mem", "mem")
def agg_feedback_quality(spark, d):
    return mem(spark, d).agg(F.round(F.avg("feedback_score"), 6).alias("mean"), F.count_if(F.col("feedback_score") <= policy.FLAGGED_AT).alias("flagged"))


@query("AND r AS (SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS run_at, avg(value) AS value FROM mem GROUP BY 1) SELECT round(latest, 6) AS latest, run_at, round(median, 6) AS median, latest < 0.9 * median AS alert FROM (SELECT arg_max(value, run_at) AS latest, max(run_at) AS run_at, (SELECT quantile_cont(value, 0.5) FROM r WHERE run_at < (SELECT max(run_at) FROM r)) AS median FROM r)", "mem")
def agg_mrr_trend(spark, d):
    runs = mem(spark, d).groupBy(F.to_date("created_at").cast("string").alias("at")).agg(F.avg("value").alias("value"))
    return ag.trend_alert(runs).withColumnRenamed("at", "run_at").withColumns({"latest": F.round("latest", 6), "median": F.round("median", 6)})


@query("SELECT trim(c) AS category, count(*) AS n FROM (SELECT unnest(string_split(lang || ', ' || source, ',')) AS c FROM documents) GROUP BY 1")
def agg_categories(spark, d):
    return ag.categories(table(spark, d, "documents").select(F.concat_ws(", ", "lang", "source").alias("c0")), "c0")


@query("SELECT DISTINCT split_part(substr(url, 9), '/', 1) AS child FROM pages WHERE starts_with(url, 'https://') AND split_part(substr(url, 9), '/', 1) <> ''")
def agg_scopes(spark, d):
    return ag.child_scopes(table(spark, d, "pages"), "url", "https://")


@query("SELECT project, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at FROM mem WHERE project LIKE 'p1%' GROUP BY 1", "mem")
def agg_scope_info(spark, d):
    return mem(spark, d).filter(F.col("project").startswith("p1")).groupBy("project").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query("SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN never_share > 0.8 THEN 'unused' WHEN flagged > 0 THEN 'flagged' ELSE 'none' END AS warning FROM (SELECT count(*) AS n, count(*) FILTER (access_count = 0) AS never, round(count(*) FILTER (access_count = 0)::DOUBLE / count(*), 6) AS never_share, count(*) FILTER (feedback_score <= -3) AS flagged FROM mem)", "mem")
def agg_memory_health(spark, d):
    return ag.health(mem(spark, d)).withColumn("never_share", F.round("never_share", 6))


@query("SELECT least(a.event_type, b.event_type) || '/' || greatest(a.event_type, b.event_type) AS pair, count(*) AS n FROM links JOIN mem a ON a.node_id = source_id JOIN mem b ON b.node_id = target_id WHERE a.event_type <> b.event_type GROUP BY 1 HAVING count(*) >= 3", "mem", "links")
def agg_type_pairs(spark, d):
    return ag.type_pairs(links(spark, d), mem(spark, d))


@query("SELECT round(regr_slope(accuracy, phase), 6) AS slope, count(*) AS phases, round(avg(accuracy), 6) AS mean_accuracy FROM (SELECT user_id % 10 AS phase, avg(CASE WHEN access_count > 0 THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM mem GROUP BY 1)", "mem")
def agg_memorystress(spark, d):
    rows = mem(spark, d).select((F.col("user_id") % 10).alias("phase"), (F.col("access_count") > 0).cast("int").alias("correct"))
    return ev.phase_slope(rows).withColumns({"slope": F.round("slope", 6), "mean_accuracy": F.round("mean_accuracy", 6)})


@query("SELECT count(*) AS nodes, max(created_at) AS last_capture FROM mem", "mem")
def hx_node_count(spark, d):
    return mem(spark, d).agg(F.count("*").alias("nodes"), F.max("created_at").alias("last_capture"))


@query("SELECT event_type AS phase, count(*) AS n, round(avg(value), 6) AS mean, round(100.0 * sum(value) / sum(sum(value)) OVER (), 4) AS share FROM mem GROUP BY 1", "mem")
def hx_latency_breakdown(spark, d):
    m = mem(spark, d)
    total = m.agg(F.sum("value").alias("t"))
    g = m.groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("n"), F.avg("value").alias("a"), F.sum("value").alias("s")).crossJoin(F.broadcast(total))  # one row
    return g.select("phase", "n", F.round("a", 6).alias("mean"), F.round(100 * F.col("s") / F.col("t"), 4).alias("share"))


@query("SELECT 'labels' AS reference, l.doc_id AS id FROM labels l LEFT JOIN documents d USING (doc_id) WHERE d.doc_id IS NULL UNION ALL SELECT 'lineitem', l_orderkey FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey AND o.o_orderkey % 97 <> 0 WHERE o.o_orderkey IS NULL")
def hx_ref_integrity(spark, d):
    a = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_anti").select(F.lit("labels").alias("reference"), F.col("doc_id").alias("id"))
    o = table(spark, d, "orders").filter("o_orderkey % 97 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return a.union(table(spark, d, "lineitem").join(o, "l_orderkey", "left_anti").select(F.lit("lineitem"), "l_orderkey"))


# Lifecycle.
@query(f"SELECT node_id, substr(content, 1, 200) AS content_preview, event_type, 'ttl_expired' AS reason, {NOW} AS deleted_at FROM mem WHERE {EXPIRED}", "mem")
def lc_ttl_cleanup(spark, d):
    return lc.cleanup_expired(mem(spark, d), as_of())[1]


@query("SELECT node_id FROM mem WHERE node_id NOT IN (SELECT node_id FROM mem ORDER BY coalesce(last_accessed, created_at), node_id LIMIT 100)", "mem")
def lc_lru_evict(spark, d):
    return lc.evict(mem(spark, d), 100).select("node_id")


@query("SELECT node_id FROM mem ORDER BY coalesce(last_accessed, created_at), node_id LIMIT 100", "mem")
def lim_lru(spark, d):
    return lc.least_recent(mem(spark, d), 100).select("node_id")


@query("SELECT node_id FROM (SELECT node_id, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, node_id) AS n FROM mem WHERE event_type = 'session_summary') WHERE n > 50", "mem")
def lim_summary_cap(spark, d):
    return lc.summary_overflow(mem(spark, d), 50, "project").select("node_id")


PROTECTED = ", ".join(f"'{t}'" for t in policy.PROTECTED)


@query(f"""AND p AS (SELECT node_id FROM mem WHERE access_count = 0 AND {AGE} > 10 AND event_type NOT IN ({PROTECTED})),
c AS (SELECT node_id FROM (SELECT node_id, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, node_id) AS n FROM mem WHERE event_type = 'session_summary' AND node_id NOT IN (SELECT node_id FROM p)) WHERE n > 50),
g AS (SELECT node_id FROM p UNION ALL SELECT node_id FROM c)
SELECT (SELECT count(*) FROM p) AS pruned, (SELECT count(*) FROM c) AS capped, (SELECT count(*) FROM (SELECT DISTINCT source_id, target_id, edge_type FROM links WHERE source_id IN (SELECT node_id FROM g) OR target_id IN (SELECT node_id FROM g))) AS edges_removed""", "mem", "links")
def lc_consolidate(spark, d):
    return lc.consolidate(mem(spark, d), links(spark, d), as_of(), 10)


@query(f"SELECT node_id, round({WEIGHT} * {FEEDBACK} * {DECAY.format(last='last_accessed')}, 6) AS strength FROM mem WHERE {AGE} >= 3 AND (access_count = 0 OR feedback_score <= -3) AND event_type NOT IN ({PROTECTED}) AND {WEIGHT} * {FEEDBACK} * {DECAY.format(last='last_accessed')} < 0.5", "mem")
def lc_strength_decay(spark, d):
    return lc.weak(mem(spark, d), as_of(), 0.5, 3).select("node_id", F.round("strength", 6).alias("strength"))


@query("SELECT m.node_id, CAST(m.feedback_score + coalesce(r.s, 0) AS BIGINT) AS feedback_score, m.feedback_score + coalesce(r.s, 0) <= -3 AS flagged FROM mem m LEFT JOIN (SELECT node_id, sum(CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE -2 END) AS s FROM mem WHERE k % 2 = 0 GROUP BY 1) r USING (node_id)", "mem")
def lc_feedback(spark, d):
    m = mem(spark, d)
    rating = F.when(F.col("k") % 3 == 0, "helpful").when(F.col("k") % 3 == 1, "unhelpful").otherwise("outdated")
    out = lc.feedback(m, m.filter("k % 2 = 0").select("node_id", rating.alias("rating")))
    return out.select("node_id", F.col("feedback_score").cast("long").alias("feedback_score"), "flagged")


@query("AND s AS (SELECT 'mem-' || lpad(CAST(l_orderkey % 1000 AS VARCHAR), 12, '0') AS node_id, count(*) FILTER (l_returnflag = 'R') AS good, count(*) FILTER (l_returnflag = 'A') AS bad FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) SELECT node_id, CAST(CASE WHEN good >= 2 THEN least(5, priority + 1) WHEN bad >= 3 AND good = 0 THEN greatest(1, priority - 1) ELSE priority END AS INTEGER) AS priority FROM mem LEFT JOIN s USING (node_id)", "mem")
def lc_graduate(spark, d):
    signal = F.when(F.col("l_returnflag") == "R", "diff_correlated").when(F.col("l_returnflag") == "A", "not_committed")
    node = F.concat(F.lit("mem-"), F.lpad((F.col("l_orderkey") % 1000).cast("string"), 12, "0"))
    signals = table(spark, d, "lineitem").filter("l_linenumber = 1").select(node.alias("node_id"), signal.alias("signal"))
    return lc.graduate(mem(spark, d), signals).select("node_id", "priority")


@query(f"SELECT node_id, created_at + INTERVAL '1' DAY * k AS remind_at, created_at + INTERVAL '1' DAY * k <= {NOW} AS overdue FROM mem WHERE k % 5 = 1 AND event_type = 'decision'", "mem")
def lc_reminders(spark, d):
    m = mem(spark, d).filter("event_type = 'decision'").withColumn("remind_at", F.expr("created_at + INTERVAL '1' DAY * k"))
    m = m.withColumn("reminder_status", F.when(F.col("k") % 5 == 1, "pending").otherwise("dismissed"))
    return lc.due_reminders(m, as_of()).select("node_id", "remind_at", "overdue")


@query(f"SELECT event_id FROM events WHERE (epoch_us({NOW}) - epoch_us(ts)) / 86400e6 <= 12")
def lc_prune_logs(spark, d):
    log = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return lc.retained(log, "at", as_of(), 12).select("event_id")


@query("SELECT event_type, reason, count(*) AS n FROM (SELECT DISTINCT content AS node_id, event_type, CASE WHEN k % 2 = 0 THEN 'lru_evicted' ELSE 'user_deleted' END AS reason FROM mem) GROUP BY ALL", "mem")
def lc_forgetting_view(spark, d):
    m = mem(spark, d).withColumn("node_id", F.col("content"))
    empty = lc.forgetting(m.limit(0), "x", as_of())
    log = lc.append_log(empty, lc.forgetting(m.filter("k % 2 = 0"), "lru_evicted", as_of()).union(lc.forgetting(m.filter("k % 2 <> 0"), "user_deleted", as_of())))
    return log.groupBy("event_type", "reason").agg(F.count("*").alias("n"))


@query("SELECT project, count(*) AS records FROM (SELECT project, sum(length(line) + 1) OVER (PARTITION BY project ORDER BY created_at, node_id ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT project, created_at, node_id, strftime(created_at, '%Y-%m-%d') || ' ' || event_type || ': ' || substr(content, 1, 400) AS line FROM mem)) WHERE used <= 14000 GROUP BY 1", "mem")
def lc_rollup(spark, d):
    """Roll-ups by an injected summariser: here the text's beginning."""
    return lc.roll_up(mem(spark, d), lambda t: F.substring(t, 1, 80), "project").select("project", "records")


# Context.
@query(f"SELECT node_id, reason FROM (SELECT node_id, CASE WHEN trim(content) = '' THEN 'empty' WHEN status = 'superseded' THEN 'superseded' WHEN feedback_score <= -3 THEN 'flagged' WHEN coalesce(project, '') NOT IN ('', 'p3') THEN 'project' WHEN {AGE} > 20 THEN 'stale' END AS reason FROM mem) WHERE reason IS NOT NULL", "mem")
def ctx_admission(spark, d):
    return mem(spark, d).select("node_id", cx.admission(as_of(), project="p3", stale_days=20).alias("reason")).filter("reason is not null")


@query("SELECT target_id, round(1.0::DOUBLE * (CASE b.event_type WHEN 'decision' THEN 2.4 WHEN 'error_pattern' THEN 2.1 WHEN 'user_preference' THEN 1.6 ELSE 1 END) * 0.55 * greatest(0.2, least(weight, 1.0)) * (CASE edge_type WHEN 'evolution' THEN 1.12 ELSE 1.03 END), 4) AS score FROM links JOIN mem b ON b.node_id = target_id", "mem", "links")
def ctx_item_score(spark, d):
    j = links(spark, d).drop("created_at").join(mem(spark, d).select(F.col("node_id").alias("target_id"), "event_type"), "target_id")
    return j.select("target_id", F.round(cx.item_score(F.lit(1.0), "event_type", F.lit(1), F.col("weight"), "edge_type"), 4).alias("score"))


@query("SELECT node_id, CAST(place AS INTEGER) AS place, CAST(used AS BIGINT) AS used FROM (SELECT node_id, row_number() OVER w AS place, sum(length(content) // 4) OVER w AS used FROM mem WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, node_id ROWS UNBOUNDED PRECEDING)) WHERE used <= 100", "mem")
def ctx_packet_budget(spark, d):
    return cx.budgeted(mem(spark, d), 100, "user_id", score="value").select("node_id", "place", "used")


@query("SELECT * FROM (SELECT project, event_type, node_id, CAST(row_number() OVER (PARTITION BY project, event_type ORDER BY created_at DESC, node_id) AS INTEGER) AS place FROM mem) WHERE place <= 5", "mem")
def ctx_sections(spark, d):
    return cx.sections(mem(spark, d), 5, "project").select("project", "event_type", "node_id", "place")


@query(f"SELECT node_id, project, round(blend, 6) AS blend FROM (SELECT node_id, project, 0.45::DOUBLE * priority + 1.75::DOUBLE / (1 + {AGE} * 24 / 72) + 0.20::DOUBLE * least(log2(1 + access_count), 5.0) AS blend, row_number() OVER (PARTITION BY project, event_type ORDER BY created_at DESC, node_id) AS p FROM mem) WHERE p <= 8", "mem")
def ctx_welcome(spark, d):
    return cx.welcome(mem(spark, d), as_of(), 8, "project").select("node_id", "project", F.round("blend", 6).alias("blend"))


@query(f"AND v AS (SELECT count(*) FILTER ((epoch_us(TIMESTAMP '2024-01-20') - epoch_us(created_at)) BETWEEN 0 AND {DAY}) AS n FROM mem), s AS (SELECT CASE WHEN n >= 20 THEN 12 WHEN n >= 5 THEN 24 ELSE 72 END AS h FROM v) SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN a <= h THEN 'fresh' WHEN a <= 2 * h THEN 'recent' ELSE 'stale' END AS bucket FROM (SELECT (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(created_at)) / 3600e6 AS a, h FROM mem, s)) GROUP BY 1", "mem")
def ctx_session(spark, d):
    return cx.velocity(mem(spark, d), as_of("2024-01-20 00:00:00")).groupBy("bucket").agg(F.count("*").alias("n"))


# Evaluation: a label's vectors ranked by their first component, judged by the sign of the second.
RESULTS = """AND r AS (SELECT label AS probe_id, vec_id AS doc_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 20),
q AS (SELECT label AS probe_id, vec_id AS doc_id, CASE WHEN embedding[2] > 0.15 THEN 3 WHEN embedding[2] > 0.05 THEN 2 WHEN embedding[2] > 0 THEN 1 ELSE 0 END AS grade FROM embeddings WHERE vec_id % 3 <> 0),
j AS (SELECT r.*, coalesce(grade, 0) AS grade, q.doc_id IS NOT NULL AS judged FROM r LEFT JOIN q USING (probe_id, doc_id))"""


def results(spark, d):
    w = Window.partitionBy("label").orderBy(F.desc(F.col("embedding")[0]), "vec_id")
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").alias("probe_id"), F.col("vec_id").alias("doc_id"), F.row_number().over(w).alias("rank")).filter("rank <= 20")


def qrels(spark, d):
    x = F.col("embedding")[1].cast("float")
    grade = F.when(x > F.lit(0.15).cast("float"), 3).when(x > F.lit(0.05).cast("float"), 2).when(x > 0, 1).otherwise(0)
    return table(spark, d, "embeddings").filter("vec_id % 3 <> 0").select(F.col("label").alias("probe_id"), F.col("vec_id").alias("doc_id"), grade.alias("grade"))


@query(RESULTS + ", m AS (SELECT probe_id, coalesce(1.0::DOUBLE / min(rank) FILTER (grade >= 2), 0) AS rr, CAST(max(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) AS INTEGER) AS hit, count(*) FILTER (grade >= 2) / 10.0::DOUBLE AS precision, avg(CASE WHEN judged THEN 1.0::DOUBLE ELSE 0 END) AS coverage FROM j WHERE rank <= 10 GROUP BY 1) SELECT probe_id, round(rr, 6) AS rr, hit, round(precision, 6) AS precision, round(coverage, 6) AS coverage FROM m", "mem")
def ev_mrr(spark, d):
    m = ev.per_probe(results(spark, d), qrels(spark, d), 10)
    return m.withColumns({c: F.round(c, 6) for c in ("rr", "precision", "coverage")})


@query(RESULTS + ", g AS (SELECT probe_id, sum(grade / log2(rank + 1)) AS dcg FROM j WHERE rank <= 10 GROUP BY 1), i AS (SELECT probe_id, sum(grade / log2(p + 1)) AS ideal FROM (SELECT probe_id, grade, row_number() OVER (PARTITION BY probe_id ORDER BY grade DESC, doc_id) AS p FROM q) WHERE p <= 10 GROUP BY 1) SELECT probe_id, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 6) AS ndcg FROM i LEFT JOIN g USING (probe_id)", "mem")
def ev_ndcg_qrels(spark, d):
    return ev.ndcg(results(spark, d), qrels(spark, d), 10).withColumn("ndcg", F.round("ndcg", 6))


@query(RESULTS + ", b AS (SELECT probe_id, rank, CASE WHEN grade >= 2 THEN 1 ELSE 0 END AS rel FROM j WHERE rank <= 10), o AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY rel DESC, rank) AS place FROM b) SELECT probe_id, round(coalesce(sum(rel / log2(rank + 1)) / nullif(sum(rel / log2(place + 1)), 0), 0), 6) AS ndcg FROM o GROUP BY 1", "mem")
def ev_lme_ndcg(spark, d):
    return ev.returned_ndcg(results(spark, d), qrels(spark, d).filter("grade >= 2"), 10).withColumn("ndcg", F.round("ndcg", 6))


@query(RESULTS + ", a AS (SELECT * FROM q WHERE grade = 3) SELECT a.probe_id, bool_or(coalesce(rank <= 5, false)) AS any_5, bool_or(coalesce(rank <= 20, false)) AS any_20, bool_and(coalesce(rank <= 5, false)) AS all_5, bool_and(coalesce(rank <= 20, false)) AS all_20 FROM a LEFT JOIN r USING (probe_id, doc_id) GROUP BY 1", "mem")
def ev_recall(spark, d):
    return ev.recall(results(spark, d), qrels(spark, d).filter("grade = 3").select("probe_id", "doc_id"), [5, 20])


@query(RESULTS + ", m AS (SELECT probe_id, coalesce(1.0::DOUBLE / min(rank) FILTER (grade >= 2), 0) AS rr, max(CASE WHEN grade >= 2 THEN 1.0::DOUBLE ELSE 0 END) AS hit, count(*) FILTER (grade >= 2) / 10.0::DOUBLE AS precision FROM j WHERE rank <= 10 GROUP BY 1) SELECT CAST(probe_id % 3 AS VARCHAR) AS kind, count(*) AS probes, round(avg(rr), 6) AS rr, round(avg(hit), 6) AS hit, round(avg(precision), 6) AS precision FROM m GROUP BY ROLLUP (kind)", "mem")
def agg_eval_by_type(spark, d):
    probes = table(spark, d, "embeddings").select(F.col("label").alias("probe_id"), (F.col("label") % 3).cast("string").alias("kind")).distinct()
    r = ev.report(results(spark, d), qrels(spark, d), probes, 10, "kind")
    return r.select("kind", "probes", *(F.round(c, 6).alias(c) for c in ("rr", "hit", "precision")))


@query(RESULTS + " SELECT probe_id, count(*) AS n, CAST(max(rank) AS INTEGER) AS last FROM (SELECT probe_id, rank FROM r UNION ALL SELECT e.label, 20 + row_number() OVER (PARTITION BY e.label ORDER BY e.vec_id) FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = e.vec_id)) GROUP BY 1", "mem")
def ev_fill_rule(spark, d):
    corpus = table(spark, d, "embeddings").select(F.col("label").alias("probe_id"), F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("place"))
    return ev.fill(results(spark, d), corpus).groupBy("probe_id").agg(F.count("*").alias("n"), F.max("rank").alias("last"))


@query("SELECT count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties, round(avg(d), 6) AS mean_delta FROM (SELECT embedding[3] - embedding[4] AS d FROM embeddings)")
def ev_compare_ab(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("probe_id"), F.col("embedding")[3].alias("a"), F.col("embedding")[2].alias("b"))
    r = ev.compare(e.select("probe_id", F.col("a").alias("m")), e.select("probe_id", F.col("b").alias("m")), "m")
    return r.withColumn("mean_delta", F.round("mean_delta", 6))


@query("SELECT round(avg(CASE WHEN o = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(avg(o), 6) AS mae, count(*) FILTER (o >= 2) AS bad, round(avg(CASE WHEN f = s THEN 1.0::DOUBLE ELSE 0 END), 6) AS consistency FROM (SELECT abs(doc_id % 4 - quality * 3) AS o, doc_id % 4 AS f, doc_id % 3 AS s FROM labels)")
def ev_judge_bench(spark, d):
    runs = table(spark, d, "labels").select((F.col("quality") * 3).alias("truth"), (F.col("doc_id") % 4).alias("first"), (F.col("doc_id") % 3).alias("second"))
    return ev.judge_agreement(runs).withColumns({c: F.round(c, 6) for c in ("accuracy", "mae", "consistency")})


@query("SELECT node_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at, node_id) AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, node_id) AS rank FROM mem) WHERE rank <= 3 OR (rank <= 10 AND value >= 60)", "mem")
def ev_adaptive_filter(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "node_id")
    m = mem(spark, d).withColumns({"rank": F.row_number().over(w), "query_id": F.col("user_id"), "relevance": F.col("value")})
    return ev.adaptive_filter(m, 60.0, 3, 10).select("node_id", "place")


@query("SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS mean, round(stddev_samp(embedding[1]::DOUBLE), 6) AS sd FROM embeddings GROUP BY 1")
def ev_multi_rubric(spark, d):
    x = F.col("embedding")[0].cast("double")
    return table(spark, d, "embeddings").groupBy("label").agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("sd"))


# Streams: run over all that is there, so that a batch query is their oracle.
def stream(spark, d):
    """events as an unbounded source of memories."""
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(event_folder(spark, d))
    kind = F.when(F.col("event_type") == "error", "error_pattern").otherwise(F.col("event_type"))
    return raw.select(F.concat(F.lit("mem-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("node_id"), F.col("ts").cast("timestamp").alias("created_at"), "user_id", kind.alias("event_type"), F.sha2("props", 256).alias("content_hash"))


def event_folder(spark, d: str) -> str:
    """A folder of events alone, written once a session: streams read folders, and tables may be single files."""
    path = f"{io.shared_folder(spark)}/events-{abs(hash(d))}-{spark.sparkContext.applicationId}"
    if path not in _copied:
        table(spark, d, "events").write.mode("overwrite").parquet(path)
        _copied.add(path)
    return path


_copied: set[str] = set()


def finished(s, name: str, mode: str = "append"):
    return streams.run_once(s, f"{name}_{abs(hash(name)) % 1000}", mode)


@query("SELECT date_trunc('day', created_at)::TIMESTAMP AS day, event_type, count(*) AS n FROM (SELECT ts AS created_at, CASE event_type WHEN 'error' THEN 'error_pattern' ELSE event_type END AS event_type FROM events) GROUP BY ALL")
def st_daily_timeline(spark, d):
    return finished(streams.daily_counts(stream(spark, d)), "st_daily_timeline", "complete")


@query("SELECT u AS until, count(*) AS n FROM (SELECT unnest(generate_series(date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS u FROM events) GROUP BY 1")
def st_velocity(spark, d):
    return finished(streams.velocity(stream(spark, d)), "st_velocity", "complete")


@query("AND e AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS stop, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM s GROUP BY user_id, s", "mem")
def st_session_summary(spark, d):
    return finished(streams.sessions(stream(spark, d)), "st_session_summary", "complete")


@query("SELECT count(DISTINCT props) AS n FROM events")
def st_dedup_hash(spark, d):
    return finished(streams.deduplicated(stream(spark, d), late="60 days"), "st_dedup_hash").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n FROM mem a JOIN mem b USING (user_id) WHERE a.node_id < b.node_id AND abs(epoch_us(a.created_at) - epoch_us(b.created_at)) <= 3600000000 GROUP BY 1", "mem")
def st_temporal_cluster(spark, d):
    return finished(streams.clusters(stream(spark, d)), "st_temporal_cluster").groupBy("user_id").agg(F.count("*").alias("n"))


@query()
def st_debounce(spark, d):
    return finished(streams.debounced(stream(spark, d), "user_id", 3600), "st_debounce")
