"""Queries of the whole read path, its branches and its second run; benchmark's items ask, documents are the memories."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemo import policy
from mnemo.functions import text as tx
from mnemo.operators import readpath as rp
from mnemo.operators import retrieval as rt
from mnemo.plans.basics import ACTIVE, EXPIRED, FEEDBACK, INFRA, PRIORITY, WEIGHT
from mnemo.plans.extraction import quoted
from mnemo.plans.reads import stem_sql
from mnemo.plans.registry import query
from mnemo.plans.search import BM25, COSINE, CREATED, DAY, EXACT, HYBRID_RANGE, A, Z
from mnemo.schema import as_of, docs, table

#: The path's own threshold of 0.3 is below what three normalised scores can average to; here the surer half passes.
LIMITS = rp.Limits(near_copies=1.0, retry_below=0.75)

# Items become queries of every kind: questions, wishes, exact names; some have a range of time, some a type in mind.
ASK = f"""ask AS (SELECT item_id AS query_id, CASE item_id % 5 WHEN 2 THEN 'What is ' || text WHEN 3 THEN 'I prefer the decision of src3: ' || text
  WHEN 4 THEN '`config` ' || text ELSE text END AS text, CASE WHEN item_id % 3 = 0 THEN {A} END AS start, CASE WHEN item_id % 3 = 0 THEN {Z} END AS stop,
  CASE WHEN item_id % 4 = 1 THEN 'decision' END AS hint FROM benchmark)"""
TERMS = BM25.replace("item_id AS query_id", "query_id").replace("FROM benchmark", "FROM ask") + ", qt AS (SELECT query_id, list(term) AS terms FROM q GROUP BY 1)"
EDGES = """edge AS (SELECT source_id, node_id AS target_id, round(1 / (1 + gap / 40.0::DOUBLE), 3) AS weight FROM (
  SELECT node_id, lag(node_id) OVER w AS source_id, doc_id - lag(doc_id) OVER w AS gap FROM docs WINDOW w AS (PARTITION BY project, entity_id ORDER BY doc_id, node_id)) WHERE source_id IS NOT NULL),
ways AS (SELECT a, b, max(least(w, 1.0)) AS w FROM (SELECT source_id AS a, target_id AS b, weight AS w FROM edge UNION ALL SELECT target_id, source_id, weight FROM edge) WHERE w >= 0.2 GROUP BY 1, 2)"""


def asked(spark, d):
    q = table(spark, d, "benchmark").withColumn("query_id", F.col("item_id"))
    kind, ranged = F.col("item_id") % 5, F.col("item_id") % 3 == 0
    text = F.when(kind == 2, F.concat(F.lit("What is "), "text")).when(kind == 3, F.concat(F.lit("I prefer the decision of src3: "), "text"))
    text = text.when(kind == 4, F.concat(F.lit("`config` "), "text")).otherwise(F.col("text"))
    q = q.select("query_id", text.alias("text"), F.when(ranged, as_of(HYBRID_RANGE[0])).alias("start"), F.when(ranged, as_of(HYBRID_RANGE[1])).alias("stop"), F.when(F.col("item_id") % 4 == 1, "decision").alias("hint"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    return q.join(e, "query_id", "left")


def parts(spark, d):
    """Queries, memories, vectors and edges: consecutive documents of a source and language are linked."""
    m = docs(spark, d).withColumns({"last_accessed": F.col("created_at"), "tags": F.array("event_type", "entity_id")})
    v = table(spark, d, "embeddings").select(F.concat(F.lit("doc-"), F.lpad(F.col("vec_id").cast("string"), 12, "0")).alias("node_id"), F.col("embedding").alias("v"))
    w = Window.partitionBy("project", "entity_id").orderBy("doc_id", "node_id")
    e = m.select("node_id", F.lag("node_id").over(w).alias("source_id"), (F.col("doc_id") - F.lag("doc_id").over(w)).alias("gap")).filter("source_id is not null")
    return asked(spark, d), m, v, e.select("source_id", F.col("node_id").alias("target_id"), F.round(1 / (1 + F.col("gap") / 40), 3).alias("weight"))


def overlap_scorer(text: pd.Series, passage: pd.Series) -> pd.Series:
    """Stands for a cross-encoder: a logit from the share of the query's words in the passage's first 512 characters."""
    words = lambda s: {w for w in re.findall("[a-z0-9_]+", s.lower()) if len(w) >= 3}
    asked = {t: words(t) for t in text.unique()}  # once a query, not once a pair
    return pd.Series([6.0 * len(asked[t] & words(p[:512])) / max(1, len(asked[t])) - 3.0 for t, p in zip(text, passage, strict=True)])


def weights_sql(values: dict, key: str, default) -> str:
    row = lambda v: "[" + ", ".join(f"{float(x)}::DOUBLE" for x in v) + "]"
    return f"(CASE {key} " + " ".join(f"WHEN '{k}' THEN {row(v)}" for k, v in values.items()) + f" ELSE {row(default)} END)"


OVERLAP = f"len(list_filter(said, lambda x: contains(lower(content), x) OR contains(lower(content), {stem_sql('x')})))::DOUBLE / len(said)"


@cache
def pass_sql(p: str, ask: str, vec: float, words: float, composite: float, limit: int = 10) -> str:
    """CTEs of one run of the path over the queries of CTE `ask`; the last, {p}out, is its result."""
    by = "PARTITION BY query_id"
    return f"""{p}n AS (SELECT *, CASE WHEN {EXACT} THEN 'navigational' WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])(what|when|who|where|which|how many)([^a-z0-9_]|$)') THEN 'factual'
  WHEN regexp_matches(lower(text), 'why|explain|concept|understand|overview|architecture|approach') THEN 'conceptual' ELSE 'none' END AS intent FROM {ask}),
{p}a AS (SELECT *, intent = 'navigational' AS exact, list_transform(range(1, 6), lambda i: {weights_sql(policy.PROFILES, 'hint', policy.PROFILES['_default'])}[i] * {weights_sql(policy.INTENTS, 'intent', [1] * 5)}[i]) AS pw,
  list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 2) AS said, regexp_matches(lower(text), '{'|'.join(rp.PREFERENCE_SIGNALS)}') AS asks_preference,
  CASE WHEN start IS NOT NULL THEN {4 * limit} ELSE {3 * limit} END AS take FROM {p}n),
{p}r AS (SELECT query_id, node_id, round(bm25, 6) AS bm25, take, terms FROM b JOIN {p}a USING (query_id) JOIN qt USING (query_id) QUALIFY row_number() OVER ({by} ORDER BY round(bm25, 6) DESC, node_id) <= 3 * take),
{p}x AS (SELECT query_id, node_id, take, round(0.7::DOUBLE * CASE WHEN max(bm25) OVER w > min(bm25) OVER w THEN 0.1 + 0.9::DOUBLE * (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) ELSE 1 END
  + 0.3::DOUBLE * len(list_intersect(terms, dl.w)) / len(terms), 6) AS score FROM {p}r JOIN dl USING (node_id) WINDOW w AS ({by})),
{p}v AS (SELECT a.query_id, 'doc-' || lpad(CAST(e.vec_id AS VARCHAR), 12, '0') AS node_id, round({COSINE}, 6) AS score FROM {p}a a JOIN embeddings q ON q.vec_id = a.query_id JOIN embeddings e ON {COSINE} >= 0.1
  WHERE NOT exact QUALIFY row_number() OVER (PARTITION BY a.query_id ORDER BY {COSINE} DESC, e.vec_id) <= {max(5 * limit, 20)}),
{p}i AS (SELECT query_id, d.node_id, CASE WHEN created_at BETWEEN start AND stop THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (1 + floor(least(abs(epoch_us(created_at) - epoch_us(start)), abs(epoch_us(created_at) - epoch_us(stop))) / {DAY}.0) / width) END AS score
  FROM (SELECT *, greatest(floor((epoch_us(stop) - epoch_us(start)) / {DAY}.0), 1) AS width FROM {p}a WHERE start IS NOT NULL) a JOIN docs d ON epoch_us(created_at) BETWEEN epoch_us(start) - width * {DAY} AND epoch_us(stop) + width * {DAY}),
{p}l AS (SELECT query_id, list_filter(list_transform(regexp_split_to_array(lower(text), '[^\\w./-]+'), lambda t: trim(t, './-')), lambda t: length(t) >= 3 AND t NOT IN ({', '.join(quoted(w.replace("'", "''")) if "'" not in w else "'" + w.replace("'", "''") + "'" for w in rp.NO_ENTITY)}))[1:8] AS names FROM {p}a),
{p}j AS (SELECT query_id, node_id, created_at, least(1.0::DOUBLE, hits::DOUBLE / len(names)) AS score FROM (SELECT query_id, names, node_id, created_at, len(list_filter(names, lambda t: list_contains([event_type, entity_id], t))) + CAST(contains(project, names[1]) AS INT)
  + CAST(entity_id = names[1] AS INT) AS hits FROM {p}l JOIN docs ON len(names) > 0 AND {ACTIVE}) WHERE hits > 0),
{p}h AS (SELECT query_id, 'text' AS channel, node_id, score, place FROM (SELECT *, row_number() OVER ({by} ORDER BY score DESC, node_id) AS place FROM {p}x) WHERE place <= take
  UNION ALL SELECT query_id, 'vec', node_id, score, row_number() OVER ({by} ORDER BY score DESC, node_id) FROM {p}v
  UNION ALL SELECT * FROM (SELECT query_id, 'temporal', node_id, score, row_number() OVER ({by} ORDER BY score DESC, node_id) AS place FROM {p}i) WHERE place <= {3 * limit}
  UNION ALL SELECT * FROM (SELECT query_id, 'entity', node_id, score, row_number() OVER ({by} ORDER BY score DESC, created_at DESC, node_id) AS place FROM {p}j) WHERE place <= {3 * limit}),
{p}st AS (SELECT query_id, coalesce(one >= 0.85 AND round(one - two, 6) >= 0.15 AND NOT exact, false) AS strong FROM {p}a LEFT JOIN (SELECT query_id, max(score) FILTER (place = 1) AS one, max(score) FILTER (place = 2) AS two FROM {p}h WHERE channel = 'text' GROUP BY 1) USING (query_id)),
{p}f AS (SELECT query_id, node_id, strong, sum((CASE channel WHEN 'vec' THEN pw[1] WHEN 'text' THEN pw[2] WHEN 'temporal' THEN 1.2 ELSE 0.8 END)::DOUBLE / (60 + place)) AS rrf, max(score) FILTER (channel = 'text') AS ts,
  max(score) FILTER (channel = 'vec') AS vs, bool_or(channel = 'vec' AND place = 1) AS vb FROM {p}h JOIN {p}a USING (query_id) JOIN {p}st USING (query_id) GROUP BY 1, 2, 3),
{p}g AS (SELECT *, CASE WHEN strong THEN ts ELSE rrf / max(rrf) OVER ({by}) END AS base FROM {p}f),
{p}s AS (SELECT query_id, node_id, strong, vs, vb, ov, round(base * {WEIGHT} * {FEEDBACK} * {PRIORITY} * {CREATED} * CASE WHEN strong THEN 1 ELSE (1 + ov * 0.5::DOUBLE * CASE WHEN feedback_score < 0 THEN 0.5 ELSE 1 END * pw[3])
  * CASE WHEN asks_preference AND event_type = 'decision' THEN 1.5::DOUBLE ELSE 1 END END * CASE WHEN start IS NULL THEN 1.0::DOUBLE WHEN created_at BETWEEN start AND stop THEN 1.3::DOUBLE ELSE 0.7::DOUBLE END, 9) AS score
  FROM (SELECT *, {OVERLAP} AS ov FROM {p}g JOIN docs USING (node_id) JOIN {p}a USING (query_id) WHERE base IS NOT NULL AND NOT {EXPIRED} AND {ACTIVE} AND feedback_score > -3 AND event_type NOT IN ({INFRA}))),
{p}w AS (SELECT query_id, node_id, score FROM {p}s WHERE NOT strong),
{p}h1 AS (SELECT query_id, b AS node_id, max(score * 0.4::DOUBLE * w) AS s FROM (SELECT * FROM {p}w QUALIFY row_number() OVER ({by} ORDER BY score DESC, node_id) <= 5) x JOIN ways ON a = x.node_id GROUP BY 1, 2),
{p}h2 AS (SELECT query_id, b AS node_id, max(s * 0.4::DOUBLE * w) AS s FROM {p}h1 x JOIN ways ON a = x.node_id GROUP BY 1, 2),
{p}y AS (SELECT query_id, node_id, {OVERLAP} AS ov, score FROM (SELECT query_id, node_id, round(max(s) * any_value(pw)[5], 9) AS score FROM (SELECT * FROM {p}h1 UNION ALL SELECT * FROM {p}h2) JOIN {p}a USING (query_id) GROUP BY 1, 2) n
  JOIN docs USING (node_id) JOIN {p}a USING (query_id) WHERE score >= 0.1 AND NOT {EXPIRED} AND {ACTIVE} AND NOT EXISTS (SELECT 1 FROM {p}w o WHERE o.query_id = n.query_id AND o.node_id = n.node_id)),
{p}u AS (SELECT * FROM {p}s UNION ALL SELECT query_id, node_id, false, NULL, NULL, ov, score FROM {p}y),
{p}m AS (SELECT u.*, CASE WHEN n <= 20 THEN 6.0::DOUBLE * len(list_intersect(terms, list_filter(regexp_extract_all(lower(substr(content, 1, 512)), '[a-z0-9_]+'), lambda x: length(x) >= 3))) / len(terms) - 3 END AS model
  FROM (SELECT *, row_number() OVER ({by} ORDER BY score DESC, node_id) AS n FROM {p}u WHERE NOT strong) u JOIN docs USING (node_id) JOIN qt USING (query_id)),
{p}c AS (SELECT *, CASE WHEN model IS NOT NULL AND count(model) OVER w > 1 THEN score * (1 + CASE WHEN n <= 3 THEN 0.15::DOUBLE WHEN n <= 10 THEN 0.30::DOUBLE ELSE 0.50::DOUBLE END * CASE WHEN max(model) OVER w > min(model) OVER w THEN (model - min(model) OVER w) / (max(model) OVER w - min(model) OVER w) ELSE 0.5 END) ELSE score END AS boosted,
  1 / (1 + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, model)))) AS sure, row_number() OVER ({by} ORDER BY model DESC NULLS LAST, n) AS favourite, count(model) OVER w AS others FROM {p}m WINDOW w AS ({by})),
{p}d AS (SELECT *, lead(sure) OVER ({by} ORDER BY favourite) AS following, max(boosted) FILTER (model IS NOT NULL AND others > 1) OVER ({by}) AS best FROM {p}c),
{p}z AS (SELECT query_id, node_id, strong, vs, vb, ov, round(CASE WHEN favourite = 1 AND others > 1 AND model IS NOT NULL AND round(sure - following, 9) >= 0.1 THEN best * 1.01 ELSE boosted END, 9) AS score FROM {p}d
  UNION ALL SELECT * FROM {p}s WHERE strong),
{p}p AS (SELECT *, row_number() OVER ({by} ORDER BY CASE WHEN vb AND rank > 3 THEN 2.5 ELSE rank END, node_id) AS seat FROM (SELECT *, row_number() OVER ({by} ORDER BY score DESC, node_id) AS rank FROM {p}z)),
{p}q AS (SELECT * FROM {p}p JOIN docs USING (node_id) QUALIFY row_number() OVER (PARTITION BY query_id, regexp_replace(substr(lower(trim(regexp_replace(content, '[ \\t\\r\\n]+', ' ', 'g'))), 1, 150), ' - [0-9a-f]+$', '') ORDER BY seat) = 1),
{p}k AS (SELECT *, round(score / max(score) OVER ({by}), 3) AS relevance FROM (SELECT * FROM {p}q QUALIFY row_number() OVER ({by} ORDER BY seat) <= {limit}) WHERE score >= {composite}::DOUBLE AND (coalesce(vs >= {vec}::DOUBLE, false) OR ov >= {words}::DOUBLE)),
{p}e AS (SELECT *, relevance * {WEIGHT} * {FEEDBACK} * {CREATED} AS sv, CAST(row_number() OVER ({by} ORDER BY seat) AS INTEGER) AS rk FROM {p}k),
{p}out AS (SELECT query_id, node_id, rk AS rank, relevance, round(sv / max(sv) OVER ({by}), 3) AS strength, strong, round(avg(CASE WHEN rk <= 3 THEN relevance END) OVER ({by}), 6) AS confidence FROM {p}e)"""


ONE = f"AND {ASK}, {TERMS}, {EDGES}, {pass_sql('x', 'ask', 0.50, 0.35, 0.10)}"
TWO = f"""{ONE}, unsure AS (SELECT query_id, any_value(confidence) AS was FROM xout WHERE confidence < {LIMITS.retry_below} AND NOT strong GROUP BY 1),
ask2 AS (SELECT query_id, text, CAST(NULL AS TIMESTAMP) AS start, CAST(NULL AS TIMESTAMP) AS stop, CAST(NULL AS VARCHAR) AS hint FROM ask JOIN unsure USING (query_id)),
{pass_sql('s', 'ask2', 0.30, 0.21, 0.05)}, surer AS (SELECT o.* FROM sout o JOIN unsure u USING (query_id) WHERE o.confidence > u.was AND o.confidence >= 0.15)"""


@query(f"{TWO} SELECT *, false AS retried FROM xout WHERE query_id NOT IN (SELECT query_id FROM surer) UNION ALL SELECT *, true FROM surer", "docs")
def ret_hybrid(spark, d):
    """The read path: all channels, strong signals, fusion, graph, reranker, guard, abstention and the second run."""
    return rp.search(*parts(spark, d), as_of(), LIMITS, overlap_scorer, "decision")


@query(f"{TWO} SELECT u.query_id, u.was AS first_confidence, coalesce(max(o.confidence), 0) AS second_confidence, count(o.node_id) AS answers, count(s.query_id) > 0 AS accepted FROM unsure u LEFT JOIN sout o ON o.query_id = u.query_id LEFT JOIN surer s ON s.query_id = o.query_id AND s.node_id = o.node_id GROUP BY 1, 2", "docs")
def ret_adaptive_retry(spark, d):
    """The second run of unsure queries only, without range and hint, thresholds lowered: both passes' confidence."""
    q, m, v, e = parts(spark, d)
    first = rp.written(rp.run(q, m, v, e, as_of(), LIMITS, overlap_scorer, "decision"), "first")
    unsure = rp.unsure(first, LIMITS)
    second = rp.second_run(q, unsure, m, v, e, as_of(), LIMITS, overlap_scorer, "decision")
    best = second.groupBy("query_id").agg(F.max("confidence").alias("second"), F.count("*").alias("answers"))
    return unsure.join(best, "query_id", "left").select(
        "query_id", F.col("was").alias("first_confidence"), F.coalesce("second", F.lit(0.0)).alias("second_confidence"), F.coalesce("answers", F.lit(0)).alias("answers"),
        F.coalesce((F.col("second") > F.col("was")) & (F.col("second") >= LIMITS.retry_least), F.lit(False)).alias("accepted"),
    )


PHASE = f"AND {ASK}, {TERMS}, {EDGES}, {pass_sql('x', 'ask', 0.50, 0.35, 0.10)}"


@query(f"{PHASE} SELECT query_id, channel, node_id, score, CAST(place AS INTEGER) AS place, d.event_type FROM xh JOIN docs d USING (node_id) WHERE channel IN ('text', 'temporal')", "docs")
def hx_fts_temporal_phase(spark, d):
    """Texts, fetched 3 times the limit or 4 times where the query has a range, and the range's own candidates, hydrated in one join."""
    q, m, _, _ = parts(spark, d)
    a = rp.plan(q, LIMITS.limit)
    hits = rp.text_hits(a, m).unionByName(rp.time_hits(a, m, 3 * LIMITS.limit))
    return hits.join(m.select("node_id", "event_type"), "node_id").withColumn("place", F.col("place").cast("int"))


@query(f"{PHASE} SELECT query_id, strong, count(node_id) AS answers, CAST(coalesce(max(CASE WHEN rank = 1 THEN substr(node_id, 5)::BIGINT END), -1) AS BIGINT) AS best FROM xst LEFT JOIN (SELECT query_id, node_id, rank FROM xout) USING (query_id) GROUP BY 1, 2", "docs")
def ret_strong_signal(spark, d):
    """Which queries one text answers so clearly that fusion, graph and reranker are left out, and what they get (-1: nothing)."""
    q, m, v, e = parts(spark, d)
    a = rp.plan(q, LIMITS.limit)
    texts = rp.written(rp.text_hits(a, m), "texts")
    signals = rp.strong_signals(texts, a, LIMITS)
    out = rp.run(q, m, v, e, as_of(), LIMITS, overlap_scorer, "decision", texts).select("query_id", "node_id", "rank")
    best = F.max(F.when(F.col("rank") == 1, F.substring("node_id", 5, 20).cast("long")))
    return signals.join(out, "query_id", "left").groupBy("query_id", "strong").agg(F.count("node_id").alias("answers"), F.coalesce(best, F.lit(-1).cast("long")).alias("best"))


@query(f"{PHASE} SELECT query_id, node_id, round(6.0::DOUBLE * len(list_intersect(terms, list_filter(regexp_extract_all(lower(substr(content, 1, 512)), '[a-z0-9_]+'), lambda x: length(x) >= 3))) / len(terms) - 3, 6) AS model FROM xh JOIN docs USING (node_id) JOIN qt USING (query_id) WHERE channel = 'text' AND place <= 20", "docs")
def sc_ce_model(spark, d):
    """Pairs of query and passage through a scorer that is handed whole batches; here one that SQL can repeat."""
    q, m, _, _ = parts(spark, d)
    hits = rp.written(rp.text_hits(rp.plan(q, LIMITS.limit), m).filter(F.col("place") <= LIMITS.reranked), "texts")  # its size is known from here on
    pairs = hits.join(m.select("node_id", F.col("content").alias("passage")), "node_id").join(q.select("query_id", "text"), "query_id")
    return rp.pair_scores(pairs, overlap_scorer).withColumn("model", F.round("model", 6))


@query(f"{PHASE} SELECT query_id, round(max(CASE WHEN favourite = 1 THEN sure END) - max(CASE WHEN favourite = 2 THEN sure END), 6) AS margin, bool_or(favourite = 1 AND others > 1 AND round(sure - following, 9) >= 0.1) AS takes_first FROM xd GROUP BY 1 HAVING max(others) > 1", "docs")
def win_max_rest(spark, d):
    """The margin of the reranker's favourite over the best of the rest, both squashed, and whether it takes the first place."""
    q, m, v, e = parts(spark, d)
    pairs = rp.rerank_input(q, m, v, e, as_of(), LIMITS, "decision")
    scored = rp.written(rp.pair_scores(pairs, overlap_scorer), "model")
    sure = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("model")))))
    places = scored.withColumn("sure", sure).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sure"))))
    at = lambda n: F.max(F.when(F.col("n") == n, F.col("sure")))
    out = places.groupBy("query_id").agg((at(1) - at(2)).alias("m"), F.count("*").alias("n")).filter("n > 1")
    return out.select("query_id", F.round("m", 6).alias("margin"), (F.round("m", 9) >= LIMITS.margin).alias("takes_first"))


@query(f"""WITH ask AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'error_pattern' END AS hint FROM conversations), n AS (SELECT *, CASE WHEN {EXACT} THEN 'navigational' WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])(what|when|who|where|which|how many)([^a-z0-9_]|$)') THEN 'factual'
  WHEN regexp_matches(lower(text), 'why|explain|concept|understand|overview|architecture|approach') THEN 'conceptual' ELSE 'none' END AS intent FROM ask)
SELECT conv_id, turn, ['vec', 'text', 'word', 'ctx', 'graph'][i] AS channel, round({weights_sql(policy.PROFILES, 'hint', policy.PROFILES['_default'])}[i] * {weights_sql(policy.INTENTS, 'intent', [1] * 5)}[i], 6) AS weight FROM n, range(1, 6) t(i)""")
def ret_channel_weights(spark, d):
    """How much each channel counts for each turn as a query: the profile of the type in mind times its intent's."""
    q = table(spark, d, "conversations").select("conv_id", "turn", "text", F.when(F.col("turn") % 3 == 0, "decision").when(F.col("turn") % 3 == 1, "error_pattern").alias("hint"), F.lit(None).cast("timestamp").alias("start"))
    names = F.array(*map(F.lit, ("vec", "text", "word", "ctx", "graph")))
    each = rp.plan(q, 10).select("conv_id", "turn", F.explode(F.arrays_zip(names.alias("channel"), F.col("pw").alias("weight"))).alias("e"))
    return each.select("conv_id", "turn", "e.channel", F.round("e.weight", 6).alias("weight"))
