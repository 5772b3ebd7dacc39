"""Queries over retrieval, duplicates, contradictions and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo import policy
from mnemo.functions import scoring as sc
from mnemo.functions import text as tx
from mnemo.operators import context as cx
from mnemo.operators import dedup as dd
from mnemo.operators import graph as gr
from mnemo.operators import retrieval as rt
from mnemo.plans.basics import ACTIVE, DECAY, EXPIRED, FEEDBACK, PRIORITY, WEIGHT
from mnemo.plans.registry import query
from mnemo.schema import as_of, docs, links, mem, table

#: Fixed words and range of the hybrid query.
HYBRID_WORDS = ["the", "tion", "ing"]
HYBRID_RANGE = ("2024-01-05 00:00:00", "2024-01-12 00:00:00")
A, Z = (f"TIMESTAMP '{t}'" for t in HYBRID_RANGE)
CREATED = DECAY.format(last="created_at")
LIKE = "(" + " + ".join(f"CAST(contains(lower(content), '{w}') AS INT)" for w in HYBRID_WORDS) + ") / 3.0::DOUBLE"
DAY = 86_400_000_000
TEXT_CHANNEL = f"t AS (SELECT node_id, {LIKE} AS score FROM docs WHERE {LIKE} > 0 ORDER BY score DESC, created_at DESC, node_id LIMIT 30)"
TIME_CHANNEL = f"""m AS (SELECT node_id, CASE WHEN created_at BETWEEN {A} AND {Z} THEN 1.0::DOUBLE
  ELSE 1.0::DOUBLE / (1 + floor(least(abs(epoch_us(created_at) - epoch_us({A})), abs(epoch_us(created_at) - epoch_us({Z}))) / {DAY}.0) / 7) END AS score
  FROM docs WHERE created_at BETWEEN {A} - INTERVAL 7 DAY AND {Z} + INTERVAL 7 DAY ORDER BY score DESC, node_id LIMIT 30)"""
FUSED = f"""c AS (SELECT node_id, 1.5::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, node_id)) AS part FROM t
  UNION ALL SELECT node_id, 1.2::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, node_id)) FROM m),
f AS (SELECT node_id, sum(part) / max(sum(part)) OVER () AS rrf FROM c GROUP BY 1)"""


@query(f"AND {TEXT_CHANNEL}, {TIME_CHANNEL}, {FUSED}, s AS (SELECT d.node_id, rrf * {WEIGHT} * {FEEDBACK} * {PRIORITY} * {CREATED} * (1 + {LIKE} * 0.5::DOUBLE * 1.3::DOUBLE) AS score FROM docs d JOIN f ON f.node_id = d.node_id WHERE NOT {EXPIRED} AND {ACTIVE})"
       " SELECT node_id, round(score / max(score) OVER (), 6) AS relevance, CAST(row_number() OVER (ORDER BY score DESC, node_id) AS INTEGER) AS rank FROM s ORDER BY score DESC, node_id LIMIT 10", "docs")  # fmt: skip
def ret_hybrid_words(spark, d):
    """One query of three words over text and time."""
    m = docs(spark, d).withColumn("last_accessed", F.col("created_at"))
    return rt.hybrid(m, HYBRID_WORDS, as_of(HYBRID_RANGE[0]), as_of(HYBRID_RANGE[1]), as_of())


@query(f"AND {TEXT_CHANNEL} SELECT node_id, round(score, 6) AS score FROM t", "docs")
def ret_like_fallback(spark, d):
    return rt.like_channel(HYBRID_WORDS, docs(spark, d), 30).withColumn("score", F.round("score", 6))


@query(f"AND {TIME_CHANNEL} SELECT node_id, round(score, 6) AS score FROM m", "docs")
def ret_temporal(spark, d):
    return rt.temporal_channel(docs(spark, d), as_of(HYBRID_RANGE[0]), as_of(HYBRID_RANGE[1]), 30).withColumn("score", F.round("score", 6))


@query(f"AND {TEXT_CHANNEL}, {TIME_CHANNEL}, {FUSED} SELECT node_id, round(rrf, 6) AS rrf FROM f", "docs")
def ret_rrf_fuse(spark, d):
    m = docs(spark, d)
    channels = [("text", rt.like_channel(HYBRID_WORDS, m, 30)), ("temporal", rt.temporal_channel(m, as_of(HYBRID_RANGE[0]), as_of(HYBRID_RANGE[1]), 30))]
    every = reduce(DataFrame.union, [c.select(F.lit(0).alias("query_id"), F.lit(n).alias("channel"), "node_id", "score") for n, c in channels])
    return rt.rrf(every, {"text": 1.5, "temporal": 1.2}).select("node_id", F.round("rrf", 6).alias("rrf"))


@query("SELECT node_id, round(least(1.0, (CAST(event_type = 'decision' AS INT) + CAST(project = 'src3' AS INT) + CAST(entity_id = 'fr' AS INT)) / 3.0::DOUBLE), 6) AS score FROM docs WHERE event_type = 'decision' OR project = 'src3' OR entity_id = 'fr'", "docs")
def ret_entity(spark, d):
    return rt.entity_channel(["decision", "src3", "fr"], docs(spark, d)).withColumn("score", F.round("score", 6))


COSINE = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"
KNN = f"n AS (SELECT q.vec_id AS query_id, e.vec_id AS node_id, {COSINE} AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id AND {COSINE} >= 0.1)"


def knn(spark, d, k: int = 10):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return rt.knn(q, e.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("v")), k + 1).filter("query_id <> node_id").drop("rank")


@query(f"AND {KNN} SELECT query_id, node_id, round(score, 6) AS score FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 10", "mem")
def ret_vec(spark, d):
    return rt.top(knn(spark, d), 10, "score", "query_id").select("query_id", "node_id", F.round("score", 6).alias("score"))


@query(f"AND {KNN}, k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 10) SELECT query_id, round(max(score), 6) AS best, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY 1", "mem")
def ret_find_similar(spark, d):
    return rt.top(knn(spark, d), 10, "score", "query_id").groupBy("query_id").agg(F.round(F.max("score"), 6).alias("best"), F.count("*").alias("n"))


@query("SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings e, embeddings q WHERE q.vec_id = 1")
def ret_cosine(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 1").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(sc.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))  # one query


BM25 = """dl AS (SELECT node_id, list_filter(regexp_extract_all(lower(content), '[a-z0-9_]+'), lambda w: length(w) >= 3) AS w FROM docs),
p AS (SELECT term, node_id, len, count(*) AS tf FROM (SELECT unnest(w) AS term, node_id, len(w) AS len FROM dl) GROUP BY ALL),
q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) >= 3))) AS term FROM benchmark),
s AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM dl), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
b AS (SELECT query_id, node_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))) AS bm25 FROM q JOIN p USING (term) JOIN df USING (term), s GROUP BY 1, 2)"""


def benchmark_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"AND {BM25} SELECT query_id, node_id, score AS bm25 FROM (SELECT query_id, node_id, round(bm25, 4) AS score FROM b) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 5", "docs")
def ret_bm25(spark, d):
    found = rt.bm25(benchmark_queries(spark, d), docs(spark, d)).withColumn("bm25", F.round("bm25", 4))  # equal texts tie
    return rt.top(found, 5, "bm25", "query_id").select("query_id", "node_id", "bm25")


@query(f"""AND {BM25}, r AS (SELECT query_id, node_id, round(bm25, 6) AS bm25 FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, node_id) <= 30),
x AS (SELECT r.query_id, r.node_id, 0.7::DOUBLE * CASE WHEN max(bm25) OVER w > min(bm25) OVER w THEN 0.1 + 0.9::DOUBLE * (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) ELSE 1 END
  + 0.3::DOUBLE * len(list_intersect((SELECT list(term) FROM q WHERE q.query_id = r.query_id), dl.w)) / (SELECT count(*) FROM q WHERE q.query_id = r.query_id) AS score
  FROM r JOIN dl USING (node_id) WINDOW w AS (PARTITION BY r.query_id))
SELECT query_id, node_id, round(score, 6) AS score FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, node_id) <= 10""", "docs")
def ret_text_blend(spark, d):
    return rt.text_channel(benchmark_queries(spark, d), docs(spark, d), 10).select("query_id", "node_id", "score")


EXACT = r"""contains(text, '`') OR regexp_matches(text, '/[a-zA-Z][\w/.]*|\b[A-Z][a-z]+[A-Z]\w*\b|\b[a-z]+_[a-z_]+\b|\bmem-[0-9a-f]{8,}\b|\bv?\d+\.\d+(?:\.\d+)?\b|https?://|\b[0-9a-f]{8,}\b')
  OR (starts_with(trim(text), '"') AND ends_with(trim(text), '"') AND length(trim(text)) > 2)"""


@query(f"SELECT conv_id, turn, CASE WHEN {EXACT} THEN 'navigational' WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])(what|when|who|where|which|how many)([^a-z0-9_]|$)') THEN 'factual' WHEN regexp_matches(lower(text), 'why|explain|concept|understand|overview|architecture|approach') THEN 'conceptual' ELSE 'none' END AS intent FROM conversations")
def ret_intent(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.intent("text").alias("intent"))


COMPOUND = """cp AS (SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'what is the auth model, and which framework runs the api? then how did ' WHEN 1 THEN 'auth and api of ' WHEN 2 THEN '"find and what this is, exactly here" and why ' ELSE 'which of these is it and is it also what we said plus where to find ' END || text AS q FROM conversations)"""


@query(f"""WITH {COMPOUND}, s AS (SELECT conv_id, turn, q, list_filter(list_transform(string_split(regexp_replace(q, ',?\\s+(?:and|also|then|plus)\\s+((?:what|which|who|when|where|why|how|did|does|do|is|are)(?:[^0-9A-Za-z_]|$))', chr(1) || '\\1', 'gi'), chr(1)),
  lambda p: trim(regexp_replace(p, '^[\\s,;]+|[\\s,;]+$', '', 'g'))), lambda p: length(p) >= 12 AND len(regexp_split_to_array(p, '\\s+')) >= 2) AS parts FROM cp)
SELECT conv_id, turn, CASE WHEN length(q) >= 25 AND NOT regexp_matches(q, '"[^\\n]*"') AND len(parts) > 1 THEN array_to_string(parts[1:4], ' | ') ELSE '' END AS parts FROM s""")
def ret_decompose(spark, d):
    """Compound questions, made of turns, in their parts."""
    q = spark.sql("WITH " + COMPOUND.replace("FROM conversations", "FROM {conversations}") + " SELECT * FROM cp", conversations=table(spark, d, "conversations"))
    return q.select("conv_id", "turn", F.array_join(tx.decompose("q"), " | ").alias("parts"))


@query("AND r AS (SELECT user_id, node_id, value, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY k DESC, node_id) = 1 THEN true ELSE false END AS best, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, node_id) AS rank FROM mem), g AS (SELECT *, CASE WHEN best AND rank > 3 THEN 2.5 ELSE rank END AS p FROM r) SELECT user_id AS query_id, node_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY p, node_id) AS INTEGER) AS rank FROM g", "mem")
def sc_vec_top_guard(spark, d):
    a, b = Window.partitionBy("user_id").orderBy(F.desc("value"), "node_id"), Window.partitionBy("user_id").orderBy(F.desc("k"), "node_id")
    m = mem(spark, d).select(F.col("user_id").alias("query_id"), "node_id", F.row_number().over(a).alias("rank"), (F.row_number().over(b) == 1).alias("best"))
    return rt.guard(m, F.col("best")).select("query_id", "node_id", "rank")


@query("SELECT node_id FROM (SELECT node_id, row_number() OVER (PARTITION BY user_id, regexp_replace(substr(lower(regexp_replace(content, '[ \\t\\r\\n]+', ' ', 'g')), 1, 150), ' - [0-9a-f]+$', '') ORDER BY value DESC, node_id) AS n FROM mem) WHERE n = 1", "mem")
def dd_query_exact(spark, d):
    m = mem(spark, d).select(F.col("user_id").alias("query_id"), "node_id", "content", F.col("value").alias("score"))
    return rt.first_of_each(m).select("node_id")


@query()
def dd_query_semantic(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("v"))
    return rt.semantic_dedup(rt.top(knn(spark, d), 10, "score", "query_id").join(e, "node_id"), 0.5)


@query("SELECT node_id, round(CASE WHEN hi > lo AND rank <= 20 THEN score * (1 + CASE WHEN rank <= 3 THEN 0.15::DOUBLE WHEN rank <= 10 THEN 0.30::DOUBLE ELSE 0.5::DOUBLE END * (model - lo) / (hi - lo)) WHEN rank <= 20 THEN score * (1 + CASE WHEN rank <= 3 THEN 0.15::DOUBLE WHEN rank <= 10 THEN 0.30::DOUBLE ELSE 0.5::DOUBLE END * 0.5) ELSE score END, 8) AS score FROM (SELECT *, max(model) FILTER (rank <= 20) OVER (PARTITION BY user_id) AS hi, min(model) FILTER (rank <= 20) OVER (PARTITION BY user_id) AS lo FROM (SELECT user_id, node_id, value AS score, k::DOUBLE AS model, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, node_id) AS rank FROM mem))", "mem")
def sc_rerank_ce(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "node_id")
    m = mem(spark, d).select(F.col("user_id").alias("query_id"), "node_id", F.col("value").alias("score"), F.row_number().over(w).alias("rank"), F.col("k").cast("double").alias("model"))
    return rt.rerank(m).select("node_id", F.round("score", 8).alias("score"))


@query("SELECT node_id FROM (SELECT node_id, value / 100 AS score, CASE WHEN k % 3 > 0 THEN k / 100.0::DOUBLE END AS v, (k % 10) / 10.0::DOUBLE AS o FROM mem) WHERE score >= 0.10 AND (o >= 0.35 OR v >= 0.50)", "mem")
def abs_abstain(spark, d):
    m = mem(spark, d).select("node_id", (F.col("value") / 100).alias("score"), F.when(F.col("k") % 3 > 0, F.col("k") / 100).alias("vec_sim"), ((F.col("k") % 10) / 10).alias("overlap"))
    return rt.abstain(m).select("node_id")


@query("SELECT node_id, round(value / max(value) OVER (PARTITION BY user_id), 3) AS relevance FROM mem", "mem")
def out_relevance(spark, d):
    return mem(spark, d).select("node_id", F.round(rt.maxnorm("value", "user_id"), 3).alias("relevance"))


@query(f"SELECT node_id, round(s / max(s) OVER (PARTITION BY user_id), 5) AS strength FROM (SELECT node_id, user_id, value * {WEIGHT} * {FEEDBACK} * {DECAY.format(last='last_accessed')} AS s FROM mem)", "mem")
def out_strength(spark, d):
    m = mem(spark, d).withColumn("s", F.col("value") * sc.type_weight() * sc.feedback_factor("feedback_score") * sc.decay(as_of()))
    return m.select("node_id", F.round(rt.maxnorm("s", "user_id"), 5).alias("strength"))


@query("SELECT user_id AS query_id, round(avg(value), 6) AS confidence FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, node_id) AS r FROM mem) WHERE r <= 3 GROUP BY 1", "mem")
def out_confidence(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "node_id")
    m = mem(spark, d).select(F.col("user_id").alias("query_id"), F.col("value").alias("relevance"), F.row_number().over(w).alias("rank"))
    return rt.confidence(m).withColumn("confidence", F.round("confidence", 6))


@query("""AND p AS (SELECT user_id AS query_id, content AS node_id, k % 4 AS part, max(value) AS relevance FROM mem GROUP BY ALL),
b AS (SELECT *, max(relevance) OVER (PARTITION BY query_id, node_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
g AS (SELECT query_id, node_id, max(relevance) * CASE WHEN bool_or(before IS NOT NULL AND relevance <= before) THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END AS r FROM b GROUP BY 1, 2)
SELECT query_id, node_id, round(r / max(r) OVER (PARTITION BY query_id), 6) AS relevance FROM g""", "mem")
def set_merge_subqueries(spark, d):
    m = mem(spark, d).groupBy(F.col("user_id").alias("query_id"), F.substring("content", 1, 200).alias("node_id"), (F.col("k") % 4).alias("part")).agg(F.max("value").alias("relevance"))
    return rt.merge_subqueries(m).withColumn("relevance", F.round("relevance", 6))


@query("""AND sd AS (SELECT node_id, value / 100 AS s FROM mem WHERE CAST(substr(node_id, 5) AS BIGINT) % 20 = 0), bb AS (SELECT a, b, max(least(w, 1.0)) AS w FROM (SELECT source_id AS a, target_id AS b, weight AS w FROM links UNION ALL SELECT target_id, source_id, weight FROM links) WHERE w >= 0.2 GROUP BY 1, 2),
h1 AS (SELECT b AS node_id, max(s * 0.4::DOUBLE * w) AS s FROM sd JOIN bb ON a = sd.node_id GROUP BY 1), h2 AS (SELECT b AS node_id, max(s * 0.4::DOUBLE * w) AS s FROM h1 JOIN bb ON a = h1.node_id GROUP BY 1)
SELECT node_id, round(max(s), 6) AS score FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) WHERE node_id NOT IN (SELECT node_id FROM sd) GROUP BY 1 HAVING max(s) >= 0.01""", "mem", "links")
def sc_graph_expand(spark, d):
    seeds = mem(spark, d).filter("cast(substr(node_id, 5) as bigint) % 20 = 0").select(F.lit(0).alias("query_id"), "node_id", (F.col("value") / 100).alias("score"))
    return rt.graph_expand(seeds, links(spark, d), least=0.01).select("node_id", F.round("score", 6).alias("score"))


# Duplicates and contradictions.
@query("SELECT sha256(text) AS hash, min('doc-' || lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS node_id, CAST(sum(doc_id % 4) + count(*) - 1 AS BIGINT) AS access_count, count(*) AS n FROM documents GROUP BY 1")
def dd_exact(spark, d):
    m = docs(spark, d).withColumn("created_at", F.lit(0))
    return dd.by_hash(m, F.sha2("content", 256))


@query("SELECT sha256(lower(trim(regexp_replace(regexp_replace(text, '[*#`~\\[\\]()>|_]', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')))) AS hash, count(*) AS n FROM documents GROUP BY 1")
def dd_canonical(spark, d):
    return dd.by_hash(docs(spark, d), F.sha2(tx.canonicalize("content"), 256)).select("hash", "n")


SETS = "s AS (SELECT node_id, event_type, list_distinct(list_filter(regexp_extract_all(lower(content), '[a-z0-9_]+'), lambda w: length(w) >= 4)) AS w FROM docs)"


@query(f"""AND {SETS}, g AS (SELECT event_type, w, node_id AS rep FROM s WHERE len(w) > 0)
SELECT a.event_type, a.rep AS a, b.rep AS b, round(len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS jaccard FROM g a JOIN g b ON a.event_type = b.event_type AND a.rep < b.rep
WHERE len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.7""", "docs")
def jn_pairwise_similarity(spark, d):
    return dd.every_pair(docs(spark, d), 0.7).withColumn("jaccard", F.round("jaccard", 6))


@query()
def dd_deduplicate(spark, d):
    return dd.leader_clusters(docs(spark, d), 0.8)


@query("AND b AS (SELECT source_id AS old_id, target_id AS new_id, created_at AS t FROM links WHERE edge_type = 'evolution'), o AS (SELECT old_id, arg_min(new_id, (t, new_id)) AS superseded_by, min(t) AS t FROM b GROUP BY 1) SELECT m.node_id, CASE WHEN o.old_id IS NOT NULL THEN 'superseded' ELSE m.status END AS status, o.superseded_by, CASE WHEN o.old_id IS NOT NULL THEN coalesce(m.valid_until, o.t) ELSE m.valid_until END AS valid_until FROM mem m LEFT JOIN o ON o.old_id = m.node_id", "mem", "links")
def sup_mark(spark, d):
    by = links(spark, d).filter("edge_type = 'evolution'").select(F.col("source_id").alias("old_id"), F.col("target_id").alias("new_id"), F.col("created_at").alias("at"))
    return dd.mark_superseded(mem(spark, d), by).select("node_id", "status", "superseded_by", "valid_until")


@query()
def dd_evolve(spark, d):
    return dd.evolved_lengths(dd.every_pair(docs(spark, d), 0.65), docs(spark, d))


# Links.
@query("AND n AS (SELECT source_id, target_id, 'related' AS edge_type, round(weight / 2, 3) AS weight, created_at FROM links WHERE hash(1) IS NOT NULL UNION ALL SELECT source_id, target_id, edge_type, weight, created_at FROM links) SELECT source_id, target_id, edge_type, weight FROM n", "mem", "links")
def gr_add_edge(spark, d):
    e = links(spark, d)
    new = e.withColumns({"edge_type": F.lit("related"), "weight": F.col("weight") / 2})
    return gr.add_edges(e, new.union(e).union(new)).select("source_id", "target_id", "edge_type", "weight")


@query("""AND e AS (SELECT source_id AS a, target_id AS b FROM links WHERE weight >= 0.6 UNION SELECT target_id, source_id FROM links WHERE weight >= 0.6), w AS (SELECT node_id AS start_id, node_id, 0 AS hop FROM mem WHERE CAST(substr(node_id, 5) AS BIGINT) % 20 = 0
UNION SELECT start_id, b, hop + 1 FROM w JOIN e ON a = node_id WHERE hop < 4) SELECT start_id, node_id, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY 1, 2 HAVING min(hop) > 0""", "mem", "links")
def gr_bfs(spark, d):
    starts = mem(spark, d).filter("cast(substr(node_id, 5) as bigint) % 20 = 0").select(F.col("node_id").alias("start_id"))
    return gr.bfs(links(spark, d), starts, 4, 0.6)


@query("SELECT node_id, other, direction, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY weight DESC, other, edge_type, direction) AS rank FROM (SELECT source_id AS node_id, target_id AS other, edge_type, weight, 'out' AS direction FROM links UNION ALL SELECT target_id, source_id, edge_type, weight, 'in' FROM links)) WHERE rank <= 2", "mem", "links")
def gr_node_edges(spark, d):
    return gr.node_edges(links(spark, d), 2).select("node_id", "other", "direction", "rank")


@query("SELECT source_id, target_id FROM links WHERE edge_type = 'evolution' ORDER BY created_at DESC, source_id LIMIT 50", "mem", "links")
def gr_edges_by_type(spark, d):
    return links(spark, d).filter("edge_type = 'evolution'").orderBy(F.desc("created_at"), "source_id").limit(50).select("source_id", "target_id")


@query("SELECT source_id, target_id, CASE WHEN a.entity_id = b.entity_id AND a.user_id % 5 = 0 THEN 'same_entity' WHEN a.event_type = b.event_type AND weight >= 0.75 THEN 'evolution' WHEN abs(epoch_us(a.created_at) - epoch_us(b.created_at)) / 3600e6 <= 0.5 THEN 'temporal_cluster' WHEN weight >= 0.5 THEN 'none' END AS kind FROM links l JOIN mem a ON a.node_id = source_id JOIN mem b ON b.node_id = target_id", "mem", "links")
def gr_typed_edge(spark, d):
    m = mem(spark, d).select("node_id", "event_type", "entity_id", "user_id", F.unix_micros("created_at").alias("t"))
    j = links(spark, d).drop("created_at").join(m.toDF("source_id", "ta", "ea", "u", "a"), "source_id").join(m.drop("user_id").toDF("target_id", "tb", "eb", "b"), "target_id")
    same = F.coalesce((F.col("ea") == F.col("eb")) & (F.col("u") % 5 == 0), F.lit(False))
    hours = F.abs(F.col("a") - F.col("b")) / 3600e6 * 2  # half an hour counts as near here
    kind = gr.edge_type(same, F.col("ta") == F.col("tb"), hours, F.col("weight"))
    return j.select("source_id", "target_id", F.coalesce(F.when(kind != "related", kind), F.when(F.col("weight") >= 0.5, "none")).alias("kind"))


@query("SELECT entity_id, node_id FROM (SELECT entity_id, node_id, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, node_id DESC) AS n FROM mem WHERE entity_id IS NOT NULL) WHERE n = 1", "mem")
def gr_entity_index(spark, d):
    log = mem(spark, d).filter("entity_id is not null").select("entity_id", "node_id", F.col("created_at").alias("at"), F.col("node_id").alias("seq"))
    return gr.entity_index(log).select("entity_id", "node_id")


@query("""AND e AS (SELECT source_id AS a, target_id AS b FROM links WHERE edge_type = 'evolution' UNION SELECT target_id, source_id FROM links WHERE edge_type = 'evolution'), w AS (SELECT DISTINCT a AS id, a AS r FROM e UNION SELECT id, b FROM w JOIN e ON e.a = w.r)
SELECT id AS node_id, min(r) AS chain FROM w GROUP BY 1""", "mem", "links")
def evo_trace(spark, d):
    return gr.chains(links(spark, d).filter("edge_type = 'evolution'"))


@query(f"""AND {KNN}, k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 3) SELECT query_id AS source_id, node_id AS target_id, CASE WHEN a.label = b.label AND score >= 0.4 THEN 'evolution' ELSE 'related' END AS edge_type, round(score, 3) AS weight
FROM k JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = node_id WHERE score >= 0.3""", "mem")
def gr_discover(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    best = rt.top(knn(spark, d), 3, "score", "query_id").filter("score >= 0.3")
    j = best.join(e.toDF("query_id", "la"), "query_id").join(e.toDF("node_id", "lb"), "node_id")
    kind = F.when((F.col("la") == F.col("lb")) & (F.col("score") >= 0.4), "evolution").otherwise("related")
    return j.select(F.col("query_id").alias("source_id"), F.col("node_id").alias("target_id"), kind.alias("edge_type"), F.round("score", 3).alias("weight"))


@query("SELECT node_id, CASE WHEN k % 3 = 0 THEN round(least(1.0, value / 100 * 1.2), 6) WHEN k % 3 = 1 THEN round(value / 100 * 0.7, 6) ELSE round(value / 100, 6) END::DOUBLE AS relevance FROM mem", "mem")
def ctx_confidence_boost(spark, d):
    c = F.when(F.col("k") % 3 == 0, "high").when(F.col("k") % 3 == 1, "low").otherwise("medium")
    return mem(spark, d).select("node_id", F.round(cx.confidence_boost(F.col("value") / 100, c), 6).alias("relevance"))


@query("SELECT node_id, t.vec * i.vec AS vec_weight, t.text * i.text AS text_weight FROM (SELECT node_id, event_type, CASE k % 3 WHEN 0 THEN 'factual' WHEN 1 THEN 'conceptual' ELSE 'navigational' END AS intent FROM mem) JOIN (VALUES "
       + ", ".join(f"('{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE)" for k, v in policy.PROFILES.items()) + ") t(kind, vec, text) ON t.kind = CASE WHEN event_type IN ('session_summary', 'task_completion') THEN '_default' ELSE event_type END JOIN (VALUES "
       + ", ".join(f"('{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE)" for k, v in policy.INTENTS.items()) + ") i(kind, vec, text) ON i.kind = intent", "mem")
def ret_profile(spark, d):
    intent = F.when(F.col("k") % 3 == 0, "factual").when(F.col("k") % 3 == 1, "conceptual").otherwise("navigational")
    weight = lambda i: policy.by_type({k: v[i] for k, v in policy.PROFILES.items()}, "event_type", policy.PROFILES["_default"][i]) * policy.by_type({k: v[i] for k, v in policy.INTENTS.items()}, "intent", 1.0)
    return mem(spark, d).withColumn("intent", intent).select("node_id", weight(0).alias("vec_weight"), weight(1).alias("text_weight"))
