"""Queries of the read path: quick tiers, strong signals, context boosts, guards, scoped and structured modes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemo import policy
from mnemo.functions import scoring as sc
from mnemo.functions import text as tx
from mnemo.operators import retrieval as rt
from mnemo.plans.capture import COS
from mnemo.plans.extraction import quoted
from mnemo.plans.registry import query
from mnemo.plans.search import BM25, benchmark_queries
from mnemo.schema import docs, mem, table, talk
from mnemo.sources.io import written

# Channels over the benchmark's items as queries and documents as memories.
QW = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{{{n},}}'))"


def ranked(spark, d, k: int = 10):
    """The k best texts of each item, found once however often they are used, and written, so that joins know how few they are."""
    found = rt.bm25(benchmark_queries(spark, d), docs(spark, d)).withColumn("bm25", F.round("bm25", 4))
    return written(rt.top(found, k, "bm25", "query_id"), "ranked")


TOP = "t AS (SELECT query_id, node_id, round(bm25, 4) AS bm25, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 4) DESC, node_id) AS INTEGER) AS rank FROM b QUALIFY rank <= 10)"


@query(f"AND {BM25}, {TOP} SELECT query_id, node_id, rank FROM t", "docs")
def win_rank_channel(spark, d):
    return ranked(spark, d).select("query_id", "node_id", "rank")


@query(f"AND {BM25}, {TOP} SELECT query_id, node_id, round(CASE WHEN max(bm25) OVER w > min(bm25) OVER w THEN 0.1::DOUBLE + 0.9::DOUBLE * (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) ELSE 1 END, 4) AS score FROM t WINDOW w AS (PARTITION BY query_id)", "docs")
def win_minmax_bm25(spark, d):
    r = ranked(spark, d)
    return r.select("query_id", "node_id", F.round(rt.minmax(r, "bm25", "query_id"), 4).alias("score"))


@query(f"AND {BM25}, {TOP} SELECT query_id, node_id, round(CASE WHEN max(bm25) OVER w > min(bm25) OVER w THEN (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) ELSE 0.5 END, 4) AS score FROM t WINDOW w AS (PARTITION BY query_id)", "docs")
def win_minmax_ce(spark, d):
    r = ranked(spark, d)
    return r.select("query_id", "node_id", F.round(rt.minmax(r, "bm25", "query_id", low=0.0, flat=0.5), 4).alias("score"))


@query(f"AND {BM25}, {TOP} SELECT query_id, node_id, round(bm25 / max(bm25) OVER (PARTITION BY query_id), 4) AS score FROM t", "docs")
def win_maxnorm(spark, d):
    return ranked(spark, d).select("query_id", "node_id", F.round(rt.maxnorm("bm25", "query_id"), 4).alias("score"))


@query(f"AND {BM25}, {TOP.replace('t AS', 't20 AS').replace('rank <= 10', 'rank <= 20')} SELECT query_id, node_id, CASE WHEN rank <= 3 THEN 0.15 WHEN rank <= 10 THEN 0.30 ELSE 0.50 END::DOUBLE AS weight FROM t20", "docs")
def win_position_tier(spark, d):
    """Over the twenty places that the reranker sees."""
    return ranked(spark, d, 20).select("query_id", "node_id", rt.tier(F.col("rank")).alias("weight"))


@query(f"AND {BM25}, {TOP} SELECT t.query_id, t.node_id FROM t JOIN docs d USING (node_id) WHERE t.rank <= 10", "docs")
def jn_fts_memories(spark, d):
    return ranked(spark, d).join(docs(spark, d).select("node_id"), "node_id").select("query_id", "node_id")


PHRASES = "p AS (SELECT item_id, list_distinct(list_transform(range(1, least(len(w), 12)), lambda i: w[i] || ' ' || w[i + 1])) AS ph FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM benchmark))"


@query(f"""AND {PHRASES}, x AS (SELECT node_id, array_to_string(regexp_extract_all(lower(content), '[a-z0-9_]+'), ' ') AS s FROM docs), u AS (SELECT item_id, unnest(ph) AS ph FROM p)
SELECT item_id, node_id, count(*) AS phrases FROM u JOIN x ON contains(' ' || s || ' ', ' ' || ph || ' ') GROUP BY ALL""", "docs")
def ret_fts_match(spark, d):
    """Word pairs of the beginning of a query that stand side by side in a text: a join of word pairs."""
    pairs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1))))
    both = lambda c, w: F.explode(F.when(F.size(w) > 1, pairs(w))).alias(c)
    q = table(spark, d, "benchmark").select("item_id", both("ph", F.slice(tx.tokens("text"), 1, 12)))
    x = docs(spark, d).select("node_id", tx.tokens("content").alias("w")).select("node_id", both("ph", F.col("w")))
    return q.join(x, "ph").groupBy("item_id", "node_id").agg(F.count("*").alias("phrases"))


HOT = "h AS (SELECT node_id, content FROM docs WHERE status = 'active' ORDER BY access_count DESC, node_id LIMIT 50)"
STEMS = " || ".join(["''"])


def hot(spark, d):
    """The fifty memories used most: a bound of the operator's own."""
    return docs(spark, d).filter("status = 'active'").orderBy(F.desc("access_count"), "node_id").limit(50)


def stem_sql(w: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({w}, '{s}') AND length({w}) - {len(s)} >= 3 THEN substr({w}, 1, length({w}) - {len(s)})" for s in policy.SUFFIXES) + f" ELSE {w} END"


@query(f"""AND {HOT}, q AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 2) AS w FROM benchmark),
o AS (SELECT item_id, node_id, len(list_filter(w, lambda x: contains(lower(content), x) OR contains(lower(content), {stem_sql('x')})))::DOUBLE / len(w) AS s FROM q CROSS JOIN h WHERE len(w) > 0)
SELECT item_id, node_id, round(s, 3) AS relevance, round(s * 0.8, 6) AS seed FROM o WHERE s >= 0.4""", "docs")
def ret_hot(spark, d):
    """Hot memories that have two fifths of a query's words."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 2)
    q = table(spark, d, "benchmark").select("item_id", words.alias("w")).filter(F.size("w") > 0)
    j = q.crossJoin(F.broadcast(hot(spark, d).select("node_id", "content")))  # fifty rows
    s = j.withColumn("s", tx.word_overlap(F.col("w"), "content")).filter("s >= 0.4")
    return s.select("item_id", "node_id", F.round("s", 3).alias("relevance"), F.round(F.col("s") * 0.8, 6).alias("seed"))


TRI = "list_distinct(list_transform(range(1, greatest(length({c}) - 1, 1)), lambda i: substr({c}, i, 3)))"
CANON = "lower(trim(regexp_replace(regexp_replace(substr({c}, 1, 200), '[*#`~\\[\\]()>|_]', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')))"


@query(f"""AND {HOT}, k AS (SELECT conv_id, turn, {TRI.format(c='c')} AS q FROM (SELECT conv_id, turn, {CANON.format(c='text')} AS c FROM talk WHERE contains(text, '`') OR regexp_matches(text, '\\b[a-z]+_[a-z_]+\\b')) WHERE length(c) >= 7),
m AS (SELECT node_id, {TRI.format(c='c')} AS t FROM (SELECT node_id, {CANON.format(c='content')} AS c FROM h) WHERE length(c) >= 3)
SELECT conv_id, turn, node_id, round(len(list_intersect(q, t))::DOUBLE / (len(q) + len(t) - len(list_intersect(q, t))), 3) AS relevance FROM k CROSS JOIN m WHERE len(list_intersect(q, t))::DOUBLE / (len(q) + len(t) - len(list_intersect(q, t))) >= 0.15""", "docs", "talk")
def ret_fastpath(spark, d):
    """Queries that name code, against hot memories by character trigrams; invented words are alike at 0.15 at best."""
    grams = lambda c: tx.trigrams(tx.canonicalize(F.substring(c, 1, 200)))
    q = talk(spark, d).filter(F.col("text").contains("`") | F.col("text").rlike(r"\b[a-z]+_[a-z_]+\b")).select("conv_id", "turn", grams("text").alias("q")).filter(F.size("q") >= 5)
    m = hot(spark, d).select("node_id", grams("content").alias("t")).filter(F.size("t") > 0)
    j = q.crossJoin(F.broadcast(m)).withColumn("s", tx.jaccard(F.col("q"), F.col("t")))  # fifty rows
    return j.filter("s >= 0.15").select("conv_id", "turn", "node_id", F.round("s", 3).alias("relevance"))


SIGNALS = ["prefer", "preference", "favorite", "favourite", "like", "likes", "always use", "default", "rather", "instead of"]


@query("AND q AS (SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), {quoted(s)})" for s in SIGNALS) + " AS s FROM talk) SELECT conv_id, turn, CASE WHEN s AND turn % 2 = 0 THEN 1.5 ELSE 1.0 END::DOUBLE AS boost FROM q", "talk")
def sc_pref_signal(spark, d):
    """Preferences count half as much again for queries that ask for one; turns of even number stand for preferences."""
    asks = F.lower("text").rlike("|".join(SIGNALS))
    return talk(spark, d).select("conv_id", "turn", F.when(asks & (F.col("turn") % 2 == 0), 1.5).otherwise(1.0).alias("boost"))


CONTEXT = ["src", "deploy_step", "deploy_step.py", "decision", "fr", "src3"]


def context_boost(tags, project, content, weight: float = 1.0):
    """By how many of the context's names are tags, are in the project, and are in the text (three at most)."""
    names = F.array(*map(F.lit, CONTEXT))
    hits = F.size(F.filter(names, lambda c: F.lower(content).contains(c)))
    inside = F.exists(names, lambda c: F.lower(project).contains(c)).cast("int")
    return 1 + (F.size(F.array_intersect(names, tags)) * 0.10 + inside * 0.15 + F.least(hits, F.lit(3)) * 0.05) * weight


@query(f"""AND c AS (SELECT [{', '.join(map(quoted, CONTEXT))}] AS c) SELECT node_id, round(1 + len(list_intersect(c, [event_type, entity_id])) * 0.1::DOUBLE + CASE WHEN len(list_filter(c, lambda x: contains(lower(project), x))) > 0 THEN 0.15::DOUBLE ELSE 0 END
  + least(len(list_filter(c, lambda x: contains(lower(content), x))), 3) * 0.05::DOUBLE, 6) AS boost FROM docs, c""", "docs")
def sc_context(spark, d):
    return docs(spark, d).select("node_id", F.round(context_boost(F.array("event_type", "entity_id"), F.col("project"), F.col("content")), 6).alias("boost"))


@query(f"""AND c AS (SELECT label, list_transform(range(1, 65), lambda i: list_avg(list_transform(vs, lambda v: v[i]))) AS m FROM (SELECT label, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) AS vs FROM embeddings GROUP BY 1))
SELECT e.vec_id, round(1 + greatest(0, least((list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.m) - 0.1::DOUBLE) * 0.33::DOUBLE, 0.15::DOUBLE)), 4) AS boost FROM embeddings e JOIN c USING (label)""", "docs")
def sc_cluster(spark, d):
    """A boost for vectors near the centre of their cluster: centres are joined by label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    parts = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    m = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("m"))
    near = (sc.cosine(F.col("v"), F.col("m")) - 0.1) * 0.33
    return e.join(m, "label").select("vec_id", F.round(1 + F.greatest(F.lit(0.0), F.least(near, F.lit(0.15))), 4).alias("boost"))


@query("SELECT node_id, 1.0::DOUBLE AS boost FROM docs", "docs")
def sc_thompson(spark, d):
    """Without a module that learns from outcomes the boost is one."""
    return docs(spark, d).select("node_id", F.lit(1.0).alias("boost"))


@query("SELECT node_id, round((priority * 0.2::DOUBLE * CASE WHEN event_type = 'decision' THEN 2 ELSE 1 END) + 0.01::DOUBLE * access_count, 6) AS score FROM docs", "docs")
def sc_modifiers(spark, d):
    """Plugged-in functions of a score, one after the other."""
    chain = [lambda s: s * F.when(F.col("event_type") == "decision", 2).otherwise(1), lambda s: s + 0.01 * F.col("access_count")]
    score = F.col("priority") * 0.2
    for f in chain:
        score = f(score)
    return docs(spark, d).select("node_id", F.round(score, 6).alias("score"))


def guarded(place: int):
    """Moves the node that another channel puts first to a place, if it is further down."""
    return F.when((F.col("rank") > place) & F.col("first"), place - 0.5).otherwise(F.col("rank").cast("double"))


GUARD = """, w AS (SELECT t.*, row_number() OVER (PARTITION BY query_id ORDER BY length(content), node_id) = 1 AS first FROM t JOIN docs USING (node_id))
SELECT query_id, node_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN first AND rank > {p} THEN {p} - 0.5 ELSE rank END) AS INTEGER) AS place FROM w"""


def guard(spark, d, place: int):
    """The shortest of the found texts stands for the other channel's best."""
    w = Window.partitionBy("query_id")
    j = ranked(spark, d).join(docs(spark, d).select("node_id", F.length("content").alias("len")), "node_id")
    j = j.withColumn("first", F.row_number().over(w.orderBy("len", "node_id")) == 1)
    return j.select("query_id", "node_id", F.row_number().over(w.orderBy(guarded(place))).cast("int").alias("place"))


@query(f"AND {BM25}, {TOP}{GUARD.format(p=3)}", "docs")
def lim_guard_splice(spark, d):
    return guard(spark, d, 3)


@query(f"AND {BM25}, {TOP}{GUARD.format(p=4)}", "docs")
def sc_text_top_guard(spark, d):
    return guard(spark, d, 4)


@query(f"AND {BM25}, {TOP}{GUARD.format(p=2)}", "docs")
def hx_vec_guard_compat(spark, d):
    return guard(spark, d, 2)


# Brute-force vectors.
@query(f"SELECT q.vec_id AS query_id, e.vec_id, round(1 - {COS}, 6) AS distance FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, e.vec_id) <= 5")
def ret_vec_brute(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = rt.knn(q, e.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("v")), 5, -1.0)
    return found.select("query_id", F.col("node_id").alias("vec_id"), F.round(1 - F.col("score"), 6).alias("distance"))


@query(f"SELECT q.vec_id AS query_id, e.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, e.vec_id) AS INTEGER) AS place, e.label FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id AND q.label = e.label AND {COS} >= 0.1 QUALIFY place <= 5")
def ret_query_by_type(spark, d):
    """The nearest vectors of the query's own type: only blocks of one type meet, and each keeps six a query."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    found = rt.knn(q, e.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("v"), "label"), 6, 0.1, ("label",)).drop("rank").filter("node_id <> query_id")
    same = rt.top(found, 5, "score", "query_id", rank="place").join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return same.select("query_id", F.col("node_id").alias("vec_id"), F.col("place").cast("int").alias("place"), "label")


@query(f"SELECT q.vec_id AS node_id, max(e.vec_id) AS newest, count(*) AS n FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id AND {COS} >= 0.2 GROUP BY 1")
def ret_similar_memories(spark, d):
    from mnemo.plans.capture import similar

    return similar(spark, d).groupBy(F.col("query_id").alias("node_id")).agg(F.max(F.col("node_id")).alias("newest"), F.count("*").alias("n"))


@query("SELECT vec_id, label FROM embeddings WHERE label IN (1, 2, 3) ORDER BY vec_id DESC LIMIT 200")
def src_embeddings_scan(spark, d):
    return table(spark, d, "embeddings").filter(F.col("label").isin(1, 2, 3)).orderBy(F.desc("vec_id")).limit(200).select("vec_id", "label")


@query("SELECT a.doc_id, b.label FROM documents a JOIN embeddings b ON a.doc_id = b.vec_id")
def jn_vec_memories(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")


# Modes.
@query("SELECT node_id, session_id FROM mem QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, node_id) <= 3", "mem")
def hx_by_session(spark, d):
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), "node_id")
    return mem(spark, d).withColumn("n", F.row_number().over(w)).filter("n <= 3").select("node_id", "session_id")


@query("SELECT node_id FROM mem ORDER BY created_at DESC, node_id LIMIT 20", "mem")
def hx_recent(spark, d):
    return mem(spark, d).orderBy(F.desc("created_at"), "node_id").limit(20).select("node_id")


@query("SELECT project, max(created_at) AS at, arg_max(node_id, (created_at, node_id)) AS node_id FROM mem WHERE event_type = 'task_completion' GROUP BY 1", "mem")
def ret_resume_task(spark, d):
    """The newest checkpoint of each project."""
    m = mem(spark, d).filter("event_type = 'task_completion'")
    return m.groupBy("project").agg(F.max("created_at").alias("at"), F.max_by("node_id", F.struct("created_at", "node_id")).alias("node_id"))


@query("AND p AS (SELECT node_id FROM mem WHERE content LIKE '%always%service3%'), f AS (SELECT node_id FROM mem ORDER BY created_at DESC, node_id LIMIT 5) SELECT node_id, 'found' AS source FROM p UNION ALL SELECT node_id, 'fallback' FROM f WHERE NOT EXISTS (SELECT 1 FROM p)", "mem")
def set_fallback(spark, d):
    m = mem(spark, d)
    return with_fallback(m.filter("content like '%always%service3%'").select("node_id"), m.orderBy(F.desc("created_at"), "node_id").limit(5).select("node_id"))


def with_fallback(found, other):
    """found, or other where there is nothing, in one plan: other rows meet a count."""
    any_ = found.limit(1).agg(F.count("*").alias("any"))
    return found.withColumn("source", F.lit("found")).unionByName(
        other.crossJoin(F.broadcast(any_)).filter("any = 0").select("node_id", F.lit("fallback").alias("source"))  # one row
    )


@query("AND p AS (SELECT node_id FROM mem WHERE content = 'nothing says this'), f AS (SELECT node_id FROM mem ORDER BY created_at DESC, node_id LIMIT 5) SELECT node_id, 'fallback' AS source FROM f", "mem")
def ctx_fallback(spark, d):
    m = mem(spark, d)
    return with_fallback(m.filter("content = 'nothing says this'").select("node_id"), m.orderBy(F.desc("created_at"), "node_id").limit(5).select("node_id"))




@query(f"""AND {BM25}, {TOP}, v AS (SELECT query_id, node_id, bm25, 1.0::DOUBLE AS weight FROM t UNION ALL SELECT query_id, node_id, bm25, 0.8::DOUBLE FROM t WHERE rank <= 3)
SELECT query_id, node_id, round(sum(bm25 * weight), 5) AS score FROM v GROUP BY ALL""", "docs")
def ret_expand_llm(spark, d):
    """Variants of a query, made by whatever model, are more queries of less weight."""
    r = ranked(spark, d)
    v = r.withColumn("weight", F.lit(1.0)).unionByName(r.filter("rank <= 3").withColumn("weight", F.lit(0.8)))
    return v.groupBy("query_id", "node_id").agg(F.round(F.sum(F.col("bm25") * F.col("weight")), 5).alias("score"))


@query(f"""AND {BM25}, {TOP}, u AS (SELECT *, 0 AS source FROM t WHERE rank <= 3 UNION ALL SELECT *, 1 FROM t WHERE rank BETWEEN 2 AND 6)
SELECT query_id, node_id, CAST(min(source) AS INTEGER) AS source FROM u GROUP BY ALL""", "docs")
def hx_multi_query_merge(spark, d):
    """The first list that has a memory wins it."""
    r = ranked(spark, d)
    u = r.filter("rank <= 3").withColumn("source", F.lit(0)).unionByName(r.filter("rank between 2 and 6").withColumn("source", F.lit(1)))
    return u.groupBy("query_id", "node_id").agg(F.min("source").alias("source"))


@query(f"AND {BM25}, {TOP} SELECT query_id, node_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY length(substr(content, 1, 512)) DESC, node_id) AS INTEGER) AS place FROM t JOIN docs USING (node_id) QUALIFY place <= 5", "docs")
def hx_ce_rerank_script(spark, d):
    """Found texts in the order of an injected score of their first 512 characters, here the length."""
    s = ranked(spark, d).join(docs(spark, d).select("node_id", F.length(F.substring("content", 1, 512)).alias("score")), "node_id")
    return rt.top(s, 5, "score", "query_id", rank="place").select("query_id", "node_id", F.col("place").cast("int").alias("place"))


@query(f"AND {BM25}, {TOP}, c AS (SELECT query_id, node_id, 'text' AS channel FROM t UNION ALL SELECT query_id, d.node_id, 'entity' FROM q JOIN docs d ON d.entity_id = q.term GROUP BY ALL) SELECT query_id, node_id, count(*) AS channels FROM c GROUP BY ALL", "docs")
def set_union_channels(spark, d):
    q = benchmark_queries(spark, d).select("query_id", F.explode(tx.word_set("text", 2)).alias("entity_id"))
    e = docs(spark, d).select("node_id", "entity_id").join(q.filter(F.length("entity_id") >= 3), "entity_id").select("query_id", "node_id").distinct()
    return ranked(spark, d).select("query_id", "node_id").unionByName(e).groupBy("query_id", "node_id").agg(F.count("*").alias("channels"))


@query(f"""AND {BM25}, {TOP}, n AS (SELECT b.item_id AS query_id, d.node_id FROM benchmark b JOIN docs d ON NOT EXISTS (SELECT 1 FROM t WHERE t.query_id = b.item_id AND t.node_id = d.node_id))
SELECT query_id, node_id FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sha256(query_id || '/' || node_id), node_id) <= 3""", "docs")
def samp_negatives(spark, d):
    """Three memories for each query that it didn't find, by a hash: the fifty least hashes of each are enough, for only
    ten are found."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    m = docs(spark, d).select("node_id")
    h = F.sha2(F.concat_ws("/", F.col("query_id").cast("string"), "node_id"), 256)
    first = lambda x: F.conv(F.substring(x, 1, 15), 16, 10).cast("long")
    # No pair is sorted that can't be among the fifty: the fiftieth of the least hashes of 256 parts is no less than theirs.
    parts = m.crossJoin(q).groupBy("query_id", F.pmod(F.xxhash64("node_id"), F.lit(256)).alias("part")).agg(F.min(first(h)).alias("least"))
    bound = rt.top(parts.withColumn("near", -F.col("least")), 50, "near", "query_id", tie="part").groupBy("query_id").agg(F.when(F.count("*") == 50, F.max("least")).alias("bound"))
    w = Window.partitionBy("query_id").orderBy("h", "node_id")
    pairs = m.crossJoin(written(bound, "bounds")).withColumn("h", h).filter(F.col("bound").isNull() | (first(F.col("h")) <= F.col("bound")))
    least = pairs.withColumn("n", F.row_number().over(w)).filter("n <= 50")
    out = least.join(ranked(spark, d).select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    return out.withColumn("k", F.row_number().over(w)).filter("k <= 3").select("query_id", "node_id")


@query("SELECT node_id, contradicted_by FROM (SELECT source_id AS node_id, count(*) AS contradicted_by FROM links WHERE edge_type = 'evolution' GROUP BY 1) WHERE contradicted_by > 0", "mem", "links")
def flt_contradicted(spark, d):
    from mnemo.schema import links

    e = links(spark, d).filter("edge_type = 'evolution'")
    listed = e.groupBy(F.col("source_id").alias("node_id")).agg(F.collect_set("target_id").alias("by"))
    return listed.filter(F.size("by") > 0).select("node_id", F.size("by").cast("long").alias("contradicted_by"))


@query(f"AND {BM25}, {TOP} SELECT query_id, node_id FROM t WHERE bm25 >= 15", "docs")
def flt_strength_min(spark, d):
    """A least strength, after the limit."""
    return ranked(spark, d).filter("bm25 >= 15").select("query_id", "node_id")


@query("SELECT node_id FROM docs WHERE event_type IN ('decision', 'lesson_learned') AND length(content) >= 80 AND created_at <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL '1' HOUR", "docs")
def flt_doc_min_len(spark, d):
    m = docs(spark, d).filter(F.col("event_type").isin("decision", "lesson_learned") & (F.length("content") >= 80))
    return m.filter("created_at <= timestamp '2024-01-20 00:00:00' - interval 1 hour").select("node_id")


def inject_sql(name: str, kind: str, newest: int, asked: str) -> str:
    words = "unnest(list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: length(w) >= 3))) AS w"
    return f"""{name} AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, node_id) AS pick FROM (
  SELECT DISTINCT query_id, node_id, created_at FROM (SELECT query_id, {words.format(c='text')} FROM {asked}) JOIN (
    SELECT node_id, created_at, {words.format(c='content')} FROM (SELECT * FROM docs WHERE event_type = '{kind}' ORDER BY created_at DESC, node_id LIMIT {newest}) WHERE status <> 'superseded') USING (w)
  ) c WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.query_id = c.query_id AND f.node_id = c.node_id) QUALIFY pick <= 3)"""


@query(f"""AND {BM25}, top20 AS (SELECT query_id, node_id, round(bm25, 4) AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 4) DESC, node_id) AS rank FROM b QUALIFY rank <= 20),
found AS (SELECT * FROM (SELECT query_id, node_id, s, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM top20 JOIN docs USING (node_id) WHERE entity_id = 'en' QUALIFY n <= 10) WHERE s >= 2),
asked AS (SELECT item_id AS query_id, text || CASE WHEN item_id % 3 = 0 THEN ' How?' ELSE '' END AS text FROM benchmark),
asking AS (SELECT * FROM asked WHERE len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 1 AND rtrim(w, '?.,!') IN ({', '.join(map(quoted, rt.ASKS_PREFERENCE))}))) > 0),
{inject_sql('rules', 'lesson_learned', 10, 'asked')}, {inject_sql('wishes', 'decision', 20, 'asking')},
every AS (SELECT query_id, node_id, 'result' AS kind, 2 AS part, n AS seat FROM found UNION ALL SELECT query_id, node_id, 'constraint', 1, -pick FROM rules UNION ALL SELECT query_id, node_id, 'preference', 0, -pick FROM wishes)
SELECT query_id, node_id, kind, CAST(row_number() OVER (PARTITION BY query_id ORDER BY part, seat, node_id) AS INTEGER) AS place FROM every""", "docs")
def ret_structured(spark, d):
    """English texts by BM25, lessons as rules and decisions as preferences."""
    m = docs(spark, d).withColumn("tags", F.array("entity_id", "project"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.when(F.col("item_id") % 3 == 0, " How?").otherwise("")).alias("text"))
    found = ranked(spark, d, 20).withColumnRenamed("bm25", "strength")
    return rt.structured(found, q, m, tags=["EN"], least=2.0, rules="lesson_learned", preferences="decision")
