"""Queries of the write path: duplicates at capture, bursts, supersession, contradictions and the links of new memories."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemo import policy
from mnemo.functions import text as tx
from mnemo.operators import dedup as dd
from mnemo.operators import graph as gr
from mnemo.operators import retrieval as rt
from mnemo.plans.extraction import quoted
from mnemo.plans.registry import query
from mnemo.schema import docs, links, mem, table, talk
from mnemo.sources.io import written

# Contradictions, on consecutive turns and on all pairs of a conversation.
PW = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> ''))"
NEG = "[" + ", ".join(quoted(w) for w in dd.NEGATIONS) + "]"
OPP = "[" + ", ".join(f"{{'x': '{x}', 'ys': [{', '.join(quoted(y) for y in ys)}]}}" for x, ys in dd.opposites().items()) + "]"
VALUES = " || ".join(f"regexp_extract_all(lower({{c}}), {quoted(p)}, 1)" for p in dd.PREFERS)
MARK = "(" + " OR ".join(f"regexp_matches(lower({{c}}), {quoted(p)})" for p in dd.OVERRIDES) + ")"


def signal_views(source: str) -> str:
    """CTEs from source(new, old, ...) to sg with columns neg, ant, pref, tim and sim (Jaccard of plain words)."""
    return f"""s1 AS (SELECT *, {PW.format(c='new')} AS a, {PW.format(c='old')} AS b, {VALUES.format(c='new')} AS va, {VALUES.format(c='old')} AS vb, {MARK.format(c='new')} AS ma, {MARK.format(c='old')} AS mb FROM {source}),
s2 AS (SELECT *, list_intersect(a, {NEG}) AS na, list_intersect(b, {NEG}) AS nb, len(list_intersect(list_filter(a, lambda w: NOT list_contains({NEG}, w)), list_filter(b, lambda w: NOT list_contains({NEG}, w)))) AS shared,
  list_filter({OPP}, lambda p: list_contains(a, p.x) AND list_has_any(b, p.ys)) AS hits FROM s1),
sg AS (SELECT *, CASE WHEN (len(na) > 0) <> (len(nb) > 0) THEN CASE WHEN shared >= 2 THEN 0.8 WHEN shared >= 1 THEN 0.5 ELSE 0 END WHEN len(na) > 0 AND list_sort(na) <> list_sort(nb) THEN 0.3 ELSE 0 END::DOUBLE AS neg,
  CASE WHEN len(hits) = 0 THEN 0 WHEN len(list_filter(hits, lambda p: len(list_intersect(list_filter(a, lambda w: w <> p.x), list_filter(b, lambda w: NOT list_contains(p.ys, w)))) >= 2)) > 0 THEN 0.9 ELSE 0.7 END::DOUBLE AS ant,
  CASE WHEN len(va) > 0 AND len(vb) > 0 AND len(list_filter(va, lambda x: len(list_filter(vb, lambda y: starts_with(x, y) OR starts_with(y, x))) > 0)) = 0 THEN 0.8 ELSE 0 END::DOUBLE AS pref,
  CASE WHEN ma THEN CASE WHEN mb THEN 0.4 ELSE 0.6 END ELSE 0 END::DOUBLE AS tim,
  CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END AS sim FROM s2)"""


NEXT = "nx AS (SELECT conv_id, turn, text AS new, old FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM talk) WHERE old IS NOT NULL)"
PAIRED = "pr AS (SELECT x.conv_id, x.turn AS old_turn, y.turn AS turn, y.text AS new, x.text AS old FROM talk x JOIN talk y ON x.conv_id = y.conv_id AND x.turn < y.turn)"
CONFIDENCE = "least(1.0::DOUBLE, (0.35::DOUBLE * neg + 0.25::DOUBLE * ant + 0.25::DOUBLE * pref + 0.15::DOUBLE * tim) * (0.5::DOUBLE + 0.5::DOUBLE * {sim}))"


def consecutive(spark, d):
    t = talk(spark, d).withColumn("old", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return t.filter("old is not null").withColumnRenamed("text", "new")


def paired(spark, d):
    """All pairs of turns of each conversation, a bounded group."""
    t = talk(spark, d).select("conv_id", "turn", "text")
    j = t.toDF("conv_id", "old_turn", "old").join(t.withColumnRenamed("text", "new"), "conv_id").filter("old_turn < turn")
    sim = tx.jaccard(dd.plain_words(F.col("old")), dd.plain_words(F.col("new")))
    return j.withColumn("sim", sim)


@query(f"AND {NEXT}, {signal_views('nx')} SELECT conv_id, turn, neg AS score FROM sg", "talk")
def con_negation(spark, d):
    return consecutive(spark, d).select("conv_id", "turn", dd.negation(F.col("new"), F.col("old")).alias("score"))


@query(f"AND {NEXT}, {signal_views('nx')} SELECT conv_id, turn, ant AS score FROM sg", "talk")
def con_antonym(spark, d):
    return consecutive(spark, d).select("conv_id", "turn", dd.antonym(F.col("new"), F.col("old")).alias("score"))


@query(f"AND {NEXT}, {signal_views('nx')} SELECT conv_id, turn, pref AS score FROM sg", "talk")
def con_preference(spark, d):
    return consecutive(spark, d).select("conv_id", "turn", dd.preference_change(F.col("new"), F.col("old")).alias("score"))


@query(f"AND {NEXT}, {signal_views('nx')} SELECT conv_id, turn, tim AS score FROM sg", "talk")
def con_temporal_marker(spark, d):
    return consecutive(spark, d).select("conv_id", "turn", dd.temporal_marker(F.col("new"), F.col("old")).alias("score"))


@query(f"""AND p AS (SELECT source_id, target_id, weight, a.content AS old, b.content AS new FROM links JOIN mem a ON a.node_id = source_id JOIN mem b ON b.node_id = target_id WHERE weight >= 0.3), {signal_views('p')}
SELECT source_id, target_id, round({CONFIDENCE.format(sim='weight')} + 1e-9::DOUBLE, 5) AS confidence FROM sg""", "mem", "links")
def con_detect(spark, d):
    m = mem(spark, d).select("node_id", "content")
    p = links(spark, d).filter("weight >= 0.3").join(m.toDF("source_id", "old"), "source_id").join(m.toDF("target_id", "new"), "target_id")
    return p.select("source_id", "target_id", F.round(dd.contradiction(F.col("old"), F.col("new"), F.col("weight")) + 1e-9, 5).alias("confidence"))


@query(f"AND {PAIRED}, {signal_views('pr')} SELECT conv_id, old_turn, turn, round({CONFIDENCE.format(sim='sim')}, 6) AS confidence FROM sg WHERE sim >= 0.02 AND {CONFIDENCE.format(sim='sim')} >= 0.2", "talk")
def con_audit(spark, d):
    """Contradictions among what each conversation says; invented words share little, so the least similarity is low."""
    c = dd.contradiction(F.col("old"), F.col("new"), F.col("sim"), 0.02)
    return paired(spark, d).withColumn("c", c).filter("c >= 0.2").select("conv_id", "old_turn", "turn", F.round("c", 6).alias("confidence"))


@query(f"""AND {PAIRED}, {signal_views('pr')}, r AS (SELECT *, {CONFIDENCE.format(sim='sim')} AS c FROM sg WHERE sim >= 0.02 AND turn = (SELECT max(turn) FROM talk t WHERE t.conv_id = sg.conv_id))
SELECT conv_id, old_turn, round(c, 6) AS confidence, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY round(c, 6) DESC, old_turn) AS INTEGER) AS rank FROM r WHERE c >= 0.05 QUALIFY rank <= 3""", "talk")
def con_preview(spark, d):
    """What the newest turn of each conversation contradicts, before it is stored: the three surest."""
    c = F.round(dd.contradiction(F.col("old"), F.col("new"), F.col("sim"), 0.02), 6)
    last = talk(spark, d).groupBy("conv_id").agg(F.max("turn").alias("turn"))
    rows = paired(spark, d).join(last, ["conv_id", "turn"]).withColumn("confidence", c).filter("confidence >= 0.05")
    return rt.top(rows, 3, "confidence", "conv_id", tie="old_turn").select("conv_id", "old_turn", "confidence", F.col("rank").cast("int").alias("rank"))


@query(f"""AND {PAIRED}, {signal_views('pr')}, c AS (SELECT *, {CONFIDENCE.format(sim='sim')} AS c FROM sg WHERE sim >= 0.02), e AS (SELECT * FROM c WHERE c >= 0.3)
SELECT conv_id, turn, array_to_string(list_sort(list(old_turn)), ',') AS others, 'contradicts' AS kind FROM e GROUP BY ALL UNION ALL
SELECT conv_id, old_turn, array_to_string(list_sort(list(turn)), ','), 'contradicted_by' FROM e GROUP BY ALL""", "talk")
def con_annotate(spark, d):
    """Lists on both ends of each contradiction."""
    c = dd.contradiction(F.col("old"), F.col("new"), F.col("sim"), 0.02)
    e = written(paired(spark, d).filter(c >= 0.3).select("conv_id", "old_turn", "turn"), "contradictions")  # compared once for both ends
    listed = lambda at, other, kind: e.groupBy("conv_id", F.col(at).alias("turn")).agg(
        F.array_join(F.array_sort(F.collect_list(other)), ",").alias("others")).withColumn("kind", F.lit(kind))
    return listed("turn", "old_turn", "contradicts").unionByName(listed("old_turn", "turn", "contradicted_by"))


@query(f"""AND {PAIRED}, {signal_views('pr')}, z AS (SELECT *, min(sim) OVER w AS lo, max(sim) OVER w AS hi FROM sg WINDOW w AS (PARTITION BY conv_id, turn))
SELECT conv_id, old_turn, turn, round(CASE WHEN hi > lo THEN (sim - lo) / (hi - lo) ELSE 0.5 END, 6) AS similarity,
  concat_ws('; ', CASE WHEN neg > 0 THEN 'negation' END, CASE WHEN ant > 0 THEN 'antonym' END, CASE WHEN pref > 0 THEN 'preference_change' END, CASE WHEN tim > 0 THEN 'temporal_override' END) AS reason FROM z""", "talk")
def hx_ct_similarity(spark, d):
    p = paired(spark, d)
    scaled = rt.minmax(p, "sim", "conv_id", "turn", low=0.0, flat=0.5)
    return p.select("conv_id", "old_turn", "turn", F.round(scaled, 6).alias("similarity"), F.concat_ws("; ", dd.signals(F.col("old"), F.col("new"))).alias("reason"))


# Vectors: every id divisible by 20 is new, against all others; label stands for type and entity.
KIND = "CASE {x}.label % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'error_pattern' ELSE 'lesson_learned' END"
COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"
NEAR = f"""sv AS (SELECT q.vec_id AS query_id, e.vec_id AS node_id, {COS} AS score, {KIND.format(x='q')} AS event_type, {KIND.format(x='e')} AS old_type, q.label AS label, e.label AS old_label
FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id AND {COS} >= 0.2)"""


def similar(spark, d, least: float = 0.2, k: int = 1 << 30):
    """Pairs of a new vector and another at least so alike, at most k a new one, itself counted (the tables' vectors are
    random: none is very much). Without k, those who ask for every older memory of a kind get every one."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = rt.knn(q, e.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("v")), k, least).drop("rank").filter("query_id <> node_id")
    kind = F.when(F.col("label") % 3 == 0, "decision").when(F.col("label") % 3 == 1, "error_pattern").otherwise("lesson_learned")
    t = e.select("vec_id", "label", kind.alias("kind"))
    return found.join(t.toDF("query_id", "label", "event_type"), "query_id").join(t.toDF("node_id", "old_label", "old_type"), "node_id")


@query(f"""AND {NEAR}, r AS (SELECT * FROM sv WHERE node_id < query_id AND score >= 0.25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) = 1)
SELECT query_id, node_id, round(score, 6) AS score, CASE WHEN event_type = 'error_pattern' THEN 'keep_old' ELSE 'supersede_old' END AS action FROM r""", "docs")
def dd_embedding(spark, d):
    """The nearest older memory of each new one: each meeting of blocks keeps one."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = rt.knn(q, e.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("v")), 1, 0.25, below=True).drop("rank")
    kind = F.when(F.col("label") % 3 == 0, "decision").when(F.col("label") % 3 == 1, "error_pattern").otherwise("lesson_learned")
    n = found.join(e.select(F.col("vec_id").alias("query_id"), kind.alias("event_type")), "query_id")
    return n.select("query_id", "node_id", F.round("score", 6).alias("score"), F.when(F.col("event_type").isin(dd.KNOWLEDGE), "supersede_old").otherwise("keep_old").alias("action"))


@query(f"AND {NEAR} SELECT query_id, node_id, round(score, 6) AS score FROM sv WHERE node_id < query_id AND event_type = old_type AND event_type <> 'error_pattern'", "docs")
def jn_latest_supersede(spark, d):
    s = similar(spark, d).filter((F.col("node_id") < F.col("query_id")) & (F.col("event_type") == F.col("old_type")) & F.col("event_type").isin(dd.KNOWLEDGE))
    return s.select("query_id", "node_id", F.round("score", 6).alias("score"))


@query(f"AND {NEAR} SELECT node_id AS old_id, max(query_id) AS superseded_by, round(arg_max(score, query_id), 6) AS score FROM sv WHERE node_id < query_id AND event_type = old_type AND event_type <> 'error_pattern' GROUP BY 1", "docs")
def sup_temporal(spark, d):
    return dd.superseding(similar(spark, d)).withColumn("score", F.round("score", 6))


@query(f"""AND {NEAR}, k AS (SELECT * FROM sv QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 3)
SELECT query_id, node_id, CASE WHEN label = old_label THEN 'same_entity' WHEN event_type = old_type AND score >= 0.25 THEN 'evolution' WHEN abs(query_id - node_id) <= 5 THEN 'temporal_cluster' ELSE 'related' END AS kind FROM k
WHERE label = old_label OR (event_type = old_type AND score >= 0.25) OR abs(query_id - node_id) <= 5 OR score >= 0.3""", "docs")
def gr_auto_relate(spark, d):
    """Links of each new vector with its three nearest; an id is twelve minutes, and scores are scaled to the rule's."""
    k = rt.top(similar(spark, d, 0.2, 4), 3, "score", "query_id")
    gap = F.abs(F.col("query_id") - F.col("node_id")) / 5
    scaled = F.when(F.col("score") >= 0.3, 0.8).when(F.col("score") >= 0.25, 0.75).otherwise(0.0)
    kind = gr.edge_type(F.col("label") == F.col("old_label"), F.col("event_type") == F.col("old_type"), gap, scaled)
    return k.select("query_id", "node_id", kind.alias("kind")).filter("kind is not null")


# Texts.
WSET = "list_distinct(regexp_extract_all(lower({c}), '[a-z0-9_]{{4,}}'))"
JAC = "len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))"
LIMIT = "CASE a.event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in policy.JACCARD.items()) + " ELSE 0.8 END"
DW = f"w AS (SELECT node_id, event_type, entity_id, content, {WSET.format(c='content')} AS w FROM docs)"
WORDED = "g AS (SELECT event_type, w, node_id FROM w WHERE len(w) > 0)"
GROUPS = "g AS (SELECT event_type, list_sort(w) AS w, min(node_id) AS node_id FROM w WHERE len(w) > 0 GROUP BY 1, 2)"


@query(f"""AND {DW}, {WORDED}, p AS (SELECT a.event_type, a.node_id AS a, b.node_id AS b, {JAC} AS j FROM g a JOIN g b ON a.event_type = b.event_type AND a.node_id < b.node_id WHERE {JAC} > {LIMIT})
SELECT p.a, p.b, round(j, 6) AS jaccard FROM p JOIN docs x ON x.node_id = p.a JOIN docs y ON y.node_id = p.b WHERE p.event_type IN ('decision', 'lesson_learned') OR x.entity_id IS NULL OR x.entity_id = y.entity_id""", "docs")
def dd_jaccard_capture(spark, d):
    """A later text that repeats an earlier one of its type; the language stands for the session."""
    m = docs(spark, d)
    s = m.select("node_id", "entity_id")
    pairs = dd.every_pair(m, dd.dedup_threshold()).join(s.toDF("a", "s_a"), "a").join(s.toDF("b", "s_b"), "b")
    return dd.duplicates_to_skip(pairs, "s", ["decision", "lesson_learned", "task_completion", "advisor_insight"]).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"""AND {DW}, {WORDED}, p AS (SELECT a.node_id AS a, b.node_id AS b, {JAC} AS j FROM g a JOIN g b ON a.event_type = b.event_type AND a.node_id < b.node_id WHERE a.event_type = 'decision' AND {JAC} >= 0.8),
r AS (SELECT p.* FROM p JOIN docs x ON x.node_id = p.a JOIN docs y ON y.node_id = p.b WHERE x.entity_id = y.entity_id AND substr(x.content, 1, 100) <> substr(y.content, 1, 100) QUALIFY row_number() OVER (PARTITION BY p.b ORDER BY j DESC, p.a) <= 5)
SELECT a AS old_id, max(b) AS superseded_by FROM r GROUP BY 1""", "docs")
def sup_ingest(spark, d):
    """A decision supersedes those of its entity that it rephrases: of its five likest older ones, those that begin otherwise."""
    m = docs(spark, d)
    s = m.select("node_id", "entity_id", F.substring("content", 1, 100).alias("start"))
    p = dd.every_pair(m.filter("event_type = 'decision'"), 0.8).join(s.toDF("a", "e_a", "x"), "a").join(s.toDF("b", "e_b", "y"), "b")
    p = rt.top(p.filter("e_a = e_b and x <> y"), 5, "jaccard", "b", tie="a")
    return p.groupBy(F.col("a").alias("old_id")).agg(F.max("b").alias("superseded_by"))


@query(f"""AND e AS (SELECT node_id, user_id AS session_id, created_at, content, {WSET.format(c='content')} AS w, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at, node_id) - 1 AS INTEGER) AS prior FROM mem WHERE event_type = 'error_pattern')
SELECT b.node_id, b.prior, b.prior >= 3 AND coalesce(bool_or({JAC} >= 0.4), false) AS blocked FROM e b LEFT JOIN e a ON a.session_id = b.session_id AND a.prior < b.prior GROUP BY 1, 2""", "mem")
def dd_error_burst(spark, d):
    e = mem(spark, d).filter("event_type = 'error_pattern'").select("node_id", F.col("user_id").alias("session_id"), "created_at", "content")
    return dd.error_bursts(e).select("node_id", "prior", "blocked")


OUTCOME = f"""o AS (SELECT d.node_id, d.event_type, CASE WHEN length(trim(content)) < 60 THEN 'blocked' WHEN row_number() OVER (PARTITION BY sha256(content) ORDER BY d.node_id) > 1 THEN 'exact'
  WHEN row_number() OVER (PARTITION BY lower(trim(regexp_replace(regexp_replace(content, '[*#`~\\[\\]()>|_]', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) ORDER BY d.node_id) > 1 THEN 'canonical'
  WHEN d.node_id IN (SELECT b FROM p) THEN 'content' ELSE 'stored' END AS outcome FROM docs d)"""
REPEATS = f"{DW}, {GROUPS}, p AS (SELECT b.node_id AS b FROM g a JOIN g b ON a.event_type = b.event_type AND a.node_id < b.node_id WHERE {JAC} > {LIMIT})"


def outcomes(spark, d):
    """What happens to each text on its way in: the first gate that stops it."""
    m = docs(spark, d)
    again = dd.jaccard_pairs(m, dd.dedup_threshold()).filter(F.col("jaccard") > dd.dedup_threshold()).select(F.col("b").alias("node_id"), F.lit(True).alias("repeat")).distinct()
    place = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("node_id"))
    short = (F.length(F.trim("content")) < 60).alias("short")  # texts aren't sent
    m = m.select("node_id", "event_type", short, F.sha2("content", 256).alias("e"), F.sha2(tx.canonicalize("content"), 256).alias("c")).withColumns({"ne": place("e"), "nc": place("c")})
    kind = F.when(F.col("short"), "blocked").when(F.col("ne") > 1, "exact").when(F.col("nc") > 1, "canonical").when(F.col("repeat"), "content")
    return m.join(again, "node_id", "left").select("node_id", "event_type", F.coalesce(kind, F.lit("stored")).alias("outcome"))


@query(f"AND {REPEATS}, {OUTCOME} SELECT node_id, outcome FROM o", "docs")
def ctx_capture(spark, d):
    return outcomes(spark, d).select("node_id", "outcome")


@query(f"AND {REPEATS}, {OUTCOME} SELECT outcome, count(*) AS n FROM o GROUP BY 1", "docs")
def hx_dedup_stats(spark, d):
    return outcomes(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@query()
def dd_compact(spark, d):
    m = docs(spark, d)
    rows = m.select("node_id", "content", F.array("project", "entity_id").alias("tags"))
    return dd.consolidated(dd.leader_clusters(m, 0.6), rows, 2).select("event_type", "leader", "members", "keeper", "quality", F.array_join("tags", ",").alias("tags"))


@query()
def dd_smart_extract(spark, d):
    """Held against a plain twin in the tests."""
    m = docs(spark, d)
    return dd.smart_extract(dd.leader_clusters(m, 0.6), m)


def insights(spark, d):
    m = mem(spark, d).filter("event_type = 'decision'")
    content = F.concat("content", F.lit(". Owned by Team"), F.col("user_id") % 3, F.lit(" since "), F.date_format("created_at", "yyyy-MM-dd"), F.lit("."))
    return m.select("node_id", "event_type", "created_at", content.alias("content"), F.array("project", "entity_id").alias("given"), "access_count").withColumn("tags", F.array_compact("given"))


@query()
def dd_synthesize(spark, d):
    """Held against a small case in the tests; its texts are those of dd_smart_extract."""
    found = dd.synthesized(insights(spark, d))
    return found.withColumns({"tags": F.array_join("tags", ","), "compacted_from": F.array_join("compacted_from", ",")})


# Reminders and rules that new texts call up.
SHARED = """rw AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{4,}'))) AS w FROM benchmark),
dw AS (SELECT node_id, unnest(list_distinct(regexp_extract_all(lower(content), '[a-z0-9_]{4,}'))) AS w FROM docs WHERE event_type = 'decision'),
sh AS (SELECT item_id, node_id, count(*) AS n FROM rw JOIN dw USING (w) GROUP BY ALL)"""


def shared_words(spark, d):
    rem = table(spark, d, "benchmark").select("item_id", F.explode(tx.word_set("text", 4)).alias("w"))
    new = docs(spark, d).filter("event_type = 'decision'").select("node_id", F.explode(tx.word_set("content", 4)).alias("w"))
    return rem.join(new, "w").groupBy("item_id", "node_id").agg(F.count("*").alias("n"))


@query(f"AND {SHARED} SELECT item_id, node_id, n FROM sh WHERE n >= 3", "docs")
def jn_reminder_keyword(spark, d):
    return shared_words(spark, d).filter("n >= 3")


@query(f"AND {SHARED} SELECT item_id, count(*) AS n, min(node_id) AS by FROM sh WHERE n >= 3 GROUP BY 1", "docs")
def sup_reminders(spark, d):
    """Reminders that a decision settles, and the first that does."""
    return shared_words(spark, d).filter("n >= 3").groupBy("item_id").agg(F.count("*").alias("n"), F.min("node_id").alias("by"))


@query(f"AND {SHARED} SELECT item_id, node_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY n DESC, node_id) AS INTEGER) AS place FROM sh QUALIFY place <= 3", "docs")
def jn_constraint_inject(spark, d):
    """Rules that share a word with the query, three at most."""
    return rt.top(shared_words(spark, d), 3, "n", "item_id", rank="place").select("item_id", "node_id", F.col("place").cast("int").alias("place"))


@query(f"AND {SHARED}, s AS (SELECT item_id, regexp_matches(lower(text), 'prefer|favorite|favourite|like|always use|default|rather|instead of') AS sig FROM benchmark) SELECT item_id, max(node_id) AS newest FROM sh JOIN s USING (item_id) WHERE sig GROUP BY 1", "docs")
def jn_pref_inject(spark, d):
    sig = table(spark, d, "benchmark").filter(F.lower("text").rlike("prefer|favorite|favourite|like|always use|default|rather|instead of")).select("item_id")
    return shared_words(spark, d).join(sig, "item_id").groupBy("item_id").agg(F.max("node_id").alias("newest"))


@query("""AND q AS (SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z0-9_]{4,}')))) AS w FROM conversations WHERE role = 'user' GROUP BY 1),
a AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{4,}')) AS w FROM conversations WHERE role <> 'user')
SELECT a.conv_id, a.turn, round(len(list_intersect(a.w, q.w))::DOUBLE / len(a.w), 6) AS share FROM a JOIN q USING (conv_id) WHERE len(a.w) > 0 AND len(list_intersect(a.w, q.w)) >= 0.1::DOUBLE * len(a.w)""", "docs")
def jn_query_log_content(spark, d):
    """Answers whose words the conversation's questions had, one in ten or more (words here are invented)."""
    c = table(spark, d, "conversations").withColumn("w", tx.word_set("text", 4))
    q = c.filter("role = 'user'").groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("asked"))
    n = F.size(F.array_intersect("w", "asked"))
    a = c.filter("role <> 'user'").join(q, "conv_id").filter((F.size("w") > 0) & (n >= 0.1 * F.size("w")))
    return a.select("conv_id", "turn", F.round(n / F.size("w"), 6).alias("share"))


@query("""AND p AS (SELECT a.conv_id, a.turn, b.turn AS other FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn AND b.turn - a.turn <= 3), e AS (SELECT conv_id, turn + 1 AS x, turn AS y FROM conversations)
SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = p.conv_id AND ((e.x = p.turn AND e.y = p.other) OR (e.x = p.other AND e.y = p.turn)))""", "docs")
def jn_existing_edge_anti(spark, d):
    """Candidate pairs without an edge in either direction; consecutive turns have one."""
    c = table(spark, d, "conversations").select("conv_id", "turn")
    p = c.join(c.toDF("conv_id", "other"), "conv_id").filter("other > turn and other - turn <= 3")
    e = c.select("conv_id", (F.col("turn") + 1).alias("x"), F.col("turn").alias("y"))
    low, high = F.least("x", "y").alias("turn"), F.greatest("x", "y").alias("other")
    return p.join(e.select("conv_id", low, high).distinct(), ["conv_id", "turn", "other"], "left_anti")
