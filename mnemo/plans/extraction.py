"""Queries of the rules that find keywords, facts, observations, preferences and the like in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemo.functions import dates
from mnemo.functions import text as tx
from mnemo.operators import extract as ex
from mnemo.plans.registry import query
from mnemo.schema import docs, mem, table, talk


def turns(spark, d):
    return talk(spark, d)


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def rlike_any(patterns: list[str]) -> str:
    return "length(text) >= 20 AND (" + " OR ".join(f"regexp_matches(lower(text), {quoted(p)})" for p in patterns) + ")"


#: DuckDB: a list's items, each once whatever its case, by first place.
ONCE = "list_filter({x}, lambda w, i: list_position(list_transform({x}, lambda y: lower(y)), lower(w)) = i)"
ALL = " || ".join(f"regexp_extract_all(text, {quoted(p)})" for p in (ex.PROPER, ex.DATE, ex.AMOUNT, ex.TECHNICAL))


@query(f"SELECT conv_id, turn, array_to_string(list_slice({ONCE.format(x='k')}, 1, 50), ' ') AS keywords FROM (SELECT *, {ALL} AS k FROM talk)", "talk")
def fn_keywords(spark, d):
    return turns(spark, d).select("conv_id", "turn", ex.keywords(F.col("text")).alias("keywords"))


PICK = " || ".join(
    f"list_transform({x}, lambda y: trim(lower(y)))"
    for x in (
        *(f"regexp_extract_all(text, {quoted(p)}, 1)" for p in (ex.CAMEL, ex.CONSTANT, ex.TICKED, ex.QUOTED)),
        f"list_filter(list_transform(regexp_extract_all(text, {quoted(ex.CHOSEN)}, 1), lambda y: regexp_replace(trim(y), '\\.+$', '')), lambda y: length(y) > 2)",
        f"list_filter(regexp_extract_all(text, {quoted(ex.DOTTED)}, 1), lambda y: NOT regexp_matches(y, '^\\d+\\.\\d+'))",
        f"list_filter(regexp_extract_all(lower(text), {quoted(ex.HYPHENED)}, 1), lambda y: length(y) > 4)",
    )
)
STOP = ", ".join(quoted(w) for w in ex.FACT_STOP)


@query(f"""SELECT conv_id, turn, array_to_string(list_slice(list_sort(list_filter(list_distinct(f), lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: length(w) > 1 AND w NOT IN ({STOP}))) > 0)), 1, 20), '|') AS facts
FROM (SELECT *, {PICK} AS f FROM talk)""", "talk")
def fn_facts(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.array_join(ex.facts(F.col("text")), "|").alias("facts"))


@query(f"""WITH m AS (SELECT doc_id, text, regexp_replace(text, '([.!?])\\s+([A-Z\\[])', '\\1' || chr(1) || '\\2', 'g') AS a FROM documents WHERE length(text) >= 150),
p AS (SELECT doc_id, string_split(CASE WHEN contains(a, chr(1)) THEN a ELSE regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g') END, chr(1)) AS parts FROM m),
u AS (SELECT doc_id, trim(s) AS s, i FROM (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM p)),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY len(list_distinct(list_transform(list_filter(regexp_split_to_array(trim(s), '\\s+'), lambda w: length(w) > 3), lambda w: lower(w))))
  + 2 * len(regexp_extract_all(s, {quoted(ex.CODE)})) + 3::DOUBLE * least(length(s), 200) / 200 DESC, i) AS n FROM u WHERE length(s) >= 15),
w AS (SELECT doc_id, max(CASE WHEN n = 1 THEN s END) AS a, max(CASE WHEN n = 2 THEN s END) AS b FROM r WHERE n <= 2 GROUP BY 1),
j AS (SELECT *, list_distinct(regexp_extract_all(lower(a), '[a-z0-9_]{{3,}}')) AS x, list_distinct(regexp_extract_all(lower(b), '[a-z0-9_]{{3,}}')) AS y FROM w),
t AS (SELECT doc_id, CASE WHEN b IS NOT NULL AND (len(x) + len(y) = 0 OR len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) < 0.7) THEN a || ' ' || b ELSE a END AS o FROM j)
SELECT d.doc_id, CASE WHEN length(o) > 200 THEN substr(o, 1, 197) || '...' ELSE o END AS observation FROM documents d LEFT JOIN t USING (doc_id)""")
def fn_observation(spark, d):
    return table(spark, d, "documents").select("doc_id", ex.observation(F.col("text")).alias("observation"))


WISHES = " || ".join(
    f"list_transform(regexp_extract_all(text, {quoted('(?i)' + p)}), lambda y: {{'content': regexp_replace(trim(y), '[.,;:]+$', ''), 'confidence': CAST({c} AS DOUBLE)}})"
    for p, c in ex.PREFERENCES
)


@query(f"""SELECT conv_id, turn, content, confidence FROM (SELECT conv_id, turn, x.content AS content, x.confidence AS confidence, row_number() OVER (PARTITION BY conv_id, turn, lower(x.content) ORDER BY i) AS n
FROM (SELECT conv_id, turn, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT *, {WISHES} AS p FROM talk)) WHERE length(x.content) BETWEEN 10 AND 300) WHERE n = 1""", "talk")
def fn_preferences(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.inline(ex.preferences(F.col("text"))))


ASKED = ["What did I say last Friday", "plans of last weekend", "Yesterday we met", "the talk last week", "two weeks ago and a year ago", "over the past 3 months", "it began in March",
         "in May 2023 or in June", "a fortnight ago", "last sunday or yesterday"]
ISO, LONG = "strftime({d}, '%Y-%m-%d')", "strftime({d}, '%Y-%m-%d %B %d')"
LAST = "CAST(a - to_days(CAST((isodow(a) + 6 - {n}) % 7 + 1 AS INTEGER)) AS DATE)"


@query(f"""AND p AS (SELECT node_id, k % 10 AS q, CAST(created_at AS DATE) AS a FROM mem)
SELECT node_id, CASE q WHEN 0 THEN 'Friday ' || {LONG.format(d=LAST.format(n=5))}
 WHEN 1 THEN 'Saturday Sunday ' || {ISO.format(d=LAST.format(n=6))} || ' ' || {ISO.format(d=LAST.format(n=6) + ' + 1')}
 WHEN 2 THEN {LONG.format(d='a - 1')}
 WHEN 3 THEN {ISO.format(d="date_trunc('week', a) - INTERVAL 7 DAY")} || ' ' || {ISO.format(d="date_trunc('week', a) - INTERVAL 1 DAY")}
 WHEN 4 THEN {LONG.format(d='a - 14')}
 WHEN 5 THEN {ISO.format(d='a - 90')} || ' ' || {ISO.format(d='a')} || strftime(a - 90, ' %B') || strftime(a, ' %B')
 WHEN 6 THEN 'March ' || (year(a) - CAST(month(a) < 3 AS INTEGER)) || ' ' || (year(a) - CAST(month(a) < 3 AS INTEGER)) || '-03'
 WHEN 7 THEN 'May 2023 2023-05' WHEN 8 THEN '' ELSE 'Sunday ' || {LONG.format(d=LAST.format(n=7))} || '|' || {LONG.format(d='a - 1')} END AS dates FROM p""", "mem")
def fn_resolve_dates(spark, d):
    q = F.get(F.array(*map(F.lit, ASKED)), (F.col("k") % 10).cast("int"))
    return mem(spark, d).select("node_id", F.array_join(dates.date_keywords(q, F.col("created_at")), "|").alias("dates"))


@query(f"SELECT conv_id, turn, {rlike_any(ex.DECISIONS)} AS decision, {rlike_any(ex.LESSONS)} AS lesson FROM talk", "talk")
def fn_decision(spark, d):
    return turns(spark, d).select("conv_id", "turn", ex.is_decision(F.col("text")).alias("decision"), ex.is_lesson(F.col("text")).alias("lesson"))


MARKED = " OR ".join(f"contains(x, {quoted(m)})" for m in ex.ERROR_MARKS)
LOG_SQL = """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Traceback (most recent call last)' || chr(10) || '  File "a.py"' || chr(10) || text || chr(10) || 'ValueError: ' || role || chr(10) || '  ^'
 WHEN 1 THEN '{"a": 1}' || chr(10) || text || chr(10) || ' fatal: ' || role ELSE text END AS log FROM {c}"""


@query(f"""AND t AS ({LOG_SQL.replace('{c}', 'talk')}), l AS (SELECT *, list_filter(list_transform(string_split(trim(log), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM t),
p AS (SELECT *, list_filter(s, lambda x: NOT regexp_matches(x, '^[{{\\[}}\\]"]')) AS plain FROM l)
SELECT conv_id, turn, substr(coalesce(CASE WHEN contains(log, 'Traceback (most recent call last)') THEN list_filter(s, lambda x: NOT starts_with(x, 'File ') AND NOT starts_with(x, '^'))[-1]
  ELSE coalesce(list_filter(plain, lambda x: {MARKED})[1], plain[1]) END, log), 1, 300) AS summary FROM p""", "talk")
def fn_error_summary(spark, d):
    logs = spark.sql(LOG_SQL.replace("chr(10)", "char(10)").replace("{c}", "{c}").replace('{"a"', '{{"a"').replace("1}'", "1}}'"), c=talk(spark, d))
    return logs.select("conv_id", "turn", ex.error_summary(F.col("log")).alias("summary"))


SKIPPED = " OR ".join(f"starts_with(t, {quoted(x)})" for x in ex.TASK_SKIPPED)
EXACT = ", ".join(quoted(x) for x in ex.TASK_EXACT)


@query(f"""AND a AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(trim(text), '<[a-zA-Z_-]+>[^<]*</[a-zA-Z_-]+>', '', 'g'), '</?[a-zA-Z_-]+>', '', 'g')) AS t FROM talk),
b AS (SELECT *, trim(regexp_replace(trim(string_split(regexp_replace(regexp_replace(t, '^#{{1,4}}\\s*', ''), '^[Rr]esume\\s*:\\s*', ''), chr(10))[1]), '([a-zA-Z])[.!?]\\s.*', '\\1', 'g')) AS l FROM a),
c AS (SELECT *, CASE WHEN length(l) > 60 THEN regexp_replace(substr(l, 1, 60), ' [^ ]*$', '') ELSE l END AS s FROM b)
SELECT conv_id, turn, CASE WHEN {SKIPPED} OR lower(t) IN ({EXACT}) OR length(s) < 8 THEN '' ELSE s END AS title FROM c""", "talk")
def fn_task_clean(spark, d):
    return turns(spark, d).select("conv_id", "turn", ex.task_title(F.col("text")).alias("title"))


def listed(words: list[str]) -> str:
    return ", ".join(map(quoted, words))


def case_of(x: str, names: dict[str, str], rest: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in names.items()) + f" ELSE {rest} END"


TOOLED = """concat(text, CASE turn % 5 WHEN 0 THEN ' k8s runs main.rs from /usr/local/bin/run, tests of the API cache' WHEN 1 THEN ' go defer func in Next.js and pytest'
 WHEN 2 THEN ' go to /opt, then use sqlite3 hooks and app.TSX' ELSE '' END)"""


@query(f"""AND t AS (SELECT conv_id, turn, {TOOLED} AS s FROM talk),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(s), {quoted(ex.TAG_WORD)})) AS w FROM t),
g AS (SELECT conv_id, turn, list_transform(w, lambda x: {case_of('x', ex.TAG_ALIASES)})
  || list_filter(w, lambda x: x IN ({listed(ex.TAG_LANGUAGES)}) AND (x <> 'go' OR list_has_any(w, [{listed(ex.GO_WORDS)}])))
  || list_filter(w, lambda x: x IN ({listed(ex.TAG_TOOLS)}))
  || list_transform(list_filter(w, lambda x: x IN ({listed(ex.TAG_CONCEPTS)})), lambda x: {case_of('x', ex.CONCEPT_NAMES, 'x')})
  || regexp_extract_all(s, {quoted(ex.TAG_PATH)})
  || list_transform(regexp_extract_all(lower(s), {quoted(ex.TAG_FILE)}, 1), lambda x: {case_of('x', ex.MENTIONED_EXTENSIONS)}) || ['talk'] AS g FROM w)
SELECT conv_id, turn, array_to_string(list_slice(list_sort(list_distinct(list_filter(g, lambda x: x IS NOT NULL))), 1, 10), '|') AS tags FROM g""", "talk")
def fn_tags(spark, d):
    found = ex.tags(F.expr(TOOLED), F.lit("/home/Talk"))
    return turns(spark, d).select("conv_id", "turn", F.array_join(found, "|").alias("tags"))


EXTENSIONS = list(ex.EXTENSION_TAGS)
PATH = "concat('src/f', page_id, CASE page_id % 5 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate([".py", ".tsx", ".Vue", ".unknown"])) + " ELSE '' END)"


@query(f"SELECT page_id, coalesce(t, '') AS tags FROM (SELECT page_id, CASE lower(regexp_extract({PATH}, '\\.[A-Za-z0-9]+$')) " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in ex.EXTENSION_TAGS.items()) + " END AS t FROM pages)")
def fn_ext_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(ex.extension_tags(F.expr(PATH)), ",").alias("tags"))


@query("SELECT conv_id, turn, array_to_string(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 3), lambda w: regexp_replace(w, '[^a-z0-9_]', '', 'g')), ' ') AS words FROM talk", "talk")
def fn_norm_words(spark, d):
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 3)
    return turns(spark, d).select("conv_id", "turn", F.array_join(F.transform(words, lambda w: F.regexp_replace(w, "[^a-z0-9_]", "")), " ").alias("words"))


@query()
def fn_hash_embedding(spark, d):
    return turns(spark, d).select("conv_id", "turn", ex.hash_embedding(16)(F.col("text")).alias("v"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a, list_transform(list_reverse(embedding), lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings),
t AS (SELECT vec_id, list_transform(range(1, len(a) + 1), lambda i: a[i] + b[i]) AS v FROM s)
SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first FROM t""")
def fn_pooling(spark, d):
    """Three token vectors, of which the mask keeps two."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    states = F.array(v, F.transform(v, lambda x: x * 9), F.reverse(v))
    pooled = ex.pooled(states, F.array(F.lit(1), F.lit(0), F.lit(1)))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.get(pooled, 0), 6).alias("first"))


@query("SELECT node_id, created_at + to_seconds(ttl_seconds) AS expires_at FROM mem WHERE ttl_seconds IS NOT NULL", "mem")
def fn_datetime_add(spark, d):
    return mem(spark, d).filter("ttl_seconds is not null").select("node_id", F.expr("timestampadd(SECOND, ttl_seconds, created_at)").alias("expires_at"))


@query("SELECT node_id, try_cast(stamp AS TIMESTAMP) AS at FROM (SELECT node_id, CASE priority WHEN 1 THEN 'soon' ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS stamp FROM docs)", "docs")
def prj_parse_dt(spark, d):
    stamp = F.when(F.col("priority") == 1, "soon").otherwise(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return docs(spark, d).select("node_id", F.try_to_timestamp(stamp).alias("at"))


# US dollars for a million tokens, in and out, of the price classes that a log may name.
PRICES = {"small": (1.0, 5.0), "middle": (3.0, 15.0), "large": (15.0, 75.0)}


@query("""SELECT doc_id, round(n * CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 3.0 ELSE 15.0 END::DOUBLE / 1000000 + (n // 4) * CASE doc_id % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 15.0 ELSE 75.0 END::DOUBLE / 1000000, 6) AS cost
FROM (SELECT doc_id, length(text) // 4 AS n FROM documents)""")
def fn_cost(spark, d):
    rate = lambda i: F.element_at(F.create_map(*(y for k, v in PRICES.items() for y in (F.lit(k), F.lit(v[i])))), F.col("model"))
    model = F.element_at(F.array(*map(F.lit, PRICES)), (F.col("doc_id") % 3 + 1).cast("int"))
    n = tx.estimate_tokens("text")
    rows = table(spark, d, "documents").withColumns({"model": model, "n": n})
    return rows.select("doc_id", F.round(F.col("n") * rate(0) / 1000000 + F.floor(F.col("n") / 4) * rate(1) / 1000000, 6).alias("cost"))


RESERVED = ["and", "not", "near"]


@query("SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) >= 3 AND w NOT IN ('and', 'not', 'near')), ' ') AS words FROM talk", "talk")
def ret_fts_sanitize(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.array_join(tx.fts_words("text"), " ").alias("words"))


@query("""SELECT conv_id, turn, contains(text, '`') OR regexp_matches(text, '/[a-zA-Z][\\w/.]*') OR (starts_with(trim(text), '"') AND ends_with(trim(text), '"') AND length(trim(text)) > 2)
 OR regexp_matches(text, '\\b[A-Z][a-z]+[A-Z]\\w*\\b') OR regexp_matches(text, '\\b[a-z]+_[a-z_]+\\b') OR regexp_matches(text, '\\bmem-[0-9a-f]{8,}\\b') OR regexp_matches(text, '\\bv?\\d+\\.\\d+(?:\\.\\d+)?\\b')
 OR contains(text, 'http://') OR contains(text, 'https://') OR regexp_matches(text, '\\b[0-9a-f]{8,}\\b') AS exact FROM talk""", "talk")
def ret_keyword_sufficient(spark, d):
    return turns(spark, d).select("conv_id", "turn", tx.is_keyword_query("text").alias("exact"))


FLIP = "(SELECT conv_id, turn, text AS new, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM talk)"
WORDS3 = "list_distinct(regexp_extract_all(lower({c}), '[a-z0-9_]{{3,}}'))"
NEGATED = ", ".join(quoted(w) for w in ex.POLARITY_NEGATIONS)
PLAIN = ", ".join(quoted(w) for w in [*ex.POLARITY_NEGATIONS, *ex.POLARITY_POSITIVES])


@query(f"""AND w AS (SELECT conv_id, turn, {WORDS3.format(c='new')} AS a, {WORDS3.format(c='old')} AS b FROM {FLIP} WHERE old IS NOT NULL),
t AS (SELECT *, list_filter(a, lambda x: x NOT IN ({PLAIN})) AS p, list_filter(b, lambda x: x NOT IN ({PLAIN})) AS q, list_has_any(a, [{NEGATED}]) AS na, list_has_any(b, [{NEGATED}]) AS nb FROM w),
o AS (SELECT *, CASE WHEN len(p) + len(q) = 0 THEN 0 ELSE len(list_intersect(p, q))::DOUBLE / (len(p) + len(q) - len(list_intersect(p, q))) END AS j FROM t)
SELECT conv_id, turn, round(j, 6) AS overlap, j >= 0.3 AND na <> nb AS flip FROM o""", "talk")
def con_pref_polarity(spark, d):
    from pyspark.sql.window import Window

    t = turns(spark, d).withColumn("old", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("old is not null")
    overlap, flip = ex.polarity_flip(F.col("text"), F.col("old"))
    return t.select("conv_id", "turn", F.round(overlap, 6).alias("overlap"), flip.alias("flip"))


CLAIM = "|".join(ex.FACT_CLAIMS)


@query(f"""AND p AS (SELECT conv_id, turn, text, list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS parts FROM talk),
f AS (SELECT *, list_filter(parts, lambda x: length(x) BETWEEN 15 AND 200 AND regexp_matches(lower(x), {quoted(ex.FACT_SPEAKER)}) AND regexp_matches(lower(x), {quoted(CLAIM)})) AS k FROM p)
SELECT conv_id, turn, CASE WHEN length(text) >= 50 THEN array_to_string(list_slice({ONCE.format(x='k')}, 1, 5), '|') WHEN text IS NOT NULL THEN '' END AS facts FROM f""", "talk")
def fn_atomic_facts(spark, d):
    t = turns(spark, d)
    return t.select("conv_id", "turn", F.when(F.col("text").isNotNull(), F.array_join(ex.atomic_facts(F.col("text")), "|")).alias("facts"))


COUNTED = " OR ".join(f"contains(lower(text), {quoted(x)})" for x in ex.COUNTING)
COMMON = ", ".join(quoted(x) for x in ex.COMMON_NAMES)


@query(f"""AND asked AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'How many of these: ' ELSE '' END || coalesce(text, '') AS text FROM talk)
SELECT conv_id, turn, concat_ws(' ', text, CASE WHEN {COUNTED} THEN {quoted(ex.COUNTING_CUE)} END, CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') END) AS expanded
FROM (SELECT *, list_filter(regexp_extract_all(text, {quoted(ex.NAMES)}), lambda x: x NOT IN ({COMMON})) AS k FROM asked)""", "talk")
def fn_expand_rule(spark, d):
    """Turns as questions, every third of them one that counts."""
    asked = F.concat(F.when(F.col("turn") % 3 == 0, "How many of these: ").otherwise(""), F.coalesce("text", F.lit("")))
    return turns(spark, d).select("conv_id", "turn", ex.expand_query(asked).alias("expanded"))
