"""The registered queries of this subpackage, opN_<name>, each over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.llm import bitslice, divergence, flatgraph, forest, katz, mixing, packing, projection, quality, runs, toxicity, urllists, warc

#: Weights of the languages that op3 and the pipeline aim at.
LANGUAGE_TARGETS = {"en": 0.55, "fr": 0.15, "de": 0.2, "es": 0.1}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_pack_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op3_mix_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains are languages: known for the documents in labels, predicted for all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("domain"))
    mixed = mixing.mix(docs, table(spark, sf_dir, "labels"), LANGUAGE_TARGETS)
    names = sorted(LANGUAGE_TARGETS)
    return mixed.select("doc_id", "n_tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(names)), "rate", "residual")


def op4_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatgraph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"))).drop("url", "path")


#: The list that op6 applies: made from the hosts of pages, for there is no table of one. Each host is listed from a day
#: of its own for some weeks; every third host's parent is listed too, twice, with a gap between.
LIST_SQL = """
WITH hosts AS (
  SELECT DISTINCT lower(regexp_extract(url, '{host}', 1)) AS host FROM pages
), named AS (
  SELECT host, {h} AS h FROM hosts WHERE host <> ''
), parents AS (
  SELECT substr(host, instr(host, '.') + 1) AS host, min(h) AS h FROM named WHERE h % 3 = 0 GROUP BY 1
)
SELECT host AS entry, 'spam' AS category, 'add' AS action, h % 200 AS day FROM named
UNION ALL SELECT host, 'spam', 'remove', h % 200 + 30 + h % 90 FROM named
UNION ALL SELECT host, 'malware', 'add', h % 150 FROM parents
UNION ALL SELECT host, 'malware', 'remove', h % 150 + 20 FROM parents
UNION ALL SELECT host, 'malware', 'add', h % 150 + 60 FROM parents
"""
HASH_SPARK = "CAST(conv(substr(md5(host), 1, 7), 16, 10) AS BIGINT)"
HASH_DUCKDB = "CAST('0x' || substr(md5(host), 1, 7) AS BIGINT)"
DAY0 = "TIMESTAMP '2024-01-01 00:00:00'"


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    sql = LIST_SQL.format(host=urllists.HOST, h=HASH_SPARK)
    changes = spark.sql(sql.replace("FROM pages", "FROM {pages}"), pages=pages)
    changes = changes.withColumn("changed_at", F.expr(f"timestampadd(DAY, day, {DAY0})")).drop("day")
    captures = pages.select(
        F.col("page_id").alias("capture_id"), "url", F.expr(f"timestampadd(DAY, CAST(page_id * 7919 % 366 AS INT), {DAY0})").alias("fetched_at")
    )
    return urllists.evaluate(captures, changes).select(
        F.col("capture_id").alias("page_id"), "host", "n_active", F.array_join("entries", ",").alias("entries"), "blocked"
    )


#: The chain's order: insults in each language, then toxicity as labelled.
TOXIC_CHAIN = ["toxic_de", "toxic_en", "toxic_es", "toxic_fr", "toxic"]
MAX_LABELLED_IDS = 20_000


def labelled_toxicity(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Labelled rows of docs with the chain's categories; at most MAX_LABELLED_IDS of each label, the least by a hash."""
    ids = table(spark, sf_dir, "labels").filter("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    halves = [ids.filter(F.coalesce("toxic", F.lit(0)) == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED_IDS // 2) for v in (0, 1)]
    ids = halves[0].union(halves[1]).withColumnRenamed("doc_id", "labelled_id")
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(ids), F.col("doc_id") == F.col("labelled_id"))
    of = lambda x: ((F.col("toxic") == 1) & (F.col("lang") == x)).cast("int")
    return rows.select("doc_id", "text", "toxic", *(of(c[6:]).alias(c) for c in TOXIC_CHAIN[:-1]))


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(labelled_toxicity(spark, sf_dir, docs), TOXIC_CHAIN))


#: For the pipeline, which is to keep clean documents of every language and length, however few are labelled: all but this
#: share of the documents labelled good set the level from which importance counts. The query samples by the plain ratio.
QUALITY_ALLOW = 0.005


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.join(table(spark, sf_dir, "documents"))


def op10_bitslice_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def with_periods(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text): of those whose id has a crc32 that 10 divides, the words from one on repeat those after it
    with a period; where that begins and how long the period is follow from the crc32 too."""
    h = F.crc32(F.col("doc_id").cast("string"))
    planted = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(planted, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1)
    index = F.expr("transform(sequence(0L, n - 1L), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)])")
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(index, " ")).otherwise(F.col("text")).alias("text"))


def op12_repeat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse(with_periods(table(spark, sf_dir, "documents")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    rows = found.select(F.col("doc.doc_id").alias("doc_id"), "runs", best.alias("best"), lines.alias("lines"), "collapsed")
    period = -F.col("best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        period.alias("period"), F.expr("best.length * 1000 div -best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that it can express."""
    return {
        "op10_bitslice_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
""",
        "op13_divergence_audit": r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL
), own AS (
  SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 2) // (coalesce(o.n, 0) + 2 * l.v) AS HUGEINT) AS p,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (k.total + 2) // (l.n + 2 * l.v) AS HUGEINT) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM groups a
  JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER w AS INTEGER) AS rank FROM every
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 10
""",
        "op6_url_lists": f"""
WITH changes AS ({LIST_SQL.format(host=urllists.HOST, h=HASH_DUCKDB)}),
turns AS (
  SELECT entry, category, day, action, lag(action) OVER w AS before FROM (
    SELECT entry, category, day, max(action) AS action FROM changes GROUP BY ALL)
  WINDOW w AS (PARTITION BY entry, category ORDER BY day)
), spans AS (
  SELECT * FROM (SELECT entry, category, action, day AS valid_from, lead(day) OVER w AS valid_to FROM turns
    WHERE before IS NULL OR before <> action WINDOW w AS (PARTITION BY entry, category ORDER BY day)) WHERE action = 'add'
), captures AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '{urllists.HOST}', 1)), '') AS host, page_id * 7919 % 366 AS day FROM pages
), hits AS (
  SELECT c.page_id, count(*) AS n, string_agg(category || ':' || entry, ',' ORDER BY category || ':' || entry) AS entries
  FROM captures c JOIN spans s ON (c.host = s.entry OR c.host LIKE '%.' || s.entry)
    AND s.valid_from <= c.day AND (s.valid_to IS NULL OR c.day < s.valid_to)
  GROUP BY 1
)
SELECT page_id, host, coalesce(n, 0) AS n_active, coalesce(entries, '') AS entries, n IS NOT NULL AS blocked
FROM captures LEFT JOIN hits USING (page_id)
""",
    }
