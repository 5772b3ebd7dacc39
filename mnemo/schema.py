"""The memory model, and views of the driver's tables as memories, vectors and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemo import policy

AS_OF = "2024-02-01 00:00:00"

MEMORIES = T.StructType([
    T.StructField("node_id", T.StringType(), False), T.StructField("content", T.StringType()),
    T.StructField("event_type", T.StringType()), T.StructField("created_at", T.TimestampType()),
    T.StructField("last_accessed", T.TimestampType()), T.StructField("access_count", T.IntegerType()),
    T.StructField("retrieval_count", T.IntegerType()), T.StructField("ttl_seconds", T.LongType()),
    T.StructField("session_id", T.StringType()), T.StructField("project", T.StringType()),
    T.StructField("priority", T.IntegerType()), T.StructField("entity_id", T.StringType()),
    T.StructField("agent_type", T.StringType()), T.StructField("memory_type", T.StringType()),
    T.StructField("valid_from", T.TimestampType()), T.StructField("valid_until", T.TimestampType()),
    T.StructField("referenced_date", T.TimestampType()), T.StructField("status", T.StringType()),
    T.StructField("feedback_score", T.IntegerType()), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("content_hash", T.StringType()), T.StructField("canonical_hash", T.StringType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(value: str = AS_OF) -> Column:
    return F.lit(value).cast("timestamp")


def age_days(then: Column | str, now: Column) -> Column:
    then = F.col(then) if isinstance(then, str) else then
    return (F.unix_micros(now) - F.unix_micros(then)) / F.lit(86400e6)


def migrate(df: DataFrame) -> DataFrame:
    """Bring a table of any earlier shape to MEMORIES: missing columns are added with their defaults."""
    has = set(df.columns)
    old = lambda name, default: F.coalesce(F.col(name), default) if name in has else default
    out = df.withColumn("event_type", old("event_type", F.lit("memory")))
    dead = F.lit(False)
    if "superseded" in has:
        dead = F.coalesce(F.col("superseded").cast("string").isin("true", "1"), F.lit(False))
    status = old("status", F.when(dead, "superseded").otherwise("active"))
    values = {
        "content": old("content", F.lit(None).cast("string")),
        "access_count": old("access_count", F.lit(0)), "retrieval_count": old("retrieval_count", F.lit(0)),
        "priority": old("priority", policy.by_type(policy.PRIORITY, "event_type", 3)),
        "memory_type": old("memory_type", policy.memory_class()), "ttl_seconds": old("ttl_seconds", policy.ttl_seconds()),
        "valid_from": old("valid_from", F.col("created_at") if "created_at" in has else F.lit(None)),
        "status": F.when(status.isin("active", "superseded", "speculative", "archived"), status).otherwise("active"),
        "feedback_score": old("feedback_score", F.lit(0)),
    }
    out = out.withColumns(values)
    for f in MEMORIES:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None))
    out = out.withColumn("content_hash", F.coalesce("content_hash", F.sha2("content", 256)))
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in MEMORIES))


# The same text makes the views in Spark and in DuckDB.
MEM_SQL = """
SELECT node_id, kind AS event_type, created_at, created_at + INTERVAL '1' HOUR * k AS last_accessed,
  CAST(k % 4 AS INT) AS access_count, CAST(k % 3 AS INT) AS retrieval_count,
  CASE WHEN kind IN ('session_summary', 'task_completion') THEN CAST(86400 * (1 + k) AS BIGINT) END AS ttl_seconds,
  user_id || '-' || CAST(created_at AS DATE) AS session_id, 'p' || (user_id % 10) AS project, CAST(1 + k % 5 AS INT) AS priority,
  CASE WHEN user_id % 3 > 0 THEN 'e' || (user_id % 5) END AS entity_id,
  CASE WHEN user_id % 4 > 0 THEN 'agent' || (user_id % 2) END AS agent_type, created_at AS valid_from,
  CASE WHEN k % 7 = 0 THEN created_at + INTERVAL '1' DAY * (1 + k) END AS valid_until,
  CASE WHEN k % 11 = 3 THEN 'superseded' WHEN k % 13 = 5 THEN 'archived' WHEN k % 17 = 2 THEN CAST(NULL AS STRING) ELSE 'active' END AS status,
  CAST(k % 14 - 4 AS INT) AS feedback_score, user_id, k, value,
  kind || ' ' || CASE k % 4 WHEN 0 THEN 'always use' WHEN 1 THEN 'never use' WHEN 2 THEN 'prefer' ELSE 'deploy' END
    || ' service' || (user_id % 7) || ' build' || (k % 9) || ' step' || (k % 5) AS content
FROM (
  SELECT 'mem-' || lpad(CAST(event_id AS STRING), 12, '0') AS node_id, CAST(ts AS TIMESTAMP) AS created_at, user_id, value,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
    CASE event_type WHEN 'error' THEN 'error_pattern' WHEN 'purchase' THEN 'decision' WHEN 'signup' THEN 'user_preference'
      WHEN 'view' THEN 'session_summary' ELSE 'task_completion' END AS kind
  FROM {events}
)
"""
DOCS_SQL = """
SELECT 'doc-' || lpad(CAST(doc_id AS STRING), 12, '0') AS node_id, doc_id, text AS content, source AS project, lang AS entity_id,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * (doc_id % 744) AS created_at,
  CASE doc_id % 5 WHEN 0 THEN 'decision' WHEN 1 THEN 'lesson_learned' WHEN 2 THEN 'error_pattern' WHEN 3 THEN 'session_summary'
    ELSE 'memory' END AS event_type,
  CAST(1 + doc_id % 5 AS INT) AS priority, CAST(doc_id % 4 AS INT) AS access_count, CAST(doc_id % 14 - 4 AS INT) AS feedback_score,
  CASE WHEN doc_id % 5 > 2 THEN CAST(86400 * 20 AS BIGINT) END AS ttl_seconds,
  CASE WHEN doc_id % 23 = 0 THEN 'superseded' ELSE 'active' END AS status
FROM {documents}
"""

# Turns that say something that rules can find, before the driver's invented words.
TALK_SQL = """
SELECT conv_id, turn, role, concat(CASE (conv_id + turn) % 9 WHEN 0 THEN 'I always use vim for config_file edits. '
  WHEN 1 THEN 'I never use vim now, switched to HelixEdit. ' WHEN 2 THEN 'We decided to use `jwt_auth` on 2024-03-05 in New York. '
  WHEN 3 THEN 'From now on enable dark mode. ' WHEN 4 THEN 'It turns out the API_KEY was not public: 45 GB lost. '
  WHEN 5 THEN 'Disable light mode, no longer needed. ' WHEN 6 THEN 'Make sure to run tests.unit before mem-12ab34cd56. '
  WHEN 7 THEN '# Resume: <b>fix</b> the "login page" of John Smith. ' ELSE '' END, text) AS text
FROM {conversations}
"""


def mem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as memories."""
    return spark.sql(MEM_SQL, events=table(spark, sf_dir, "events"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as memories."""
    return spark.sql(DOCS_SQL, documents=table(spark, sf_dir, "documents"))


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations, with phrases of every kind that rules look for."""
    return spark.sql(TALK_SQL, conversations=table(spark, sf_dir, "conversations"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between each user's consecutive events within an hour: source_id, target_id, edge_type, weight, created_at."""
    from pyspark.sql.window import Window

    m = mem(spark, sf_dir)
    order = Window.partitionBy("user_id").orderBy("created_at", "node_id")
    gap = (F.unix_micros("created_at") - F.unix_micros(F.lag("created_at").over(order))) / F.lit(6e7)
    e = m.select("node_id", "created_at", "event_type", F.lag("node_id").over(order).alias("source_id"), F.lag("event_type").over(order).alias("before"), gap.alias("gap"))
    same = F.when(F.col("before") == F.col("event_type"), "evolution").otherwise("temporal_cluster")
    return e.filter("gap <= 60").select(
        "source_id", F.col("node_id").alias("target_id"), same.alias("edge_type"), F.round(1 / (1 + F.col("gap") / 60), 3).alias("weight"), "created_at"
    )


VIEWS = {
    "mem": MEM_SQL.replace("{events}", "events"),
    "docs": DOCS_SQL.replace("{documents}", "documents"),
    "talk": TALK_SQL.replace("{conversations}", "conversations"),
    "links": """
SELECT source_id, node_id AS target_id, CASE WHEN before = event_type THEN 'evolution' ELSE 'temporal_cluster' END AS edge_type,
  round(1 / (1 + gap / 60), 3) AS weight, created_at
FROM (SELECT node_id, created_at, event_type, lag(node_id) OVER w AS source_id, lag(event_type) OVER w AS before,
  (epoch_us(created_at) - epoch_us(lag(created_at) OVER w)) / 6e7 AS gap FROM mem
  WINDOW w AS (PARTITION BY user_id ORDER BY created_at, node_id)) WHERE gap <= 60
""",
}


def with_views(sql: str, *names: str) -> str:
    """SQL for DuckDB with the views that it uses in front."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + (", " if sql.lstrip()[:4] == "AND " else " ") + sql.lstrip().removeprefix("AND ")
