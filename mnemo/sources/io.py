"""Sources and sinks: JSON documents and lines, CSV history, markdown vaults, logs, probe sets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo import policy

VERSION = "mnemo-1"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; one of our own only where all runs in one process."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or _own.get(sc.applicationId)
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="mnemo-")
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, no lineage, whatever executors are lost later."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """Memories as JSON lines, a document of counts beside them: every executor writes its own part."""
    df.write.mode("overwrite").json(f"{path}/nodes")
    df.agg(F.lit(VERSION).alias("version"), F.count("*").alias("node_count"), F.countDistinct("session_id").alias("session_count")).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def import_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/nodes")


def read_document(spark: SparkSession, path: str, nodes: str) -> DataFrame:
    """One multi-line JSON document {"nodes": [...]} as rows."""
    doc = spark.read.schema(f"version string, nodes array<struct<{nodes}>>").option("multiLine", True).json(path)
    return doc.select(F.explode("nodes").alias("n")).select("n.*")


def read_jsonl(spark: SparkSession, path: str, skip: list[str], most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Legacy lines {content, metadata{event_type, session_id}}: usable rows, and a row of counts."""
    schema = "content string, metadata struct<event_type string, session_id string>, _corrupt string"
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    raw = raw.withColumn("event_type", F.coalesce("metadata.event_type", F.lit("memory")))
    bad = F.col("_corrupt").isNotNull() | F.col("content").isNull()
    skipped = ~bad & F.col("event_type").isin(skip)
    rows = raw.filter(~bad & ~F.col("event_type").isin(skip)).select(
        F.concat(F.lit("mem-"), F.substring(F.sha2("content", 256), 1, 12)).alias("node_id"), F.substring("content", 1, most).alias("content"),
        "event_type", F.col("metadata.session_id").alias("session_id"), policy.ttl_seconds().alias("ttl_seconds"),
    )
    return rows, raw.agg(F.count("*").alias("lines"), F.count_if(bad).alias("bad"), F.count_if(skipped).alias("skipped"))


def merge_new(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and those new rows whose content it lacks, by hash; the first of equal new ones."""
    n = new.withColumn("h", F.sha2("content", 256)).dropDuplicates(["h"])
    return old.unionByName(n.join(old.select(F.sha2("content", 256).alias("h")), "h", "left_anti").select(*old.columns))


def merge_sources(sources: list[DataFrame], key: str = "node_id") -> DataFrame:
    """Union of sources; of equal keys the earliest source's row stays."""
    from functools import reduce

    from pyspark.sql.window import Window

    every = reduce(DataFrame.unionByName, [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)])
    w = Window.partitionBy(key).orderBy("_source")
    return every.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_source")


def markdown(df: DataFrame, edges: DataFrame) -> DataFrame:
    """event_type, node_id and the markdown of each memory, with links to its neighbours."""
    near = edges.groupBy(F.col("source_id").alias("node_id")).agg(F.sort_array(F.collect_set("target_id")).alias("to"))
    j = df.join(near, "node_id", "left")
    linked = F.coalesce(F.array_join(F.transform("to", lambda t: F.concat(F.lit("[["), t, F.lit("]]"))), "\n"), F.lit(""))
    body = F.concat(F.lit("# "), F.col("node_id"), F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n\n"), linked)
    return j.select("event_type", "node_id", body.alias("value"))


def export_markdown(df: DataFrame, edges: DataFrame, path: str) -> None:
    markdown(df, edges).select("event_type", "value").write.mode("overwrite").partitionBy("event_type").option("lineSep", "\n---\n").text(path)


def append_csv(row: DataFrame, path: str) -> None:
    row.write.mode("append").option("header", True).csv(path)


def estimate_cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Cost by prices for a million tokens in and out."""
    a = policy.by_type({k: v[0] for k, v in prices.items()}, model, 0.0)
    b = policy.by_type({k: v[1] for k, v in prices.items()}, model, 0.0)
    return F.round((tokens_in * a + tokens_out * b) / 1e6, 6)
