"""Context assembly: packets, sections, briefings within budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemo import policy
from mnemo.functions import scoring as sc
from mnemo.functions import text as tx
from mnemo.schema import age_days


def item_score(relevance: Column, event_type: str, hop: Column, weight: Column, edge_type: str) -> Column:
    source = F.when(hop == 0, 1.2).otherwise(1.0)
    edge = F.when(hop == 0, 1.0).otherwise(policy.by_type(policy.PACKET_EDGE, edge_type, 1.0))
    link = F.when(hop == 0, 1.0).otherwise(F.greatest(F.lit(0.2), F.least(weight, F.lit(1.0))))
    return relevance * policy.by_type(policy.PACKET_TYPE, event_type, 1.0) * source * F.pow(F.lit(0.55), hop) * link * edge


def admission(now: Column, project: str | None = None, entity: str | None = None, stale_days: int = 90) -> Column:
    """Why an item stays out of a packet, or null: the first reason that applies."""
    out = F.when(F.trim("content") == "", "empty").when(F.col("status") == "superseded", "superseded")
    out = out.when(F.col("feedback_score") <= policy.FLAGGED_AT, "flagged")
    if entity is not None:
        out = out.when(F.coalesce("entity_id", F.lit("")) != entity, "entity")
    if project is not None:
        out = out.when(~F.coalesce("project", F.lit("")).isin("", project), "project")
    return out.when(age_days("created_at", now) > stale_days, "stale")


def budgeted(df: DataFrame, budget: int, *keys: str, score: str = "score") -> DataFrame:
    """Best items first while their tokens fit, up to the first that doesn't."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), "node_id")
    used = F.sum(tx.estimate_tokens("content")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"used": used, "place": F.row_number().over(w)}).filter(F.col("used") <= budget)


def sections(df: DataFrame, per_type: int, *keys: str) -> DataFrame:
    """The newest of each type."""
    w = Window.partitionBy(*keys, "event_type").orderBy(F.desc("created_at"), "node_id")
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_type)


def welcome(df: DataFrame, now: Column, per_type: int = 8, *keys: str) -> DataFrame:
    """The newest of each type, ordered by a blend of priority, recency and use."""
    hours = age_days("created_at", now) * 24
    blend = 0.45 * F.col("priority") + 1.75 * sc.recency(hours) + 0.20 * sc.access_boost(F.col("access_count"))
    w = Window.partitionBy(*keys).orderBy(F.desc("blend"), "node_id")
    return sections(df, per_type, *keys).withColumn("blend", blend).withColumn("rank", F.row_number().over(w))


def velocity(df: DataFrame, now: Column, busy: int = 20) -> DataFrame:
    """Freshness by windows that depend on how much came in the last day."""
    age = age_days("created_at", now) * 24
    day = df.agg(F.count_if((age >= 0) & (age <= 24)).alias("per_day"))
    span = F.when(F.col("per_day") >= busy, 12).when(F.col("per_day") >= busy / 4, 24).otherwise(72)
    return df.crossJoin(F.broadcast(day)).withColumn("bucket", F.when(age <= span, "fresh").when(age <= 2 * span, "recent").otherwise("stale"))  # one row


def contradiction_warnings(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Of two packet items that contradict each other, the one of less type weight, then less score."""
    e = edges.filter("edge_type = 'contradicts'").select("source_id", "target_id")
    key = lambda p: items.select("packet_id", F.col("node_id").alias(f"{p}_id"), F.struct("type_weight", "score", "node_id").alias(p))
    j = e.join(key("source"), "source_id").join(key("target"), ["target_id"]).filter(F.col("source.node_id") != F.col("target.node_id"))
    return j.select(F.when(F.col("source") < F.col("target"), F.col("source_id")).otherwise(F.col("target_id")).alias("node_id")).distinct()


def confidence_boost(relevance: Column, confidence: Column) -> Column:
    return F.when(confidence == "high", F.least(F.lit(1.0), relevance * 1.2)).when(confidence == "low", relevance * 0.7).otherwise(relevance)
