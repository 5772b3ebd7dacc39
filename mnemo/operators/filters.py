"""Predicates and projections over memories. Each takes and returns a DataFrame, or is a Column to filter by."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo import policy
from mnemo.functions import text as tx
from mnemo.schema import age_days


def active() -> Column:
    return F.col("status").isNull() | ~F.col("status").isin("superseded", "archived")


def expired(now: Column) -> Column:
    return F.coalesce(now > F.timestamp_seconds(F.unix_micros("created_at") / 1e6 + F.col("ttl_seconds")), F.lit(False))


def ttl_remaining(now: Column) -> Column:
    left = F.col("ttl_seconds") - F.floor((F.unix_micros(now) - F.unix_micros("created_at")) / 1e6)
    return F.greatest(F.lit(0), left).cast("long")


def valid_at(t: Column) -> Column:
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_until").isNull() | (F.col("valid_until") > t))


def in_entity(entity: str) -> Column:
    """The entity's own rows and the global ones."""
    return F.col("entity_id").isNull() | (F.col("entity_id") == entity)


def pipeline(df: DataFrame, now: Column, at: Column | None = None, project: str | None = None, keep_infrastructure: bool = False, session: str | None = None) -> DataFrame:
    """Unexpired, active, valid, unflagged rows in scope: one conjunction, so that it reaches the scan."""
    keep = ~expired(now) & active() & (F.coalesce("feedback_score", F.lit(0)) > policy.FLAGGED_AT)
    if at is not None:
        keep &= valid_at(at)
    if not keep_infrastructure:
        keep &= ~F.coalesce(F.col("event_type"), F.lit("")).isin(policy.INFRASTRUCTURE)
    if project is not None:
        keep &= F.coalesce("project", F.lit("")).isin("", project)
    if session is not None:
        keep &= F.coalesce("session_id", F.lit("")).isin("", session)
    return df.filter(keep)


def history(df: DataFrame, at: Column) -> DataFrame:
    """What was valid at a moment, superseded since or not."""
    return df.filter(valid_at(at))


def tags_all(tags: list[str]) -> Column:
    have = F.transform("tags", F.lower)
    return F.size(F.array_except(F.array(*(F.lit(t.lower()) for t in tags)), have)) == 0


def phrase(df: DataFrame, words: str, case_sensitive: bool = False, limit: int = 20) -> DataFrame:
    hit = F.col("content").contains(words) if case_sensitive else F.lower("content").contains(words.lower())
    return df.filter(hit).orderBy(F.desc("created_at"), "node_id").limit(limit)


def check_pattern(pattern: str) -> str:
    """Reject patterns that are empty, too long, nested in their quantifiers or no regular expression."""
    if not pattern or len(pattern) > 256 or re.search(r"\([^)]*[+*][^)]*\)[+*]", pattern):
        raise ValueError("unusable pattern")
    re.compile(pattern)
    return pattern


def regex(df: DataFrame, pattern: str, limit: int = 20, first: int = 8000) -> DataFrame:
    return df.filter(F.substring("content", 1, first).rlike(check_pattern(pattern))).orderBy(F.desc("created_at"), "node_id").limit(limit)


def glob_constraints(paths: DataFrame, rules: list[dict]) -> DataFrame:
    """paths(path) with every rule whose pattern fits the path or its last part; rules are a short list, a literal."""
    base = F.element_at(F.split("path", "/"), -1)
    hits = [
        F.when(F.col("path").rlike(p := fnmatch.translate(r["pattern"]).replace(r"\Z", "$").replace(r"\z", "$")) | base.rlike(p),
               F.struct(F.lit(r["pattern"]).alias("pattern"), F.lit(r["constraint"]).alias("constraint"), F.lit(r.get("severity", "warning")).alias("severity")))
        for r in rules
    ]
    found = paths.withColumn("hit", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())))
    return found.select("path", "hit.pattern", "hit.constraint", "hit.severity")


def by_prefix(df: DataFrame, prefix: str, most: int = 10) -> DataFrame:
    """Ids that begin with a prefix of four characters or more, and how many there are: one is unique."""
    if len(prefix) < 4:
        raise ValueError("prefix too short")
    found = df.filter(F.col("node_id").startswith(prefix)).select("node_id").orderBy("node_id").limit(most + 1)
    return found


def flagged(df: DataFrame, limit: int = 20) -> DataFrame:
    return df.filter(F.col("feedback_score") <= policy.FLAGGED_AT).orderBy(F.desc("created_at"), "node_id").limit(limit)


def sensitivity_ok(level: Column, most: str) -> Column:
    rank = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, policy.SENSITIVITY)), c), F.lit(1))
    return rank(level) <= policy.SENSITIVITY.index(most) + 1


def capture_block_reason(content: Column, event_type: Column, least: int = 80) -> Column:
    """Why a capture is refused, or null: the first reason that applies."""
    return (
        F.when(F.trim(content) == "", "empty")
        .when(content.startswith("<") | content.startswith("[tool"), "blocked_prefix")
        .when(event_type.isin(policy.INFRASTRUCTURE), "infrastructure")
        .when(F.length(content) < least, "too_short")
        .when((event_type == "decision") & content.startswith("{"), "json_blob")
    )


def stale(df: DataFrame, now: Column, days: int, min_age: int = 0) -> DataFrame:
    age = age_days("created_at", now)
    return df.filter((age >= min_age) & (age <= min_age + days) & (F.col("access_count") == 0) & ~F.col("event_type").isin(policy.PROTECTED_STALE))


def safe_id(c: Column) -> Column:
    return F.when(c.rlike(r"^[A-Za-z0-9_.:\-]{1,128}$") & ~c.contains(".."), c)


def clamp(c: Column, low: int, high: int, default: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.expr("try_cast(NULL AS INT)") if c is None else c, F.lit(default))))


def row_view(df: DataFrame, schema: str) -> DataFrame:
    """Rows with their metadata document parsed into typed columns."""
    parsed = F.from_json("metadata", schema)
    return df.withColumn("m", parsed).select(*[c for c in df.columns if c != "metadata"], "m.*")


def keyword_filter(df: DataFrame, words: list[str]) -> DataFrame:
    return df.filter(F.size(F.array_intersect(tx.tokens("content"), F.array(*map(F.lit, words)))) > 0)
