"""Scores as column expressions: feedback, decay, metadata, similarity, boosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemo import policy
from mnemo.schema import age_days


def feedback_factor(score: Column | str) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 0, 1 + 0.15 * F.least(s, F.lit(10))).otherwise(F.greatest(F.lit(0.2), 1 + 0.2 * s))


def decay(now: Column, event_type: str = "event_type") -> Column:
    """Exponential in the days since last access; durable types decay slower the more they were used; floored."""
    rate = policy.by_type(policy.DECAY, event_type, policy.DECAY_DEFAULT)
    used = F.least(F.coalesce("access_count", F.lit(0)), F.lit(policy.ACCESS_CAP))
    slower = F.greatest(F.lit(policy.ACCESS_LEAST), rate * F.pow(F.lit(policy.ACCESS_FACTOR), used))
    lam = F.when(F.col(event_type).isin(policy.ACCESS_AWARE), slower).otherwise(rate)
    days = age_days(F.coalesce("last_accessed", "created_at"), now)
    floor = F.when(F.coalesce("access_count", F.lit(0)) > 0, policy.FLOOR_USED).otherwise(policy.FLOOR_UNUSED)
    return F.when((rate == 0) | (days <= 0), 1.0).otherwise(F.greatest(floor, F.exp(-lam * days)))


def priority_factor(priority: Column | str = "priority") -> Column:
    p = F.col(priority) if isinstance(priority, str) else priority
    return 0.7 + 0.08 * F.greatest(F.lit(1), F.least(F.lit(5), p))


def type_weight(event_type: str = "event_type") -> Column:
    return policy.by_type(policy.TYPE_WEIGHT, event_type, 1.0)


def metadata_factor(now: Column) -> Column:
    return type_weight() * feedback_factor("feedback_score") * priority_factor() * decay(now)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def recency(hours: Column) -> Column:
    return 1 / (1 + hours / 72)


def access_boost(n: Column) -> Column:
    return F.least(F.log2(1 + n), F.lit(5.0))


def consolidation_factor(quality: Column) -> Column:
    return 1 + 0.1 * F.least(quality, F.lit(3.0))


def staleness(days: Column, priority: Column, superseded: Column) -> Column:
    return 0.4 * F.least(F.lit(1.0), days / 90) + 0.3 + 0.2 * F.greatest(F.lit(0.0), 1 - priority / 5) + 0.1 * superseded.cast("int")


def temporal_boost(t: Column, start: Column, end: Column, explicit: bool = True) -> Column:
    """Inside the range, near it, and outside."""
    span = F.greatest(F.unix_micros(end) - F.unix_micros(start), F.lit(86_400_000_000))
    near = (F.unix_micros(t) >= F.unix_micros(start) - span) & (F.unix_micros(t) <= F.unix_micros(end) + span)
    return F.when((t >= start) & (t <= end), 1.3).when(near, 0.85).otherwise(0.15 if explicit else 0.70)
