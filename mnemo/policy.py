"""Policy values by memory type, and scoring constants."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, decay rates, priorities, lifetimes, classes and thresholds that results depend on.
TYPE_WEIGHT = {
    "constraint": 3.0, "reminder": 3.0, "checkpoint": 2.5, "decision": 2.0, "lesson_learned": 2.0, "error_pattern": 2.0,
    "user_preference": 2.0, "contradiction_detected": 2.0, "skill_template": 2.0, "project_history": 1.8,
    "advisor_insight": 1.5, "public_statement": 1.5, "outcome_resolution": 1.5, "task_completion": 1.4,
    "sota_research": 1.4, "reflexion": 1.3, "outcome_evaluation": 1.3, "self_reflection": 1.3, "research_report": 1.3,
    "benchmark_update": 1.3, "session_summary": 1.2, "preference_generated": 1.1, "advisor_action_outcome": 1.1,
    "sota_scan": 1.1, "file_conflict": 1.0, "entity_profile_update": 1.0, "merge_claim": 0.8, "merge_release": 0.8,
    "file_claimed": 0.7, "file_released": 0.7, "branch_claimed": 0.7, "branch_released": 0.7, "session_respawn": 0.5,
    "test": 0.4, "coordination_snapshot": 0.2, "code_chunk": 0.1, "file_summary": 0.05,
}
DECAY = {
    "constraint": 0.0, "user_preference": 0.0, "error_pattern": 0.0, "reminder": 0.0, "lesson_learned": 0.005,
    "project_history": 0.005, "skill_template": 0.01, "advisor_insight": 0.015, "decision": 0.015, "checkpoint": 0.02,
    "memory": 0.02, "task_completion": 0.03, "session_summary": 0.05, "coordination_snapshot": 0.10,
}
DECAY_DEFAULT, FLOOR_USED, FLOOR_UNUSED = 0.02, 0.35, 0.15
ACCESS_AWARE = ["decision", "lesson_learned", "advisor_insight", "skill_template", "project_history"]
ACCESS_FACTOR, ACCESS_CAP, ACCESS_LEAST = 0.85, 10, 0.002
PRIORITY = {
    "constraint": 5, "checkpoint": 5, "reminder": 5, "user_preference": 5, "error_pattern": 4, "lesson_learned": 4,
    "decision": 4, "skill_template": 4, "session_summary": 2, "coordination_snapshot": 1, "session_respawn": 1,
    "file_summary": 1, "code_chunk": 1,
}
HOUR, DAY = 3600, 86400
TTL = {
    "code_chunk": HOUR, "blocked_context": DAY, "session_start": DAY, "context_warning": DAY, "coordination_snapshot": DAY,
    "system_event": DAY, "sota_scan": DAY, "test": DAY, "file_summary": DAY, "checkpoint": 7 * DAY,
}
TTL_LONG = 90 * DAY
PERMANENT = [
    "error_pattern", "lesson_learned", "decision", "user_preference", "user_fact", "advisor_insight", "constraint",
    "reminder", "skill_template", "project_context", "project_status", "project_history", "git_conflict",
]
EPISODIC = [
    "session_summary", "task_completion", "coordination_snapshot", "session_respawn", "merge_claim", "merge_release",
    "file_claimed", "file_released", "branch_claimed", "branch_released", "code_chunk", "file_summary", "file_conflict",
]
PROCEDURAL = ["lesson_learned", "reflexion", "self_reflection", "outcome_evaluation", "reminder", "skill_template"]
INFRASTRUCTURE = ["file_summary", "code_chunk", "session_respawn", "coordination_snapshot", "session_summary"]
PROTECTED = [
    "user_preference", "error_pattern", "behavioral_pattern", "constraint", "reminder", "decision", "lesson_learned",
    "advisor_insight", "project_history",
]
PROTECTED_STALE = ["user_preference", "constraint", "behavioral_pattern", "reminder"]
JACCARD = {
    "error_pattern": 0.70, "session_summary": 0.75, "advisor_insight": 0.75, "decision": 0.80, "user_fact": 0.80,
    "memory": 0.80, "task_completion": 0.85, "lesson_learned": 0.85, "skill_template": 0.85, "project_status": 0.85,
    "checkpoint": 0.90, "constraint": 0.90,
}
EVOLVING = [
    "lesson_learned", "decision", "error_pattern", "constraint", "skill_template", "project_status", "advisor_insight",
    "session_summary",
]
PERSPECTIVE = {
    "implementation": {"error_pattern": 1.8, "lesson_learned": 1.5, "decision": 1.3, "task_completion": 1.4, "code_chunk": 2.0, "file_summary": 2.0},
    "critique": {"constraint": 1.8, "user_preference": 1.8, "contradiction_detected": 2.0, "lesson_learned": 1.3, "error_pattern": 1.5, "decision": 0.8},
    "verification": {"decision": 1.8, "lesson_learned": 1.5, "benchmark_update": 1.8, "outcome_evaluation": 1.8, "sota_research": 1.5, "error_pattern": 1.3},
}
#: Vector, text, word, context, graph.
PROFILES = {
    "error_pattern": (0.3, 1.5, 2.0, 0.5, 0.3), "decision": (0.8, 0.6, 0.5, 1.0, 2.0), "lesson_learned": (1.5, 0.8, 0.5, 0.8, 1.0),
    "user_preference": (0.6, 1.0, 1.5, 0.3, 0.3), "_default": (0.7, 1.5, 1.3, 1.0, 1.0),
}
INTENTS = {"factual": (0.3, 1.5, 1.8, 1.0, 1.0), "conceptual": (1.8, 0.5, 0.3, 1.0, 1.0), "navigational": (0.1, 2.0, 2.0, 0.5, 0.3)}
#: Least vector similarity, text score and composite, and context boost.
SURFACING = {
    "general": (0.50, 0.35, 0.10, 1.0), "error_debug": (0.40, 0.45, 0.08, 1.0), "file_edit": (0.50, 0.35, 0.10, 2.0),
    "session_start": (0.45, 0.40, 0.10, 1.0), "planning": (0.45, 0.40, 0.10, 1.5), "review": (0.45, 0.40, 0.10, 1.5),
}
#: Up to which place the reranker counts how much; the last for all after.
RERANK_TIERS = [(3, 0.15), (10, 0.30), (None, 0.50)]
RRF_K, TEMPORAL_WEIGHT, ENTITY_WEIGHT = 60, 1.2, 0.8
RATINGS = {"helpful": 1, "unhelpful": -1, "outdated": -2}
FLAGGED_AT = -3
SENSITIVITY = ["public", "internal", "confidential", "restricted"]
PACKET_TYPE = {"constraint": 3.0, "decision": 2.4, "error_pattern": 2.1, "lesson_learned": 1.8, "user_preference": 1.6, "user_fact": 1.2}
PACKET_EDGE = {"supersedes": 1.2, "same_entity": 1.12, "evolution": 1.12, "derived_from": 1.12, "evolves": 1.1, "contradicts": 1.05, "temporal_cluster": 1.03}
ANTONYMS = [
    ("always", "never"), ("true", "false"), ("enable", "disable"), ("enabled", "disabled"), ("yes", "no"), ("light", "dark"),
    ("on", "off"), ("allow", "deny"), ("allow", "block"), ("accept", "reject"), ("include", "exclude"), ("prefer", "avoid"),
    ("like", "dislike"), ("use", "avoid"), ("increase", "decrease"), ("add", "remove"), ("start", "stop"), ("open", "close"),
    ("show", "hide"), ("public", "private"), ("before", "after"),
]
SUFFIXES = ["ation", "tion", "ment", "ing", "ness", "ity", "ous", "ive", "able", "ed", "er", "es", "ly", "al", "s"]
MILESTONES, STREAKS = [1, 10, 50, 100, 500, 1000, 1500, 2000], [7, 30, 100, 365]


def by_type(values: dict, key: Column | str, default) -> Column:
    """The value for a type column: a literal map, so that no join is needed."""
    found = F.create_map(*(F.lit(x) for x in chain(*values.items())))
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.element_at(found, key), F.lit(default))


def ttl_seconds(key: str = "event_type") -> Column:
    """Lifetime of a type; null for permanent ones."""
    return F.when(~F.col(key).isin(PERMANENT) | F.col(key).isNull(), by_type(TTL, key, TTL_LONG)).cast("long")


def memory_class(key: str = "event_type") -> Column:
    return F.when(F.col(key).isin(EPISODIC), "episodic").when(F.col(key).isin(PROCEDURAL), "procedural").otherwise("semantic")
