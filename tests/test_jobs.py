"""Generator jobs, prefetching, routing, deleting and surfacing on small and odd tables."""

import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemo.operators import generate as ge
from mnemo.operators import lifecycle as lc
from mnemo.operators import prefetch as pf
from mnemo.operators import router as ro
from mnemo.schema import as_of
from mnemo.streaming import streams
from mnemo.streaming import surfacing as su

START = datetime(2024, 1, 1)
MEM = "node_id string, content string, event_type string, created_at timestamp, session_id string, project string, access_count int, status string, ttl_seconds long, entity_id string, tags array<string>, memory_type string"


def memories(spark, rows):
    """rows of (id, content, type, hour, session, project, uses)."""
    full = [(i, c, t, None if h is None else START + timedelta(hours=h), s, p, n, "active", None, None, None, None) for i, c, t, h, s, p, n in rows]
    return spark.createDataFrame(full, MEM)


def test_replies_fail_alone(spark):
    def model(prompts):
        if "bad" in set(prompts):
            raise RuntimeError("down")
        return prompts.str.upper()

    p = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", None)], "id string, prompt string").coalesce(1)
    assert {r["id"]: r["reply"] for r in ge.replies(p, "id", model).collect()} == {"a": "X", "b": None, "c": None}


@pytest.mark.parametrize(("reply", "kept"), [
    ('{"skill_type": "a", "summary": "s", "steps": ["x"], "key_insight": "k"}', True), ('```json\n{"skill_type": "a", "summary": "s", "steps": ["x"], "key_insight": "k"}\n```', True),
    ('{"skip": true, "skill_type": "a", "summary": "s", "steps": ["x"], "key_insight": "k"}', False), ('{"skill_type": "a", "summary": "s", "steps": [], "key_insight": "k"}', False),
    ("sorry", False), (None, False), ("", False),
])
def test_distill(spark, reply, kept):
    m = memories(spark, [(f"m{i}", f"c{i}", "task_completion" if i == 1 else "decision", i, "s", "p", 0) for i in range(60)] + [("z", "c", "decision", 0, "short", "p", 0)])
    assert ge.trajectories(m).count() == 0  # what was finished is not among the newest fifty
    m = m.filter("node_id in ('m0', 'm1', 'm2', 'z')")
    t = ge.trajectories(m).collect()
    assert [r["prompt"] for r in t] == ["- [decision] c0\n- [task_completion] c1\n- [decision] c2"]
    got = ge.distill(m, lambda s: pd.Series([reply] * len(s))).collect()
    assert [r["content"] for r in got] == (["s. Steps: x. Insight: k"] if kept else [])


def test_enrich_again_finds_nothing(spark):
    m = memories(spark, [("a", "x" * 80, "decision", 0, None, None, 0), ("b", "x" * 79, "decision", 0, None, None, 0), ("c", "y" * 90, "decision", None, None, None, 0), ("d", None, "memory", 0, None, None, 0), ("e", "z" * 90, "memory", 744, None, None, 0)])
    ask = lambda s: s.map(lambda t: json.dumps([t[:3], " ", "q" * 201] + ["w"] * 9))
    embed = lambda s: s.map(lambda t: [float(len(t))])
    first = ge.enrich(m, m.limit(0).select("node_id"), as_of(), ask, embed).collect()
    assert {r["node_id"]: (r["queries"], r["v"]) for r in first} == {"a": (["xxx"] + ["w"] * 4, [80.0 + 1 + 3 + 8]), "c": (["yyy"] + ["w"] * 4, [90.0 + 1 + 3 + 8])}
    assert ge.enrich(m, spark.createDataFrame(first).select("node_id"), as_of(), ask, embed).count() == 0


def test_prefetch(spark):
    m = memories(spark, [
        ("a", "see src/auth.py and lib/auth.test.js", "memory", 0, None, "p", 3), ("b", "AUTH fails", "memory", 0, None, None, 9), ("c", "auth of others", "memory", 0, None, "q", 5),
        ("d", None, "memory", 0, None, "p", 7), ("e", "", "memory", 0, None, None, 7), ("f", "unused/file.py", "memory", 0, None, "p", 0),
    ])
    got = {(r["project"], r["stem"], r["node_id"], r["place"]) for r in pf.prefetch(m, as_of()).collect()}
    assert got == {("p", "auth", "b", 1), ("p", "auth", "a", 2), ("p", "auth.test", "a", 1)}
    named = spark.createDataFrame([("q", "auth")], "project string, stem string")
    assert {r["node_id"] for r in pf.prefetch(m, as_of(), named).collect()} == {"b", "c"}
    assert pf.prefetch(m.limit(0), as_of()).count() == 0


ASK = "query_id long, mode string, text string, wanted int, event_type string, project string, session_id string, tags array<string>, memory_type string, status string, strength_min double, case_sensitive boolean, browse_by string, days int"


def asks(spark, *rows):
    names = [c.split()[0] for c in ASK.replace("array<string>", "list").split(", ")]
    return spark.createDataFrame([tuple({"query_id": i, **r}.get(c) for c in names) for i, r in enumerate(rows)], ASK).withColumn("q", F.lit(None).cast("array<double>"))


def test_routes(spark):
    m = memories(spark, [("a", "Alpha beta", "decision", 1, "s", "p", 0), ("b", "alpha BETA gamma", "memory", 2, "s", "q", 0), ("c", None, "memory", 3, "t", None, 0), ("d", "x.y", "memory", 4, "t", "", 0)])
    r = asks(spark, {"mode": "phrase", "text": "alpha beta"}, {"mode": "phrase", "text": "Alpha beta", "case_sensitive": True}, {"mode": "phrase", "text": "beta", "project": "p"},
        {"mode": "regex", "text": "^x.y$|gam+a"}, {"mode": "regex", "text": "BETA", "case_sensitive": True, "wanted": 0}, {"mode": "browse", "wanted": 2}, {"mode": "browse", "browse_by": "session", "session_id": "s"},
        {"mode": "browse", "browse_by": "type", "event_type": "decision", "wanted": 999}, {"mode": "timeline", "days": 400, "wanted": 3}, {"mode": "regex", "text": "(a+)+"}, {"mode": "regex", "text": "["}, {"text": " "},
        {"mode": "browse", "browse_by": "type"}, {"mode": "regex", "text": "a" * 257})
    got = {}
    none = spark.createDataFrame([], "node_id string, v array<double>")
    for x in ro.answer(r, m, none, none, as_of()).orderBy("query_id", "place").collect():
        got.setdefault(x["query_id"], []).append(x["node_id"])
    assert got == {0: ["b", "a"], 1: ["a"], 2: ["a"], 3: ["d", "b"], 4: ["b"], 5: ["d", "c"], 6: ["b", "a"], 7: ["a"], 8: ["d", "c", "b"]}
    why = {x["query_id"]: x["error"] for x in ro.rejected(r).collect()}
    assert why == {9: "nested quantifiers", 10: "not a pattern", 11: "text is required", 12: "event_type is required", 13: "pattern is too long"}


def test_patterns_in_many_blocks(spark):
    m = memories(spark, [(f"m{i:03}", f"word{i} end", "memory", i, "s", None, 0) for i in range(200)])
    r = ro.checked(asks(spark, *({"mode": "regex", "text": f"^word{i}\\b"} for i in range(200))))
    assert {(x["query_id"], x["node_id"]) for x in ro.patterns(r, m).collect()} == {(i, f"m{i:03}") for i in range(200)}
    p = ro.checked(asks(spark, *({"mode": "phrase", "text": f"word{i} end"} for i in range(200))))
    assert {(x["query_id"], x["node_id"]) for x in ro.phrases(p, m).collect()} == {(i, f"m{i:03}") for i in range(200)}


def test_delete(spark):
    m = memories(spark, [("a", "x", "memory", 0, "s", "p", 0), ("b", None, None, 0, "s", "p", 0)])
    e = spark.createDataFrame([("a", "c"), ("c", "a"), ("c", "d"), ("a", "a")], "source_id string, target_id string")
    gone, log = lc.deleted(m, spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "node_id string"), as_of())
    assert {(r["node_id"], r["success"], r["error"]) for r in gone.collect()} == {("a", True, None), ("z", False, "Memory z not found")}
    assert [(r["node_id"], r["reason"]) for r in log.collect()] == [("a", "user_deleted")]
    assert lc.lost_links(e, gone).count() == 3 and [tuple(r) for r in lc.links_left(e, gone).collect()] == [("c", "d")]


def test_debounce_over_batches(spark, tmp_path):
    """State lives from batch to batch; what comes in order passes as by hand, and null times and keys do no harm."""
    at = [[0, 5, 20, 39], [40, 41, 61, 200_000], [200_010, 200_020, 200_020]]
    n = 0
    for batch in at:
        rows = [(f"n{(n := n + 1):03}", START + timedelta(seconds=s), "k") for s in batch] + [(f"x{n}", None, "k")]
        spark.createDataFrame(rows, "node_id string, created_at timestamp, key string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = streams.read_events(spark, str(tmp_path / "in"), "node_id string, created_at timestamp, key string")
    got = [int((r["at"] - START).total_seconds()) for r in streams.run_once(streams.debounced(s, "key", 20, "1 hour"), "debounce").orderBy("at").collect()]
    want, last = [], None
    for t in sum(at, []):
        if last is None or t - last >= 20:
            want.append(t)
            last = t
    assert got == want


def test_blocks(spark):
    p = spark.createDataFrame([("e", 1, "[MEMORY_CONTEXT] a\n\nFacts:\n- one"), ("e", 2, "[MEMORY_CONTEXT] b\n\nLessons:\n- " + "w" * 600), ("f", 1, "[MEMORY_CONTEXT] c\n\nFacts:")], "node_id string, pass int, text string")
    assert {r["node_id"]: r["block"] for r in su.blocks(p).collect()} == {"e": "[MEMORY_CONTEXT] a\n\nFacts:\n- one"}
