"""Closed-form vectors and round trips."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mnemo.functions import scoring as sc
from mnemo.functions import text as tx
from mnemo.operators import dedup as dd
from mnemo.operators import evaluation as ev
from mnemo.operators import filters as fl
from mnemo.operators import retrieval as rt
from mnemo.schema import MEMORIES, as_of, migrate
from mnemo.sources import io


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("score", "want"), [(0, 1.0), (5, 1.75), (10, 2.5), (15, 2.5), (-4, 0.2), (-10, 0.2)])
def test_feedback_factor(spark, score, want):
    assert one(spark, sc.feedback_factor(F.lit(score))) == pytest.approx(want)


@pytest.mark.parametrize(("priority", "want"), [(1, 0.78), (3, 0.94), (5, 1.10)])
def test_priority_factor(spark, priority, want):
    assert one(spark, sc.priority_factor(F.lit(priority))) == pytest.approx(want)


@pytest.mark.parametrize(("kind", "days", "access", "low", "high"), [
    ("user_preference", 365, 0, 1, 1), ("error_pattern", 365, 0, 1, 1), ("reminder", 365, 0, 1, 1), ("decision", 0, 0, 0.99, 1),
    ("session_summary", 10000, 0, 0.15, 0.15), ("session_summary", 10000, 1, 0.35, 0.35), ("decision", 30, 0, 0.588, 0.688),
])
def test_decay(spark, kind, days, access, low, high):
    row = spark.createDataFrame([(kind, access)], "event_type string, access_count int")
    row = row.withColumn("created_at", as_of() - F.make_dt_interval(F.lit(days))).withColumn("last_accessed", F.lit(None).cast("timestamp"))
    assert low - 1e-9 <= row.select(sc.decay(as_of()).alias("x")).first()["x"] <= high + 1e-9


def test_rrf(spark):
    c = spark.createDataFrame([(1, "a", "x", 0.9), (1, "b", "x", 0.8), (1, "a", "y", 0.1)], "query_id int, channel string, node_id string, score double")
    got = {r["node_id"]: r["rrf"] for r in rt.rrf(c, {}).collect()}
    assert got["x"] == 1.0 and 0 < got["y"] < 1
    assert rt.rrf(c.limit(0), {}).count() == 0


@pytest.mark.parametrize(("wins", "losses", "want"), [(2, 2, 1.0), (10, 0, 2 / 1024), (0, 0, 1.0)])
def test_sign_test(wins, losses, want):
    assert ev.sign_test(wins, losses) == pytest.approx(want)


def test_ndcg(spark):
    r = spark.createDataFrame([(1, i, i + 1) for i in range(4)], "probe_id int, doc_id int, rank int")
    best = spark.createDataFrame([(1, 0, 3), (1, 1, 2), (1, 2, 1), (1, 3, 0)], "probe_id int, doc_id int, grade int")
    worst = best.withColumn("grade", F.when(F.col("doc_id") == 3, 3).otherwise(0))
    assert ev.ndcg(r, best, 4).first()["ndcg"] == pytest.approx(1.0)
    assert 0 < ev.ndcg(r, worst, 4).first()["ndcg"] < 1
    assert ev.ndcg(r, best.withColumn("grade", F.lit(0)), 4).first()["ndcg"] == 0


def test_contradiction(spark):
    score = lambda a, b: one(spark, dd.contradiction(F.lit(a), F.lit(b), F.lit(0.8)))
    assert score("the user prefers dark mode in editors", "the user prefers light mode in editors") > 0.3
    assert score("the build runs on linux", "lunch is at noon") == 0


def test_evolve_appends_only_new_sentences(spark):
    row = spark.createDataFrame([("Deploy through staging first.", "Deploy through staging first. Rollback requires manual approval tickets.", 0.7, "decision")], "old string, new string, jaccard double, event_type string")
    assert "Rollback requires" in dd.evolve(row).first()["evolved"]


def test_leader_clusters(spark):
    rows = [("a", "t", 3, "alpha beta gamma delta"), ("b", "t", 2, "alpha beta gamma delta"), ("c", "t", 1, "other words entirely here")]
    df = spark.createDataFrame(rows, "node_id string, event_type string, created_at int, content string")
    assert {r["node_id"]: r["leader"] for r in dd.leader_clusters(df, 0.8).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_duration_and_ttl(spark):
    assert one(spark, tx.duration_seconds(F.lit("1w2d3h4m"))) == 604800 + 2 * 86400 + 3 * 3600 + 240
    assert one(spark, tx.duration_seconds(F.lit("soon"))) is None
    assert one(spark, tx.human_ttl(F.lit(7200))) == "2h"


@pytest.mark.parametrize("bad", ["", "a" * 257, "(a+)+"])
def test_patterns_are_checked(bad):
    with pytest.raises(ValueError):
        fl.check_pattern(bad)


def test_null_predicates(spark):
    df = spark.createDataFrame([("a", None), ("b", "superseded"), ("c", "active")], "node_id string, status string")
    assert {r["node_id"] for r in df.filter(fl.active()).collect()} == {"a", "c"}


def test_json_round_trip(spark, tmp_path):
    df = migrate(spark.createDataFrame([("mem-1", "text", "decision")], "node_id string, content string, event_type string"))
    io.export_json(df, str(tmp_path))
    assert io.import_json(spark, str(tmp_path), MEMORIES).collect() == df.collect()


def test_jsonl_counts_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"content": "a", "metadata": {"event_type": "decision"}}\nnot json\n{"content": "b", "metadata": {"event_type": "test"}}\n')
    rows, counts = io.read_jsonl(spark, str(tmp_path / "x.jsonl"), ["test"])
    assert rows.count() == 1 and counts.first().asDict() == {"lines": 3, "bad": 1, "skipped": 1}


def test_merge_new_is_by_content(spark):
    a = spark.createDataFrame([("1", "x")], "node_id string, content string")
    b = spark.createDataFrame([("2", "x"), ("3", "y"), ("4", "y")], "node_id string, content string")
    assert io.merge_new(a, b).count() == 2


def plain_extract(members):
    """One cluster's extract, sentence by sentence: members are (node_id, content, created_at)."""
    import re
    from collections import Counter

    members = sorted((m for m in members if m[1] is not None), key=lambda m: (-len(m[1]), m[0]))
    long = lambda s: [w for w in s.lower().split() if len(w) > 3]
    uses = Counter(w for m in members for w in set(long(m[1])))
    found, keys = [], set()
    for _, text, at in members:
        for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)):
            key = " ".join(s.lower().split())[:100]
            if len(s) >= 15 and key not in keys:
                keys.add(key)
                score = len(set(long(s))) + 1.5 * sum(w[0].isupper() for w in s.split()[1:]) + 3 * min(len(s), 200) / 200
                score += 2 * len(re.findall(r"`[^`]+`|/[\w/.]+|\b[A-Z][a-z]+[A-Z]\w*\b", s, re.ASCII)) + 0.8 * sum(uses[w] > 1 for w in s.lower().split())
                found.append((round(score, 9), at, s, set(re.findall(r"[a-z0-9_]{3,}", s.lower()))))
    chosen = []
    for x in sorted(found, key=lambda x: -x[0]):
        if len(chosen) < 8 and all(not x[3] | y[3] or len(x[3] & y[3]) / len(x[3] | y[3]) < 0.7 for y in chosen):
            chosen.append(x)
    text = " ".join(x[2] for x in sorted(chosen, key=lambda x: x[1]))
    pairs = Counter(" ".join(p) for m in members for p in zip(long(m[1]), long(m[1])[1:]))
    n, theme = min(((-n, p) for p, n in pairs.items()), default=(0, ""))
    if len(members) >= 5 and n <= -3 and text:
        text = f"Strategy: {theme}. {text}"
    return text[:997] + "..." if len(text) > 1000 else text


def test_smart_extract_equals_a_plain_twin(spark):
    import random
    from datetime import datetime, timedelta

    rng = random.Random(5)
    words = "the build cache Redis needs warm start after `make all` in /usr/lib/x.so FooBar deploy never again staging".split(" ")
    rows = []
    for i in range(60):
        sentences = [" ".join(rng.choices(words, k=rng.randint(1, 12))) + rng.choice([".", "!", "?"]) for _ in range(rng.randint(0, 9))]
        rows.append((f"n{i:02}", "  ".join(sentences), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(9)), f"c{i % 7}" if i < 50 else "c9"))
    rows += [("e1", "", datetime(2024, 1, 1), "empty"), ("e2", "short.", datetime(2024, 1, 1), "empty"), ("z", None, None, "null")]
    df = spark.createDataFrame(rows, "node_id string, content string, created_at timestamp, leader string")
    got = {r["leader"]: r for r in dd.smart_extract(df.select("node_id", "leader"), df).collect()}
    for c in {r[3] for r in rows}:
        of = [r[:3] for r in rows if r[3] == c]
        assert got[c]["members"] == len(of)
        assert got[c]["text"] == plain_extract(of)


def test_synthesized(spark):
    from datetime import datetime

    said = "the build cache needs warm start before deploy number "
    rows = [(f"n{i}", "advisor_insight", datetime(2024, 1, 1 + i), said + f"extra{i % 2} today.", ["cache", f"t{i}"], 2) for i in range(4)]
    rows += [("x", "advisor_insight", datetime(2024, 1, 9), "nothing like those others written here.", None, 1)]
    df = spark.createDataFrame(rows, "node_id string, event_type string, created_at timestamp, content string, tags array<string>, access_count int")
    (r,) = dd.synthesized(df).collect()
    assert (r["leader"], r["subsystem"], r["members"], r["access_count"]) == ("n3", "cache", 4, 8)
    assert r["compacted_from"] == ["n0", "n1", "n2", "n3"] and r["tags"] == ["cache", "t0", "t1", "t2", "t3"]
    assert r["content"].startswith("[Subsystem brief: cache] the build cache")
    assert dd.synthesized(df, least=9).count() == 0 == dd.synthesized(df.limit(0)).count()


def test_tags(spark):
    from mnemo.operators import extract as ex

    s = "K8s and PostgreSQL tests; go figure. See /opt/app/main.py, a.TS and hooks"
    assert one(spark, ex.tags(F.lit(s), F.lit("/home/me/Proj"))) == ["/opt/app/main.py", "hook", "kubernetes", "postgres", "proj", "python", "testing", "typescript"]
    assert one(spark, ex.tags(F.lit("go func"))) == ["go"]
    assert one(spark, ex.tags(F.lit(None).cast("string"), F.lit("a/"))) == []


def test_leader_clusters_equal_a_plain_loop(spark):
    """No bound on a type's rows, ties in time, equal sets, chains of similar ones, memories without words or type."""
    import random

    rng = random.Random(4)
    rows = []
    for i in range(260):
        base = rng.randrange(12)
        words = [f"word{base}x{j}" for j in range(10)] + [f"more{rng.randrange(6)}"] * rng.randrange(3)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(10)] = f"word{base}y{rng.randrange(5)}"
        text = rng.choice([" ".join(words), " ".join(words), "a b c", "", None])
        rows.append((f"n{i:03d}", text, rng.choice(["decision", "memory", None]), datetime(2024, 1, 1 + rng.randrange(9))))
    df = spark.createDataFrame(rows, "node_id string, content string, event_type string, created_at timestamp")
    got = {r["node_id"]: (r["leader"], r["keeper"]) for r in dd.leader_clusters(df, 0.6).collect()}
    sets = {n: set(re.findall("[a-z0-9_]{4,}", (t or "").lower())) for n, t, _, _ in rows}
    leaders, want = [], {}
    for n, _, kind, _ in sorted(rows, key=lambda r: (-r[3].timestamp(), r[0])):
        found = next((m for m, k in leaders if k == kind and kind and sets[n] and len(sets[n] & sets[m]) / len(sets[n] | sets[m]) >= 0.6), None)
        if found is None:
            leaders.append((n, kind))
        want[n] = found or n
    size = {n: -1 if t is None else len(t) for n, t, _, _ in rows}
    keeper = {m: min((n for n in want if want[n] == m), key=lambda n: (-size[n], n)) for m in set(want.values())}
    assert got == {n: (m, keeper[m]) for n, m in want.items()}


def test_similar_pairs_with_split_words(spark):
    rows = [(f"n{i:02d}", " ".join(f"term{j}" for j in range(20) if j != i % 25), "decision") for i in range(40)]
    df = spark.createDataFrame(rows, "node_id string, content string, event_type string")
    got = lambda hot: sorted((r["a"], r["b"], round(r["jaccard"], 9)) for r in dd.jaccard_pairs(df, 0.7, hot=hot).collect())
    assert got(10_000) == got(3) and len(got(3)) > 100


def test_nearest_neighbours_of_unusable_vectors(spark):
    from mnemo.operators import retrieval as rt

    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1e300, 0.0])]
    v = spark.createDataFrame(rows, "node_id long, v array<double>")
    q = v.select(F.col("node_id").alias("query_id"), F.col("v").alias("q"))
    got = sorted((r["query_id"], r["rank"], r["node_id"]) for r in rt.knn(q, v, 2, 0.1).collect())
    assert got == [(1, 1, 1), (1, 2, 10), (2, 1, 2), (2, 2, 1), (9, 1, 9), (10, 1, 1), (10, 2, 10)]
    older = sorted((r["query_id"], r["node_id"]) for r in rt.knn(q, v, 1, 0.1, below=True).collect())
    assert older == [(2, 1), (10, 1)]


def test_reranker_override_and_near_copies(spark):
    from mnemo.operators import readpath as rp

    limits = rp.Limits()
    scored = spark.createDataFrame([(1, "a", 1.0, -3.0), (1, "b", 0.9, 3.0), (1, "c", 0.8, -3.0), (2, "a", 1.0, 0.01), (2, "b", 0.9, 0.02), (3, "a", 0.5, 9.0)], "query_id int, node_id string, score double, model double")
    got = {(r["query_id"], r["node_id"]): round(r["score"], 6) for r in rp.rerank(scored, limits).collect()}
    # Query 1: a sure favourite takes the first place; query 2: an indifferent model only boosts; query 3: one candidate stays.
    assert got == {(1, "a"): 1.0, (1, "b"): round(0.9 * 1.15 * 1.01, 6), (1, "c"): 0.8, (2, "a"): 1.0, (2, "b"): round(0.9 * 1.15, 6), (3, "a"): 0.5}
    rows = [(1, "a", 3.0, [1.0, 0.0]), (1, "b", 2.0, [1.0, 0.01]), (1, "c", 1.0, [0.0, 1.0]), (1, "d", 0.5, [0.0]), (1, "e", 0.4, [0.0]), (2, "b", 1.0, [1.0, 0.01])]
    df = spark.createDataFrame(rows, "query_id int, node_id string, score double, v array<double>")
    assert sorted(tuple(r) for r in rp.unlike(df, 0.92).collect()) == [(1, "a"), (1, "c"), (1, "d"), (1, "e"), (2, "b")]
