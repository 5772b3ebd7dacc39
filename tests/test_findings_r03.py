"""Small cases of the findings of round 3: results, and how many rows are made on the way."""

import random
import re
from datetime import datetime

from pyspark.sql import functions as F

from mnemo.operators import dedup as dd


def most_joined(df):
    """The most rows that a join of the plan put out, once the plan has run."""
    df.collect()

    def walk(p):
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            yield from walk(p.executedPlan())
        elif "QueryStage" in name:
            yield from walk(p.plan())
        else:
            if "Join" in name:
                yield p.metrics().get("numOutputRows").get().value()
            for i in range(p.children().size()):
                yield from walk(p.children().apply(i))

    return max(walk(df._jdf.queryExecution().executedPlan()), default=0)


def test_similar_pairs_are_verified_before_they_are_written(spark, monkeypatch):
    """Sets share rare words by chance, each with many; none of these meetings leaves its group."""
    rng = random.Random(7)
    rows = [(f"n{i:03d}", " ".join(rng.sample([f"word{j}" for j in range(400)], 40)), "decision") for i in range(150)]
    rows += [(f"m{i:03d}", rows[i][1] + " extra" if i % 2 else rows[i][1][7:], "decision") for i in range(30)]
    df = spark.createDataFrame(rows, "node_id string, content string, event_type string")
    sizes, kept = {}, dd.written

    def counted(df, name):
        out = kept(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(dd, "written", counted)
    sets = {n: set(re.findall("[a-z0-9_]{4,}", t)) for n, t, _ in rows}
    for low in (0.6, 0.8):
        for hot in (10_000, 20):
            got = {(r["a"], r["b"]) for r in dd.jaccard_pairs(df, low, hot=hot).collect()}
            want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= low * len(sets[a] | sets[b])}
            assert got == want and len(got) >= 30
            assert sizes["alike"] == len(got)


def test_ranges_of_equal_dates_meet_once(spark, tmp_path):
    """Lines and orders of one day are counted before they meet."""
    from mnemo.plans.basics import jn_temporal_range

    day = datetime(2024, 1, 2)
    spark.createDataFrame([(i, day) for i in range(60)] + [(0, day)], "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    times = [day, datetime(2024, 1, 3, 23, 59), datetime(2024, 1, 4), datetime(2024, 1, 1, 23)]
    spark.createDataFrame([(t,) for t in times for _ in range(50)], "l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = jn_temporal_range(spark, str(tmp_path))
    assert most_joined(df) <= 100
    assert {r["q"]: r["n"] for r in df.collect()} == {0: 200, **{i: 100 for i in range(1, 60)}}


def test_word_boundaries_are_those_of_ascii(spark):
    """A preference ends at a whole "in", also before a letter beyond ASCII, as in DuckDB."""
    import duckdb

    from mnemo.operators import extract as ex
    from mnemo.plans import load

    texts = ["I never use vim now, better in\u00dflich and more in there", "please always use caf\u00e9 when\u00fc sure for all", "no wish"]
    rows = [(i, 7, "user", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    df.createOrReplaceTempView("conversations")
    from mnemo.schema import TALK_SQL

    talk = spark.sql(TALK_SQL.format(conversations="conversations"))
    got = sorted(tuple(r) for r in talk.select("conv_id", "turn", F.inline(ex.preferences(F.col("text")))).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn INTEGER, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert got == sorted(con.execute(load().SQL["fn_preferences"]).fetchall()) and any(c.endswith(" in") or c.endswith("better") for _, _, c, _ in got)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_document_are_counted_where_it_is(spark):
    """The index counts words without sending them."""
    from mnemo.operators import retrieval as rt

    texts = [("a", "one two two three THREE three x"), ("b", "of a"), ("c", None), ("d", "solo")]
    df = spark.createDataFrame(texts, "node_id string, content string")
    index = rt.postings(df)
    assert "Exchange" not in plan_of(index)
    got = sorted((r["node_id"], r["term"], r["tf"], r["len"]) for r in index.collect())
    assert got == [("a", "one", 1, 6), ("a", "three", 3, 6), ("a", "two", 2, 6), ("d", "solo", 1, 1)]


def test_texts_are_cut_before_they_are_sent(spark, monkeypatch):
    """A query's best texts are kept in each task, by a number that the plan knows."""
    from mnemo.operators import readpath as rp

    df = spark.createDataFrame([(f"n{i:03d}", f"shared words of note{i % 7}") for i in range(200)], "node_id string, content string")
    q = spark.createDataFrame([("q", "shared note3", None, None), ("z", None, None, None)], "query_id string, text string, start timestamp, hint string")
    plans, kept = {}, rp.written

    def seen(df, name):
        plans[name] = plan_of(df)
        return kept(df, name)

    monkeypatch.setattr(rp, "written", seen)
    rows = rp.text_hits(rp.plan(q, 5), df).collect()
    assert "WindowGroupLimit" in plans["best-texts"] and len(rows) == 15
    assert sorted(r["node_id"] for r in rows) == [f"n{i:03d}" for i in range(3, 200, 7)][:15]


def test_negatives_sort_few_pairs(spark):
    """Only pairs under a bound on the fiftieth hash are sorted."""
    from mnemo.plans.reads import samp_negatives

    plan = plan_of(samp_negatives(spark, "/root/testdata/sf0.01"))
    assert "bound" in plan


def test_contradictions_are_looked_for_once(spark):
    """Both ends' lists come from one table of contradictions, so texts are compared once."""
    from mnemo.plans.capture import con_annotate

    df = con_annotate(spark, "/root/testdata/sf0.001")
    assert "conversations.parquet" not in plan_of(df) and df.count() > 0


def test_a_dense_cluster_is_not_opened_for_each_of_its_members():
    """A search meets parts, not their members: pairs found grow with the members, not with their square (F1)."""
    import numpy as np

    from mnemo.llm import flatgraph as fg
    from mnemo.llm.components import unite

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=16) + 0.02 * rng.normal(size=(800, 16)), rng.normal(size=(200, 16))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    a, b = fg.build_graph(x)
    pairs = np.unique(a * len(x) + b)
    to, first = pairs % len(x), np.searchsorted(pairs // len(x), np.arange(len(x) + 1))
    a = np.repeat(np.arange(len(x)), np.diff(first))
    close = fg.cosines(x, a, to) >= 0.9
    part = unite(len(x), a[close], to[close])
    q, found = fg.range_search(x, to, first, 0.9, part)
    assert len(q) <= 2 * fg.BEAM * len(x) and (x[q] * x[found]).sum(1).min() >= 0.9 - 1e-6
    region = unite(len(x), np.concatenate([part, q]), np.concatenate([np.arange(len(x)), found]))
    assert (region == unite(len(x), *np.nonzero(x @ x.T >= 0.9))).all()


def test_sets_meet_only_those_of_a_like_size(spark, monkeypatch):
    """Blocks are cut by size, so that far sizes share no group; words leave their row only where a pair is left."""
    rng = random.Random(3)
    words = [f"word{i}" for i in range(500)]
    rows = [(f"n{i:03d}", " ".join(rng.sample(words, 10 if i % 2 else 200)), "decision") for i in range(120)]
    rows += [(f"o{i}", rows[i][1] + " extra", "decision") for i in range(6)] + [("p0", rows[0][1], "decision"), ("q0", "a", "decision"), ("q1", None, None)]
    df = spark.createDataFrame(rows, "node_id string, content string, event_type string")
    seen, kept = {}, dd.written

    def noted(df, name):
        out = seen[name] = kept(df, name)
        return out

    monkeypatch.setattr(dd, "written", noted)
    got = {(r["a"], r["b"]) for r in dd.jaccard_pairs(df, 0.8, hot=10).collect()}
    assert got == {(f"n{i:03d}", f"o{i}") for i in range(6)}
    blocks = {y for r in seen["blocks"].collect() for y in (r["x"], r["y"])}
    assert len(blocks) >= 5 and seen["blocks"].count() < len(blocks) * (len(blocks) + 1) / 2
    assert seen["linked"].count() == 12
    again = {r["node_id"]: r["leader"] for r in dd.leader_clusters(df.withColumn("created_at", F.lit(datetime(2024, 1, 1))), 0.8).collect()}
    assert again["p0"] == again["o0"] == "n000" and again["q1"] == "q1" and len(again) == len(rows)
    assert "words" not in seen["keyed"].columns


def test_surfacing_sends_nothing_that_grows_to_the_driver(spark, monkeypatch):
    """Seeds, tasks and candidates of packets are never broadcast, however small their files are (F2)."""
    from mnemo.operators import packets as pk

    edges = spark.createDataFrame([("a", "b", "evolution", 0.9, None, False)], "source_id string, target_id string, edge_type string, weight double, source string, typed boolean")
    asked = spark.createDataFrame([("p", "fix it", ["x/y.py"], "home")], "packet_id string, task string, files array<string>, project string")
    seeds = spark.createDataFrame([("p", "a", 0.9, 1)], "packet_id string, node_id string, relevance double, rank int")
    schema = "node_id string, content string, event_type string, status string, feedback_score int, project string, priority int, created_at timestamp"
    m = spark.createDataFrame([(n, f"text {n}", "decision", "active", 0, "home", 1, datetime(2024, 1, 1)) for n in "abc"], schema)
    chained = pk.chains(seeds, edges)
    assert "SortMergeJoin" in plan_of(chained) and "Broadcast" not in plan_of(chained)
    items = pk.candidates(asked, seeds, m, edges).localCheckpoint()
    assert sorted(r["node_id"] for r in items.collect()) == ["a", "b"]
    judged = pk.judge(items, asked, edges).localCheckpoint()
    said = pk.render(asked, judged)
    assert "BroadcastHashJoin" not in plan_of(said) and said.first()["used"] == 2


def test_sums_of_texts_are_cut_where_they_are_made(spark, monkeypatch):
    """Documents' terms are dealt out once, in tasks of a bounded number; sums are never sent by query before they are cut."""
    from mnemo.operators import retrieval as rt

    df = spark.createDataFrame([(f"n{i:03d}", f"shared words of note{i % 7}") for i in range(200)], "node_id string, content string")
    q = spark.createDataFrame([("q", "shared note3"), ("r", "shared words"), ("z", None)], "query_id string, text string")
    monkeypatch.setattr(rt, "PARTS", 100)
    found = rt.bm25(q, df)
    assert plan_of(found).count("Exchange hashpartitioning") == 1 and "hashpartitioning(node_id" in plan_of(found)
    best = plan_of(rt.top(found, 3, "bm25", "query_id"))
    assert best.index("WindowGroupLimit") < best.index("Exchange hashpartitioning(query_id") < best.rindex("WindowGroupLimit") < best.index("hashpartitioning(node_id")
    assert {r["query_id"]: r["count"] for r in found.groupBy("query_id").count().collect()} == {"q": 200, "r": 200}


def test_words_of_a_least_length_are_whole_runs(spark):
    """Short runs are left out by the pattern, which takes no part of a longer one."""
    from mnemo.functions import text as tx

    df = spark.createDataFrame([("ab abc; ABCD_1-xy zzzzz\u00e9q", ), (None,), ("",)], "s string")
    got = [r["t"] for r in df.select(tx.tokens("s", 3).alias("t")).collect()]
    assert got == [["abc", "abcd_1", "zzzzz"], None, []]


def test_texts_are_not_sent_for_a_few_candidates(spark, monkeypatch, tmp_path):
    """Candidates are written before texts are joined to them, so that no plan sends the memories' texts (F16, F17); equal
    ranges of time are ranked once."""
    from mnemo.operators import readpath as rp
    from mnemo.schema import as_of

    at = datetime(2024, 1, 1)
    rows = [(f"n{i:03d}", f"shared words of note{i % 7}", at, at, "decision", "src1", "en", ["decision"], "active", 1, 0, 0, None) for i in range(60)]
    schema = "node_id string, content string, created_at timestamp, last_accessed timestamp, event_type string, project string, entity_id string, tags array<string>, status string, priority int, access_count int, feedback_score int, ttl_seconds long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/m")
    m = spark.read.parquet(f"{tmp_path}/m")
    v = spark.createDataFrame([(r[0], [1.0, float(i)]) for i, r in enumerate(rows)], "node_id string, v array<double>")
    e = spark.createDataFrame([("n000", "n001", 0.9)], "source_id string, target_id string, weight double")
    q = spark.createDataFrame([(i, "shared note3", [1.0, 3.0], at, datetime(2024, 1, 3), None) for i in range(4)], "query_id long, text string, q array<double>, start timestamp, stop timestamp, hint string")
    plans, kept = {}, rp.written

    def seen(df, name):
        plans[name] = plan_of(df)
        return kept(df, name)

    monkeypatch.setattr(rp, "written", seen)
    scored = rp.fuse(q, m, v, e, as_of(), rp.Limits(limit=5))
    pairs = plan_of(rp.rerank_pairs(scored, q, m, rp.Limits(limit=5)))
    out = rp.assemble(scored, m, v, as_of(), rp.Limits(limit=5, near_copies=1.0))
    assert {"fused", "neighbours", "best", "ranked"} <= set(plans)
    for plan in (plans["scored"], pairs, plan_of(out)):
        assert "content" in plan and "BroadcastHashJoin [node_id" in plan
    assert {r["query_id"] for r in out.collect()} == {0, 1, 2, 3}
    near = rp.time_hits(rp.plan(q, 5), m, 7)
    assert {k: n for k, n in near.groupBy("query_id").count().collect()} == {0: 7, 1: 7, 2: 7, 3: 7}
    assert "hashpartitioning(a" in plan_of(near) and "partitionBy(query_id" not in plan_of(near) and "Window [row_number() windowspecdefinition(query_id" not in plan_of(near)


def test_words_are_found_once(spark, monkeypatch):
    """Sets without words are left out after they were written, not by finding every set's words twice."""
    df = spark.createDataFrame([("a", "some words here", "decision"), ("b", "words some here", "decision"), ("c", "x", "decision"), ("d", "some words here", None)], "node_id string, content string, event_type string")
    plans, kept = {}, dd.written

    def seen(df, name):
        plans[name] = plan_of(df)
        return kept(df, name)

    monkeypatch.setattr(dd, "written", seen)
    assert dd.jaccard_pairs(df, 0.7).count() == 0
    assert plans["sets"].count("regexp_extract_all") == 1


def test_a_key_keeps_times_and_ids_only(spark, tmp_path):
    """Texts and other columns of a key's events aren't sent to Python; of equal times the least id passes, null last."""
    from mnemo.streaming import streams

    at = [datetime(2024, 1, 1, 0, 0, s) for s in (0, 0, 0, 10, 30, 30)]
    rows = [(n, t, "k", "long text") for n, t in zip(["c", None, "a", "b", None, None], at, strict=True)]
    schema = "node_id string, created_at timestamp, key string, content string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = streams.debounced(streams.read_events(spark, str(tmp_path / "in"), schema), "key", 20, "1 hour")
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "GroupsInPandasWithState" in plan and "content" not in plan.split("EventTimeWatermark")[0]
    assert [(r["key"], r["node_id"], r["at"]) for r in streams.run_once(got, "debounce_ids").orderBy("at").collect()] == [("k", "a", at[0]), ("k", None, at[4])]


def test_blocks_meet_in_groups_of_a_bounded_number(spark, monkeypatch):
    """A task holds a few blocks of vectors and of queries, not a batch of thousands of pairs of blocks."""
    import numpy as np

    from mnemo.operators import retrieval as rt

    for name, n in (("HELD", 16), ("ASKED", 4), ("HELD_BLOCKS", 2), ("ASKED_BLOCKS", 2)):
        monkeypatch.setattr(rt, name, n)
    x = np.random.default_rng(2).normal(size=(150, 8))
    x[7] = x[9]
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(500, [1.0, 2.0], 0), (501, [0.0] * 8, 0), (502, None, 1)]
    v = spark.createDataFrame(rows, "node_id long, v array<double>, kind int")
    q = v.filter("node_id % 5 = 0 or node_id = 7").select(F.col("node_id").alias("query_id"), F.col("v").alias("q"), "kind")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for within in ((), ("kind",)):
        found = rt.knn(q, v, 6, 0.1, within)
        assert "FlatMapCoGroupsInPandas" in plan_of(found) and "MapInPandas" not in plan_of(found).replace("FlatMapCoGroupsInPandas", "")
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["node_id"])
        assert got.pop(500) == [500]
        for i, near in got.items():
            s = [(-round(float(unit[i] @ unit[j]), 12), j) for j in range(150) if unit[i] @ unit[j] >= 0.1 and (not within or (i - j) % 2 == 0)]
            assert near == [j for _, j in sorted(s)[:6]]
        assert sorted(got) == sorted({*range(0, 150, 5), 7})


def test_sentences_are_weighed_once(spark):
    """An observation's sentences are found and weighed in one place of the plan."""
    from mnemo.operators import extract as ex

    long = "We chose PostgresDB over others for many good reasons today. " + "The quick brown foxes jumped over seven lazy sleeping dogs. " * 3
    df = spark.createDataFrame([(long,), ("short. Text.",), (None,), ("- " * 100,)], "s string").select(ex.observation(F.col("s")).alias("o"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("`[^`]+`") == 1
    got = [r["o"] for r in df.collect()]
    assert "The quick brown foxes" in got[0] and "PostgresDB" in got[0] and got[1] is None and got[2] is None


def test_texts_are_read_once_for_the_terms_asked(spark, monkeypatch):
    """Lengths come with the asked terms, so that texts' words are found once; words that nobody asks for are neither sorted nor
    counted (F23, F24, F26 to F32)."""
    import math

    from mnemo.operators import retrieval as rt

    texts = [("a", "one two two three of"), ("b", "of a"), ("c", None), ("d", ""), ("e", "two four five six seven"), ("f", "two two two two")]
    df = spark.createDataFrame(texts, "node_id string, content string")
    q = spark.createDataFrame([(1, "two, three TWO"), (2, "nobody says this"), (3, None)], "query_id int, text string")
    plans, kept = {}, rt.written

    def seen(df, name):
        plans[name] = plan_of(df)
        return kept(df, name)

    monkeypatch.setattr(rt, "written", seen)
    found = rt.bm25(q, df)
    assert plans["postings"].count("regexp_extract_all") == 1 and "sort_array" not in plans["postings"] and "regexp_extract_all" not in plan_of(found)
    words = {n: [w for w in (t or "").split() if len(w) >= 3] for n, t in texts}
    avg = sum(map(len, words.values())) / 5  # a null text is a document without length
    want = {}
    for term in ("two", "three"):
        has = [n for n in words if term in words[n]]
        for n in has:
            tf = words[n].count(term)
            part = math.log(1 + (6 - len(has) + 0.5) / (len(has) + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[n]) / avg))
            want[1, n] = want.get((1, n), 0) + part
    assert {(r["query_id"], r["node_id"]): round(r["bm25"], 9) for r in found.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_found_texts_are_found_once(spark):
    """What an item found is written, however often a query uses it."""
    from mnemo.plans.reads import ranked

    found = ranked(spark, "/root/testdata/sf0.001", 3)
    assert "Exchange" not in plan_of(found) and found.groupBy("query_id").count().agg(F.max("count")).first()[0] == 3


def test_packets_send_texts_of_candidates_only(spark, monkeypatch, tmp_path):
    """Memories that no packet considers go before texts are sent; many ids are never broadcast."""
    from mnemo.operators import packets as pk

    edges = spark.createDataFrame([("a", "b", "evolution", 0.9, None, False)], "source_id string, target_id string, edge_type string, weight double, source string, typed boolean")
    asked = spark.createDataFrame([("p", "fix it", ["x/y.py"], "home"), ("r", None, None, None)], "packet_id string, task string, files array<string>, project string")
    seeds = spark.createDataFrame([("p", "a", 0.9, 1)], "packet_id string, node_id string, relevance double, rank int")
    schema = "node_id string, content string, event_type string, status string, feedback_score int, project string, priority int, created_at timestamp"
    spark.createDataFrame([(n, f"text {n}", "decision", "active", 0, "home", 1, datetime(2024, 1, 1)) for n in "abcd"], schema).write.parquet(f"{tmp_path}/m")
    m, got = spark.read.parquet(f"{tmp_path}/m"), []
    for few, join in ((2, "BroadcastHashJoin"), (1, "SortMergeJoin")):
        monkeypatch.setattr(pk, "FEW", few)
        found = pk.candidates(asked, seeds, m, edges)
        assert any(join in line and "LeftSemi" in line for line in plan_of(found).splitlines())
        got.append(sorted((r["packet_id"], r["node_id"], r["hop"], r["content"], r["score"]) for r in found.collect()))
    assert got[0] == got[1] and [x[:3] for x in got[0]] == [("p", "a", 0), ("p", "b", 1), *(("r", n, 0) for n in "abcd")]


def test_lower_case_is_made_once_a_text(spark):
    """The share of words found makes a text's lower case once, not for each word and each stem."""
    from mnemo.functions import text as tx

    df = spark.createDataFrame([(["tests", "zebras", "ran"], "He RAN a Test"), ([], "x"), (["abc"], None), (None, "x")], "said array<string>, content string")
    got = df.select(tx.word_overlap(F.col("said"), F.col("content")).alias("o"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("lower(content") == 1
    assert [r["o"] for r in got.collect()][:2] == [2 / 3, 0.0]


def test_found_words_are_not_counted_again(spark):
    """How many of a query's words a text has is counted with its sum, so that found texts aren't read again."""
    from mnemo.operators import readpath as rp
    from mnemo.operators import retrieval as rt

    df = spark.createDataFrame([(f"n{i}", f"shared words of note{i % 3} note{i % 3}") for i in range(9)], "node_id string, content string")
    q = spark.createDataFrame([("q", "Shared note1 nothing shared", None, None)], "query_id string, text string, start timestamp, hint string")
    for hits in (rp.text_hits(rp.plan(q, 9), df), rt.text_channel(q, df, 9)):
        assert "content" not in plan_of(hits)
        got = {r["node_id"]: r["score"] for r in hits.collect()}
        assert got["n1"] == got["n4"] == 0.9 and got["n0"] == 0.17
