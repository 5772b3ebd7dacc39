"""The approximate search against brute force, runs against their definition, divergence against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.llm import divergence, projection, queries, runs

ODD_TEXTS = [None, "", "   \t\n", "é ü 日本語", "a" * 5000, "x y " * 3000]


# Approximate nearest neighbours.
def exact_neighbours(rows, asked, k):
    """(query_id, rank, vec_id, score) by brute force over usable (vec_id, vector) rows."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (i, q) in enumerate(good):
        if asked(i):
            others = [(-float((q * v).sum() / np.sqrt((q * q).sum()) / np.sqrt((v * v).sum())), j) for n, (j, v) in enumerate(good) if n != at and len(v) == len(q)]
            out += [(i, r + 1, j, round(-c, 9)) for r, (c, j) in enumerate(sorted(others, key=lambda x: (round(x[0], 12), x[1]))[:k])]
    return sorted(out)


def answers(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())


def test_chi_square_and_its_inverse():
    draws = (np.random.default_rng(1).normal(size=(20_000, projection.M)) ** 2).sum(1)
    for p in (0.5, 0.9, 0.95):
        assert abs((draws < projection.widest(p)).mean() - p) < 0.01
        assert abs(projection.chi_square(projection.widest(p)) - p) < 1e-9


def test_neighbours_in_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 0.0, 0.0]), (5, None), (6, []),
            (7, [nan, 1.0, 0.0]), (8, [inf, 0.0, 1.0]), (9, [None, 1.0, 1.0]), (10, [1.0, 1.0, 0.0]), (10, [1.0, 1.0, 0.0]), (10, [0.0, 0.0, 1.0]),
            (20, [1.0, 0.5]), (21, [0.5, 1.0]), (None, [1.0, 0.0, 0.0]), (30, [1e300, 1e300, 0.0]), (40, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cid": F.lit(1), "k1": F.lit("x"), "leaf": F.lit(2)})
    got = answers(projection.nearest(df, F.col("vec_id") % 10 == 0, 3))
    assert got == exact_neighbours([*rows[:16], (30, [1.0, 1.0, 0.0]), rows[17]], lambda i: i % 10 == 0, 3)
    assert projection.nearest(df.limit(0), F.col("vec_id") % 10 == 0, 3).collect() == []


def test_neighbours_of_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(projection, "SALTS", 3)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 else [float(i), 1.0, 0.0, 2.0]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert answers(projection.nearest(df, F.col("vec_id") % 50 == 0, 5)) == exact_neighbours(rows, lambda i: i % 50 == 0, 5)


@pytest.mark.parametrize("spread", [0.15, 10.0])
def test_recall_over_many_leaves_and_blocks(spark, monkeypatch, spread):
    for name, value in (("LEAF", 256), ("BLOCK", 128), ("BUCKET", 16), ("ASKED", 7), ("MOST_LEAVES", 8)):
        monkeypatch.setattr(projection, name, value)
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)] + spread * rng.normal(size=(3000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = projection.nearest(df, F.col("vec_id") % 50 == 0, 5).cache()
    got, want = answers(found), exact_neighbours([(i, v.tolist()) for i, v in enumerate(x)], lambda i: i % 50 == 0, 5)
    share = len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) / len(want)
    assert len(got) == len(want) == 300 and share >= 0.9
    exact = {(q, v): c for q, _, v, c in exact_neighbours([(i, v.tolist()) for i, v in enumerate(x)], lambda i: i % 50 == 0, 2999)}
    assert all(exact[q, v] == c for q, _, v, c in got)
    assert abs(projection.audit(df, F.col("vec_id") % 50 == 0, found) - share) < 0.02


def test_the_tree_leaves_vectors_unverified():
    """In clustered data the stopping test holds long before all vectors of a block are verified."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 32))[np.arange(4000) % 40] + 0.05 * rng.normal(size=(4000, 32))
    p = x / np.linalg.norm(x, axis=1, keepdims=True) @ projection.directions(32)
    import pandas as pd

    rows = pd.DataFrame({"cid": range(4000), "ids": [[i] for i in range(4000)], "vec": [v.tobytes() for v in x], "proj": list(p)})
    block = projection.Block(projection.build_block((32, 0, 0), rows).iloc[0].to_dict())
    verified = [block.near(x[i], p[i], -2.0, 6, projection.widest(0.95))[2] for i in range(0, 4000, 100)]
    assert np.mean(verified) < 1200


# Runs.
def plain_runs(w, least=12):
    """By definition, period by period."""
    seen = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                seen.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in seen.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(7)
    for _ in range(2500):
        w = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randint(0, 70))]
        if len(w) > 4 and rng.random() < 0.5:
            a = rng.randrange(len(w))
            p = 1 + (len(w) - a) // rng.randint(2, 7)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))]
        for least in (2, 5, 12):
            assert runs.find_runs(w, least) == plain_runs(w, least)


def test_factors_are_the_longest_that_occurred():
    rng = random.Random(3)
    for _ in range(300):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        at = 0
        for b, size, source in runs.factorise(w):
            longest = max((k for s in range(b) for k in range(len(w) - b + 1) if w[s : s + k] == w[b : b + k]), default=0)
            assert b == at and size == max(1, longest) and (source < 0) == (longest == 0)
            assert source < 0 or (source < b and w[source : source + size] == w[b : b + size])
            at += size
        assert at == len(w)


def expected_runs(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    return (doc_id, len(found), *four, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op12_equals_its_definition(spark, tmp_path):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("abc") if i % 3 else f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 90)))) for i in range(200)]
    docs += [(i + 200, t) for i, t in enumerate(ODD_TEXTS)] + [(200, None), (3, docs[3][1]), (None, "a b " * 20), (None, None)]
    docs += [(300, "k\tl\nm\x0bn\x0co\rp  " * 4), (301, "no\x00nul\x1f run here" * 3), (302, " ".join(f"s{i}" for i in range(30)) + " " + " ".join(f"s{i}" for i in range(30)))]
    spark.createDataFrame(docs, "doc_id long, text string").withColumns({"runs": F.lit(1), "doc": F.lit("d"), "n": F.lit(0)}).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op12_repeat_runs(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(expected_runs(*d) for d in docs)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert runs.collapse(empty).collect() == []


def test_op12_on_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents").select("doc_id", "text").collect()
    assert Counter(tuple(r) for r in queries.op12_repeat_runs(spark, sf).collect()) == Counter(expected_runs(*d) for d in docs)


# Divergence.
def plain_divergence(docs, min_docs=10, top=10):
    docs = [(t or "", a or "", b or "") for t, a, b in docs]
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(fold)) for t, _, _ in docs]
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for (_, a, b), w in zip(docs, words):
        held[a].update(set(w))
        counts[a, b].update(w)
        groups[a].add(b)
    out = []
    for a, sources in groups.items():
        kept = sorted(t for t, n in held[a].items() if n >= min_docs)
        of = {b: [counts[a, b][t] for t in kept] for b in sources}
        p = {b: [1 + 10**9 * (c + 2) // (sum(x) + 2 * len(kept)) for c in x] for b, x in of.items()}
        all_ = [sum(of[b][i] for b in sources) for i in range(len(kept))]
        q = [1 + 10**9 * (c + 2) // (sum(all_) + 2 * len(kept)) for c in all_]
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for b in sources:
            pairs = [(-sum(map(f, p[b], p[d])), d) for d in sources if d != b]
            terms = [(-f(p[b][i], q[i]), t) for i, t in enumerate(kept) if of[b][i] and p[b][i] > q[i]]
            for part, some in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(a, b, part, t, -v, r + 1) for r, (v, t) in enumerate(some)]
    return Counter(out)


def sources_table(spark):
    rng = random.Random(9)
    vocabulary = [f"{'xyz'[i % 3]}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["Größe", "größe", "ÉTÉ", "été", "日本", "x" * 70, "x" * 69 + "y"]
    docs = [(" ".join(rng.choice(vocabulary[: 20 + 30 * (i % 5)]) + rng.choice(["", ".", "'s", "9"]) for _ in range(rng.randint(0, 60))),
             rng.choice(["en", "en", "fr", None]), rng.choice([f"s{j}" for j in range(7)] + [None, "é"])) for i in range(300)]
    docs += [(t, "odd", f"o{i}") for i, t in enumerate(ODD_TEXTS)] + [("alone here", "single", "only"), (None, None, "never")] + [("Same Same row", "fr", "s1")] * 12
    return docs, spark.createDataFrame(docs, "text string, lang string, source string").withColumns({"term": F.lit("t"), "n": F.lit(1), "part": F.lit(2), "gid": F.lit(3)})


@pytest.mark.parametrize("terms, sources", [(2048, 512), (16, 3), (7, 1)])
def test_divergence_equals_plain_python(spark, monkeypatch, terms, sources):
    docs, df = sources_table(spark)
    monkeypatch.setattr(divergence, "SLICE", 500)
    got = divergence.audit(df, block_terms=terms, block_sources=sources)
    assert Counter(tuple(r) for r in got.collect()) == plain_divergence(docs)


def test_divergence_of_nothing(spark):
    assert divergence.audit(sources_table(spark)[1].limit(0)).collect() == []


def test_rates_are_exact_beyond_doubles():
    rng = random.Random(2)
    total = [rng.randrange(1, 9 * 10**15) for _ in range(2000)]
    count = [rng.randrange(0, t + 1) for t in total]
    want = [1 + 10**9 * c // t for c, t in zip(count, total)]
    assert divergence.rates(np.array(count), np.array(total)).tolist() == want
