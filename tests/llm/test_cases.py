"""Cases that are easy to get wrong: colliding hashes, ids that recur, clashing names, domains without rows; and plain
Python twins of the two classifiers."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemo.llm import flatgraph, forest, mixing, packing, quality, queries, scratch, tokens, toxicity

#: Names that operators have used or use for columns of their own.
NAMES = ["_rate", "_doc", "_copy", "_gone", "_again", "_ratio", "log_importance", "gumbel_key", "rate", "key", "copy", "doc", "given",
         "id", "h", "row", "group", "target", "is_target", "total", "stays", "toxic", "cid", "text_", "domain"]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def clashing(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).withColumns({x: F.concat(F.lit(x), F.coalesce(F.col("doc_id"), F.lit(-1))) for x in NAMES})


def unchanged(kept, docs):
    """All columns come back, and every row is one of docs, whole."""
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0


# Hashes and units.
@pytest.mark.parametrize("n", [8, 9, 64, 65, 1024, 4096])
def test_words_that_a_polynomial_confuses(n):
    a = thue_morse(n)
    b = a.translate(str.maketrans("ab", "ba"))
    assert tokens.hash_one(a.encode()) != tokens.hash_one(b.encode())
    e = packing.UnitEncoder(queries.tokenizer_path())
    ids, at = e.encode(*tokens.text_arrays(pa.array([a, b, a])))
    for i, t in enumerate([a, b, a]):
        assert ids[at[i] : at[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_units_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "runs_hash", lambda b, start, end: (end - start).astype(np.uint64) % np.uint64(3))
    texts = ["one two six", "two one it's don't", "x" * 100 + " " + "y" * 100, "six IT'S", "y" * 100]
    e = packing.UnitEncoder(queries.tokenizer_path())
    for _ in range(2):
        ids, at = e.encode(*tokens.text_arrays(pa.array(texts)))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


# Ids that recur.
def test_forest_with_ids_that_recur(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a), (5, b), (6, a + " z"), (7, b + " z"), (8, "something else entirely here now"), (None, a), (9, None), (9, None)]
    docs = clashing(spark, rows)
    got = sorted((r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in forest.join(docs).filter("doc_id is not null").collect())
    assert got == [(5, 5, 1), (5, 5, 1), (6, 5, 1), (7, 5, 1), (8, 8, 0), (9, 9, 0), (9, 9, 0)]
    kept = forest.keep_one(docs)
    unchanged(kept, docs)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(5, a), (5, b), (8, rows[4][1]), (0, a), (9, "")])
    unique = clashing(spark, [(1, a), (2, a + " z"), (3, b), (4, None), (10, "")])
    assert sorted(r["doc_id"] for r in forest.keep_one(unique).collect()) == [1, 3, 4, 10]


def test_flat_graph_with_ids_that_recur(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [0.1, 1.0, 0.0]), (4, [0.0, 0.0, 1.0]), (None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cid": F.lit(7), "v": F.lit("x"), "least": F.lit(1)})
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in flatgraph.near_duplicates(df).collect() if r["vec_id"])
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


@pytest.mark.parametrize("few", [2000, 0])
def test_flat_graph_links_in_every_dimension(spark, monkeypatch, few):
    """Vectors of a rarer dimension link with each other, compared exactly or by a graph of their own."""
    monkeypatch.setattr(flatgraph, "FEW", few)
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 0.001]), (5, [1.0, 0.0]), (6, [0.0, 1.0]), (7, [5.0]), (8, [-5.0]), (9, [2.0]), (10, [1e-9, 1e-9, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in flatgraph.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True),
                   (7, 1, 7, True), (8, 0, 8, True), (9, 1, 7, False), (10, 0, 10, True)]
    assert flatgraph.near_duplicates(df.limit(0)).collect() == []
    assert [tuple(r)[:4] for r in flatgraph.near_duplicates(df.limit(0).union(spark.createDataFrame([(1, None)], df.schema))).collect()] == [(1, 0, 1, True)]


# Mixing.
def test_mixing_with_a_domain_without_rows(spark):
    docs = spark.createDataFrame([(i, "uno dos tres" if i % 2 else "one two three", "es" if i % 2 else "en") for i in range(20)], "doc_id long, text string, domain string")
    mixed = mixing.mix(docs, docs.filter("domain = 'en'"), {"en": 0.5, "es": 0.3, "fr": 0.2}).collect()
    assert len(mixed) == 20 and all(len(r["p"]) == 3 and r["rate"] >= 0 and math.isclose(sum(r["p"]), 1) for r in mixed)


def least_squares(a, goal):
    """Nonnegative least squares by Lawson and Hanson's active sets, in plain numpy: the errors' root sum of squares."""
    n, free = a.shape[0], np.zeros(len(a), bool)
    r = np.zeros(n)
    for _ in range(10 * n):
        slope = a @ (goal - a.T @ r)
        if free.all() or slope[~free].max() <= 1e-10 * np.abs(a).max() * np.abs(goal).max():
            break
        free[np.argmax(np.where(free, -np.inf, slope))] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[free].T, goal, rcond=None)[0]
            if z[free].min() > -1e-12:
                r = np.maximum(z, 0)
                break
            bad = free & (z <= 0)
            r = r + min((r[bad] / (r[bad] - z[bad])).min(), 1) * (z - r)
            free &= r > 1e-12
            r[~free] = 0
    return np.sqrt(((a.T @ r - goal) ** 2).sum())


def check_rates(spark, rows, targets):
    """Rates are nonnegative and as near to the targets as plain least squares, the residual is true, tokens stay bounded."""
    members = scratch.materialise(spark.createDataFrame(rows, "n_tokens long, p array<double>"), "test-members")
    got = mixing.fit_rates(members, targets).collect()
    a = np.array([[n * x for x in p] for n, p in ((r["n_tokens"], r["p"]) for r in got)])
    rate, n = np.array([r["rate"] for r in got]), sum(r["n_tokens"] for r in got)
    goal = np.array(targets) / sum(targets) * n
    off = a.T @ rate - goal
    assert rate.min() >= 0 and abs(got[0]["residual"] - np.abs(off).max() / n) < 1e-9
    assert np.sqrt((off**2).sum()) <= least_squares(a, goal) + 2e-3 * n
    assert np.sqrt(((a.T @ rate) ** 2).sum()) <= np.sqrt((goal**2).sum()) * (1 + 1e-3)
    return off, n, rate


def test_mixing_says_how_far_off_it_is(spark):
    """Two domains whose documents look alike can't be mixed 9 to 1: the nearest rates, and the rest as residual."""
    off, n, rate = check_rates(spark, [(100, [0.6, 0.4]), (100, [0.4, 0.6])], [0.9, 0.1])
    assert np.abs(off).max() > 0.05 * n and rate.min() == 0
    off, n, _ = check_rates(spark, [(100, [0.6, 0.4]), (100, [0.4, 0.6])], [0.55, 0.45])
    assert np.abs(off).max() <= mixing.TOLERANCE * n


@pytest.mark.parametrize("few", [0.0, 1e-12, 1e-6, 1e-3])
def test_mixing_with_a_domain_that_nobody_belongs_to(spark, few):
    off, n, rate = check_rates(spark, [(10 + i % 9, [1 - few, few]) for i in range(200)], [0.9, 0.1])
    assert rate.max() < 1.5 and off.sum() <= 1e-6 * n


def test_mixing_with_a_rare_domain_and_long_texts(spark):
    rng = np.random.default_rng(1)
    rows = [(int(n), x.tolist()) for n, x in zip(rng.pareto(1.2, 400) * 50 + 1, rng.dirichlet([0.05, 0.05, 0.02, 0.002], 400))]
    off, n, _ = check_rates(spark, rows, [0.55, 0.2, 0.15, 0.1])
    check_rates(spark, rows, [0.0, 0.0, 0.0, 1.0])
    check_rates(spark, [(0, [0.5, 0.5]), (7, [1.0, 0.0]), (10**4, [0.0, 1.0])], [0.5, 0.5])


@pytest.mark.parametrize("french", [0, 2])
def test_mixing_after_a_language_has_vanished(spark, french):
    """What an earlier stage leaves may lack a language: the corpus is not multiplied for its sake."""
    docs = [(i, " ".join(f"word{(i * 7 + j) % 50}" for j in range(15)), "en") for i in range(200)] + [(200 + i, " ".join(f"mot{i}{j}" for j in range(15)), "fr") for i in range(french)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, domain string")
    for targets in ({"en": 0.9, "fr": 0.1}, queries.LANGUAGE_TARGETS):
        mixed = mixing.mix(docs, docs.select("doc_id"), targets)
        rows, n = mixed.collect(), 15 * (200 + french)
        assert sum(r["rate"] * r["n_tokens"] for r in rows) <= n * 1.001 and max(r["rate"] for r in rows) < 0.11 * n / 15
        again = mixing.resample(docs, mixed)
        assert again.count() <= 1.2 * len(rows)
        if french and len(targets) == 2:
            assert rows[0]["residual"] < 1e-3


def test_mixing_resample_keeps_names_and_spreads_rows_without_id(spark):
    docs = clashing(spark, [(1, "a b"), (None, "c d e"), (None, "f"), (None, None), (2, ""), (2, "g h"), (2, "g h")])
    rates = docs.select(mixing.row_key().alias("key"), F.when(F.col("text") == "f", 0.0).when(F.col("doc_id") == 1, 3.0).otherwise(1.0).alias("rate"))
    kept = mixing.resample(docs, rates)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted(
        [(1, "a b")] * 3 + [(0, "c d e"), (0, ""), (2, ""), (2, "g h"), (2, "g h")]
    )
    unchanged(kept.distinct(), docs)


# Quality.
def test_quality_equals_a_plain_twin(spark):
    good = [(i, f"the river runs deep {i} and slow " * (1 + i % 3)) for i in range(12)]
    bad = [(i, f"buy buy cheap{i} now now click " * (1 + i % 4)) for i in range(12, 30)]
    rows = [*good, *bad, (30, None), (31, ""), (31, "ab"), (32, "é ü the river")]
    docs = clashing(spark, rows)
    labelled = spark.createDataFrame([(i, 1) for i, _ in good[:8]] + [(20, 0)], "doc_id long, quality int")

    def grams(text):
        raw = (text or "").encode()
        tri = [(((a * 0x1003F * 0x1003F + b * 0x1003F + c) % 2**32) * 2654435761 % 2**32) >> 16 for a, b, c in zip(raw, raw[1:], raw[2:])]
        words = [tokens.hash_one(w) for w in raw.split()]
        bi = [0 if a == b else int(tokens.mix(np.array([(a * 3 + b) % 2**64], np.uint64))[0]) % (quality.BUCKETS - 1) + 1 for a, b in zip(words, words[1:])]
        return tri, bi

    target = {i for i, _ in good[:8]}
    count = [[Counter(), Counter()] for _ in range(2)]
    for i, text in rows:
        for k, g in enumerate(grams(text)):
            count[0][k].update(g)
            if i in target:
                count[1][k].update(g)

    def ratio(text):
        out, n = 0.0, 0
        for k, g in enumerate(grams(text)):
            size = sum(count[1][k].values()) / sum(count[0][k].values())
            out += sum(math.log((count[1][k][x] + quality.PSEUDO) / (count[0][k][x] * size + quality.PSEUDO)) for x in g)
            n += len(g)
        return out, n

    noise = {r["doc_id"]: r["g"] for r in docs.select("doc_id", quality.gumbel(F.col("doc_id")).alias("g")).collect()}
    means = sorted(r / n for r, n in (ratio(t) for i, t in rows if i in target))
    for allow, k in ((None, None), (0.25, None), (None, 5)):
        level = min(0.0, float(np.quantile(means, allow))) if allow else 0.0
        want = [(i, r, r - level * n, r - level * n + noise[i]) for i, t in rows for r, n in [ratio(t)]]
        most = k if k is not None else sum(w >= 0 for _, _, w, _ in want)
        least = sorted((x[3] for x in want), reverse=True)[most - 1]
        got = sorted((r["doc_id"], r["log_ratio"], r["log_importance"], r["gumbel_key"], r["kept"]) for r in quality.classify(docs, labelled, k=k, allow=allow).collect())
        for g, w in zip(got, sorted((*x, x[3] >= least) for x in want), strict=True):
            assert g[0] == w[0] and g[4] == w[4] and g[1:4] == pytest.approx(w[1:4], abs=1e-8)
        kept = quality.resample(docs, labelled, k=k, allow=allow)
        unchanged(kept, docs)
        assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(g[0] for g in got if g[4])


# Toxicity.
def test_toxicity_equals_a_plain_twin(spark):
    rows = [(i, ("vile dreck" if i % 3 == 0 else "kind words") + f" here{i % 5} again, Again! {'vilest' if i % 6 == 0 else ''}", int(i % 3 == 0), int(i % 6 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, severe int")
    chain = toxicity.fit(df, ["severe", "toxic"])
    docs = clashing(spark, [(i, t) for i, t, _, _ in rows[:12]] + [(100, None), (101, ""), (102, "VILE"), (None, "dreck dreck"), (102, "VILE")])

    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = "".join(c if c.isalnum() else " " for c in low).encode().split()
        keys = {tokens.hash_one(w) for w in words}
        for k in toxicity.PREFIXES:
            keys |= {int(tokens.mix(np.array([int.from_bytes(w[:k], "big") + (k << 56)], np.uint64))[0]) for w in words if len(w) > k}
        return keys

    def predict(text):
        odds = []
        for m in chain.models:
            z = m.intercept + sum(w * o for w, o in zip(m.chain, odds)) + sum(w for x, w in zip(m.keys.tolist(), m.weights) if x in features(text))
            odds.append(max(-30.0, min(30.0, z)))
        return [1 / (1 + math.exp(-z)) for z in odds]

    got = toxicity.classify(docs, chain)
    assert got.columns == ["doc_id", "p_severe", "p_toxic", "toxic"]
    want = sorted((r["doc_id"] or 0, *predict(r["text"])) for r in docs.collect())
    for g, w in zip(sorted((r["doc_id"] or 0, r["p_severe"], r["p_toxic"]) for r in got.collect()), want, strict=True):
        assert g == pytest.approx(w, abs=1e-9)
    kept = toxicity.clean(docs, chain)
    unchanged(kept, docs)
    assert kept.count() == sum(p[-1] < chain.threshold for p in (predict(r["text"]) for r in docs.collect()))


def test_toxicity_fits_within_its_bytes(spark):
    rows = [(i, ("vile " if i % 2 else "kind ") * 50, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert toxicity.fit(df, ["toxic"], max_bytes=5000).quality["rows"] == 20
    assert toxicity.fit(df, ["toxic"], max_bytes=10).models[0].intercept == -12.0


def test_toxicity_fits_without_a_text_that_takes_the_room(spark):
    rows = [(i, "vile scum here" if i % 2 else "kind words here", i % 2) for i in range(40)]
    df = spark.createDataFrame([*rows, (100, "vile " * 5000, 1)], "doc_id long, text string, toxic int")
    chain = toxicity.fit(df, ["toxic"], max_bytes=20_000)
    assert chain.quality["rows"] == 40
    assert toxicity.classify(df, chain).filter("toxic").count() == 21


# Stages of the pipeline on odd tables.
def test_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "s", 9), (2, text + " x", None, None, None), (None, text, "xx", "s", 1), (3, None, "fr", "s", 0), (4, "", "fr", "s", 0), (5, "long " * 200_000, "de", "s", 10**6), (1, text, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None), (3, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for made, few in ((docs, labels), (docs.limit(0), labels.limit(0))):
        folder = str(tmp_path / f"{made.count()}-{few.count()}")
        made.write.parquet(f"{folder}/documents.parquet")
        few.write.parquet(f"{folder}/labels.parquet")
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
            if name != "packing":
                assert out.columns == docs.columns
            kept = out.count()
            assert kept == 0 if not made.count() else kept >= 1


def test_range_search_takes_all_that_is_in_range():
    """A blob much larger than the beam, and single pairs: on a whole graph every pair in range is found."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=16) + 0.05 * rng.normal(size=(3 * flatgraph.BEAM, 16)), rng.normal(size=(200, 16))])
    x = np.concatenate([x, x[-30:] + 0.05 * rng.normal(size=(30, 16))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    a, b = flatgraph.build_graph(x)
    ids = np.arange(len(x)) * 7
    to, first = flatgraph.adjacency(ids, [[(ids[b[a == i]]).tobytes(), np.array([10**9]).tobytes()] for i in range(len(x))])
    q, found = flatgraph.range_search(x, to, first, 0.9)
    got = set(zip(q.tolist(), found.tolist()))
    want = set(zip(*(z.tolist() for z in np.nonzero(x @ x.T >= 0.9))))
    assert got <= want and len(got) >= 0.98 * len(want) and {p for p in want if max(p) < 3 * flatgraph.BEAM} <= got
