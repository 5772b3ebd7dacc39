"""The ten operators and the pipeline: brute force, round trips and edge cases on small tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemo.llm import bitslice, components, flatgraph, forest, katz, mixing, packing, quality, queries, scratch, tokens, toxicity, urllists, warc

from .katz_brute import Brute, held_out, tokens_of

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "Don't STOP <|endoftext|> now, it's 1234!"), (2, None), (3, ""), (4, " \n\t"), (5, "naïve ÀÉÎ ß × ÷ a×b"), (6, "日本語 テスト x1y2"),
    (7, "word " * 3000), (8, "one two"), (8, "one two"), (None, "no id at all here"), (9, "same words as the others " * 3), (10, "same words as the others " * 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({"rate": F.lit("x"), "n": F.lit(1), "key": F.lit(None).cast("string"), "row": F.lit(2), "size": F.lit(3)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Words.
def test_words_match_a_plain_split():
    texts = [t for _, t in ODD]
    w = tokens.words(*tokens.text_arrays(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        want = [x.encode() for x in tokens_of(t)[:-1]]
        assert [tokens.hash_one(x) for x in want] == w.hash[w.first[i] : w.first[i + 1]].tolist()


# 1: packing.
def test_packing_equals_the_tokenizer(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    got = packing.pack(odd, queries.tokenizer_path(), longest=64).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    docs = {}
    for r in got:
        assert r["length"] == len(r["ids"]) // 4 and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
        docs.setdefault(r["doc_id"], {}).setdefault(r["start"], np.frombuffer(r["ids"], "<u4").tolist())
    for i, text in ODD:
        pieces = docs[i]
        assert sum((pieces[s] for s in sorted(pieces)), []) == [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_packing_digest(spark, docs):
    p = packing.pack(docs.limit(20), queries.tokenizer_path())
    for a, b in zip(p.collect(), packing.digest(p).collect(), strict=True):
        assert b["ids_crc32"] == zlib.crc32(a["ids"])


@pytest.mark.parametrize("n", [1, 2, 4095, 4096, 4097, 12345])
def test_piece_lengths(n):
    p = packing.piece_lengths(n, 4096)
    assert sum(p) == n and all(x & (x - 1) == 0 for x in p) and p == sorted(p, reverse=True)


def test_packing_random_texts():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("aBé'ÀßÿS <|1.\n字€") for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    e = packing.encoder(queries.tokenizer_path())
    ids, at = e.encode(*tokens.text_arrays(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


# 2: scoring.
@pytest.mark.parametrize(("chunk", "order"), [(300, 2), (1 << 24, 2), (300, 3), (1 << 24, 4), (3000, 1)])
def test_katz_equals_brute_force(spark, docs, odd, chunk, order):
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(60).select("doc_id", "text").collect()] + [(i and i + 10**6, t) for i, t in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("x"))
    brute = Brute(rows, order)
    got = sorted(katz.score(df, bucket_bytes=2000, chunk_bytes=chunk, order=order).collect(), key=lambda r: (r["doc_id"] or 0, r["score"]))
    want = sorted(((i, *brute.score(t)) for i, t in rows), key=lambda r: (r[0] or 0, r[4]))
    for g, (i, n, known, base, score) in zip(got, want, strict=True):
        assert (g["doc_id"], g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (i, held_out(i), n, known, brute.N)
        assert g["base_score"] == pytest.approx(base, rel=1e-9) and g["score"] == pytest.approx(score, rel=1e-9)
    for h in [(None,), ("the",), ("word",), ("word", "word"), ("no", "id")]:
        h = h[: order - 1]
        assert sum(brute.p(h, w) for w in brute.one) + brute.p(h, "unknown word") == pytest.approx(1)


def test_katz_stores_its_model(spark, docs, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(40).select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    katz.score(df, bucket_bytes=20_000, chunk_bytes=5000, order=3, store=f"file://{tmp_path}/model").count()
    brute = Brute(rows, 3)
    for n in (2, 3):
        found = katz.stored(spark, f"file://{tmp_path}/model", n).filter("count > 0").collect()
        assert sorted(r["count"] for r in found) == sorted(c for x in brute.after[n].values() for c in x.values())
        assert len({(r["context"], r["word"]) for r in found}) == len(found)
        per = {r["context"]: r["weight"] for r in found if r["weight"] == r["weight"]}
        for h in brute.after[n]:
            brute.p(h, "unknown word")
        want = sorted(brute.weights[h] for h in brute.after[n])
        assert len(per) > 0.9 * len(want) and all(min(abs(w - x) for x in want) < 1e-9 for w in list(per.values())[:200])
    assert all(p.name.startswith(("part=", "_", ".")) for p in (tmp_path / "model" / "grams-2").iterdir())


def test_katz_without_rows_or_training(spark, empty):
    assert katz.score(empty).count() == 0
    only = next(i for i in range(100) if held_out(i))
    r = katz.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0


# 3: mixing.
def test_mixing_meets_its_targets(spark, docs):
    targets = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    d = docs.withColumn("domain", F.col("lang"))
    m = mixing.mix(d, labels, targets).collect()
    a = np.array([[r["n_tokens"] * p for p in r["p"]] for r in m])
    rate = np.array([r["rate"] for r in m])
    total = sum(r["n_tokens"] for r in m)
    assert (rate >= 0).all() and np.allclose(a.T @ rate / total, [targets[k] for k in sorted(targets)], atol=1e-4)
    # The same projected gradient, with every rate held.
    scale = np.sqrt((a * a).sum(0))
    gram = (a.T @ a) / scale / scale[:, None]
    r, goal = np.ones(len(a)), total * np.array([targets[k] for k in sorted(targets)])
    for _ in range(mixing.STEPS):
        off = a.T @ r - goal
        if np.abs(off).max() <= mixing.TOLERANCE * total:
            break
        r = np.maximum(0, r - a @ (off / scale**2) / np.linalg.eigvalsh(gram).max())
    assert np.allclose(r, rate, atol=1e-4)
    best = {x["doc_id"]: sorted(targets)[int(np.argmax(x["p"]))] for x in m}
    known = {x["doc_id"]: x["lang"] for x in docs.collect()}
    assert np.mean([best[i] == known[i] for i in known]) > 0.9


def test_mixing_edges(spark, odd, empty):
    d = odd.withColumn("domain", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    m = mixing.mix(d, odd.select("doc_id"), {"a": 1.0, "b": 1.0})
    assert m.count() == len(ODD) and m.filter("n_tokens = 0 and rate <> 1").count() == 0
    assert mixing.mix(empty.withColumn("domain", F.col("lang")), empty, {"a": 1.0, "b": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.fit_rates(d, [-1.0, 2.0])


def test_copies(spark):
    rows = spark.range(20000).select(mixing.copies(F.lit(1.25), "id").alias("c")).groupBy("c").count().collect()
    assert {r["c"] for r in rows} == {1, 2} and 0.22 < next(r["count"] for r in rows if r["c"] == 2) / 20000 < 0.28


# 4: near-duplicate vectors.
def test_flat_graph_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 16))
    blob = rng.normal(size=16) + 0.15 * rng.normal(size=(150, 16))
    x = np.concatenate([base, base[:40] + 0.02 * rng.normal(size=(40, 16)), blob, base[:10]]).astype(np.float32)
    rows = [(i, [float(z) for z in v], 0) for i, v in enumerate(x)]
    odd = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [1.0, None] + [1.0] * 14, 1), (9005, [1.0, 2.0], 1), (9006, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, links int")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    root = flatgraph.unite(len(x), *np.nonzero(linked))
    for kw in ({"shard": 60}, {"shard": 60, "block": 40}):
        got = {r["vec_id"]: r for r in flatgraph.near_duplicates(df, **kw).collect()}
        assert len(got) == len(rows) + len(odd)
        assert sum(got[i]["n_links"] for i in range(len(x))) >= 0.95 * linked.sum()
        assert all(got[i]["n_links"] <= linked[i].sum() for i in range(len(x)))
        assert np.mean([got[i]["component_id"] == root[i] for i in range(len(x))]) > 0.95
        for i in range(9001, 9007):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert flatgraph.near_duplicates(df.limit(0)).count() == 0


def test_flat_graph_overlap_without_links():
    """Vectors without any link still tell how many shards hold a pair at the threshold; three are too few here."""
    rng = np.random.default_rng(5)
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    c = unit(rng.normal(size=(1000, 64))).astype(np.float32)
    x, held = unit(rng.normal(size=(2000, 64))), unit(rng.normal(size=(1000, 64)))
    overlap = flatgraph.shared_overlap(c, x, 0.9, 0.98)
    u = rng.normal(size=held.shape)
    near = 0.9 * held + np.sqrt(1 - 0.81) * unit(u - (u * held).sum(1, keepdims=True) * held)

    def shared(a):
        left, right = (np.argsort(-(z @ c.T), axis=1)[:, :a] for z in (held, near))
        return (left[:, :, None] == right[:, None, :]).any((1, 2)).mean()

    assert overlap > flatgraph.OVERLAP and shared(flatgraph.OVERLAP) < 0.95 and shared(overlap) > 0.965


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 200)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[102] == 100 and 200 not in got


# 5: archives.
def test_warc_round_trip(spark, tmp_path):
    import zstandard

    big = "<p>" + "lorem ipsum dolor " * 20000 + "</p>"
    rows = [(i, f"http://a.example/{i}", f"<html><body>page {i % 7} " + "some shared words " * 20 + "</body></html>") for i in range(300)]
    rows += [(1000, "bad url\r\n", big), (1001, None, None), (1002, "http://b.example/", ""), (None, "http://c.example/", ""), (3, "http://a.example/3", rows[3][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    manifest = warc.write_archives(df, str(tmp_path / "out"))
    assert sum(r["records"] for r in manifest.collect()) == len(rows)
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", 10**9), i if i is not None else 10**9)
    for r in got:
        payloads = {h or "" for i, _, h in rows if i == r["page_id"]}
        assert any(len(h.encode()) == r["payload_bytes"] for h in payloads)
        least = first[next(iter(payloads))]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == least else ("revisit", least))
    one = next(r for r in got if r["page_id"] == 5)
    with open(one["path"], "rb") as f:
        raw = f.read()
    size = int.from_bytes(raw[4:8], "little")
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    record = d.decompressobj().decompress(raw[one["record_offset"] : one["record_offset"] + one["record_length"]])
    assert record.startswith(b"WARC/1.1") and rows[5][2].encode() in record
    assert warc.read_archives(warc.write_archives(df.limit(0), str(tmp_path / "none"))).count() == 0


def test_warc_min_bytes(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.read_archives(warc.write_archives(df, min_bytes=4)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


# 6: URL lists.
def test_url_lists_against_brute_force(spark):
    rnd = random.Random(1)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "x.org", "deep.x.org"]
    changes = [(rnd.choice(hosts), rnd.choice(["spam", "malware"]), rnd.choice(["add", "remove"]), rnd.randrange(100)) for _ in range(80)]
    urls = [(i, f"HTTP://user@{rnd.choice(hosts).upper()}:80/p?q", rnd.randrange(110)) for i in range(200)] + [(900, None, 5), (901, "no host", 5), (902, "http://x.org/", None)]
    at = F.expr("timestampadd(DAY, day, TIMESTAMP '2024-01-01')")
    c = spark.createDataFrame(changes, "entry string, category string, action string, day int").withColumn("changed_at", at).drop("day")
    u = spark.createDataFrame(urls, "capture_id long, url string, day int").withColumn("fetched_at", at).drop("day").withColumn("entry", F.lit("x"))
    got = {r["capture_id"]: sorted(r["entries"]) for r in urllists.evaluate(u, c).collect()}
    for i, url, day in urls:
        host = (url or "").split("@")[-1].split(":")[0].lower() if "@" in (url or "") else ("x.org" if i == 902 else "")
        want = []
        for entry, cat in {(e, k) for e, k, _, _ in changes}:
            if day is None or not (host == entry or host.endswith("." + entry)):
                continue
            past = sorted((d, a) for e, k, a, d in changes if (e, k) == (entry, cat) and d <= day)
            if past and past[-1][1] == "add":
                want.append(f"{cat}:{entry}")
        assert got[i] == sorted(want)
    assert urllists.evaluate(u.limit(0), c).count() == 0
    assert urllists.evaluate(u, c.limit(0)).filter("blocked").count() == 0


# 7: toxicity.
def test_toxicity_held_out(spark):
    rnd = random.Random(4)
    plain, bad = ["stone", "river", "cloud", "paper", "window", "garden", "letter", "music"], ["vileish", "vilely", "dreck"]
    make = lambda toxic: " ".join(rnd.choice(plain) + rnd.choice(["", ",", "."]) for _ in range(60)) + (" " + rnd.choice(bad) + "!" if toxic else "")
    rows = [(i, make(i % 4 == 0), int(i % 4 == 0), int(i % 8 == 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, severe int")
    chain = toxicity.fit(df.filter("doc_id < 500"), ["severe", "toxic"])
    got = toxicity.classify(df.filter("doc_id >= 500"), chain).join(df.select("doc_id", F.col("toxic").alias("y")), "doc_id")
    assert got.filter("toxic <> (y = 1)").count() <= 3
    assert chain.models[1].chain.shape == (1,) and chain.quality["out_of_fold_f1"] > 0.97


def test_toxicity_edges(spark, odd, empty):
    labelled = odd.withColumn("toxic", F.lit(None).cast("int"))
    chain = toxicity.fit(labelled, ["toxic"])
    assert toxicity.classify(odd, chain).filter("toxic").count() == 0
    assert toxicity.clean(odd, chain).columns == odd.columns
    assert toxicity.classify(empty, toxicity.fit(empty.withColumn("toxic", F.lit(1)), ["toxic"])).count() == 0


def test_toxicity_keeps_a_frequent_indicator():
    """An insult in most toxic rows and in no clean one decides; a word that all rows have does not."""
    rnd = random.Random(11)
    plain = ["stone", "river", "cloud", "paper", "window", "garden", "letter", "music"]
    y = np.array([i % 2 for i in range(400)])
    texts = ["ever " + " ".join(rnd.choices(plain, k=30)) + (" vileness" if t and i % 10 < 8 else " dreck" if t else "") for i, t in enumerate(y)]
    chain = toxicity.fit_rows(texts, y[:, None], np.ones(400), ["toxic"])
    p = chain.predict(pa.array(["ever stone river vileness cloud", "ever stone river dreck cloud", "ever stone river cloud"]))[:, -1]
    assert min(p[:2]) >= chain.threshold > p[2]
    keys, of = toxicity.all_features(pa.array(texts))
    uniq, sums = toxicity.tally(pa.array(texts), np.ones((400, 1)), np.arange(400) % 3, 3)
    want, rows = np.unique(keys, return_counts=True)
    assert dict(zip(uniq, sums.sum((1, 2)))) == {k: r for k, r in zip(want, rows) if r >= toxicity.LEAST_ROWS}


# 8: quality.
def test_quality_separates(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = quality.classify(docs, labels, allow=queries.QUALITY_ALLOW).join(labels, "doc_id")
    assert kept.filter("kept and quality = 0").count() <= 1
    assert kept.filter("not kept and quality = 1").count() <= 0.05 * kept.filter("quality = 1").count()


def test_quality_edges(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(odd, none)
    assert got.count() == len(ODD) and got.filter("log_importance <> 0").count() == 0
    assert quality.resample(odd, none, k=5).columns == odd.columns
    assert quality.resample(empty, none).count() == 0


def test_kth_largest(spark):
    rnd = random.Random(9)
    x = [rnd.choice([rnd.gauss(0, 1), 3.0, -1e9]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in x], "key double")
    for k in (1, 2, 700, 2999, 3000):
        assert quality.kth_largest(df, k, bins=4, few=8) == sorted(x, reverse=True)[k - 1]
    assert quality.kth_largest(df, 3001) == -np.inf


# 9: similarity join.
def shingles(text):
    w = tokens_of(text)[:-1]
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def test_forest_equals_brute_force(spark, docs):
    rnd = random.Random(3)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    base = rows[3][1].split()[:200]
    for k in range(60):
        copy = base[:]
        for _ in range(rnd.randint(1, 5)):
            copy[rnd.randrange(len(copy))] = f"zz{rnd.randrange(10**6)}"
        rows.append((100000 + k, " ".join(copy)))
    rows += [(200000, None), (200001, ""), (200002, " \n"), (200003, "one two"), (200004, "ONE  two"), (None, "one two")]
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    root, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    links[a] += 1
                    links[b] += 1
                    root[find(b)] = find(a)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"cid": F.lit(1), "size": F.lit(2), "area": F.lit(3)})
    for kw in ({}, {"block": 16, "task": 50}):
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in forest.join(df, **kw).collect()}
        assert got.pop(None) == (None, 0)
        assert got == {i: (min(j for j in ids if find(j) == find(i)), links[i]) for i in ids}
    kept = forest.keep_one(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {None, *(min(j for j in ids if find(j) == find(i)) for i in ids)}
    assert forest.keep_one(df.union(df)).filter("doc_id = 200003").count() == 1
    assert forest.join(df.limit(0)).count() == 0


def test_prefix_depth_meets_recall():
    d = forest.prefix_depth(0.8, 0.995)
    assert forest.chance(d, 0.8) >= 0.995 and (d == forest.DEPTH or forest.chance(d + 1, 0.8) < 0.995)
    assert forest.prefix_depth(0.99, 0.995) == forest.DEPTH
    assert forest.prefix_depth(0.99, 0.995, [1.0, 1.0, 1.0, 0.999, 0.9, 0.8]) == 4


def test_forest_measures_recall_and_ties_only_the_like(spark):
    """Signatures made by hand: three that agree in most values, one that shares a whole label of a tree by chance."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**32, (forest.TREES, forest.DEPTH), np.uint64).astype(np.uint32)
    near, far = base.copy(), rng.integers(0, 2**32, base.shape, np.uint64).astype(np.uint32)
    near[:3] = far[:3] ^ 1
    far[15] = base[15]
    half = base.copy()
    half[:, 1] += 1  # like all else, but no prefix of two values
    rows = [(i, bytearray(x.tobytes())) for i, x in enumerate([base, near, far, half])]
    classes = spark.createDataFrame(rows, "cid long, sig binary")
    measured = forest.measured_recall(classes, 0.8)
    assert measured[0] == 1 and 0.4 < measured[1] < 0.7 and measured == sorted(measured, reverse=True)
    areas = {r["cid"]: r["area"] for r in forest.neighbourhoods(classes, 5, 100).collect()}
    assert areas == {0: 0, 1: 0}
    assert forest.neighbourhoods(classes, 5, 1).count() == 3 and forest.measured_recall(classes.filter("cid = 2"), 0.8) is None


# 10: exact top-k.
def test_bitslice_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(300, 8)), 2)
    x[50:60] = x[40]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(900, None), (920, [float("inf")] + [0.0] * 7), (940, [None] + [0.0] * 7), (None, [1.0] * 8), (960, [1.0, 2.0]), (980, [1e5] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    q = {i: np.floor(64 * np.array(v)).astype(int) for i, v in [*rows, odd[-1]]}
    for kw in ({}, {"block_rows": 64, "block_queries": 4}):
        got = bitslice.top_k(df, F.col("vec_id") % 20 == 0, 7, **kw).collect()
        asked = [i for i in q if i % 20 == 0]
        assert {r["query_id"] for r in got} == set(asked)
        for i in asked:
            want = sorted(((int(q[i] @ q[j]), j) for j in q if j != i), key=lambda s: (-s[0], s[1]))[:7]
            mine = sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])
            assert [(r["score"], r["vec_id"]) for r in mine] == want and [r["rank"] for r in mine] == list(range(1, 8))
    few = bitslice.top_k(df.filter("vec_id in (0, 1)"), F.col("vec_id") == 0, 20).collect()
    assert [(r["rank"], r["vec_id"]) for r in few] == [(1, 1)]
    assert bitslice.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


# The pipeline.
def test_pipeline_takes_effect(spark):
    import corpus_pipeline

    docs = queries.table(spark, SF, "documents")
    columns, labels = docs.columns, queries.table(spark, SF, "labels")
    path = scratch.base_dir(spark) + "/test-pipeline"
    counts = [docs.count()]
    for name, f in corpus_pipeline.STAGES[:-1]:
        f(spark, docs, SF).write.mode("overwrite").parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        assert docs.columns == columns
        counts.append(docs.count())
        if name == "quality":
            assert docs.join(labels.filter("quality = 0"), "doc_id", "left_semi").count() <= 1
        if name == "near_duplicates":
            assert forest.join(docs).filter("n_links > 0").count() == 0
    assert counts[1] < counts[0] and counts[3] < counts[2]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
