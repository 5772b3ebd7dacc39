"""Retrieval: ranked channels, their fusion, boosts, guards, abstention and normalisation, for many queries at a time.

queries(query_id, text, ...) meet memories through inverted lists or blocks; every later step works within a query.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemo import policy
from mnemo.functions import scoring as sc
from mnemo.functions import text as tx
from mnemo.sources.io import written


#: Terms of documents that meet terms of queries in one task of the text channel.
PARTS = 2_000_000
#: Vectors and queries in a block, and how many blocks of each meet in one group of a task.
HELD, ASKED, HELD_BLOCKS, ASKED_BLOCKS = 4096, 512, 4, 16


def top(df: DataFrame, k: int, score: str, *keys: str, tie: str = "node_id", rank: str = "rank") -> DataFrame:
    """The k best rows of each key, rank from 1; equal scores by id."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def postings(df: DataFrame, least: int = 3) -> DataFrame:
    """term, node_id, tf and document length: the full-text index. A node has one row, whose sorted words are counted by
    where each begins, so that words aren't shuffled."""
    words = df.select("node_id", F.sort_array(tx.tokens("content", least)).alias("words")).withColumn("n", F.size("words"))  # once a document, not once a word
    fresh = lambda i: (i <= F.col("n")) & ((i == 1) | (F.get("words", i - 1) != F.get("words", i - 2)))
    starts = words.withColumn("starts", F.filter(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), fresh))
    tf = lambda i, k: F.coalesce(F.get("starts", k + 1), F.col("n") + 1) - i
    each = F.transform("starts", lambda i, k: F.struct(F.get("words", i - 1).alias("term"), tf(i, k).cast("long").alias("tf")))
    return starts.select("node_id", F.col("n").alias("len"), F.explode(each).alias("x")).select("x.term", "node_id", "len", "x.tf")


def counted(df: DataFrame, terms: DataFrame, least: int = 3) -> DataFrame:
    """postings() of the given terms(term) only, and of the term '' for each node, so that every length is there: texts are
    read once, and words that nobody asks for go before any is counted."""
    words = df.select("node_id", tx.tokens("content", least).alias("words")).withColumn("len", F.size("words"))
    each = words.select("node_id", "len", F.explode(F.array_append(F.coalesce("words", F.array().cast("array<string>")), F.lit(""))).alias("term"))
    asked = terms.unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term")))
    return each.join(asked, "term", "left_semi").groupBy("node_id", "len", "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, df: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, node_id, bm25, hits (how many of the query's terms it has): only the queries' terms leave the index, and only their frequencies are joined. The used
    part of the index is dealt out by documents, about PARTS sums to a task, so that terms meet queries, sums are made and a
    query's best are kept where a document's terms are: the sums, many times the index, aren't sent."""
    q = written(queries.select("query_id", F.explode(tx.word_set("text", 3)).alias("term")), "asked")  # its size is known from here on
    used = written(counted(df, written(q.select("term").distinct(), "asked-terms")), "postings")
    lens = used.filter("term = ''")  # a row for each document
    size = lens.agg(F.sum("tf").alias("n"), (F.sum(F.col("len") * F.col("tf")) / F.sum(F.when(F.col("len").isNotNull(), F.col("tf")))).alias("avg_len"))
    used = used.filter("term <> ''")
    terms = written(q.join(used.groupBy("term").agg(F.count("*").alias("df")), "term"), "terms")
    tasks = 1 + (terms.agg(F.sum("df")).first()[0] or 0) // PARTS
    weighted = used.repartition(tasks, "node_id").join(terms, "term").crossJoin(F.broadcast(size))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return weighted.groupBy("node_id", "query_id").agg(F.sum(part).alias("bm25"), F.count("*").alias("hits")).select("query_id", "node_id", "bm25", "hits")


def minmax(df: DataFrame, column: str, *keys: str, low: float = 0.1, flat: float = 1.0) -> Column:
    """Scale within each key to low..1; `flat` where all are equal."""
    w = Window.partitionBy(*keys)
    a, z = F.min(column).over(w), F.max(column).over(w)
    return F.when(z > a, low + (1 - low) * (F.col(column) - a) / (z - a)).otherwise(flat)


def maxnorm(column: str, *keys: str) -> Column:
    z = F.max(column).over(Window.partitionBy(*keys))
    return F.when(z > 0, F.col(column) / z).otherwise(0.0)


def text_channel(queries: DataFrame, df: DataFrame, limit: int) -> DataFrame:
    """BM25 among the best 3 * limit, scaled, blended with the share of query words found."""
    found = bm25(queries, df).withColumn("bm25", F.round("bm25", 6))  # equal texts tie, whatever the order of their sums
    best = top(found, 3 * limit, "bm25", "query_id")
    scored = best.withColumn("norm", minmax(best, "bm25", "query_id"))
    j = scored.join(queries.select("query_id", F.size(tx.word_set("text", 3)).alias("said")), "query_id")
    return top(j.select("query_id", "node_id", F.round(0.7 * F.col("norm") + 0.3 * (F.col("hits") / F.col("said")), 6).alias("score")), limit, "score", "query_id")


def like_channel(words: list[str], df: DataFrame, cap: int, content: str = "content") -> DataFrame:
    """Share of the words that the content contains; best, then newest."""
    hits = reduce(lambda a, b: a + b, [F.lower(content).contains(w).cast("int") for w in words])
    found = df.withColumn("score", hits / float(len(words))).filter("score > 0")
    return found.orderBy(F.desc("score"), F.desc("created_at"), "node_id").limit(cap).select("node_id", "score")


def temporal_channel(df: DataFrame, start: Column, end: Column, cap: int) -> DataFrame:
    """1 in the range, less with whole days outside it, within a range's width on both sides."""
    day = 86_400_000_000
    t, a, z = F.unix_micros("created_at"), F.unix_micros(start), F.unix_micros(end)
    width = F.greatest(F.floor((z - a) / day), F.lit(1))
    off = F.floor(F.least(F.abs(t - a), F.abs(t - z)) / day)
    score = F.when((t >= a) & (t <= z), 1.0).otherwise(1 / (1 + off / width))
    near = df.filter((t >= a - width * day) & (t <= z + width * day)).withColumn("score", score)
    return near.orderBy(F.desc("score"), "node_id").limit(cap).select("node_id", "score")


def entity_channel(words: list[str], df: DataFrame) -> DataFrame:
    """Structured fields that name query words: project, entity, type."""
    w = F.array(*map(F.lit, words))
    hits = F.array_contains(w, F.col("event_type")).cast("int") + F.array_contains(w, F.col("project")).cast("int") + F.array_contains(w, F.col("entity_id")).cast("int")
    hits = F.coalesce(hits, F.lit(0))
    return df.select("node_id", F.least(F.lit(1.0), hits / float(len(words))).alias("score")).filter("score > 0")


def rrf(channels: DataFrame, weights: dict[str, float], k: int = policy.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of channels(query_id, channel, node_id, score), the best scaled to 1."""
    w = Window.partitionBy("query_id", "channel").orderBy(F.desc("score"), "node_id")
    ranked = channels.withColumn("place", F.row_number().over(w))
    part = policy.by_type(weights, "channel", 1.0) / (k + F.col("place"))
    fused = ranked.groupBy("query_id", "node_id").agg(F.sum(part).alias("rrf"))
    return fused.withColumn("rrf", maxnorm("rrf", "query_id"))


def usable(v: str) -> Column:
    """Whether a vector (array of double) has a cosine: not null, empty or zero, every component finite."""
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def packed(rows: DataFrame, names: str, size: int, *within: str) -> DataFrame:
    """rows(id, v, *within) in blocks of about `size`: *within, dim, block, ids and the unit vectors as one binary."""
    import numpy as np

    n = max(1, -(-rows.count() // size))
    rows = rows.withColumns({"dim": F.size("v"), "block": F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")})
    keys = [*within, "dim", "block"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "ids": pdf["id"].tolist(), "vecs": x.tobytes()}])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"ids array<{types['id']}>", "vecs binary"])
    return rows.groupBy(*keys).applyInPandas(pack, schema).withColumnsRenamed({"ids": f"{names}_ids", "vecs": f"{names}_vecs", "block": f"{names}_block"})


def knn(queries: DataFrame, vectors: DataFrame, k: int, least: float = 0.1, within: tuple[str, ...] = (), below: bool = False) -> DataFrame:
    """The k nearest vectors of each query by cosine: queries(query_id, q), vectors(node_id, v); a query's own id counts.

    Queries and vectors are packed in blocks of unit vectors; a few blocks of each meet in a group, so that a task's memory is
    bounded and a block is sent once a group, not once a pair; each meeting of two blocks keeps k a query.
    Only rows that agree in the columns `within` meet, and with below only vectors of smaller ids. Vectors that have no
    cosine take no part, and those of another dimension than the query's are no candidates. Ties go to the smaller id.
    """
    import numpy as np

    q = queries.select(F.col("query_id").alias("id"), F.col("q").cast("array<double>").alias("v"), *within).filter(F.col("id").isNotNull() & usable("v"))
    v = vectors.select(F.col("node_id").alias("id"), F.col("v").cast("array<double>").alias("v"), *within).filter(F.col("id").isNotNull() & usable("v"))

    def nearest(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for held_ids, held_vecs, dim in zip(held["held_ids"], held["held_vecs"], held["dim"], strict=True):
            ids = np.asarray(held_ids)
            order = np.argsort(ids, kind="stable")  # so that a stable sort by nearness leaves ties by id
            ids, x = ids[order], np.frombuffer(held_vecs).reshape(-1, dim)[order]
            for asked_ids, asked_vecs in zip(asked["asked_ids"], asked["asked_vecs"], strict=True):
                names = np.asarray(asked_ids)
                s = np.frombuffer(asked_vecs).reshape(-1, dim) @ x.T
                if below:
                    s[ids[None, :] >= names[:, None]] = -2
                at, to = [], []
                for i, row in enumerate(s):
                    some = np.flatnonzero(row >= least)
                    if len(some) > k:
                        some = some[row[some] >= np.partition(row[some], len(some) - k)[len(some) - k]]
                    some = some[np.argsort(-row[some], kind="stable")][:k]
                    at.append(np.full(len(some), i))
                    to.append(some)
                at, to = np.concatenate(at), np.concatenate(to)
                out.append(pd.DataFrame({"query_id": names[at], "node_id": ids[to], "score": s[at, to]}))
        return pd.concat(out, ignore_index=True)

    group = lambda df, name, n: written(df.withColumn(name, F.floor(F.col(f"{name}_block") / n)), name)
    held, asked = group(packed(v, "held", HELD, *within), "held", HELD_BLOCKS), group(packed(q, "asked", ASKED, *within), "asked", ASKED_BLOCKS)
    keys = [*within, "dim", "held", "asked"]
    groups = lambda df, name: df.select(*within, "dim", name).distinct().toDF(*within, "dim", name)
    one = held.join(groups(asked, "asked"), [*within, "dim"]).groupBy(*keys)
    two = asked.join(groups(held, "held"), [*within, "dim"]).groupBy(*keys)
    types = f"query_id {queries.schema['query_id'].dataType.simpleString()}, node_id {vectors.schema['node_id'].dataType.simpleString()}, score double"
    return top(one.cogroup(two).applyInPandas(nearest, types), k, "score", "query_id")


def guard(df: DataFrame, best: Column, at: int = 3) -> DataFrame:
    """A channel's best candidate comes no later than place `at`: ranked(query_id, node_id, rank)."""
    place = F.when(best & (F.col("rank") > at), F.lit(at) - 0.5).otherwise(F.col("rank").cast("double"))
    w = Window.partitionBy("query_id").orderBy("place", "node_id")
    return df.withColumn("place", place).withColumn("rank", F.row_number().over(w)).drop("place")


def first_of_each(df: DataFrame, text: str = "content", score: str = "score") -> DataFrame:
    """One row of each normalised beginning, the best."""
    key = F.regexp_replace(F.substring(F.lower(F.regexp_replace(text, r"[ \t\r\n]+", " ")), 1, 150), r" - [0-9a-f]+$", "")
    w = Window.partitionBy("query_id", "key").orderBy(F.desc(score), "node_id")
    return df.withColumn("key", key).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("key", "n")


def semantic_dedup(df: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Greedily drop a query's result that a kept better one is nearly equal to: df(query_id, node_id, score, v).

    The kept set decides, so a query's few results are handled together.
    """
    import numpy as np

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "node_id"], ascending=[False, True], ignore_index=True)
        v = np.array([list(x) for x in pdf["v"]], np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        kept: list[int] = []
        for i in range(len(pdf)):
            if not kept or (v[kept] @ v[i]).max() < threshold:
                kept.append(i)
        return pdf.loc[kept, ["query_id", "node_id", "score"]]

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ("query_id", "node_id", "score"))
    return df.groupBy("query_id").applyInPandas(greedy, schema)


def tier(place: Column) -> Column:
    """How much the reranker counts at a place."""
    out = F.lit(policy.RERANK_TIERS[-1][1])
    for last, weight in policy.RERANK_TIERS[-2::-1]:
        out = F.when(place <= last, weight).otherwise(out)
    return out


def rerank(df: DataFrame, first: int = 20) -> DataFrame:
    """Boost by an injected model's score, more for better places: df(query_id, node_id, score, rank, model)."""
    w = Window.partitionBy("query_id")
    z, a = F.max(F.when(F.col("rank") <= first, F.col("model"))).over(w), F.min(F.when(F.col("rank") <= first, F.col("model"))).over(w)
    norm = F.when(z > a, (F.col("model") - a) / (z - a)).otherwise(0.5)
    return df.withColumn("score", F.when(F.col("rank") <= first, F.col("score") * (1 + tier(F.col("rank")) * norm)).otherwise(F.col("score")))


def graph_expand(seeds: DataFrame, edges: DataFrame, hops: int = 2, fade: float = 0.4, least: float = 0.10, least_weight: float = 0.2) -> DataFrame:
    """Neighbours of seeds(query_id, node_id, score), fading by hop and weight; the best way to each, seeds left out."""
    w = F.least("weight", F.lit(1.0))
    both = edges.filter(F.col("weight") >= least_weight).select("source_id", "target_id", w.alias("w"))
    both = both.union(both.select("target_id", "source_id", "w")).toDF("node_id", "to", "w").groupBy("node_id", "to").agg(F.max("w").alias("w"))
    at, out = seeds.select("query_id", "node_id", F.col("score").alias("s")), None
    for _ in range(hops):
        at = at.join(both, "node_id").select("query_id", F.col("to").alias("node_id"), (F.col("s") * fade * F.col("w")).alias("s"))
        at = at.groupBy("query_id", "node_id").agg(F.max("s").alias("s"))
        out = at if out is None else out.union(at)
    best = out.groupBy("query_id", "node_id").agg(F.max("s").alias("score")).filter(F.col("score") >= least)
    return best.join(seeds.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")


def abstain(df: DataFrame, context: str = "general") -> DataFrame:
    """Rows above the context's floors: df(score, vec_sim, overlap); a row without a vector needs its words."""
    vec, words, composite, _ = policy.SURFACING[context]
    enough = F.when(F.col("vec_sim").isNotNull(), (F.col("vec_sim") >= vec) | (F.col("overlap") >= words)).otherwise(F.col("overlap") >= words)
    return df.filter((F.col("score") >= composite) & enough)


def confidence(df: DataFrame, first: int = 3) -> DataFrame:
    """Mean relevance of the first results of each query."""
    return df.filter(F.col("rank") <= first).groupBy("query_id").agg(F.avg("relevance").alias("confidence"))


def merge_subqueries(df: DataFrame, again: float = 1.15) -> DataFrame:
    """Results of a query's parts(query_id, part, node_id, relevance): the best, more if a later part found it no better."""
    w = Window.partitionBy("query_id", "node_id").orderBy("part")
    so_far = F.max("relevance").over(w.rowsBetween(Window.unboundedPreceding, -1))
    seen = df.withColumn("again", so_far.isNotNull() & (F.col("relevance") <= so_far))
    m = seen.groupBy("query_id", "node_id").agg((F.max("relevance") * F.when(F.bool_or("again"), again).otherwise(1.0)).alias("relevance"))
    return m.withColumn("relevance", maxnorm("relevance", "query_id"))


def hybrid(df: DataFrame, words: list[str], start: Column, end: Column, now: Column, limit: int = 10) -> DataFrame:
    """One query over text and time: fused, weighted by metadata and word overlap, filtered, normalised, ranked."""
    from mnemo.operators.filters import active, expired

    channels = [("text", like_channel(words, df, 3 * limit)), ("temporal", temporal_channel(df, start, end, 3 * limit))]
    every = reduce(DataFrame.union, [c.select(F.lit(0).alias("query_id"), F.lit(n).alias("channel"), "node_id", "score") for n, c in channels])
    fused = rrf(every, {"text": policy.PROFILES["_default"][1], "temporal": policy.TEMPORAL_WEIGHT})
    rows = df.filter(~expired(now) & active()).join(F.broadcast(fused), "node_id")  # two channels of 3 * limit rows
    found = reduce(lambda a, b: a + b, [F.lower("content").contains(w).cast("int") for w in words]) / float(len(words))
    scored = rows.withColumn("score", F.col("rrf") * sc.metadata_factor(now) * (1 + found * 0.5 * policy.PROFILES["_default"][2]))
    best = top(scored, limit, "score", "query_id")
    return best.select("node_id", F.round(maxnorm("score", "query_id"), 6).alias("relevance"), "rank")


# Words that ask for preferences.
ASKS_PREFERENCE = [
    "rule", "rules", "preference", "setting", "configured", "should", "allowed", "policy", "default", "location", "timezone", "where", "how",
]


def spaced_words(s: Column, least: int = 3) -> Column:
    """Distinct lower-case words between white space of a length or more."""
    return F.array_distinct(F.filter(F.split(F.lower(s), r"\s+"), lambda w: F.length(w) >= least))


def injected(queries: DataFrame, df: DataFrame, found: DataFrame, kind: str, newest: int, most: int = 3) -> DataFrame:
    """Of df's `newest` memories of a kind, those that aren't superseded, share a word with a query and weren't found by
    it: query_id, node_id, pick (1 to most, the newest first). Queries and these few memories are joined by words."""
    of_kind = df.filter(F.col("event_type") == kind).orderBy(F.desc("created_at"), "node_id").limit(newest).filter("status is null or status <> 'superseded'")
    words = of_kind.select("node_id", "created_at", F.explode(spaced_words(F.col("content"))).alias("w"))
    asked = queries.select("query_id", F.explode(spaced_words(F.col("text"))).alias("w"))
    hits = asked.join(words, "w").select("query_id", "node_id", "created_at").distinct().join(found.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("created_at"), "node_id")
    return hits.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= most).select("query_id", "node_id", "pick")


def structured(
    ranked: DataFrame, queries: DataFrame, df: DataFrame, limit: int = 10, event_type: str | None = None, tags: list[str] | None = None,
    least: float | None = None, rules: str = "constraint", preferences: str = "user_preference",
) -> DataFrame:
    """Results of queries(query_id, text) as rows: query_id, node_id, kind, place (from 1).

    ranked(query_id, node_id, rank, strength) holds at least twice the limit where tags are given. Results are filtered
    by type and tags, cut to the limit, then filtered by strength. Up to three rules, and for queries that ask for
    preferences up to three of these, are put in front, each before those already there. Null texts share no word.
    """
    j = ranked.join(df.select("node_id", "event_type", "tags"), "node_id")
    if event_type is not None:
        j = j.filter(F.col("event_type") == event_type)
    for t in tags or []:
        j = j.filter(F.array_contains(F.transform("tags", F.lower), t.lower()))
    order = Window.partitionBy("query_id").orderBy("rank", "node_id")
    found = j.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)
    if least:
        found = found.filter(F.col("strength") >= least)
    parts = [found.select("query_id", "node_id", F.lit("result").alias("kind"), F.lit(2).alias("part"), F.col("n").alias("at"))]
    if event_type != rules:
        parts.append(injected(queries, df, found, rules, 10).select("query_id", "node_id", F.lit("constraint").alias("kind"), F.lit(1).alias("part"), (-F.col("pick")).alias("at")))
    if event_type != preferences:
        said = F.transform(spaced_words(F.col("text"), 2), lambda w: F.regexp_replace(w, r"[?.,!]+$", ""))
        asking = queries.filter(F.arrays_overlap(said, F.array(*map(F.lit, ASKS_PREFERENCE))))
        parts.append(injected(asking, df, found, preferences, 20).select("query_id", "node_id", F.lit("preference").alias("kind"), F.lit(0).alias("part"), (-F.col("pick")).alias("at")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("part", "at", "node_id"))
    return every.select("query_id", "node_id", "kind", place.cast("int").alias("place"))
