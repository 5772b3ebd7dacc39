"""Approximate nearest neighbours by cosine, through a few stable projections and a kd-tree.

Unit vectors are projected on M random directions with Gaussian (2-stable) entries, so that the squared distance of two
projections over that of the vectors is chi-square with M degrees of freedom. A kd-tree over the projections has two
levels: its upper splits, fitted on a bounded sample, deal every vector to a leaf; a leaf is kept in blocks of bounded
size, each with the lower tree of its own vectors. A query takes neighbours in the projection in order of their
projected distance, and computes their exact cosines, until the stopping test holds: were a vector nearer than the k-th
best found, its projection would lie nearer than the next one does with at least the probability given.

The search has two rounds: the query's own leaf gives a first k-th best, and then only leaves whose box the test doesn't
rule out are asked. Each query misses each of its neighbours with a probability of at most 1 - sure. audit() compares a
sample of queries with all vectors by brute force.

Equal vectors are one class with its smallest ids, as many as an answer can hold, so that a vector that a third of the
rows share is searched and found once; answers go back to rows over salted keys.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows without vec_id take
no part; a query has candidates of its own dimension only; fewer than k candidates are all returned; repeated rows and
vec_ids are candidates each, only the query's very row is left out, and a repeated query vec_id is asked for each row;
ties go to the smaller vec_id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemo.llm import scratch

#: Projections (even), and with which probability a neighbour is found.
M, SURE = 8, 0.95
#: Sampled projections and most leaves of the upper tree; classes of a leaf, of a block and of a bucket; queries of a task.
SAMPLE, MOST_LEAVES, LEAF, BLOCK, BUCKET, ASKED = 32_768, 1024, 16_384, 16_384, 64, 1024
SALTS = 16
VISIT = "cid long, dim int, leaf int, q binary, proj binary, least double"
FOUND = "cid long, vec_id long, own boolean, score double"
PROJECTED = "cid long, k1 long, k2 long, dim int, ids array<bigint>, asked boolean, vec binary, proj array<double>"
BLOCKS = "dim int, leaf int, chunk int, n int, cids binary, ids binary, first binary, begin binary, vecs binary, projs binary, low binary, high binary"


def chi_square(x: float, m: int = M) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def widest(sure: float, m: int = M) -> float:
    """The value that chi-square stays below with this probability."""
    low, high = 0.0, 1.0
    while chi_square(high, m) < sure:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < sure else (low, mid)
    return high


def directions(dim: int, m: int = M) -> np.ndarray:
    return np.random.default_rng([11, dim]).normal(size=(dim, m))


def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors, scaled by a power of two to a greatest component of about 1, and their unit vectors' projections."""
    for batch in batches:
        v = batch.column("v")
        size, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy()
        at = np.cumsum(size) - size
        for dim in np.unique(size):
            rows = np.flatnonzero(size == dim)
            x = flat[at[rows][:, None] + np.arange(dim)]
            x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
            p = x / np.sqrt((x * x).sum(1, keepdims=True)) @ directions(int(dim))
            some = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*(some.column(c) for c in ("cid", "k1", "k2")), pa.array(np.full(len(rows), dim, np.int32)), some.column("ids"), some.column("asked"),
                 pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(p), pa.list_(pa.float64()))],
                ["cid", "k1", "k2", "dim", "ids", "asked", "vec", "proj"],
            )


def upper_tree(points: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and value of the splits of a balanced kd-tree over points, in heap order; leaves is a power of two."""
    axis, value = np.zeros(leaves - 1, np.int64), np.zeros(leaves - 1)
    held = {0: points}
    for node in range(leaves - 1):
        x = held.pop(node)
        axis[node] = (x.max(0) - x.min(0)).argmax() if len(x) else 0
        value[node] = np.median(x[:, axis[node]]) if len(x) else 0.0
        right = x[:, axis[node]] > value[node]
        held[2 * node + 1], held[2 * node + 2] = x[~right], x[right]
    return axis, value


def leaf_of(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    if tree is None or not len(tree[0]):
        return node
    while node[0] < len(tree[0]):
        node = 2 * node + 1 + (points[np.arange(len(points)), tree[0][node]] > tree[1][node])
    return node - len(tree[0])


def route(batches: Iterator[pa.RecordBatch], trees: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            points = batch.column("proj").flatten().to_numpy().reshape(batch.num_rows, M)
            dims = batch.column("dim").to_numpy()
            leaf = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                leaf[dims == dim] = leaf_of(points[dims == dim], trees.get(int(dim)))
            yield batch.append_column("leaf", pa.array(leaf))


def buckets(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Leaves of a kd-tree over points: halves at the median of the widest dimension until at most size are left."""
    out, left = [], [np.arange(len(points))]
    while left:
        at = left.pop()
        if len(at) <= size:
            out.append(at)
            continue
        x = points[at]
        order = np.argpartition(x[:, (x.max(0) - x.min(0)).argmax()], len(at) // 2)
        left += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def build_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    points = np.stack(rows["proj"].to_numpy())
    parts = buckets(points, BUCKET)
    order = np.concatenate(parts)
    rows, points = rows.iloc[order], points[order]
    first = np.cumsum([0, *map(len, parts)])
    ids = rows["ids"].tolist()
    bound = lambda f: np.stack([f(points[a:b], axis=0) for a, b in zip(first, first[1:])]).tobytes()
    return pd.DataFrame([{
        "dim": key[0], "leaf": key[1], "chunk": key[2], "n": len(rows), "cids": rows["cid"].to_numpy(np.int64).tobytes(),
        "ids": np.concatenate(ids).astype(np.int64).tobytes(), "first": np.cumsum([0, *map(len, ids)]).astype(np.int64).tobytes(),
        "begin": first.astype(np.int64).tobytes(), "vecs": b"".join(rows["vec"]), "projs": points.tobytes(), "low": bound(np.min), "high": bound(np.max),
    }])


class Block:
    """A block's vectors in kd order: bucket i holds at most BUCKET of them, within the box low[i], high[i]."""

    def __init__(self, row: dict):
        get = lambda c, t=np.float64: np.frombuffer(row[c], t)
        self.cids, self.ids, self.first = get("cids", np.int64), get("ids", np.int64), get("first", np.int64)
        self.vecs, self.projs = get("vecs").reshape(row["n"], -1), get("projs").reshape(row["n"], M)
        self.low, self.high = get("low").reshape(-1, M), get("high").reshape(-1, M)
        self.squares = (self.vecs * self.vecs).sum(1)
        self.sizes = np.diff(self.first)
        self.begin = get("begin", np.int64)

    def near(self, q: np.ndarray, proj: np.ndarray, least: float, want: int, limit: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Vectors (places) with their cosines that can be among the best `want` ids, of cosine `least` or more, and how many were verified."""
        square = (q * q).sum()
        out = np.maximum(np.maximum(self.low - proj, proj - self.high), 0)
        boxes = (out * out).sum(1)
        order = np.argsort(boxes, kind="stable")
        rows, far = np.zeros(0, np.int64), np.zeros(0)  # opened, not verified, by projected distance
        seen, cosines, opened, step = [], [], 0, BUCKET
        best = least
        while True:
            if not len(rows) or (opened < len(order) and far[0] > boxes[order[opened]]):
                if opened == len(order):
                    break
                if boxes[order[opened]] > limit * max(0.0, 2 - 2 * best) + 1e-12 and not len(rows):
                    break
                some = order[opened : opened + max(1, step // BUCKET)]
                opened += len(some)
                more = np.concatenate([np.arange(self.begin[b], self.begin[b + 1]) for b in some])
                d = self.projs[more] - proj
                rows, far = np.r_[rows, more], np.r_[far, (d * d).sum(1)]
                by = np.argsort(far, kind="stable")
                rows, far = rows[by], far[by]
                continue
            # The stopping test: the next projected neighbour is too far for one nearer than the k-th best.
            if far[0] > limit * max(0.0, 2 - 2 * best) + 1e-12:
                break
            sure = len(far) if opened == len(order) else int(np.searchsorted(far, boxes[order[opened]], "right"))
            take = min(step, sure)
            at, rows, far = rows[:take], rows[take:], far[take:]
            seen.append(at)
            cosines.append(self.vecs[at] @ q / np.sqrt(self.squares[at] * square))
            step = min(2 * step, 4096)
            best = max(best, self.kth(np.concatenate(seen), np.concatenate(cosines), want))
        if not seen:
            return np.zeros(0, np.int64), np.zeros(0), 0
        at, c = np.concatenate(seen), np.concatenate(cosines)
        some = at[c >= max(best, least) - 1e-9]
        exact = (self.vecs[some] * q).sum(1) / np.sqrt(self.squares[some] * square)
        return some, exact, len(at)

    def kth(self, at: np.ndarray, c: np.ndarray, want: int) -> float:
        if len(at) > want:
            top = np.argpartition(-c, want - 1)[:want]
            at, c = at[top], c[top]
        by = np.argsort(-c, kind="stable")
        enough = np.searchsorted(np.cumsum(self.sizes[at[by]]), want)
        return float(c[by[enough]]) if enough < len(by) else -2.0


def answer(asks: pd.DataFrame, blocks: pd.DataFrame, want: int, limit: float) -> pd.DataFrame:
    """The best ids of one block for some queries, each with its cosine."""
    out: list[tuple[np.ndarray, ...]] = []
    if len(blocks):
        block = Block(blocks.iloc[0].to_dict())
        for cid, q, proj, least in zip(asks["cid"], asks["q"], asks["proj"], asks["least"], strict=True):
            at, c, _ = block.near(np.frombuffer(q), np.frombuffer(proj), least, want, limit)
            some = np.repeat(np.arange(len(at)), block.sizes[at])
            ids = np.concatenate([block.ids[block.first[i] : block.first[i + 1]] for i in at]) if len(at) else np.zeros(0, np.int64)
            best = np.lexsort((ids, -c[some]))[:want]
            some = some[best]
            out.append((np.full(len(best), cid), ids[best], block.cids[at[some]] == cid, c[some]))
    if not out:
        return pd.DataFrame({"cid": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "own": pd.Series(dtype=bool), "score": pd.Series(dtype="float64")})
    return pd.DataFrame(dict(zip(("cid", "vec_id", "own", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def visit(asks: DataFrame, blocks: DataFrame, want: int, limit: float) -> DataFrame:
    """FOUND of asks (VISIT), each in all blocks of the leaf it names; at most ASKED of them meet a block in a task."""
    count = asks.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    chunks = blocks.groupBy("dim", "leaf").agg(F.max("chunk").alias("last"))
    # A row for each leaf: at most MOST_LEAVES for each dimension, whatever the input.
    leaves = F.broadcast(count.join(chunks, ["dim", "leaf"]))
    left = asks.join(leaves, ["dim", "leaf"]).select(
        *asks.columns, F.pmod(F.xxhash64("cid"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), "last")).alias("chunk")
    )
    right = blocks.join(leaves, ["dim", "leaf"]).select(*blocks.columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    keys = ["dim", "leaf", "chunk", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: answer(a, b, want, limit), FOUND)


def best_of(found: DataFrame, want: int) -> DataFrame:
    best = Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= want)


def usable_rows(vectors: DataFrame, query: Column) -> DataFrame:
    """vec_id, v (array of double), is_query and the key k1, k2 of the vectors that take part."""
    v = F.transform("embedding", lambda e: e.cast("double"))
    good = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    ) & F.exists("v", lambda e: e != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(query, F.lit(False)).alias("is_query"))
    return rows.filter(F.coalesce(good, F.lit(False))).withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})


def nearest(vectors: DataFrame, query: Column, k: int = 5, sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors(vec_id, embedding) for which query holds, k others."""
    spark = vectors.sparkSession
    scratch.ship_code(spark)
    limit, want = widest(sure), k + 1  # one more, for the query's own row may be among them
    rows = usable_rows(vectors, query)
    least = Window.partitionBy("k1", "k2").orderBy("vec_id")
    classes = rows.drop("is_query").withColumn("n", F.row_number().over(least)).filter(F.col("n") <= want).groupBy("k1", "k2").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")  # at most `want` ids
    )
    asks = rows.filter("is_query").select("vec_id", "k1", "k2")
    asked = asks.select("k1", "k2", F.lit(True).alias("asked")).distinct()
    classes = classes.join(asked, ["k1", "k2"], "left").withColumn("cid", F.monotonically_increasing_id())
    classes = scratch.materialise(classes.mapInArrow(project, PROJECTED), "projected")
    counts = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    sample = classes.select("dim", "proj", F.xxhash64("cid").alias("h"), "cid").orderBy("h", "cid").limit(SAMPLE).select("dim", "proj").toPandas()
    trees = {}
    for dim, some in sample.groupby("dim"):
        leaves = min(MOST_LEAVES, -(-counts[dim] // LEAF), max(1, len(some) // 16))
        trees[int(dim)] = upper_tree(np.stack(some["proj"].to_numpy()), 1 << (leaves - 1).bit_length())
    schema = spark.createDataFrame([], PROJECTED + ", leaf int").schema
    routed = scratch.materialise(classes.mapInArrow(lambda b: route(b, trees), schema), "routed")
    box = [f(F.col("proj")[i]) for f in (F.min, F.max) for i in range(M)]
    seen = routed.groupBy("dim", "leaf").agg(F.count("*").alias("n"), F.array(*box).alias("box")).collect()  # a row a leaf
    boxes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in counts:
        mine = [r for r in seen if r["dim"] == dim]
        boxes[dim] = np.array([r["leaf"] for r in mine]), np.array([r["box"] for r in mine])
    chunks = spark.createDataFrame([(r["dim"], r["leaf"], -(-r["n"] // BLOCK)) for r in seen], "dim int, leaf int, chunks int")
    dealt = routed.join(F.broadcast(chunks), ["dim", "leaf"]).withColumn("chunk", F.pmod(F.xxhash64("cid"), "chunks").cast("int"))
    blocks = dealt.select("dim", "leaf", "chunk", "cid", "ids", "vec", "proj").groupBy("dim", "leaf", "chunk").applyInPandas(build_block, BLOCKS)
    blocks = scratch.materialise(blocks, "kd-blocks")

    def pack(batches: Iterator[pa.RecordBatch], others: bool) -> Iterator[pa.RecordBatch]:
        """Queries with the leaves they go to: their own, or all others that the test doesn't rule out."""
        for batch in batches:
            points = batch.column("proj").flatten().to_numpy().reshape(batch.num_rows, M) if batch.num_rows else np.zeros((0, M))
            dims, own, bound = (batch.column(c).to_numpy() for c in ("dim", "leaf", "least"))
            at, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, (dim, home, p, c) in enumerate(zip(dims.tolist(), own.tolist(), points, bound, strict=True)):
                leaf = np.array([home])
                if others:
                    leaf, box = boxes[dim]
                    out = np.maximum(np.maximum(box[:, :M] - p, p - box[:, M:]), 0)
                    leaf = leaf[((out * out).sum(1) <= limit * max(0.0, 2 - 2 * c) + 1e-12) & (leaf != home)]
                at.append(np.full(len(leaf), i))
                to.append(leaf)
            at, to = np.concatenate(at), np.concatenate(to)
            where = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid").take(where), batch.column("dim").take(where), pa.array(to.astype(np.int32)), batch.column("vec").take(where),
                 pa.array([points[i].tobytes() for i in at], pa.binary()), batch.column("least").take(where)],
                ["cid", "dim", "leaf", "q", "proj", "least"],
            )

    queries = routed.filter("asked").select("cid", "dim", "leaf", "vec", "proj")
    first = queries.withColumn("least", F.lit(-2.0)).mapInArrow(lambda b: pack(b, False), VISIT)
    near = scratch.materialise(best_of(visit(first, blocks, want, limit), want), "near")
    kth = near.groupBy("cid").agg(F.when(F.count("*") >= want, F.min("score")).otherwise(-2.0).alias("least"))
    again = queries.join(kth, "cid", "left").na.fill(-2.0, ["least"]).mapInArrow(lambda b: pack(b, True), VISIT)
    again = scratch.materialise(again, "visits")
    found = best_of(near.drop("place").unionByName(visit(again, blocks, want, limit)), want)
    # At most `want` ids a query.
    lists = found.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("away"), "vec_id", "own", "score"))).alias("best"))
    lists = routed.filter("asked").select("cid", "k1", "k2").join(lists, "cid").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asks = asks.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    out = asks.join(lists, ["k1", "k2", "salt"]).select(F.col("vec_id").alias("query_id"), "best")
    # The query's very row: the first of its class with its id.
    self_at = F.array_position(F.transform("best", lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))), True).cast("int")
    others = F.filter("best", lambda x, i: (F.lit(0) + i) != F.col("self_at") - 1)
    ranked = out.withColumn("self_at", self_at).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "x"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def audit(vectors: DataFrame, query: Column, found: DataFrame, sample: int = 256) -> float:
    """Recall of found (as nearest() gives it): which share of the true k best, by brute force for at most `sample` queries
    with the least hashes, is there. A candidate counts as true if it is as near as the k-th best."""
    rows = usable_rows(vectors, query)
    some = rows.filter("is_query").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "v").collect()
    k = found.agg(F.max("rank")).first()[0] or 0
    ids, by_dim = [r["vec_id"] for r in some], {}
    for i, r in enumerate(some):
        by_dim.setdefault(len(r["v"]), []).append((i, np.array(r["v"])))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[np.ndarray] = [np.zeros(0)] * len(ids)
        for batch in batches:
            size, flat = np.diff(batch.column("v").offsets.to_numpy()), batch.column("v").flatten().to_numpy()
            at, vec_id = np.cumsum(size) - size, batch.column("vec_id").to_numpy()
            for dim, asked in by_dim.items():
                here = np.flatnonzero(size == dim)
                x = flat[at[here][:, None] + np.arange(dim)]
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                for i, q in asked:
                    q = q / np.abs(q).max()
                    c = (x @ (q / np.sqrt((q * q).sum())))[vec_id[here] != ids[i]]
                    top[i] = np.sort(np.r_[top[i], c])[::-1][:k]
        yield pa.RecordBatch.from_pydict({"query_id": np.repeat(ids, [len(t) for t in top]).astype(np.int64), "c": np.concatenate([np.zeros(0), *top])})

    truth = rows.select("vec_id", "v").mapInArrow(best, "query_id long, c double")
    order = Window.partitionBy("query_id").orderBy(F.desc("c"))
    truth = truth.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).groupBy("query_id").agg(F.min("c").alias("kth"), F.count("*").alias("n"))
    got = truth.join(found, "query_id", "left").groupBy("query_id", "n").agg(F.count_if(F.col("score") >= F.col("kth") - 1e-9).alias("hits"))
    return got.agg(F.sum("hits") / F.sum("n")).first()[0]
