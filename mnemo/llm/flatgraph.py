"""Near-duplicate vectors by a flat, robust-pruned proximity graph.

Equal vectors form a class, kept once. Cluster centres, fitted on a bounded sample, deal every class to the shards of
its nearest centres, so that shards overlap. Each shard builds a graph: nearest neighbours, pruned so that an edge is
left out where another leads closer by a margin, with reverse edges. A class's adjacency lists are united over its
shards. In each shard, a greedy search from its medoid then looks for what lies near every member, with a beam that
grows with what is in range. What edges within a slightly wider range join is a part; the parts that a search meets in that range
are one region (a part is met once, not in each of its members), and all cosines inside a
region are computed exactly in double precision. A pair that several shards hold is counted in the first of them.

How many shards a class goes to is measured before the search: sampled vectors, each beside one made at exactly the
threshold from it, have to share a shard at the target rate, whether or not the table has links. An audit then compares
a bounded sample of vectors with all others by brute force, a larger one where few of them have links; while the linked
ones' average recall is below the target, every class goes to more shards and the search is repeated. The recall that the
audit found in the end is a column of the result, null where no audited vector has a link.

Links leave a shard only as counts and as local roots of its components; the global components are joined from those.
A shard with more members than a task should hold is dealt to blocks, and each two blocks meet in a task of their own.

Vectors of different dimensions have no cosine: each dimension has centres, shards, an audit and a graph of its own,
but for dimensions with at most FEW classes (the commonest one apart), which are compared exactly, each in one task.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows without vec_id link
with nothing: no links, a component of their own, kept. Equal vectors, also of repeated rows, link with each other. The
recall is the least of the dimensions that have a graph. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm import scratch
from mnemo.llm.components import components, least_values, unite

THRESHOLD, RECALL = 0.9, 0.98
#: Classes for each centre, sampled vectors, least shards for each class, members of a task.
SHARD, SAMPLE, OVERLAP, BLOCK = 1500, 50_000, 3, 12_000
#: Candidates and kept edges of a node, pruning margin, beam, nodes opened at a time, and how much wider regions are.
CANDIDATES, DEGREE, ALPHA, BEAM, OPENED, SLACK = 40, 20, 1.2, 24, 4, 0.05
#: Queries times nodes of a search at a time.
ENTRIES = 4 << 20
#: Classes of a dimension that are compared without a graph.
FEW = 2000
#: Audited vectors; as many as the second where fewer than LINKED of them have links.
AUDITED, MOST_AUDITED, LINKED = 256, 4096, 64
MEMBERS = "shard int, cid long, size long, shards binary, vec binary"
PACKED = "ids binary, vecs binary"


def unit_rows(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    """An array column of one dimension as unit rows."""
    x = batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_pylist([{"ids": batch.column("cid").to_numpy().tobytes(), "vecs": unit_rows(batch).tobytes()}])


def collect_rows(classes: DataFrame, limit: int, seed: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the limit classes least by a hash."""
    sample = classes.select("cid", "v", F.xxhash64(F.lit(seed), "cid").alias("h")).orderBy("h", "cid").limit(limit)
    parts = sample.select("cid", "v").mapInArrow(pack_rows, PACKED).collect()
    ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in parts]) if parts else np.zeros(0, np.int64)
    return ids, np.concatenate([np.frombuffer(r["vecs"]).reshape(-1, dim) for r in parts]) if parts else np.zeros((0, dim))


def centres(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].astype(np.float32)
    x = x.astype(np.float32)
    for _ in range(rounds if k > 1 else 0):
        near = np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.diff(near[order], prepend=-1))
        sums = np.add.reduceat(x[order], at)
        c[near[order][at]] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return c


def deal_shards(batches: Iterator[pa.RecordBatch], c: np.ndarray, overlap: int) -> Iterator[pa.RecordBatch]:
    """Each class once for each of its nearest centres."""
    a = min(overlap, len(c))
    for batch in batches:
        if not batch.num_rows:
            continue
        x = unit_rows(batch)
        n, dim = x.shape
        near = np.sort(np.argpartition(-(x.astype(np.float32) @ c.T), a - 1, axis=1)[:, :a].astype(np.int32), axis=1)
        rows = np.repeat(np.arange(n), a)
        binary = lambda m: pa.Array.from_buffers(
            pa.binary(), len(m), [None, pa.py_buffer((np.arange(len(m) + 1) * m[:1].nbytes).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(m))]
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(near.ravel()), batch.column("cid").take(pa.array(rows)), batch.column("size").take(pa.array(rows)), binary(near[rows]), binary(x[rows])],
            ["shard", "cid", "size", "shards", "vec"],
        )


def robust_prune(x: np.ndarray, cand: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """Which of each node's candidates (nearest first) stay: none that a kept one is closer to by the margin."""
    keep = np.zeros(cand.shape, bool)
    far = 1 - sims
    for i in range(0, len(cand), 1024):
        v = x[cand[i : i + 1024]]
        between = 1 - v @ v.transpose(0, 2, 1)
        gone = np.zeros(v.shape[:2], bool)
        count = np.zeros(len(v), int)
        for j in range(cand.shape[1]):
            use = ~gone[:, j] & (count < DEGREE)
            keep[i : i + 1024][:, j] = use
            count += use
            gone |= use[:, None] & (ALPHA * between[:, j] <= far[i : i + 1024])
    return keep


def nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest other rows of each row, nearest first, and their cosines."""
    found, sims = np.empty((len(x), k), np.int64), np.empty((len(x), k), np.float32)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(x) else np.tile(np.arange(k), (len(s), 1))
        value = np.take_along_axis(s, top, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        found[i : i + 1024], sims[i : i + 1024] = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
    return found, sims


def build_graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of a pruned graph over the rows of x, with reverse edges."""
    k = min(CANDIDATES, len(x) - 1)
    if k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cand, sims = nearest(x, k)
    keep = robust_prune(x, cand, sims)
    a, b = np.repeat(np.arange(len(x)), keep.sum(1)), cand[keep]
    return np.concatenate([a, b]), np.concatenate([b, a])


def vectors_of(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["vec"]), np.float64).reshape(len(pdf), -1)


def shard_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's adjacency lists: cid, near (ids)."""
    ids = pdf["cid"].to_numpy(np.int64)
    a, b = build_graph(vectors_of(pdf).astype(np.float32))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    at = np.flatnonzero(np.diff(a, prepend=-1))
    lists = [ids[x].tobytes() for x in np.split(b, at[1:])] if len(a) else []
    return pd.DataFrame({"cid": ids[a[at]], "near": lists})


def adjacency(ids: np.ndarray, lists: list) -> tuple[np.ndarray, np.ndarray]:
    """United lists as neighbours' positions (all of them, by node) and where each node's begin; ids of other shards go."""
    order = np.argsort(ids)
    flat = [np.frombuffer(b"".join(x), np.int64) if x is not None else np.zeros(0, np.int64) for x in lists]
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in flat])
    to = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(ids[order], to), len(ids) - 1)
    hit = ids[order][at] == to
    pairs = np.unique(owner[hit] * len(ids) + order[at[hit]])
    return pairs % len(ids), np.searchsorted(pairs // len(ids), np.arange(len(ids) + 1))


def cosines(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x[a] times x[b], row by row."""
    parts = [np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)]
    return np.concatenate(parts) if parts else np.zeros(0, x.dtype)


def places(rows: np.ndarray) -> np.ndarray:
    """The place of each of ascending rows within its run."""
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    return np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))


def range_search(x: np.ndarray, to: np.ndarray, first: np.ndarray, threshold: float, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, found) in range, for each row of x: a greedy search from the medoid, the nearest unopened nodes
    first. A query's beam holds its BEAM nearest nodes and, however many, those in range; it ends when all are opened.

    Where only the parts that a query meets matter, part names each row's: beyond its nearest, the beam then holds one
    node in range of each part but the query's own, so that its length doesn't grow with the members of a part."""
    n = len(x)
    medoid, degree = int((x @ x.mean(0)).argmax()), np.diff(first)
    width = max(16, min(2048, ENTRIES // n))
    hits = [np.zeros((2, 0), np.int64)]
    for i in range(0, n, width):
        m = min(width, n - i)
        row, node = np.arange(m), np.full(m, medoid)
        sim = cosines(x, row + i, node)
        opened, seen = np.zeros(m, bool), np.zeros(m * n, bool)
        seen[row * n + medoid] = True
        while not opened.all():
            # Entries are sorted by row, then by nearness, so the first unopened ones of a row are its nearest.
            left = np.flatnonzero(~opened)
            now = left[places(row[left]) < OPENED]
            opened[now] = True
            size = degree[node[now]]
            reach = to[np.repeat(first[node[now]] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            key = np.unique(np.repeat(row[now], size) * n + reach)
            key = key[~seen[key]]
            seen[key] = True
            r, v = key // n, key % n
            s = cosines(x, r + i, v)
            row, node, sim, opened = (np.concatenate(z) for z in ((row, r), (node, v), (sim, s), (opened, np.zeros(len(r), bool))))
            order = np.lexsort((-sim, row))
            far = places(row[order]) >= BEAM
            keep = ~far | (sim[order] >= threshold)
            if part is not None and (far := far & keep).any():
                met = part[node[order]]
                first_met = np.zeros(len(order), bool)
                first_met[np.unique(row[order] * n + met, return_index=True)[1]] = True
                keep &= ~far | (first_met & (met != part[row[order] + i]))
            order = order[keep]
            row, node, sim, opened = row[order], node[order], sim[order], opened[order]
        found = sim >= threshold
        hits.append(np.stack([row[found] + i, node[found]]))
    return tuple(np.concatenate(hits, axis=1))


def search_shard(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One task: a shard, or two blocks of one (side 1 and 2): cid, links, root of the members with links."""
    pdf = pdf.sort_values("cid", ignore_index=True)
    ids, weight, side = pdf["cid"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64), pdf["side"].to_numpy()
    shard = int(pdf["shard"].iloc[0])
    shards = np.frombuffer(b"".join(pdf["shards"]), np.int32).reshape(len(ids), -1)
    exact = vectors_of(pdf)
    x = exact.astype(np.float32)
    to, first = adjacency(ids, list(pdf["near"]))
    wide = threshold - SLACK
    a, b = np.repeat(np.arange(len(ids)), np.diff(first)), to
    close = cosines(x, a, b) >= wide
    part = unite(len(ids), a[close], b[close])
    q, found = range_search(x, to, first, wide, part)
    region = unite(len(ids), np.concatenate([part, q]), np.concatenate([np.arange(len(ids)), found]))
    links, lefts, rights = np.zeros(len(ids), np.int64), [], []
    order = np.argsort(region, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(region[order], prepend=-1)), len(order))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        part = order[i:j]
        if len(part) < 2:
            continue
        for k in range(0, len(part), 1024):
            left = part[k : k + 1024]
            at, to = np.nonzero(exact[left] @ exact[part].T >= threshold)
            at, to = left[at], part[to]
            first = np.full(len(at), np.iinfo(np.int32).max, np.int32)
            for s in range(shards.shape[1]):
                shared = (shards[to] == shards[at, s][:, None]).any(1)
                first[shared] = np.minimum(first[shared], shards[at[shared], s])
            mine = (at != to) & (first == shard) & ((side[at] == 0) | (side[at] != side[to]) | bool((side == 1).all()))
            at, to = at[mine], to[mine]
            np.add.at(links, at, weight[to])
            top = unite(len(ids), at, to)
            moved = np.flatnonzero(top != np.arange(len(ids)))  # a pair a member, not one a link
            lefts.append(moved)
            rights.append(top[moved])
    a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (lefts, rights))
    root = ids[unite(len(ids), a, b)]
    some = np.flatnonzero(links)
    return pd.DataFrame({"cid": ids[some], "links": links[some], "root": root[some]})


def by_task(members: DataFrame, block: int) -> DataFrame:
    """members with task and side: whole shards, or every two blocks of a shard with more than block members."""
    count = members.groupBy("shard").agg(F.count("*").alias("here"))
    m = members.join(count, "shard").withColumn("blocks", F.ceil(F.col("here") / block).cast("int"))
    small = m.filter("blocks = 1").select(*members.columns, F.col("shard").cast("string").alias("task"), F.lit(0).alias("side"))
    large = m.filter("blocks > 1").withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    name = F.concat_ws("/", "shard", F.least("mine", "other"), F.greatest("mine", "other"))
    return small.unionByName(large.select(*members.columns, name.alias("task"), F.when(F.col("mine") <= F.col("other"), 1).otherwise(2).alias("side")))


def links_in_shards(classes: DataFrame, c: np.ndarray, overlap: int, threshold: float, block: int) -> DataFrame:
    """cid, links, root: one row for each shard in which a class has links."""
    members = scratch.materialise(classes.mapInArrow(lambda b: deal_shards(b, c, overlap), MEMBERS), "shards")
    tasks = by_task(members, block)
    own = tasks.filter("side = 0 or element_at(split(task, '/'), 2) = element_at(split(task, '/'), 3)")
    parts = min(max(len(c), 8), 4000)  # a shard takes seconds but few bytes, by which partitions would be put together
    edges = own.repartition(parts, "task").groupBy("task").applyInPandas(shard_edges, "cid long, near binary")
    united = edges.groupBy("cid").agg(F.collect_list("near").alias("near"))  # a list for each of the class's shards
    full = tasks.join(united, "cid", "left")
    return scratch.materialise(full.repartition(parts, "task").groupBy("task").applyInPandas(lambda p: search_shard(p, threshold), "cid long, links long, root long"), "links")


def brute_links(classes: DataFrame, ids: np.ndarray, x: np.ndarray, threshold: float) -> dict[int, int]:
    """Exact links of a few vectors with all classes, weighted by size."""

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                v, cid, size = unit_rows(batch), batch.column("cid").to_numpy(), batch.column("size").to_numpy()
                links = np.zeros(len(ids), np.int64)
                for i in range(0, len(v), 1024):
                    at, to = np.nonzero(v[i : i + 1024] @ x.T >= threshold)
                    other = cid[i + at] != ids[to]
                    np.add.at(links, to[other], size[i + at[other]])
                yield pa.RecordBatch.from_pydict({"cid": ids, "links": links})

    return {r["cid"]: r["links"] for r in classes.mapInArrow(count, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links")).collect()}


def audit(classes: DataFrame, n: int, dim: int, threshold: float) -> dict[int, int]:
    """Exact links of those sampled vectors that have any."""
    for most in (AUDITED, MOST_AUDITED):
        ids, x = collect_rows(classes, most, 1, dim)
        truth = {i: links for i, links in brute_links(classes, ids, x, threshold).items() if links}
        if len(truth) >= LINKED or most >= n:
            break
    return truth


def shared_overlap(c: np.ndarray, x: np.ndarray, threshold: float, recall: float) -> int:
    """To how many of its nearest centres a vector has to go, so that rows of x and vectors at the threshold from them, in
    random directions, share one at the rate of recall."""
    x = x[:MOST_AUDITED]
    u = np.random.default_rng(3).normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * u
    need = []
    for i in range(0, len(x), 256):
        rank = lambda v: (-(v[i : i + 256].astype(np.float32) @ c.T)).argsort(1).argsort(1)
        need.append(np.maximum(rank(x), rank(y)).min(1) + 1)
    need = np.sort(np.concatenate(need))
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)])


def few_links(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """All links of a dimension's few classes: cid, links, root of those with links."""
    ids, weight = pdf["cid"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64)
    x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    a, b = np.nonzero((x @ x.T >= threshold) & ~np.eye(len(x), dtype=bool))
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a, weight[b])
    some = np.flatnonzero(links)
    return pd.DataFrame({"cid": ids[some], "links": links[some], "root": ids[unite(len(ids), a, b)][some]})


def graph_links(classes: DataFrame, n: int, dim: int, threshold: float, recall: float, shard: int, block: int) -> tuple[DataFrame, float | None]:
    """cid, links, root of the linked classes of one dimension, n of them, and the recall that the audit found."""
    spark = classes.sparkSession
    k = max(1, min(-(-n // shard), SAMPLE // 16))
    _, sample = collect_rows(classes, SAMPLE, 0, dim)
    c = centres(sample, k)
    truth = audit(classes, n, dim, threshold)
    overlap = min(max(OVERLAP, shared_overlap(c, sample, threshold, recall)), k)
    while True:
        found = links_in_shards(classes, c, overlap, threshold, block)
        audited = spark.createDataFrame(list(truth.items()), "cid long, truth long")
        links = found.groupBy("cid").agg(F.sum("links").alias("links"))
        got = audited.join(links, "cid", "left").agg(F.avg(F.coalesce("links", F.lit(0)) / F.col("truth"))).first()[0]
        if overlap >= k or got is None or got >= recall:  # got: None without linked vectors
            return found, got
        overlap = min(k, 2 * overlap)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall for vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch.ship_code(spark)
    v = F.transform("embedding", lambda e: e.cast("double"))
    usable = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    ) & F.exists("v", lambda e: e != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v"), "dim": F.size("v")})
    good = F.col("usable")
    # Classes have numbers of their own: a vec_id may recur with another vector.
    classes = rows.filter(good).groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.first("dim").alias("dim"), F.first("v").alias("v"))
    classes = scratch.materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    dims = [(r["dim"], r["count"]) for r in classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").collect()]  # a row a dimension
    large = [x for i, x in enumerate(dims) if not i or x[1] > FEW]
    parts, recalls = [], []
    for dim, n in large:
        found, got = graph_links(classes.filter(F.col("dim") == dim), n, dim, threshold, recall, shard, block)
        parts.append(found)
        recalls += [] if got is None else [got]
    if len(dims) > len(large) or not dims:
        few = classes.filter(~F.col("dim").isin([dim for dim, _ in large])) if large else classes
        few = few.select("dim", "cid", "size", "v").groupBy("dim").applyInPandas(lambda p: few_links(p, threshold), "cid long, links long, root long")
        parts.append(scratch.materialise(few, "few-links"))
    found = parts[0]
    for other in parts[1:]:
        found = found.unionByName(other)
    links, got = found.groupBy("cid").agg(F.sum("links").alias("links")), min(recalls, default=None)
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = least_values(roots, classes.select(F.col("cid").alias("id"), F.col("least").alias("value"))).withColumnRenamed("id", "cid")
    per_class = (
        classes.select("k1", "k2", "cid", "least", "size").join(links, "cid", "left").join(named, "cid", "left")
        .select("k1", "k2", F.coalesce("top", "least").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"))
    )
    keys = rows.select("vec_id", F.when(good, F.col("k1")).alias("k1"), F.when(good, F.col("k2")).alias("k2"))
    out = keys.join(per_class, ["k1", "k2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"), F.lit(got).cast("double").alias("recall"),
    )
