"""Similarity join of texts by the Jaccard coefficient of their word n-grams: MinHash LSH forest, then exact checks.

Texts with equal sets of shingles form a class, compared once. A class's signature is cut into the labels of several
prefix trees. Matching starts at the trees' full depth; the matched prefix is shortened a step at a time until two
things hold: texts of just the least similarity share a prefix in some tree with the target probability, and so do, on
average, the classes that a sample of classes resembles according to their whole signatures (recall, measured on the
table at each depth). Classes below one trie node then meet. Within a node, leaders are picked until each class is well
like one of them by the signatures, and tied to every leader that it is a little like; so two texts of the threshold
similarity are tied to a common leader, while texts that share a node by chance are not tied, however many there are. A
node of more than a block of classes is tied together whole.

What ties connect is a neighbourhood, and within it every two classes whose sizes allow the similarity are compared
exactly, by their shingles, in tasks of bounded size. So signatures only decide who is compared at all, and no pair is
ever a row of text: a task returns a link count and a local root for each class. A neighbourhood of more than a block
of classes, or of shingles, is spread: its classes are dealt to blocks of similar sizes, and each two blocks whose sizes
allow links meet in a task of their own.

Defined cases: words are separated by ASCII white space and lower-cased in A-Z; a text of fewer words than a shingle
has one shingle, all its words; a null or empty text has none and links with nothing; rows without doc_id are returned
without links; a doc_id's repeated rows are rows like others, and so
count as links; a table without links gives every document
itself; an empty table gives no rows; other columns are not read, and carried along by keep_one(). Classes and rows have
numbers of their own, so a doc_id that recurs with another text is in the class of each of its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm import scratch, tokens
from mnemo.llm.components import components, least_values, unite

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 6, 0.995
#: Classes of a neighbourhood in one task, and texts dealt to a task of small neighbourhoods.
BLOCK, TASK = 512, 2000
#: Shingles of a block or a task, whatever the number of its classes.
SHINGLES = 2_000_000
#: Share of the signature in which a class agrees with a leader that stands for it, and with one that it is tied to.
ALIKE, TIED = 0.75, 0.25
#: Classes whose links, by signatures, measure recall; rows of trie nodes in a task.
AUDITED, NODE_ROWS = 128, 60_000
SKETCH = "row long, doc_id long, k1 long, k2 long, n long, sig binary, text string"
_rng = np.random.Generator(np.random.PCG64(20240101))
_MUL = _rng.integers(0, 1 << 32, TREES * DEPTH, np.uint64).astype(np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, TREES * DEPTH, np.uint64).astype(np.uint32)


def chance(depth: int, threshold: float, trees: int = TREES) -> float:
    """The probability that two texts of the threshold similarity share a prefix of this depth in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def prefix_depth(threshold: float, recall: float, measured: list[float] | None = None) -> int:
    """Descend from the full depth until chance and measured recall (by depth, from 1) reach the target."""
    depth = DEPTH
    while depth > 1 and (chance(depth, threshold) < recall or (measured is not None and measured[depth - 1] < recall)):
        depth -= 1
    return depth


def signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), TREES * DEPTH)


def measured_recall(classes: DataFrame, threshold: float, audited: int = AUDITED) -> list[float] | None:
    """For each depth, the mean share of what sampled classes resemble that shares a prefix of this depth with them; None
    where nothing resembles them."""
    sample = classes.select("cid", "sig").orderBy(F.xxhash64("cid"), "cid").limit(audited).collect()
    if not sample:
        return None
    ids = np.array([r["cid"] for r in sample])
    own = np.frombuffer(b"".join(r["sig"] for r in sample), np.uint32).reshape(len(ids), TREES, DEPTH)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(ids), DEPTH + 1), np.int64)
        for batch in batches:
            sig, cid = signatures(batch.column("sig")), batch.column("cid").to_numpy()
            for k in range(len(ids)):
                same = sig == own[k].reshape(-1)
                like = np.flatnonzero((same.mean(1) >= threshold) & (cid != ids[k]))
                deep = np.logical_and.accumulate(same[like].reshape(len(like), TREES, DEPTH), axis=2).any(1)
                sums[k] += [*deep.sum(0), len(like)]
        yield pa.RecordBatch.from_pydict({"k": np.arange(len(ids)), **{f"d{d}": sums[:, d] for d in range(DEPTH + 1)}})

    names = [f"d{d}" for d in range(DEPTH + 1)]
    found = classes.select("cid", "sig").mapInArrow(count, "k long, " + ", ".join(f"{x} long" for x in names))
    rows = [r for r in found.groupBy("k").agg(*(F.sum(x).alias(x) for x in names)).collect() if r[names[-1]]]
    return [float(np.mean([r[x] / r[names[-1]] for r in rows])) for x in names[:-1]] if rows else None


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin."""
    w = tokens.words(data, offs)
    grams, first = tokens.ngrams(w.hash, w.first, n)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((grams, text)) if len(first) > 2 else np.argsort(grams)
    grams, text = grams[order], text[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[keep], text[keep]
    return grams, np.searchsorted(text, np.arange(len(first)))


def sketch(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A number for each row, doc_id, a 128-bit key of the set of shingles, its size and its signature, text."""
    from pyspark import TaskContext

    made = TaskContext.get().partitionId() << 33
    for batch in batches:
        data, offs = tokens.text_arrays(batch.column("text"))
        for i, j in tokens.slices(offs, 1 << 19):
            grams, first = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)
            size = np.diff(first)
            some = np.flatnonzero(size)
            at = first[some]
            k1, k2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
            sig = np.zeros((j - i, TREES * DEPTH), np.uint32)
            if len(some):
                k1[some] = np.add.reduceat(grams, at)
                k2[some] = np.add.reduceat(tokens.mix(grams ^ np.uint64(0xA0761D6478BD642F)), at)
                low = (grams >> np.uint64(32)).astype(np.uint32)
                for k in range(TREES * DEPTH):
                    sig[some, k] = np.minimum.reduceat((low ^ _XOR[k]) * _MUL[k], at)
            width = TREES * DEPTH * 4
            offsets = pa.py_buffer((np.arange(j - i + 1) * width).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(made + np.arange(j - i)), batch.column("doc_id").slice(i, j - i), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(size),
                 pa.Array.from_buffers(pa.binary(), j - i, [None, offsets, pa.py_buffer(sig.tobytes())]), batch.column("text").slice(i, j - i)],
                ["row", "doc_id", "k1", "k2", "n", "sig", "text"],
            )
            made += j - i
        del batch, data, offs
        tokens.release()


def compare(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the sets left and right have a Jaccard coefficient of threshold or more: a boolean matrix."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, owner = column[shared], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    column = np.cumsum(np.diff(column, prepend=column[:1]) != 0) if len(column) else column
    inter = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    total = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, width):
        i, j = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), min(width, total - at)), np.float32)
        m[owner[i:j], column[i:j] - at] = 1
        inter += m[left] @ m[right].T
    size = np.array([len(s) for s in sets], np.float64)
    union = size[left][:, None] + size[right][None, :] - inter
    return inter >= threshold * union - 1e-9


def link_groups(ids: np.ndarray, weight: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float):
    """Links of left with right (indices; equal, or without common elements): id, links, local root of those with any."""
    linked = compare(sets, left, right, threshold)
    same = len(left) == len(right) and bool((left == right).all())
    if same:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return []
    links = np.zeros(len(ids), np.int64)
    links[left] += linked @ weight[right]
    if not same:
        links[right] += linked.T @ weight[left]
    root = ids.copy()
    far = np.iinfo(np.int64).max
    while True:
        before = root.copy()
        root[left] = np.minimum(root[left], np.where(linked, root[right][None, :], far).min(1, initial=far))
        root[right] = np.minimum(root[right], np.where(linked, root[left][:, None], far).min(0, initial=far))
        if (before == root).all():
            break
    some = np.flatnonzero(links)
    return [(ids[some], links[some], root[some])]


def verify(pdf: pd.DataFrame, n: int, threshold: float) -> pd.DataFrame:
    """One task: small neighbourhoods (side 0), or two blocks of a large one (sides 1 and 2; 1 alone: with itself)."""
    pdf = pdf.sort_values(["area", "cid"], ignore_index=True)
    data, offs = tokens.text_arrays(pa.array(pdf["text"], pa.string()))
    grams, first = shingle_sets(data, offs, n)
    sets = [grams[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
    ids, weight, side = pdf["cid"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64), pdf["side"].to_numpy()
    out = []
    cuts = np.append(np.flatnonzero(np.diff(pdf["area"].to_numpy(np.int64), prepend=np.iinfo(np.int64).min)), len(pdf))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        at = np.arange(j - i)
        left, right = at[side[i:j] != 2], at[side[i:j] != 1]
        if not len(right):
            right = left
        out += link_groups(ids[i:j], weight[i:j], sets[i:j], left, right, threshold)
    parts = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
    return pd.DataFrame({"cid": parts[0], "links": parts[1], "root": parts[2]})


def tie(pdf: pd.DataFrame) -> pd.DataFrame:
    """Some trie nodes: each class and the least one that ties connect it with here. All nodes pick a leader at a time."""
    pdf = pdf.sort_values(["node", "cid"], ignore_index=True)
    sig = signatures(pa.array(pdf["sig"], pa.binary()))
    ids, cid = np.unique(pdf["cid"].to_numpy(np.int64), return_inverse=True)
    run = np.cumsum(np.diff(pdf["node"].to_numpy(np.int64), prepend=pdf["node"].iloc[0]) != 0)
    leader, stands, root = np.empty(run[-1] + 1, np.int64), np.zeros(len(cid), bool), np.arange(len(ids))
    while not stands.all():
        left = np.flatnonzero(~stands)
        leader[:] = -1
        nodes, at = np.unique(run[left], return_index=True)
        leader[nodes] = left[at]
        rows = np.flatnonzero(leader[run] >= 0)
        lead = leader[run[rows]]
        like = np.concatenate([(sig[rows[i : i + 8192]] == sig[lead[i : i + 8192]]).mean(1) for i in range(0, len(rows), 8192)])
        stands[rows[like >= ALIKE]] = True
        tied = (like >= TIED) & (rows != lead)
        root = unite(len(ids), np.concatenate([np.arange(len(ids)), cid[rows[tied]]]), np.concatenate([root, cid[lead[tied]]]))
    some = np.flatnonzero(root != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[some], "b": ids[root[some]]})


def neighbourhoods(classes: DataFrame, depth: int, block: int) -> DataFrame:
    """cid and area: classes tied to each other, directly or through others. Lone classes are left out."""
    trees = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.xxhash64(t, F.col("sig").substr(t * DEPTH * 4 + 1, F.lit(4 * depth))),
    )
    at = classes.select("cid", F.explode(trees).alias("node"))
    nodes = at.groupBy("node").agg(F.min("cid").alias("hub"), F.max("cid").alias("last"), F.count("*").alias("here"))
    nodes = scratch.materialise(nodes.filter("hub <> last").select("node", "hub", "here"), "nodes")
    rows = at.join(nodes, "node")
    whole = rows.filter((F.col("here") > block) & (F.col("cid") != F.col("hub"))).select(F.col("cid").alias("a"), F.col("hub").alias("b"))
    tasks = max(1, -(-(nodes.filter(F.col("here") <= block).agg(F.sum("here")).first()[0] or 0) // NODE_ROWS))
    small = rows.filter(F.col("here") <= block).select("cid", "node", F.pmod(F.xxhash64("node"), F.lit(tasks)).alias("task"))
    tied = small.join(classes.select("cid", "sig"), "cid").groupBy("task").applyInPandas(tie, "a long, b long")
    return components(tied.union(whole)).select(F.col("id").alias("cid"), F.col("component").alias("area"))


def deal(members: DataFrame, block: int, task: int, threshold: float) -> DataFrame:
    """Rows of members(cid, area, n, ...), each once for every task that compares it: with task, side."""
    m = members.withColumn("band", F.floor(F.log("n") / F.lit(-np.log(threshold))).cast("int"))
    count = m.groupBy("area").agg(F.count("*").alias("here"), F.sum("n").alias("held"))
    every, held = m.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(1, -(-every // task), -(-held // SHINGLES))
    m = m.join(count, "area")
    alone = (F.col("here") <= block) & (F.col("held") <= SHINGLES)
    small = m.filter(alone).select(
        *members.columns, F.concat_ws("/", F.lit("s"), F.pmod(F.xxhash64("area"), F.lit(tasks))).alias("task"), F.lit(0).alias("side")
    )
    large = m.filter(~alone)
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("n") / SHINGLES)).cast("int")
    sizes = large.groupBy("area", "band").agg(blocks.alias("blocks"))
    large = large.join(sizes, ["area", "band"]).withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # Sets of sizes in bands two apart are too unlike to link.
    above = sizes.select("area", (F.col("band") - 1).alias("band"), F.col("blocks").alias("up"))
    below = sizes.select("area", (F.col("band") + 1).alias("band"), F.col("blocks").alias("down"))
    large = large.join(above, ["area", "band"], "left").join(below, ["area", "band"], "left").na.fill(0, ["up", "down"])
    name = lambda b1, i, b2, j: F.concat_ws("/", F.lit("l"), "area", b1, i, b2, j)
    to = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<struct<task:string,side:int>>"))
    spot = lambda t, s: F.struct(t.alias("task"), F.lit(s).alias("side") if isinstance(s, int) else s.alias("side"))
    b, i = F.col("band"), F.col("mine")
    own = to(F.col("blocks"), lambda k: spot(name(b, F.least(i, k), b, F.greatest(i, k)), F.when(i <= k, 1).otherwise(2)))
    up = to(F.col("up"), lambda k: spot(name(b, i, b + 1, k), 1))
    down = to(F.col("down"), lambda k: spot(name(b - 1, k, b, i), 2))
    dealt = large.withColumn("spot", F.explode(F.concat(own, up, down)))
    return small.unionByName(dealt.select(*members.columns, "spot.task", "spot.side"))


def grouped(docs: DataFrame, n: int, threshold: float, recall: float, block: int, task: int) -> DataFrame:
    """row, doc_id, text, top (doc_id and row that are the least of the row's component) and n_links of each row of docs;
    rows without doc_id or without words have no top. The row's numbers and text are those of a written table."""
    scratch.ship_code(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = scratch.materialise(texts.mapInArrow(lambda b: sketch(b, n), SKETCH), "sketches")
    key = ["k1", "k2", "n"]
    real = sketches.filter("n > 0 and doc_id is not null")
    classes = real.groupBy(*key).agg(F.min(F.struct("doc_id", "row")).alias("least"), F.count("*").alias("size"), F.first("sig").alias("sig"))
    classes = scratch.materialise(classes.withColumn("cid", F.col("least.row")), "classes")
    areas = neighbourhoods(classes, prefix_depth(threshold, recall, measured_recall(classes, threshold)), block)
    members = scratch.materialise(areas.join(classes.select("cid", "size", "n"), "cid"), "members")
    dealt = deal(members, block, task, threshold)
    work = dealt.join(sketches.select(F.col("row").alias("cid"), "text"), "cid")
    found = work.groupBy("task").applyInPandas(lambda pdf: verify(pdf, n, threshold), "cid long, links long, root long")
    found = scratch.materialise(found, "found")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    tops = least_values(roots, classes.select(F.col("cid").alias("id"), F.col("least").alias("value"))).withColumnRenamed("id", "cid")
    per_class = (
        classes.select(*key, "cid", "least", "size").join(links, "cid", "left").join(tops, "cid", "left")
        .select(*key, F.coalesce("top", "least").alias("top"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    )
    return sketches.drop("sig").join(per_class, key, "left")


def join(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, task: int = TASK) -> DataFrame:
    """doc_id, class_id (smallest doc_id that links or equal sets reach) and n_links (other rows linked directly)."""
    return grouped(docs, n, threshold, recall, block, task).select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("top.doc_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, task: int = TASK) -> DataFrame:
    """The rows of docs, all columns, less those of a class but the one of the smallest doc_id.

    What goes, a small part of a corpus, is taken away by an anti-join; texts are only shuffled if that part is too
    large to broadcast. Rows without doc_id, without words or without links stay, but a doc_id's rows of equal texts are
    one row. Rows travel as one struct, so that no name of theirs can clash.
    """
    found = grouped(docs, n, threshold, recall, block, task).filter("doc_id is not null")
    stays = F.col("top").isNull() | (F.col("top.row") == F.col("row"))
    found = scratch.materialise(found.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), stays.alias("stays")), "join")
    per_id = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("stays").alias("any"))
    per_id = per_id.filter("n > 1 or not any").select(F.col("doc_id").alias("id"), "n", "any")
    per_id = scratch.materialise(per_id, "per-id")
    id_, h = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.struct("*").alias("doc"), id_.alias("id"), h.alias("h"))
    kept = rows.join(scratch.materialise(per_id.filter("not any").select("id"), "gone"), "id", "left_anti")
    # A doc_id that recurs, seldom if ever there, is told apart by its texts.
    again = scratch.materialise(per_id.filter("any and n > 1").select("id"), "again")
    if again.limit(1).count():
        texts = found.filter("stays").select(F.col("doc_id").alias("id"), "h").distinct().join(again, "id")
        same = kept.join(again, "id", "left_semi").join(texts, ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
        kept = kept.join(again, "id", "left_anti").unionByName(same)
    return kept.select("doc.*")
