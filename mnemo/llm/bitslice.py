"""Exact top-k inner products over a bit-sliced index.

Vectors become integers, floor(scale * x). A block of rows stores each dimension as bit slices: bitmaps over the rows,
one for each binary digit of the value above the block's least value in that dimension. A query adds, with bitmap
arithmetic, the slices that its own digits call for (a negative digit takes a slice's complement), by carry-save adders
on whole bitmaps; what results are the slices of every row's score. The best k rows are selected from the most
significant slice downward; rows that tie at the boundary are resolved by the smaller vec_id, which is their order in
the block. Each block of queries meets each block of rows in a task of its own and returns k rows a query, of which a
window keeps the best.

Defined cases: a vector that is null or empty, or holds null or non-finite components, and a row without vec_id take no
part; rows of another dimension than the query are no candidates; fewer than k candidates are all returned; repeated
rows are candidates each, and only the query's very row is left out; a repeated query vec_id is asked once for each
row, and the answers stand side by side; an empty table gives no rows; other columns are not read. Scores must fit a
long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemo.llm import scratch

INDEX_SCHEMA = (
    "kind int, block long, dim int, n int, ids binary, low binary, digits binary, slices binary, vals binary, pos binary"
)
BLOCK_ROWS = 1 << 16
BLOCK_QUERIES = 512


def quantised(vectors: DataFrame, scale: int, query: Column) -> DataFrame:
    """vec_id, q (array of long) and is_query of the vectors that take part."""
    v = F.col("embedding")
    doubles = F.transform(v, lambda x: x.cast("double"))
    usable = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(
        doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(doubles, lambda x: F.floor(x * scale).cast("long")).alias("q"),
        F.coalesce(query, F.lit(False)).alias("is_query"),
    )


def slice_block(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least value and number of digits of each column of values, and the bitmaps (digits.sum(), words)."""
    n, dim = values.shape
    low = values.min(0)
    above = (values - low).astype(np.uint64)
    digits = np.array([int(x).bit_length() for x in above.max(0)], np.int64)
    words = -(-n // 64)
    out = np.zeros((int(digits.sum()), words * 8), np.uint8)
    row = 0
    for j in range(dim):
        for b in range(digits[j]):
            packed = np.packbits((above[:, j] >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little")
            out[row, : len(packed)] = packed
            row += 1
    return low, digits, out.view(np.uint64)


def build(batches: Iterator[pa.RecordBatch], block_rows: int, block_queries: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    held: dict[int, list] = {}
    made = 0

    def flush(dim: int):
        nonlocal made
        ids = np.concatenate([x[0] for x in held[dim]])
        vals = np.concatenate([x[1] for x in held[dim]])
        asks = np.concatenate([x[2] for x in held[dim]])
        held[dim] = []
        order = np.lexsort([*vals.T[::-1], ids])
        ids, vals, asks = ids[order], vals[order], asks[order]
        block = (TaskContext.get().partitionId() << 24) + made
        made += 1
        low, digits, slices = slice_block(vals)
        rows = [(0, block, dim, len(ids), ids.tobytes(), low.tobytes(), digits.tobytes(), slices.tobytes(), None, None)]
        at = np.flatnonzero(asks)
        for i in range(0, len(at), block_queries):
            part = at[i : i + block_queries]
            rows.append((1, (block << 16) + i // block_queries, dim, len(part), ids[part].tobytes(), None, None, None,
                         vals[part].tobytes(), part.astype(np.int64).tobytes()))
        return pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=True)) for r in rows], schema=ARROW)

    for batch in batches:
        q = batch.column("q")
        sizes = np.diff(q.offsets.to_numpy())
        flat = q.flatten().to_numpy()
        first = np.cumsum(sizes) - sizes
        ids, asks = batch.column("vec_id").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            held.setdefault(int(dim), []).append((ids[rows], flat[first[rows][:, None] + np.arange(dim)], asks[rows]))
            while sum(len(x[0]) for x in held[dim]) >= block_rows:
                whole = [np.concatenate([x[k] for x in held[dim]]) for k in range(3)]
                held[dim] = [tuple(x[:block_rows] for x in whole)]
                yield flush(int(dim))
                held[dim] = [tuple(x[block_rows:] for x in whole)]
    for dim, parts in held.items():
        if sum(len(x[0]) for x in parts):
            yield flush(dim)


NAMES = ["kind", "block", "dim", "n", "ids", "low", "digits", "slices", "vals", "pos"]
ARROW = pa.schema([(x, pa.int32() if x in ("kind", "dim", "n") else pa.int64() if x == "block" else pa.binary()) for x in NAMES])


def add_slices(levels: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Sum of bitmaps; those of levels[l] count 2**l. Returns one bitmap a level."""
    out, level = {}, 0
    levels = dict(levels)
    while levels:
        maps = levels.pop(level, None)
        if maps is not None:
            carries = []
            while len(maps) > 2:
                m = len(maps) // 3
                a, b, c = maps[:m], maps[m : 2 * m], maps[2 * m : 3 * m]
                ab = a ^ b
                carries.append((a & b) | (ab & c))
                maps = np.concatenate([ab ^ c, maps[3 * m :]])
            if len(maps) == 2:
                carries.append((maps[0] & maps[1])[None])
                maps = (maps[0] ^ maps[1])[None]
            out[level] = maps[0]
            if carries:
                up = levels.get(level + 1)
                levels[level + 1] = np.concatenate([*carries, *([up] if up is not None else [])])
        level += 1
    return out


def best_rows(scores: dict[int, np.ndarray], alive: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest scores among alive ones, from the most significant slice downward; ties: first rows."""
    sure, even, have = np.zeros_like(alive), alive, 0
    if int(np.bitwise_count(alive).sum()) > k:
        for level in sorted(scores, reverse=True):
            ones = even & scores[level]
            n = have + int(np.bitwise_count(ones).sum())
            if n > k:
                even = ones
            else:
                sure, have = sure | ones, n
                even = even & ~scores[level]
                if n == k:
                    break
    rows = lambda bits: np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
    return np.concatenate([rows(sure), rows(even)[: max(0, k - have)]]) if have < k else rows(sure)


def search_block(index: dict, queries: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k rows of one block for each query of one block: query_id, vec_id, score."""
    n, dim = index["n"], index["dim"]
    ids = np.frombuffer(index["ids"], np.int64)
    low, digits = np.frombuffer(index["low"], np.int64), np.frombuffer(index["digits"], np.int64)
    words = -(-n // 64)
    slices = np.frombuffer(index["slices"], np.uint64).reshape(int(digits.sum()), words)
    first = np.cumsum(digits) - digits
    everyone = np.packbits(np.ones(n, np.uint8), bitorder="little")
    alive = np.zeros(words * 8, np.uint8)
    alive[: len(everyone)] = everyone
    alive = alive.view(np.uint64)
    asked = np.frombuffer(queries["vals"], np.int64).reshape(-1, dim)
    names, pos = np.frombuffer(queries["ids"], np.int64), np.frombuffer(queries["pos"], np.int64)
    own = queries["block"] >> 16 == index["block"]
    dims = np.repeat(np.arange(dim), digits)
    place = np.arange(len(slices)) - np.repeat(first, digits)
    full = (np.int64(1) << digits) - 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for name, at, q in zip(names, pos, asked, strict=True):
        size = np.abs(q)
        base = int((q * low).sum()) - int((size * full)[q < 0].sum())
        flip = np.where(q < 0, ~np.uint64(0), np.uint64(0))[dims]
        levels: dict[int, list] = {}
        for p in range(int(size.max()).bit_length()):
            use = np.flatnonzero(((size >> p) & 1)[dims])
            for lv in np.unique(place[use]):
                levels.setdefault(p + int(lv), []).append(use[place[use] == lv])
        maps = {lv: slices[i := np.concatenate(x)] ^ flip[i][:, None] for lv, x in levels.items()}
        total = add_slices(maps)
        mine = alive
        if own:
            mine = alive.copy()
            mine[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
        rows = best_rows(total, mine, k)
        score = np.full(len(rows), base, np.int64)
        for lv, bits in total.items():
            score += ((bits[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << lv
        found.append((np.full(len(rows), name), ids[rows], score))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def top_k(
    vectors: DataFrame, query: Column, k: int = 20, scale: int = 64,
    block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row of vectors for which query holds."""
    spark = vectors.sparkSession
    scratch.ship_code(spark)
    usable = quantised(vectors, scale, query)
    blocks = max(1, -(-usable.count() // block_rows))
    table = scratch.materialise(
        usable.coalesce(blocks).mapInArrow(lambda b: build(b, block_rows, block_queries), INDEX_SCHEMA), "bitslices"
    )
    # Block numbers only: a row for each block_rows rows or block_queries queries.
    rows, asks = (table.filter(F.col("kind") == i).select(F.col("block").alias(x), "dim") for i, x in ((0, "row_block"), (1, "ask_block")))
    pairs = rows.join(F.broadcast(asks), "dim")
    index = table.filter("kind = 0").join(pairs, (F.col("block") == F.col("row_block")) & (table["dim"] == pairs["dim"])).drop(pairs["dim"])
    queries = table.filter("kind = 1").join(pairs, (F.col("block") == F.col("ask_block")) & (table["dim"] == pairs["dim"])).drop(pairs["dim"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        both = {int(r["kind"]): r for r in pdf.to_dict("records")}
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), search_block(both[0], both[1], k), strict=True)))

    found = index.unionByName(queries).groupBy("row_block", "ask_block").applyInPandas(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
