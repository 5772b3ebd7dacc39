"""A language model of n words with Katz backoff, trained, stored and evaluated in bulk.

Good-Turing discounts (counts up to 5) at every order. A word not seen after its context gets the context's left-over
mass times its share of the next lower order, by a weight that makes every context's probabilities sum to exactly one over
the vocabulary and one class of unknown words, which itself holds the unseen mass of the single words. Each text is
framed by its end token: the first word's context is an end, and no context reaches further back. A token's probability
is found order by order: of the words alone, then after one word, and so on; each order keeps the one below where it
has not seen the word after the context.

Texts are cut into chunks of whole texts. A chunk asks for what it needs once for each distinct word and n-gram:
requests go to buckets by context, a bucket counts what all chunks report and answers each in its own order. Training
counts and questions travel in the same rows, so that an n-gram costs a few bytes in each chunk in which it occurs,
however frequent it is. A context with more tokens than a bucket's share is spread over all buckets by its next words;
there are at most as many such contexts as buckets and order, and only their sums come together. An n-gram is known by
its bucket and its number there, and so can be a context of the next order.

The model is a folder of tables, a row for each bucket, partitioned by ranges of PART buckets: words, and for each order
n from 2 grams-n (contexts, next words and counts, and what each chunk asked) and weights-n (contexts, denominators and
backoff weights, but for spread contexts). See ``stored`` for reading it as plain rows.

Defined cases: a null or empty text is one end token; a null doc_id counts as the empty text for the split; repeated
rows count and are scored each; a table without training rows scores every token as unknown; an empty table gives no
rows; other columns are not read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm import scratch, tokens

END = np.uint64(0x2545F4914F6CDD1D)
DISCOUNTED = 5
CHUNK_BYTES = 10 << 20
BUCKET_BYTES = 6 << 20
RANK_BITS = 26
PART = 64
#: Kinds of messages: a chunk's texts; questions; answers of order 1, 2 and so on are ANSWERS + order.
TEXTS, QUESTIONS, ANSWERS = range(3)
CHUNKS = "chunk long, kind int, bucket int, blob binary"
STATS = ["total", "types", *(f"n{r}" for r in range(1, DISCOUNTED + 2))]
_STATS = ", ".join(f"{x} long" for x in STATS)
WORD_ROWS = f"{CHUNKS}, keys binary, {_STATS}"
SUMS = f"spread array<struct<context: long, total: long, low: double, {', '.join(f'n{r}: long' for r in range(1, DISCOUNTED + 1))}>>"
GRAM_ROWS = f"bucket int, contexts binary, grams binary, asked binary, chunks array<long>, {_STATS}, {SUMS}"
WEIGHT_ROWS = "bucket int, weights binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: each transposed so that equal-ranked bytes lie together, all compressed as one."""
    import zstandard

    parts = [np.array([len(arrays)], "<i8").tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [a.dtype.str.encode().ljust(4), np.array([len(a)], "<i8").tobytes()]
        parts.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 8
    for _ in range(int(np.frombuffer(raw, "<i8", 1)[0])):
        kind, n = np.dtype(raw[at : at + 4].decode().strip()), int(np.frombuffer(raw, "<i8", 1, at + 4)[0])
        at += 12
        flat = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(flat.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Nonnegative integers in the least type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of hashes, ascending with them."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """value, begin and end of each run."""
    at = np.flatnonzero(np.diff(sorted_values, prepend=-1))
    yield from zip(sorted_values[at].tolist(), at.tolist(), [*at[1:].tolist(), len(sorted_values)], strict=True)


def cut(batches: Iterator[pa.RecordBatch], buckets: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Chunks of texts as local word numbers, and for each bucket the chunk's words with their training counts."""
    from pyspark import TaskContext

    made, size, held = 0, 0, []

    def chunk():
        number = (TaskContext.get().partitionId() << 24) + made
        stream, lens, ids, known_id, held_out = (np.concatenate([x[k] for x in held]) for k in range(5))
        keys, local = np.unique(stream, return_inverse=True)
        train = np.repeat(~held_out, lens)
        counts = np.bincount(local[train], minlength=len(keys))
        rows = [(number, TEXTS, -1, pack(narrow(local), narrow(lens), ids, known_id, held_out))]
        for b, i, j in runs(bucket_of(keys, buckets)):
            rows.append((number, QUESTIONS, b, pack(np.diff(keys[i:j], prepend=np.uint64(0)), narrow(counts[i:j]))))
        n = ["chunk", "kind", "bucket", "blob"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], n)

    for batch in batches:
        data, offs = tokens.text_arrays(batch.column("text"))
        ids = batch.column("doc_id")
        known = ~ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        out = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for i, j in tokens.slices(offs):
            w = tokens.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            held.append((np.insert(w.hash, w.first[1:], END), np.diff(w.first) + 1, ids[i:j], known[i:j], out[i:j]))
            size += int(offs[j] - offs[i])
            if size >= chunk_bytes:
                yield chunk()
                made, size, held = made + 1, 0, []
    if held:
        yield chunk()


def count_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: number its words, count them over all chunks, and answer each chunk in its order. The bucket's own
    row has chunk null: its words' hashes (keys) and counts (blob)."""
    parts = [unpack(x) for x in pdf["blob"]]
    keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    uniq, inverse = np.unique(keys, return_inverse=True)
    if len(uniq) >= 1 << RANK_BITS:
        raise ValueError("too many words in a bucket: use smaller buckets")
    counts = np.bincount(inverse, np.concatenate([p[1] for p in parts]).astype(float), len(uniq)).astype(np.int64)
    at = np.cumsum([0, *(len(p[0]) for p in parts)])
    blobs = [pack(narrow(inverse[i:j]), narrow(counts[inverse[i:j]])) for i, j in zip(at[:-1], at[1:], strict=True)]
    out = pd.DataFrame({"chunk": [*pdf["chunk"], None], "kind": ANSWERS + 1, "bucket": pdf["bucket"].iloc[0], "blob": [*blobs, pack(narrow(counts))]})
    out["chunk"] = out["chunk"].astype("Int64")
    out["keys"] = [*([None] * len(blobs)), pack(steps(uniq))]
    for name, n in statistics(counts).items():
        out[name] = pd.array([*([None] * len(blobs)), n], "Int64")
    return out


def statistics(counts: np.ndarray) -> dict[str, int]:
    some = np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
    return dict(zip(STATS, [int(counts.sum()), int((counts > 0).sum()), *some[1 : DISCOUNTED + 2].tolist()], strict=True))


def steps(ids: np.ndarray) -> np.ndarray:
    """Differences of ids, modulo 2^64; np.cumsum undoes it."""
    return np.diff(ids.astype(np.uint64), prepend=np.uint64(0))


def from_steps(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a.astype(np.uint64), dtype=np.uint64)


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing's factors for counts 0..5 and, last, above, from the numbers of types counted 1..6 times.

    A factor that the numbers don't allow (not between 0 and 1) is 1: no discount.
    """
    out = np.ones(DISCOUNTED + 2)
    out[0] = 0
    if n[0]:
        rest = (DISCOUNTED + 1) * n[DISCOUNTED] / n[0]
        for r in range(1, DISCOUNTED + 1):
            if n[r - 1] and rest < 1:
                d = ((r + 1) * n[r] / n[r - 1] / r - rest) / (1 - rest)
                if 0 < d < 1:
                    out[r] = d
    return out


class LowerOrder:
    """Probabilities of single words by their counts; those of all words and of one unknown word sum to one."""

    def __init__(self, total: int, types: int, n: list[int]):
        self.total, self.types, self.factor = total, types, discounts(n)
        cut_off = sum((1 - self.factor[r]) * r * n[r - 1] for r in range(1, DISCOUNTED + 1))
        self.size = total if cut_off > 0 else total + 1  # else nothing would be left for unknown words
        self.unknown = (self.size - total + cut_off) / self.size

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        p = self.factor[np.minimum(counts, DISCOUNTED + 1)] * counts / self.size
        return np.where(counts > 0, p, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.types + 1)))


class Chunk:
    """A chunk's texts with the n-grams of the highest order answered: for each token its n-gram (at), and for each
    distinct n-gram its id, training count and probability."""

    def __init__(self, pdf: pd.DataFrame, buckets: int, lower: LowerOrder, factors: list[np.ndarray]):
        self.buckets, self.lower = buckets, lower
        local, lens, self.ids, self.known_id, self.held_out = unpack(pdf["blob"][pdf["kind"] == TEXTS].iloc[0])
        self.lens = lens.astype(np.int64)
        self.train = np.repeat(~self.held_out, self.lens)
        self.place = np.arange(len(local)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        self.local = self.at = local.astype(np.int64)
        home, parts = self.answers(pdf, 1)
        self.word = self.id = (np.repeat(home, [len(p[0]) for p in parts]) << RANK_BITS) | np.concatenate([p[0] for p in parts]).astype(np.int64)
        self.word_count = self.count = np.concatenate([p[1] for p in parts]).astype(np.int64)
        self.probability = lower(self.count)
        self.token_probability = self.probability[self.local]
        self.order = 1
        for factor in factors:
            self.look()
            self.learn(self.answers(pdf, self.order + 1)[1], factor)

    @staticmethod
    def answers(pdf: pd.DataFrame, order: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
        some = pdf[pdf["kind"] == ANSWERS + order].sort_values("bucket")
        return some["bucket"].to_numpy(np.int64), [unpack(x) for x in some["blob"]]

    def look(self) -> None:
        """The distinct n-grams of the next order, as contexts (n-grams of this order) and next words, by buckets."""
        self.deep = np.flatnonzero(self.place >= self.order - 1)
        before = self.at[self.deep - 1]
        if self.order == 1:  # the end token; it is the last of the first text
            before[0] = self.local[self.lens[0] - 1]
        words = len(self.word)
        grams, self.first, self.new_at = np.unique(before * words + self.local[self.deep], return_index=True, return_inverse=True)
        self.context, self.next = grams // words, grams % words
        self.spread = self.count > self.lower.total // self.buckets
        bucket = self.id[self.context] >> RANK_BITS
        hot = self.spread[self.context]
        bucket[hot] = (tokens.mix(self.word[self.next[hot]].astype(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)
        self.by_bucket = np.argsort(bucket, kind="stable")
        self.ranges = list(runs(bucket[self.by_bucket]))

    def ask(self) -> list[tuple[int, bytes]]:
        """For each bucket: contexts, whether they are spread, and their numbers of next words; words; what gives the lower
        order's probability (counts of the words, or a probability for each n-gram); next words and training counts."""
        counts = np.bincount(self.new_at[self.train[self.deep]], minlength=len(self.context))
        out = []
        for b, i, j in self.ranges:
            some = self.by_bucket[i:j]
            heads, sizes = np.unique(self.context[some], return_counts=True)
            words, index = np.unique(self.next[some], return_inverse=True)
            low = narrow(self.word_count[words]) if self.order == 1 else self.token_probability[self.deep[self.first[some]]]
            out.append((b, pack(steps(self.id[heads]), self.spread[heads], narrow(sizes), steps(self.word[words]), low, narrow(index), narrow(counts[some]))))
        return out

    def learn(self, parts: list[list[np.ndarray]], factor: np.ndarray) -> None:
        """Go up an order by the buckets' answers: ranks and counts of n-grams, denominators and weights of contexts."""
        n = len(self.context)
        ids, counts, size, weight = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n), np.empty(n)
        for (b, i, j), (ranks, found, sizes, weights) in zip(self.ranges, parts, strict=True):
            some = self.by_bucket[i:j]
            _, head = np.unique(self.context[some], return_inverse=True)
            ids[some], counts[some] = (b << RANK_BITS) | from_steps(ranks).astype(np.int64), found
            size[some], weight[some] = sizes[head], weights[head]
        low = self.token_probability[self.deep[self.first]]
        seen = factor[np.minimum(counts, DISCOUNTED + 1)] * counts / np.maximum(size, 1)
        self.id, self.count, self.probability = ids, counts, np.where(counts > 0, seen, weight * low)
        self.at = np.full(len(self.local), -1)
        self.at[self.deep] = self.new_at
        self.token_probability[self.deep] = self.probability[self.new_at]
        self.order += 1


def ask(pdf: pd.DataFrame, buckets: int, lower: LowerOrder, factors: list[np.ndarray]) -> pd.DataFrame:
    c = Chunk(pdf, buckets, lower, factors)
    c.look()
    rows = [(int(pdf["chunk"].iloc[0]), QUESTIONS, b, blob) for b, blob in c.ask()]
    return pd.DataFrame(rows, columns=["chunk", "kind", "bucket", "blob"])


def asking(buckets: int, lower: LowerOrder, factors: list[np.ndarray]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: ask(pdf, buckets, lower, factors)


def count_grams(pdf: pd.DataFrame, lower: LowerOrder) -> pd.DataFrame:
    """One bucket's row: its n-grams and their counts over all chunks, sums of its contexts, and each chunk's questions."""
    parts = [unpack(x) for x in pdf["blob"]]
    contexts, context_at = np.unique(np.concatenate([from_steps(p[0]) for p in parts]), return_inverse=True)
    words, word_at = np.unique(np.concatenate([from_steps(p[3]) for p in parts]), return_inverse=True)
    c_at, w_at, g_at = (np.cumsum([0, *(len(p[k]) for p in parts)]) for k in (0, 3, 5))
    own = np.concatenate([np.repeat(context_at[i:j], p[2]) for p, i, j in zip(parts, c_at[:-1], c_at[1:], strict=True)])
    word = np.concatenate([word_at[i:j][p[5]] for p, i, j in zip(parts, w_at[:-1], w_at[1:], strict=True)])
    low = np.concatenate([lower(p[4].astype(np.int64))[p[5]] if p[4].dtype.kind == "u" else p[4] for p in parts])
    uniq, first, inverse = np.unique((own << 32) | word, return_index=True, return_inverse=True)
    if len(uniq) >= 1 << RANK_BITS:
        raise ValueError("too many n-grams in a bucket: use smaller buckets")
    counts = np.bincount(inverse, np.concatenate([p[6] for p in parts]).astype(float), len(uniq)).astype(np.int64)
    own, low, n = own[first], low[first], len(contexts)
    seen = counts > 0
    sums = [np.bincount(own, counts, n).astype(np.int64), np.bincount(own[seen], low[seen], n)]
    sums += [np.bincount(own[counts == r], minlength=n) for r in range(1, DISCOUNTED + 1)]
    hot = np.zeros(n, bool)
    hot[context_at[np.concatenate([p[1] for p in parts]).astype(bool)]] = True
    asked = [
        x
        for i, j, k, m in zip(c_at[:-1], c_at[1:], g_at[:-1], g_at[1:], strict=True)
        for x in (narrow(context_at[i:j]), steps(inverse[k:m]))
    ]
    names = ["context", "total", "low", *(f"n{r}" for r in range(1, DISCOUNTED + 1))]
    spread = [dict(zip(names, x, strict=True)) for x in zip(*(a[hot].tolist() for a in (contexts.astype(np.int64), *sums)), strict=True)]
    row = {
        "bucket": int(pdf["bucket"].iloc[0]), "contexts": pack(steps(contexts), hot, narrow(sums[0]), sums[1], *map(narrow, sums[2:])),
        "grams": pack(narrow(np.bincount(own, minlength=n)), steps(words), narrow(uniq & 0xFFFFFFFF), narrow(counts)),
        "asked": pack(*asked), "chunks": pdf["chunk"].tolist(), **statistics(counts), "spread": spread,
    }
    return pd.DataFrame([row])


def backoff(total: np.ndarray, low: np.ndarray, singles: list[np.ndarray], factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominator and backoff weight of contexts, from their counts, lower-order mass seen, and types counted 1..5 times."""
    cut_off = sum((1 - factor[r]) * r * s for r, s in enumerate(singles, 1))
    size = np.where(cut_off > 0, total, total + 1)  # else nothing would be left to back off with
    left = np.where(cut_off > 0, cut_off, 1.0)
    return size, np.where(total > 0, left / size / np.maximum(1 - low, 1e-300), 1.0)


def weigh(contexts: bytes, factor: np.ndarray, spread: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's contexts, which are spread, and all their denominators and weights, by the sums over all buckets."""
    steps_of, hot, *sums = unpack(contexts)
    ids, sums = from_steps(steps_of).astype(np.int64), [x.astype(float) for x in sums]
    for k in np.flatnonzero(hot):
        for s, x in zip(sums, spread[int(ids[k])], strict=True):
            s[k] = x
    return ids, hot.astype(bool), *backoff(sums[0], sums[1], sums[2:], factor)


def weights(batches: Iterator[pa.RecordBatch], factor: np.ndarray, spread: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket: contexts that are its own, denominators and backoff weights."""
    for batch in batches:
        blobs = []
        for x in batch.column("contexts"):
            ids, hot, size, weight = weigh(x.as_py(), factor, spread)
            blobs.append(pack(steps(ids[~hot]), size[~hot], weight[~hot]))
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(blobs, pa.binary())], ["bucket", "weights"])


def answer(batches: Iterator[pa.RecordBatch], order: int, factor: np.ndarray, spread: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    """Each chunk's answers, in its order: ranks and counts of its n-grams, denominators and weights of its contexts."""
    for batch in batches:
        for i in range(batch.num_rows):
            bucket, contexts, grams, asked, chunks = (batch.column(x)[i].as_py() for x in ("bucket", "contexts", "grams", "asked", "chunks"))
            _, _, size, weight = weigh(contexts, factor, spread)
            counts, questions = unpack(grams)[3], unpack(asked)
            blobs = []
            for heads, ranks in zip(questions[::2], questions[1::2], strict=True):
                blobs.append(pack(ranks, counts[from_steps(ranks).astype(np.int64)], size[heads], weight[heads]))
            n = len(chunks)
            columns = [pa.array(chunks, pa.int64()), pa.array([ANSWERS + order] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "kind", "bucket", "blob"])


def score_chunk(pdf: pd.DataFrame, buckets: int, lower: LowerOrder, factors: list[np.ndarray]) -> pd.DataFrame:
    c = Chunk(pdf, buckets, lower, factors)
    first = np.cumsum(c.lens) - c.lens
    return pd.DataFrame({
        "doc_id": pd.Series(c.ids, dtype="Int64").mask(~c.known_id),
        "held_out": c.held_out, "n_tokens": c.lens,
        "n_known": np.add.reduceat((c.word_count > 0)[c.local].astype(np.int64), first), "train_tokens": lower.total,
        "base_score": np.add.reduceat(lower.base(c.word_count)[c.local], first),
        "score": np.add.reduceat(np.log10(c.token_probability), first),
    })


def totals(rows: DataFrame) -> dict:
    return rows.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in STATS)).first().asDict()


def numbers(t: dict) -> list[int]:
    return [t[f"n{r}"] for r in range(1, DISCOUNTED + 2)]


def keep(df: DataFrame, path: str) -> DataFrame:
    """Write a table of the model, partitioned by ranges of buckets, and read it back."""
    df.withColumn("part", F.floor(F.col("bucket") / PART).cast("int")).write.option("compression", "zstd").partitionBy("part").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark, path: str, order: int) -> DataFrame:
    """The stored n-grams of an order as rows: context and word (ids: bucket and number there), count in training and,
    for contexts that aren't spread, the context's denominator and backoff weight."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                heads, grams, own = (unpack(batch.column(x)[i].as_py()) for x in ("contexts", "grams", "weights"))
                ids, sizes, words = from_steps(heads[0]).astype(np.int64), grams[0], from_steps(grams[1]).astype(np.int64)
                size, weight = np.full((2, len(ids)), np.nan)
                size[~heads[1].astype(bool)], weight[~heads[1].astype(bool)] = own[1], own[2]
                at = np.repeat(np.arange(len(ids)), sizes)
                out = [ids[at], words[grams[2]], grams[3].astype(np.int64), size[at], weight[at]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, out)], ["context", "word", "count", "size", "weight"])

    scratch.ship_code(spark)
    both = spark.read.parquet(f"{path}/grams-{order}").join(spark.read.parquet(f"{path}/weights-{order}"), ["part", "bucket"])
    return both.select("contexts", "grams", "weights").mapInArrow(rows, "context long, word long, count long, size double, weight double")


def score(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, chunk_bytes: int = CHUNK_BYTES, order: int = 2, store: str | None = None) -> DataFrame:
    """Scores of docs(doc_id, text) by a model of those whose crc32(doc_id) modulo 10 isn't 0; see SCORES.

    The model has contexts of up to order - 1 words and is stored in the folder ``store`` (new; by default in scratch
    space). Each order writes, sends and reads about as much as the second.
    """
    spark = docs.sparkSession
    scratch.ship_code(spark)
    store = store or scratch.scratch_path(spark, "lm-model")
    buckets = scratch.bucket_count(docs, "text", bucket_bytes, 8)
    # Tasks in proportion to the input: about one bucket or one chunk each.
    by_bucket = lambda df: df.repartition(buckets, "bucket").groupBy("bucket")
    by_chunk = lambda df: df.repartition(max(8, -(-buckets * bucket_bytes // chunk_bytes)), "chunk").groupBy("chunk")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held_out"),
    )
    chunks = scratch.materialise(rows.mapInArrow(lambda b: cut(b, buckets, chunk_bytes), CHUNKS), "lm-chunks")
    words = keep(by_bucket(chunks.filter(F.col("kind") == QUESTIONS)).applyInPandas(count_words, WORD_ROWS), f"{store}/words")
    t = totals(words)
    lower = LowerOrder(t["total"], t["types"], numbers(t))
    known = chunks.filter(F.col("kind") == TEXTS).unionByName(words.filter(F.col("chunk").isNotNull()).select(*chunks.columns))
    factors: list[np.ndarray] = []
    for n in range(2, order + 1):
        questions = by_chunk(known).applyInPandas(asking(buckets, lower, list(factors)), CHUNKS)
        grams = keep(by_bucket(questions).applyInPandas(lambda pdf: count_grams(pdf, lower), GRAM_ROWS), f"{store}/grams-{n}")
        factor = discounts(numbers(totals(grams)))
        # At most one context for each bucket is this frequent; their sums are a few numbers each.
        names = ["total", "low", *(f"n{r}" for r in range(1, DISCOUNTED + 1))]
        hot = grams.select(F.inline("spread")).groupBy("context").agg(*(F.sum(x).alias(x) for x in names)).collect()
        spread = {r["context"]: tuple(r[x] for x in names) for r in hot}
        own = grams.select("bucket", "contexts").mapInArrow(lambda b, f=factor, s=spread: weights(b, f, s), WEIGHT_ROWS)
        keep(own, f"{store}/weights-{n}")
        asked = grams.select("bucket", "contexts", "grams", "asked", "chunks")
        known = known.unionByName(asked.mapInArrow(lambda b, n=n, f=factor, s=spread: answer(b, n, f, s), CHUNKS))
        factors.append(factor)
    return by_chunk(known).applyInPandas(lambda pdf: score_chunk(pdf, buckets, lower, factors), SCORES)
