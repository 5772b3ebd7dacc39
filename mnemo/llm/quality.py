"""Quality by importance resampling: how much likelier a text is under the target's n-gram model than under the raw one.

Two families of hashed n-grams, byte trigrams and word bigrams as written (a word after itself is a bigram of its own),
are counted over all raw texts and over the target's; the log of the ratio of the two multinomials, summed over a text,
is its log importance. Adding Gumbel noise to it and keeping the k largest samples k texts without replacement in
proportion to their importance. By default k is the number of texts with a nonnegative log importance.

By default the log importance is the log ratio. A raw corpus differs from a small target in more than quality (a few
long texts in one language are enough), which shifts every n-gram of some texts; where that shall not count, allow is
a share of the target's texts, and the log importance of an n-gram is taken from the level, 0 at most, that all but
that share reach on average. Log ratio and log importance are both returned.

The k-th largest key comes from counting passes over narrow rows, each splitting the interval that holds it, until few
distinct keys are left in it: no global sort, nothing but counts on the driver.

Defined cases: a null or empty text, and one too short for any n-gram, has log importance 0; a null doc_id has noise of
its own like any other; repeated rows have equal keys; rows that tie with the k-th key are all kept; without target
rows every log importance is 0; an empty table gives no rows; other columns are carried along by resample().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.llm import scratch, tokens

BUCKETS = 1 << 16
MAX_TARGET = 20_000
PSEUDO = 2.0
SEED = 20240101
#: Bytes of text whose n-grams are made at a time.
SLICE = 1 << 19


def features(data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of byte trigrams and of word bigrams, each with the texts they are in."""
    n = len(data)
    wide = data.astype(np.uint32)
    tri = wide[:-2] * np.uint32(0x1003F * 0x1003F % (1 << 32)) + wide[1:-1] * np.uint32(0x1003F) + wide[2:] if n > 2 else wide[:0]
    tri = (tri * np.uint32(2654435761)) >> np.uint32(16)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    whole = text[:-2] == text[2:] if n > 2 else np.zeros(0, bool)
    w = tokens.words(data, offs, fold=False)
    of = np.repeat(np.arange(len(offs) - 1), np.diff(w.first))
    a, b, same = w.hash[:-1], w.hash[1:], of[:-1] == of[1:]
    bi = np.where(a == b, np.uint64(0), tokens.mix(a * np.uint64(3) + b) % np.uint64(BUCKETS - 1) + np.uint64(1))
    return [(tri[whole].astype(np.int64), text[: len(whole)][whole]), (bi[same].astype(np.int64), of[:-1][same])]


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """family, bucket, raw and target counts of a partition."""
    counts = np.zeros((2, 2, BUCKETS), np.int64)
    for batch in batches:
        data, offs = tokens.text_arrays(batch.column("text"))
        target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
        for i, j in tokens.slices(offs, SLICE):
            for k, (grams, text) in enumerate(features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])):
                counts[k, 0] += np.bincount(grams, minlength=BUCKETS)
                counts[k, 1] += np.bincount(grams[target[i:j][text]], minlength=BUCKETS)
    for k in range(2):
        some = np.flatnonzero(counts[k, 0])
        yield pa.RecordBatch.from_pydict({
            "family": pa.array(np.full(len(some), k, np.int32)), "bucket": pa.array(some.astype(np.int32)),
            "raw": pa.array(counts[k, 0, some]), "target": pa.array(counts[k, 1, some]),
        })


def with_target(docs: DataFrame, labelled: DataFrame, max_target: int = MAX_TARGET) -> DataFrame:
    """docs with a column is_target. labelled(doc_id, quality): quality 1 is the target.

    At most max_target target ids are used, the least by a hash.
    """
    ids = (
        labelled.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_target_id")).distinct()
        .orderBy(F.xxhash64("_target_id"), "_target_id").limit(max_target)
    )
    rows = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_target_id"), "left")  # max_target ids at most
    return rows.withColumn("is_target", F.col("_target_id").isNotNull()).drop("_target_id")


def fit(docs: DataFrame, labelled: DataFrame) -> np.ndarray:
    """Log ratios by family and bucket; the raw model counts every row of docs."""
    scratch.ship_code(docs.sparkSession)
    rows = with_target(docs.select("doc_id", F.col("text").cast("string").alias("text")), labelled)
    sums = (
        rows.select("text", F.col("is_target").alias("target")).mapInArrow(count_grams, "family int, bucket int, raw long, target long")
        .groupBy("family", "bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    )
    counts = np.zeros((2, 2, BUCKETS))
    for r in sums:  # two families of BUCKETS rows at most
        counts[:, r["family"], r["bucket"]] = r["raw"], r["target"]
    if not counts[1].any():
        return np.zeros((2, BUCKETS))
    # Both models are smoothed at the target's size: a rare n-gram that a small target lacks says little.
    counts[0] *= counts[1].sum(-1, keepdims=True) / np.maximum(counts[0].sum(-1, keepdims=True), 1)
    return np.log((counts[1] + PSEUDO) / (counts[0] + PSEUDO))


def log_ratios(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log ratios and number of n-grams of each text."""
    data, offs = tokens.text_arrays(texts)
    out, count = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1, np.int64)
    for i, j in tokens.slices(offs, SLICE):
        for k, (grams, text) in enumerate(features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])):
            out[i:j] += np.bincount(text, table[k][grams], j - i)
            count[i:j] += np.bincount(text, minlength=j - i)
    return out, count


def measure(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """doc_id, target, sum of log ratios and number of n-grams of each text."""
    for batch in batches:
        total, grams = log_ratios(batch.column("text"), table)
        columns = [batch.column("doc_id"), batch.column("target"), pa.array(total), pa.array(grams)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "target", "total", "grams"])
        del batch, columns
        tokens.release()


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise that depends on the id alone."""
    u = (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, bins: int = 1024, few: int = 4096) -> float:
    """The k-th largest value of keys(key double, no nulls), counting equal ones each; -inf if there are no k."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k <= 0:
        return math.inf
    if n < k:
        return -math.inf
    above = 0
    while True:
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        left = inside.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("key")).limit(few + 1).collect()
        if len(left) <= few or not low < low + (high - low) / bins < high:
            for r in left:
                above += r["n"]
                if above >= k:
                    return r["key"]
        width = (high - low) / bins
        spot = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        for r in inside.groupBy(spot.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("bin")).collect():
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]


def select(docs: DataFrame, labelled: DataFrame, k: int | None, seed: int, allow: float | None) -> tuple[DataFrame, np.ndarray, float, float]:
    """doc_id, log_ratio, log_importance and gumbel_key of each row of docs (a written table), the model, the level of an
    n-gram, and the least key that is kept."""
    table = fit(docs, labelled)
    own = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = with_target(texts, labelled).select("doc_id", "text", F.col("is_target").alias("target"))
    schema = f"doc_id {own}, target boolean, total double, grams long"
    first = scratch.materialise(rows.mapInArrow(lambda b: measure(b, table), schema), "ratios")
    mean = F.when(F.col("target") & (F.col("grams") > 0), F.col("total") / F.col("grams"))
    level = min(0.0, first.agg(F.percentile(mean, F.lit(allow))).first()[0] or 0.0) if allow is not None else 0.0
    importance = F.col("total") - F.lit(level) * F.col("grams")
    scored = first.select(
        "doc_id", F.col("total").alias("log_ratio"), importance.alias("log_importance"), (importance + gumbel(F.col("doc_id"), seed)).alias("gumbel_key")
    )
    if k is None:
        k = scored.filter("log_importance >= 0").count()
    return scored, table, level, kth_largest(scored.select(F.col("gumbel_key").alias("key")), k)


def classify(docs: DataFrame, labelled: DataFrame, k: int | None = None, seed: int = SEED, allow: float | None = None) -> DataFrame:
    """doc_id, log_ratio, log_importance, gumbel_key, kept."""
    scored, _, _, least = select(docs, labelled, k, seed, allow)
    return scored.select("*", (F.col("gumbel_key") >= least).alias("kept"))


def resample(docs: DataFrame, labelled: DataFrame, k: int | None = None, seed: int = SEED, allow: float | None = None) -> DataFrame:
    """The sampled rows of docs, all columns: a last pass over docs, no shuffle."""
    _, table, level, least = select(docs, labelled, k, seed, allow)

    def kept(texts: pa.Array, noise: np.ndarray) -> np.ndarray:
        total, grams = log_ratios(texts, table)
        return total - level * grams + noise >= least

    return scratch.keep_rows(docs, kept, gumbel(F.col("doc_id"), seed))
