"""Retrieval metrics over ranked results and judged relevance: results(probe_id, doc_id, rank), qrels(probe_id, doc_id, grade)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def judged(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Results with their grades; what isn't judged counts 0."""
    j = results.join(qrels.withColumn("judged", F.lit(True)), ["probe_id", "doc_id"], "left")
    return j.withColumns({"grade": F.coalesce("grade", F.lit(0)), "judged": F.coalesce("judged", F.lit(False))})


def gain(grade: Column, rank: Column) -> Column:
    return grade / F.log2(rank + 1)


def ndcg(results: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """nDCG of each probe, the ideal over all its judgements."""
    got = judged(results, qrels).filter(F.col("rank") <= k).groupBy("probe_id").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    w = Window.partitionBy("probe_id").orderBy(F.desc("grade"), "doc_id")
    best = qrels.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).groupBy("probe_id").agg(F.sum(gain(F.col("grade"), F.col("place"))).alias("ideal"))
    j = best.join(got, "probe_id", "left")
    return j.select("probe_id", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def per_probe(results: DataFrame, qrels: DataFrame, k: int, good: int = 2) -> DataFrame:
    """Reciprocal rank, hit, precision and judged share of each probe that has results."""
    j = judged(results, qrels).filter(F.col("rank") <= k)
    hit = F.col("grade") >= good
    return j.groupBy("probe_id").agg(
        F.coalesce(1 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr"), F.max(hit.cast("int")).alias("hit"),
        (F.count_if(hit) / k).alias("precision"), F.avg(F.col("judged").cast("int")).alias("coverage"),
    )


def report(results: DataFrame, qrels: DataFrame, probes: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """Means over probes, by a column of probes and in total (null); probes without results count 0."""
    m = probes.join(per_probe(results, qrels, k), "probe_id", "left").join(ndcg(results, qrels, k), "probe_id", "left")
    abstained = F.count_if(F.col("rr").isNull()).alias("abstained")
    mean = lambda c: F.avg(F.coalesce(c, F.lit(0.0))).alias(c)
    aggs = [F.count("*").alias("probes"), abstained, *(mean(c) for c in ("rr", "hit", "precision", "ndcg"))]
    return m.rollup(by).agg(*aggs) if by else m.agg(*aggs)


def recall(results: DataFrame, answers: DataFrame, ks: list[int]) -> DataFrame:
    """Whether any and all answers are among the first k, for each k."""
    j = answers.join(results, ["probe_id", "doc_id"], "left").groupBy("probe_id")
    inside = lambda k: F.coalesce(F.col("rank") <= k, F.lit(False))
    return j.agg(*(F.bool_or(inside(k)).alias(f"any_{k}") for k in ks), *(F.bool_and(inside(k)).alias(f"all_{k}") for k in ks))


def fill(results: DataFrame, corpus: DataFrame) -> DataFrame:
    """Results followed by what they lack of corpus(probe_id, doc_id, place), in order."""
    n = results.groupBy("probe_id").agg(F.max("rank").alias("n"))
    rest = corpus.join(results.select("probe_id", "doc_id"), ["probe_id", "doc_id"], "left_anti").join(n, "probe_id", "left")
    w = Window.partitionBy("probe_id").orderBy("place")
    return results.select("probe_id", "doc_id", "rank").unionByName(rest.select("probe_id", "doc_id", (F.row_number().over(w) + F.coalesce("n", F.lit(0))).alias("rank")))


def sign_test(wins: int, losses: int) -> float:
    """Two-sided exact binomial probability; 1 without any difference."""
    n = wins + losses
    if not n:
        return 1.0
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n)


def compare(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """Paired differences of two variants' per-probe metrics: wins, losses, ties and mean."""
    j = a.select("probe_id", F.col(metric).alias("x")).join(b.select("probe_id", F.col(metric).alias("y")), "probe_id")
    d = F.col("y") - F.col("x")
    return j.agg(F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"), F.avg(d).alias("mean_delta"))


def judge_agreement(runs: DataFrame) -> DataFrame:
    """Two runs of a judge against truth: accuracy, mean absolute error, bad misses, agreement with itself."""
    off = F.abs(F.col("first") - F.col("truth"))
    return runs.agg(
        F.avg((off == 0).cast("int")).alias("accuracy"), F.avg(off).alias("mae"), F.count_if(off >= 2).alias("bad"),
        F.avg((F.col("first") == F.col("second")).cast("int")).alias("consistency"),
    )


def phase_slope(rows: DataFrame) -> DataFrame:
    """Accuracy by phase and the slope of accuracy over phases, of rows(phase, correct)."""
    acc = rows.groupBy("phase").agg(F.avg("correct").alias("accuracy"), F.count("*").alias("n"))
    return acc.agg(F.regr_slope("accuracy", "phase").alias("slope"), F.count("*").alias("phases"), F.avg("accuracy").alias("mean_accuracy"))


def adaptive_filter(df: DataFrame, least: float, few: int, most: int) -> DataFrame:
    """Results at least so relevant, at least a few and at most so many, in time order."""
    kept = df.filter((F.col("rank") <= few) | ((F.col("rank") <= most) & (F.col("relevance") >= least)))
    w = Window.partitionBy("query_id").orderBy("created_at", "node_id")
    return kept.withColumn("place", F.row_number().over(w))


def returned_ndcg(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """nDCG of each probe by results(probe_id, doc_id, rank) and the pairs that are relevant; the ideal order is of what was
    returned in the first k, not of all that is relevant."""
    hit = F.col("relevant").cast("double")
    j = results.filter(F.col("rank") <= k).join(relevant.select("probe_id", "doc_id").distinct().withColumn("relevant", F.lit(1)), ["probe_id", "doc_id"], "left")
    got = j.groupBy("probe_id").agg(F.coalesce(F.sum(gain(hit, F.col("rank"))), F.lit(0.0)).alias("dcg"), F.count("relevant").cast("int").alias("hits"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest("hits", F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return got.select("probe_id", F.when(F.col("hits") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))
