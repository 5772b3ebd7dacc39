"""Soft-membership mixing of sources to target weights, in DataFrame operations only.

A multinomial naive Bayes model over hashed words is fitted on labelled rows (at most max_labelled of them, those least
by a hash of their id) and predicts for every document how much it belongs to each domain. Rates r >= 0, one for each
document, are then fitted so that the expected tokens of each domain, sum of r * tokens * posterior, come to the target
share of all tokens: plain least squares, one scale for all domains, for an error is a share of all tokens.

It is solved by projected gradient: a gradient of the sum of squares is a combination of the domains' columns, so what is
carried are a few numbers a step, never a rate; a step is one pass over a narrow table. The first steps are scaled ones:
the rates are r = max(0, 1 + combination), the projection of rates of 1 moved along the columns, and the combination is
moved by the Gram matrix of the rows that the projection leaves positive, slightly regularised, only if that lowers the
regularised sum. They end within ten steps or so, at the rates nearest to 1 that meet the targets. Plain steps, accelerated and
each followed by the projection, then go on from there until the targets are met or the sum of squares no longer falls.

Where no nonnegative rates meet the targets (a domain that hardly any document belongs to) the rates are the nearest in
that norm: expected tokens then have no larger root sum of squares than the targets, so a target out of reach doesn't
multiply the others. The column residual says how far off the worst domain is, as a share of all tokens.

Defined cases: a null or empty text has no tokens, the prior as its posterior and the rate 1; a null doc_id is kept;
repeated rows are fitted each; labelled rows with a null domain or text are not used; a domain without labelled rows
is as likely as one labelled row would make it and has no words of its own, so its target is mostly out of reach; negative targets are an error; an empty table gives no rows; other columns are carried along by resample() and not
read otherwise. What the driver sees is the domains' Gram matrix and residuals.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.llm import scratch

MAX_LABELLED = 20_000
BUCKETS = 4096
STEPS, WRITTEN = 200, 20
TOLERANCE, STILL = 1e-6, 1e-6
#: Scaled steps, and their regularisation as a share of the Gram matrix's trace.
SCALED, RIDGE = 40, 1e-9


def word_buckets(text: Column, buckets: int) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def fit_domains(
    docs: DataFrame, labelled: DataFrame, domains: list[str], buckets: int = BUCKETS, max_labelled: int = MAX_LABELLED
) -> DataFrame:
    """bucket, w (array: for each domain the log probability of the bucket), of those docs(doc_id, text, domain) that
    labelled(doc_id) names.

    Bucket -1 holds the log priors. buckets + 1 rows at most.
    """
    spark = docs.sparkSession
    ids = (
        labelled.filter("doc_id is not null").select(F.col("doc_id").alias("labelled_id")).distinct()
        .orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(max_labelled)
    )
    rows = docs.filter("text is not null").filter(F.col("domain").isin(domains))
    # At most max_labelled ids, whatever the input: no text is shuffled to find them.
    sample = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("labelled_id"), "left_semi").select("text", "domain")
    sample = scratch.materialise(sample, "labelled")
    counts = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    prior = {d: max(1, counts.get(d, 0)) for d in domains}
    each = sample.select("domain", F.explode(word_buckets(F.col("text"), buckets)).alias("bucket"))
    sums = each.groupBy("bucket").agg(*(F.count_if(F.col("domain") == d).cast("double").alias(f"c{i}") for i, d in enumerate(domains)))
    sums = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(sums, "bucket", "left").na.fill(0.0)
    totals = sums.agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(len(domains)))).first()
    weights = sums.select(
        "bucket",
        F.array(*(F.log((F.col(f"c{i}") + 0.5) / (totals[f"c{i}"] + 0.5 * buckets)) for i in range(len(domains)))).alias("w"),
    )
    n = sum(prior.values())
    priors = spark.createDataFrame([(-1, [math.log(prior[d] / n) for d in domains])], "bucket int, w array<double>")
    return scratch.materialise(weights.union(priors).coalesce(1), "domain-model")


def row_key() -> Column:
    """What rows of equal doc_id and text share."""
    return F.xxhash64(F.col("doc_id"), F.col("text").cast("string"))


def posteriors(docs: DataFrame, model: DataFrame, domains: list[str], buckets: int = BUCKETS) -> DataFrame:
    """row (a number for each row), key, doc_id, n_tokens, p (array of posteriors) of docs(doc_id, text).

    Naive Bayes counts every word as independent evidence and is far too sure; the mean evidence a word, times the
    root of the number of words, keeps memberships soft.
    """
    k = len(domains)
    prior = model.filter("bucket = -1").first()["w"]
    flat = model.filter("bucket >= 0").select(F.col("bucket").alias("b"), *(F.col("w")[i].alias(f"w{i}") for i in range(k)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), row_key().alias("key"), "doc_id", "text")
    words = rows.select("row", "key", "doc_id", F.explode_outer(word_buckets(F.col("text"), buckets)).alias("b"))
    # The model has at most `buckets` rows, whatever the input.
    scored = words.join(F.broadcast(flat), "b", "left").groupBy("row", "key", "doc_id").agg(
        F.count("b").alias("n_tokens"), *(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(k))
    )
    logs = [F.col(f"s{i}") / F.sqrt(F.greatest("n_tokens", F.lit(1))) + prior[i] for i in range(k)]
    top = F.greatest(*logs) if k > 1 else logs[0]
    odds = scored.select("row", "key", "doc_id", "n_tokens", *(F.exp(x - top).alias(f"e{i}") for i, x in enumerate(logs)))
    total = sum((F.col(f"e{i}") for i in range(k)), F.lit(0.0))
    return odds.select("row", "key", "doc_id", "n_tokens", F.array(*(F.col(f"e{i}") / total for i in range(k))).alias("p"))


def scaled_steps(members: DataFrame, a: list[Column], gram: np.ndarray, goal: np.ndarray, tolerance: float) -> np.ndarray:
    """The combination c for which rates max(0, 1 + a c) minimise their squared distance from 1 times a small ridge plus
    the squares of the errors: Newton's method on the dual, which has a variable for each domain. One pass a trial."""
    k, total = len(goal), goal.sum()
    ridge = RIDGE * gram.trace()

    def look(c: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        r = F.greatest(F.lit(0.0), sum((x * float(y) for x, y in zip(a, c, strict=True)), F.lit(1.0)))
        both = [F.sum(F.when(F.col("r") > 0, a[i] * a[j])) for i in range(k) for j in range(i, k)]
        row = members.withColumn("r", r).agg(F.sum(F.col("r") * F.col("r")), *(F.sum(F.col("r") * x) for x in a), *both).first()
        sums, active = np.array(row[1 : k + 1], float), np.zeros((k, k))
        active[np.triu_indices(k)] = [x or 0.0 for x in row[k + 1 :]]
        return row[0] / 2 - goal @ c + ridge / 2 * c @ c, sums - goal + ridge * c, active + np.triu(active, 1).T

    c = np.zeros(k)
    value, slope, active = look(c)
    passes = 1
    while passes < SCALED and np.abs(slope).max() > tolerance * total / 10:
        move = np.linalg.solve(active + ridge * np.eye(k), -slope)
        part = 1.0
        while passes < SCALED:
            trial = look(c + part * move)
            passes += 1
            if trial[0] <= value + 1e-4 * part * (slope @ move):
                break
            part /= 2
        else:
            break
        if value - trial[0] <= 1e-15 * abs(value):
            break
        c, (value, slope, active) = c + part * move, trial
    return c


def fit_rates(members: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """members(n_tokens, p, ...) with columns rate and residual. members must be a written table: it is read once a step."""
    k = len(targets)
    if min(targets) < 0 or not sum(targets):
        raise ValueError("targets must be nonnegative and not all zero")
    a = [F.col("n_tokens") * F.col("p")[i] for i in range(k)]
    first = members.agg(F.sum("n_tokens"), *(F.sum(a[i] * a[j]) for i in range(k) for j in range(k))).first()
    if not first[0]:
        return members.withColumn("rate", F.lit(1.0)).withColumn("residual", F.lit(0.0))
    n, gram = float(first[0]), np.array(first[1:], float).reshape(k, k)
    goal = np.array(targets, float) / sum(targets) * n

    def errors(table: DataFrame, rate: Column) -> np.ndarray:
        return np.array(table.withColumn("rate", rate).agg(*(F.sum(F.col("rate") * x) for x in a)).first(), float) - goal

    start, c = F.lit(1.0), scaled_steps(members, a, gram, goal, tolerance)
    moved = F.greatest(F.lit(0.0), sum((x * float(y) for x, y in zip(a, c, strict=True)), F.lit(1.0)))
    off, other = errors(members, start), errors(members, moved)
    if other @ other < off @ off:
        start, off = moved, other
    members = members.withColumn("rate", start)
    if np.abs(off).max() <= tolerance * n:
        return members.withColumn("residual", F.lit(float(np.abs(off).max() / n)))
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    # Two states a row, the rate and the one before, of which the next is a function of k errors and the momentum.
    history: list[tuple[np.ndarray, float]] = []
    members, momentum, last, now = members.withColumn("before", F.col("rate")), 1.0, off, off

    def state() -> Column:
        held = F.struct(F.col("rate").alias("rate"), F.col("before").alias("before"))
        if not history:
            return held
        past = F.array(*(F.struct(F.array(*(F.lit(float(x)) for x in e)).alias("e"), F.lit(m).alias("m")) for e, m in history))

        def follow(s: Column, h: Column) -> Column:
            ahead = s["rate"] + h["m"] * (s["rate"] - s["before"])
            return F.struct(F.greatest(F.lit(0.0), ahead - sum((x * h["e"][i] for i, x in enumerate(a)), F.lit(0.0))).alias("rate"), s["rate"].alias("before"))

        return F.aggregate(past, held, follow)

    def written(columns: list[str]) -> DataFrame:
        return scratch.materialise(members.withColumn("state", state()).select(*columns, "state.rate", "state.before"), "rates")

    own = [x for x in members.columns if x not in ("rate", "before")]
    for _ in range(steps):
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        push = (momentum - 1) / following
        if len(history) == WRITTEN:
            members = written(own)
            history.clear()
        # The sums of rates are linear, so the gradient where the momentum leads follows from the last two errors.
        ahead = now + push * (now - last)
        history.append((step * ahead, float(push)))
        found = errors(members.withColumn("state", state()), F.col("state.rate"))
        if found @ found >= (now @ now) * (1 - STILL):
            if push > 0 and found @ found > now @ now:  # the momentum overshot: start it again
                history.pop()
                history.append((step * now, 0.0))
                again = errors(members.withColumn("state", state()), F.col("state.rate"))
                if again @ again < (now @ now) * (1 - STILL):
                    momentum, last, now = 1.0, now, again
                    continue
                history.pop()
            break
        momentum, last, now = following, now, found
        if np.abs(now).max() <= tolerance * n:
            break
    off = errors(members.withColumn("state", state()), F.col("state.rate"))
    return written(own).drop("before").withColumn("residual", F.lit(float(np.abs(off).max() / n)))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], buckets: int = BUCKETS) -> DataFrame:
    """row, key (see resample()), doc_id, n_tokens, p, rate and residual of docs(doc_id, text, domain), for target weights.

    The domain column is believed for the rows that labelled(doc_id) names, and not looked at for others.
    """
    domains = sorted(targets)
    model = fit_domains(docs, labelled, domains, buckets)
    members = scratch.materialise(posteriors(docs, model, domains, buckets), "members")
    return fit_rates(members, [targets[d] for d in domains])


def copies(rate: Column, *key: Column | str) -> Column:
    """How often to repeat a row of this rate: its whole part, and one more with the probability of the rest."""
    chance = F.pmod(F.xxhash64(F.lit("mix"), *key), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def resample(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows of docs, all columns, each as often as its rate says, for rates(key, rate) as mix() gives them; rows of equal
    doc_id and text have equal rates, and a row without one stays once.

    Rows travel as one struct, so that no name of theirs can clash. The key spreads rows without doc_id by their texts.
    """
    one = rates.groupBy("key").agg(F.avg("rate").alias("rate"))
    rows = docs.select(F.struct("*").alias("doc"), row_key().alias("key")).join(one, "key", "left")
    times = copies(F.coalesce("rate", F.lit(1.0)), "key")
    return rows.select("doc", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).select("doc.*")
