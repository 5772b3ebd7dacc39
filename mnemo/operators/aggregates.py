"""Statistics over memories, sessions, usage logs and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemo import policy
from mnemo.schema import age_days


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def stats_card(df: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: memories, accesses, first memory, distinct sessions, edges."""
    a = df.agg(
        F.count("*").alias("memories"), F.sum("access_count").alias("accesses"), F.min("created_at").alias("oldest"),
        F.countDistinct("session_id").alias("sessions"),
    )
    return a.crossJoin(edges.agg(F.count("*").alias("edges")))  # two single rows


def period_stats(df: DataFrame, start: Column, before: Column) -> DataFrame:
    now = F.col("created_at") >= start
    return df.filter(F.col("created_at") >= before).agg(
        F.count_if(now).alias("current"), F.count_if(~now).alias("previous"),
        F.countDistinct(F.when(now, F.col("session_id"))).alias("sessions"), F.countDistinct(F.when(now, F.col("event_type"))).alias("types"),
    )


def access_rate(df: DataFrame) -> DataFrame:
    """By type: count, mean access, unused share, mean retrieval; with a total row, type null."""
    n = F.count("*")
    unused = F.count_if(F.col("access_count") == 0)
    return df.rollup("event_type").agg(
        n.alias("n"), F.avg("access_count").alias("avg_access"), unused.alias("never"), ratio(unused, n).alias("never_share"),
        F.avg("retrieval_count").alias("avg_retrieval"), F.count_if(F.col("retrieval_count") == 0).alias("never_retrieved"),
    )


def access_buckets(df: DataFrame) -> DataFrame:
    a = F.col("access_count")
    bucket = F.when(a == 0, "0").when(a <= 2, "1-2").when(a <= 9, "3-9").otherwise("10+")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def diagnostic(df: DataFrame, now: Column, days: int = 7) -> DataFrame:
    dead = F.count_if((F.col("access_count") == 0) & (age_days("created_at", now) > days))
    return df.agg(
        F.count("*").alias("total"), F.count_if(age_days("created_at", now) <= days).alias("recent"), dead.alias("dead"),
        ratio(dead, F.count("*")).alias("dead_share"),
    ).withColumn("verdict", F.when(F.col("dead_share") > 0.5, "stale").when(F.col("recent") == 0, "idle").otherwise("healthy"))


def topic_terms(df: DataFrame, stop: list[str], most: int = 8) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("content"), F.lit("([a-z_]{4,})"), F.lit(1))).alias("term")
    return df.select(words).filter(~F.col("term").isin(stop)).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(most)


def weekly_digest(df: DataFrame, now: Column, days: int = 7) -> DataFrame:
    age = age_days("created_at", now)
    new, old = F.count_if(age <= days), F.count_if((age > days) & (age <= 2 * days))
    return df.agg(new.alias("new"), old.alias("previous"), (ratio(new - old, old) * 100).alias("growth_pct"))


def timeline(df: DataFrame, per_day: int) -> DataFrame:
    """The newest of each day."""
    day = F.to_date("created_at")
    w = Window.partitionBy(day).orderBy(F.desc("created_at"), "node_id")
    return df.withColumns({"day": day, "rank": F.row_number().over(w)}).filter(F.col("rank") <= per_day)


def streaks(df: DataFrame, *keys: str) -> DataFrame:
    """Runs of consecutive days: first and last day and length, by gaps and islands over distinct days."""
    days = df.select(*keys, F.to_date("created_at").alias("day")).distinct()
    w = Window.partitionBy(*keys).orderBy("day")
    runs = days.withColumn("run", F.date_sub("day", F.row_number().over(w)))
    return runs.groupBy(*keys, "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("length")).drop("run")


def milestones(df: DataFrame, thresholds: list[int]) -> DataFrame:
    """The highest threshold that the count has reached; null before the first."""
    reached = F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("n"))
    return df.agg(F.count("*").alias("n")).withColumn("milestone", F.array_max(reached))


def session_score(hits: DataFrame, most: int) -> DataFrame:
    """Sessions by their best hit and a tenth of their mean: hits(session_id, relevance)."""
    s = hits.groupBy("session_id").agg((F.max("relevance") + 0.1 * F.avg("relevance")).alias("score"), F.count("*").alias("hits"))
    return s.orderBy(F.desc("score"), "session_id").limit(most)


def rollup_windows(df: DataFrame, now: Column, min_age: int, least: int = 3) -> DataFrame:
    """Projects' closed months with enough memories of the kinds that are rolled up."""
    old = df.filter((age_days("created_at", now) >= min_age) & F.col("event_type").isin("task_completion", "session_summary"))
    return old.groupBy("project", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.min("created_at").alias("first_at")).filter(F.col("n") >= least)


def dedup_prefix(df: DataFrame, length: int = 80, least: int = 3) -> DataFrame:
    """Groups with one beginning: which row stays (most used, oldest id) and how many go."""
    return (
        df.groupBy(F.substring("content", 1, length).alias("prefix"))
        .agg(F.count("*").alias("n"), F.max_by("node_id", F.struct("access_count", "node_id")).alias("keeper"))
        .filter(F.col("n") >= least)
    )


def verified(df: DataFrame, by: str, length: int = 80) -> DataFrame:
    """Lessons by their beginning: in how many distinct sessions or projects they were learned."""
    return df.groupBy(F.lower(F.substring("content", 1, length)).alias("lesson")).agg(
        F.countDistinct(by).alias("verified"), F.sum("access_count").alias("accesses"), F.count("*").alias("n")
    )


def usage(log: DataFrame, *keys: str) -> DataFrame:
    """Calls, tokens and cost of log(tokens_in, tokens_out, cost, ...) by any keys, and in total."""
    return log.rollup(*keys).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost"))


def latency(log: DataFrame, key: str, last: int = 100) -> DataFrame:
    """Nearest-rank percentiles of the last timings of each key: log(key, at, ms, id)."""
    w = Window.partitionBy(key).orderBy(F.desc("at"), F.desc("id"))
    recent = log.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= last)
    a = recent.groupBy(key).agg(F.array_sort(F.collect_list("ms")).alias("v"), F.avg("ms").alias("mean"), F.count("*").alias("n"))
    at = lambda p: F.element_at("v", F.least(F.floor(F.col("n") * p) + 1, F.col("n")).cast("int"))
    return a.select(key, "n", "mean", at(0.5).alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def trend_alert(runs: DataFrame, least: float = 0.9) -> DataFrame:
    """The latest of runs(at, value) against the median of the earlier ones."""
    last = runs.agg(F.max_by("value", "at").alias("latest"), F.max("at").alias("at"))
    earlier = runs.join(F.broadcast(last.select(F.col("at").alias("last_at"))), F.col("at") < F.col("last_at")).agg(F.percentile("value", F.lit(0.5)).alias("median"))
    return last.crossJoin(earlier).withColumn("alert", F.col("latest") < least * F.col("median"))  # two single rows


def graph_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"), F.avg("weight").alias("avg_weight"), F.countDistinct("source_id").alias("sources"))


def type_pairs(edges: DataFrame, nodes: DataFrame, least: int = 3) -> DataFrame:
    """Links between two types, whatever their direction."""
    n = nodes.select("node_id", "event_type")
    a, b = n.toDF("source_id", "ta"), n.toDF("target_id", "tb")
    j = edges.join(a, "source_id").join(b, "target_id").filter("ta <> tb")
    pair = F.array_join(F.sort_array(F.array("ta", "tb")), "/")
    return j.groupBy(pair.alias("pair")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def health(df: DataFrame) -> DataFrame:
    n = F.count("*")
    never = F.count_if(F.col("access_count") == 0)
    out = df.agg(n.alias("n"), never.alias("never"), ratio(never, n).alias("never_share"), F.count_if(F.col("feedback_score") <= policy.FLAGGED_AT).alias("flagged"))
    return out.withColumn("warning", F.when(F.col("n") == 0, "empty").when(F.col("never_share") > 0.8, "unused").when(F.col("flagged") > 0, "flagged").otherwise("none"))


def categories(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(F.split(column, ",")).alias("c")).groupBy(F.trim("c").alias("category")).agg(F.count("*").alias("n"))


def child_scopes(df: DataFrame, scope: str, parent: str) -> DataFrame:
    """Distinct next path segments below a scope."""
    rest = F.substring(F.col(scope), F.lit(len(parent) + 1), F.length(scope))
    return df.filter(F.col(scope).startswith(parent)).select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("child")).filter("child <> ''").distinct()


def utilization(calls: DataFrame, now: Column) -> DataFrame:
    """By tool: calls in the last week and in the week before."""
    age = age_days("at", now)
    return calls.groupBy("tool").agg(F.count_if((age >= 0) & (age <= 7)).alias("this_week"), F.count_if((age > 7) & (age <= 14)).alias("last_week"))
