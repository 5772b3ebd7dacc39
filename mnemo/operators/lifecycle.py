"""Batch jobs over memories: expiry, eviction, decay, consolidation, feedback, reminders, roll-ups and their logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemo import policy
from mnemo.functions import scoring as sc
from mnemo.operators.filters import expired
from mnemo.schema import age_days


def forgetting(rows: DataFrame, reason: str, now: Column) -> DataFrame:
    return rows.select("node_id", F.substring("content", 1, 200).alias("content_preview"), "event_type", F.lit(reason).alias("reason"), now.alias("deleted_at"))


def append_log(log: DataFrame, new: DataFrame) -> DataFrame:
    """The forgetting log with new rows: the first of each (node, reason) stays."""
    w = Window.partitionBy("node_id", "reason").orderBy("deleted_at")
    return log.unionByName(new).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def cleanup_expired(df: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and the log of what goes."""
    return df.filter(~expired(now)), forgetting(df.filter(expired(now)), "ttl_expired", now)


def least_recent(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.coalesce("last_accessed", "created_at"), "node_id").limit(n)


def evict(df: DataFrame, n: int) -> DataFrame:
    return df.join(least_recent(df, n).select("node_id"), "node_id", "left_anti")


def prunable(df: DataFrame, now: Column, days: int) -> DataFrame:
    return df.filter((F.col("access_count") == 0) & (age_days("created_at", now) > days) & ~F.col("event_type").isin(policy.PROTECTED))


def summary_overflow(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """Session summaries beyond the newest ones."""
    w = Window.partitionBy(*keys).orderBy(F.desc("created_at"), "node_id")
    return df.filter("event_type = 'session_summary'").withColumn("n", F.row_number().over(w)).filter(F.col("n") > most).drop("n")


def consolidate(df: DataFrame, edges: DataFrame, now: Column, days: int = 30, most: int = 50) -> DataFrame:
    """One row of counts: pruned, capped, and edges that lose an end."""
    gone = prunable(df, now, days).select("node_id", F.lit("pruned").alias("why"))
    capped = summary_overflow(df.join(gone.select("node_id"), "node_id", "left_anti"), most, "project").select("node_id", F.lit("capped").alias("why"))
    every = gone.union(capped)
    ends = edges.join(every.select(F.col("node_id").alias("source_id")), "source_id", "left_semi").select("source_id", "target_id", "edge_type").union(
        edges.join(every.select(F.col("node_id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id", "edge_type")
    ).distinct()
    counts = every.agg(F.count_if(F.col("why") == "pruned").alias("pruned"), F.count_if(F.col("why") == "capped").alias("capped"))
    return counts.crossJoin(ends.agg(F.count("*").alias("edges_removed")))  # two single rows


def weak(df: DataFrame, now: Column, least: float = 0.05, age: int = 30) -> DataFrame:
    """Old, unused or disliked, unprotected memories whose strength has decayed."""
    strength = sc.type_weight() * sc.feedback_factor("feedback_score") * sc.decay(now)
    old = (age_days("created_at", now) >= age) & ((F.col("access_count") == 0) | (F.col("feedback_score") <= policy.FLAGGED_AT))
    return df.withColumn("strength", strength).filter(old & ~F.col("event_type").isin(policy.PROTECTED) & (F.col("strength") < least))


def feedback(df: DataFrame, ratings: DataFrame) -> DataFrame:
    """df with ratings(node_id, rating) folded into feedback_score and flagged."""
    delta = policy.by_type(policy.RATINGS, "rating", 0)
    sums = ratings.groupBy("node_id").agg(F.sum(delta).alias("delta"))
    j = df.join(sums, "node_id", "left").withColumn("feedback_score", F.coalesce("feedback_score", F.lit(0)) + F.coalesce("delta", F.lit(0)))
    return j.drop("delta").withColumn("flagged", F.col("feedback_score") <= policy.FLAGGED_AT)


def graduate(df: DataFrame, signals: DataFrame) -> DataFrame:
    """Priorities raised after two correlated changes, lowered after three uncommitted ones without a good one."""
    s = signals.groupBy("node_id").agg(F.count_if(F.col("signal") == "diff_correlated").alias("good"), F.count_if(F.col("signal") == "not_committed").alias("bad"))
    j = df.join(s, "node_id", "left").na.fill(0, ["good", "bad"])
    p = F.when(F.col("good") >= 2, F.least(F.lit(5), F.col("priority") + 1)).when((F.col("bad") >= 3) & (F.col("good") == 0), F.greatest(F.lit(1), F.col("priority") - 1))
    return j.withColumn("priority", F.coalesce(p, "priority")).drop("good", "bad")


def due_reminders(df: DataFrame, now: Column) -> DataFrame:
    """Pending reminders(remind_at, reminder_status), overdue ones first."""
    over = F.col("remind_at") <= now
    return df.filter("reminder_status = 'pending'").withColumn("overdue", over).orderBy(F.desc("overdue"), "remind_at", "node_id")


def retained(log: DataFrame, at: str, now: Column, days: int = 90) -> DataFrame:
    return log.filter(age_days(at, now) <= days)


def rollup_text(df: DataFrame, *keys: str, excerpt: int = 400, budget: int = 14000) -> DataFrame:
    """Each window's records in time order, cut to excerpts, up to the first that would exceed the budget."""
    line = F.concat(F.date_format("created_at", "yyyy-MM-dd"), F.lit(" "), F.col("event_type"), F.lit(": "), F.substring("content", 1, excerpt))
    w = Window.partitionBy(*keys).orderBy("created_at", "node_id")
    rows = df.withColumn("line", line).withColumn("used", F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.filter(F.col("used") <= budget)
    texts = F.array_sort(F.collect_list(F.struct("created_at", "node_id", "line")))
    return rows.groupBy(*keys).agg(F.count("*").alias("records"), F.array_join(F.transform(texts, lambda x: x["line"]), "\n").alias("text"))


def roll_up(df: DataFrame, summarise, *keys: str) -> DataFrame:
    """Roll-up memories by an injected summariser, a function of a Column; deterministic ids."""
    t = rollup_text(df, *keys)
    return t.select(F.concat(F.lit("mem-"), F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 12)).alias("node_id"), *keys, "records", summarise(F.col("text")).alias("content"))


# Name, days between runs, and whether the job waits until nothing else runs.
JOBS = [
    ("rollup", 1, False), ("enrich", 1, False), ("link", 1, False), ("gc", 7, True),
    ("consolidate", 3, False), ("compact", 3, False), ("backup", 7, False), ("behavioral", 3, False),
]


def due_jobs(runs: DataFrame, now: Column, idle: bool = True) -> DataFrame:
    """Jobs to run now, in their order, by runs(name, ran_at) so far: those never run, or not within their days. A job that
    waits for idleness isn't due without it, and so stays due."""
    jobs = runs.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(JOBS)], "place int, name string, days int, needs_idle boolean")
    last = runs.groupBy("name").agg(F.max("ran_at").alias("last_run"))  # a row for each job
    due = F.col("last_run").isNull() | (F.unix_micros(now) - F.unix_micros("last_run") >= F.col("days") * F.lit(86_400_000_000))
    return jobs.join(F.broadcast(last), "name", "left").filter(due & (F.lit(idle) | ~F.col("needs_idle"))).select("place", "name", "last_run")


def mark_run(runs: DataFrame, due: DataFrame, now: Column) -> DataFrame:
    """runs with those of the due jobs, which are then not due until their days are over."""
    return runs.unionByName(due.select("name", now.alias("ran_at")))


def deleted(memories: DataFrame, asked: DataFrame, now: Column, reason: str = "user_deleted") -> tuple[DataFrame, DataFrame]:
    """asked(node_id) to be deleted: results (node_id, success, error), a row for each id whatever often it is asked, and
    the forgetting log's rows of those found. The store is what an anti-join with the successes leaves; null ids ask nothing."""
    ids = asked.filter("node_id is not null").select("node_id").distinct()
    j = ids.join(memories.select("node_id", F.lit(True).alias("there")), "node_id", "left")
    there = F.col("there").isNotNull()
    error = F.when(~there, F.concat(F.lit("Memory "), "node_id", F.lit(" not found")))
    found = memories.join(ids, "node_id", "left_semi")
    return j.select("node_id", there.alias("success"), error.alias("error")), forgetting(found, reason, now)


def lost_links(edges: DataFrame, results: DataFrame) -> DataFrame:
    """Links that go with deleted nodes: node_id, source_id, target_id; one between two of them is each one's."""
    gone = results.filter("success").select("node_id")
    ends = edges.select("source_id", "target_id", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("node_id"))
    return ends.join(gone, "node_id", "left_semi").select("node_id", "source_id", "target_id")


def links_left(edges: DataFrame, results: DataFrame) -> DataFrame:
    """edges without those of deleted nodes."""
    gone = results.filter("success").select("node_id")
    left = edges.join(gone.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti")
    return left.join(gone.withColumnRenamed("node_id", "target_id"), "target_id", "left_anti").select(*edges.columns)
