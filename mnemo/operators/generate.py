"""Jobs around a text generator that the caller gives: sessions distilled into skills, memories enriched with the questions
that they answer. A generator takes a series of prompts and returns a series of replies, a whole Arrow batch at a time.

Defined cases: where the generator fails on a batch, its prompts are tried one by one, and those that fail have no reply;
a null, empty, malformed or incomplete reply makes no row; nothing is written, so a run that is repeated gives the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemo.operators import filters as fl

Generator = Callable[[pd.Series], pd.Series]

# How much of a session is read and shown, what makes one worth distilling, what is enriched and with how much.
READ, SHOWN, LINE, LEAST = 50, 20, 200, 3
SKILL = "skip boolean, skill_type string, summary string, steps array<string>, key_insight string, tools_used array<string>, files_involved array<string>, outcome string"
ENRICHED = ["user_preference", "decision", "lesson_learned", "memory"]
LEAST_CHARS, LEAST_HOURS, QUERIES, QUERY_CHARS, FILES = 80, 1, 5, 200, 5


def replies(prompts: DataFrame, key: str, generator: Generator) -> DataFrame:
    """prompts(key, prompt) with reply, null where the generator failed."""

    def one(prompt: str) -> str | None:
        try:
            return generator(pd.Series([prompt])).iloc[0]
        except Exception:  # noqa: BLE001 - whatever a model raises costs its own row only
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                said = list(generator(pdf["prompt"]))
            except Exception:  # noqa: BLE001
                said = [one(p) for p in pdf["prompt"]]
            yield pd.DataFrame({key: pdf[key], "reply": pd.Series(said, index=pdf.index, dtype=object)})

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {prompts.schema[key].dataType.simpleString()}, reply string")


def unfenced(reply: Column) -> Column:
    """A reply without the code fence that models like to put around JSON."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[^\n]*\n?", ""), r"\n?```\s*$", ""))


def trajectories(memories: DataFrame) -> DataFrame:
    """session_id, memory_count and prompt (oldest first) of the sessions worth distilling: three memories and something
    finished among the newest fifty. Only those fifty of a session meet in a task, however long it is."""
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("node_id"))
    live = memories.filter(fl.active() & F.col("session_id").isNotNull())
    last = live.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= READ)
    line = F.concat(F.lit("- ["), F.coalesce("event_type", F.lit("memory")), F.lit("] "), F.substring(F.coalesce("content", F.lit("")), 1, LINE))
    done = F.max(F.coalesce(F.col("event_type") == "task_completion", F.lit(False))).alias("done")
    s = last.groupBy("session_id").agg(F.count("*").alias("memory_count"), done, F.sort_array(F.collect_list(F.struct("n", line.alias("line"))), asc=False).alias("said"))
    shown = F.array_join(F.transform(F.slice("said", 1, SHOWN), lambda x: x["line"]), "\n")
    return s.filter((F.col("memory_count") >= LEAST) & F.col("done")).select("session_id", "memory_count", shown.alias("prompt"))


def distill(memories: DataFrame, generator: Generator) -> DataFrame:
    """Skill templates: node_id, content, event_type, session_id, skill_type, steps, outcome, memory_count."""
    t = trajectories(memories)
    r = replies(t, "session_id", generator).select("session_id", F.from_json(unfenced(F.col("reply")), SKILL).alias("s")).select("session_id", "s.*")
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    good = r.filter(~F.coalesce("skip", F.lit(False)) & has("skill_type") & has("summary") & has("key_insight") & F.coalesce(F.size("steps") > 0, F.lit(False)))
    files = F.array_join(F.slice(F.coalesce("files_involved", F.array().cast("array<string>")), 1, FILES), ", ")
    content = F.concat("summary", F.lit(". Steps: "), F.array_join("steps", " → "), F.lit(". Insight: "), "key_insight", F.when(files != "", F.concat(F.lit(". Files: "), files)).otherwise(""))
    j = good.withColumn("content", content).join(t.select("session_id", "memory_count"), "session_id")
    return j.select(
        F.concat(F.lit("mem-"), F.substring(F.sha2(F.concat_ws("\n", "session_id", "content"), 256), 1, 12)).alias("node_id"), "content", F.lit("skill_template").alias("event_type"),
        "session_id", "skill_type", "steps", F.coalesce("outcome", F.lit("success")).alias("outcome"), "memory_count",
    )


def pending(memories: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Live memories of the kinds worth enriching, long and old enough (or of unknown age), that done(node_id) lacks."""
    old = F.unix_micros(now) - F.unix_micros("created_at") >= LEAST_HOURS * 3_600_000_000
    m = memories.filter(F.col("event_type").isin(ENRICHED) & (F.length("content") >= LEAST_CHARS) & F.coalesce(old, F.lit(True)))
    return m.join(done.select("node_id"), "node_id", "left_anti")


def enrich(memories: DataFrame, done: DataFrame, now: Column, generator: Generator, embedder: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """node_id, queries (five at most), and v: the embedding of content and queries. The result joins done for the next run;
    its queries' words are postings beside the content's."""
    m = pending(memories, done, now)
    said = replies(m.select("node_id", F.col("content").alias("prompt")), "node_id", generator)
    q = F.transform(F.from_json(unfenced(F.col("reply")), "array<string>"), lambda x: F.trim(x))
    q = F.slice(F.filter(q, lambda x: x.isNotNull() & F.length(x).between(1, QUERY_CHARS)), 1, QUERIES)
    good = said.select("node_id", q.alias("queries")).filter("size(queries) > 0")
    text = good.join(m.select("node_id", "content"), "node_id").withColumn("text", F.concat("content", F.lit("\n"), F.array_join("queries", "\n")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"node_id": pdf["node_id"], "queries": pdf["queries"], "v": list(embedder(pdf["text"]))})

    return text.select("node_id", "queries", "text").mapInPandas(run, "node_id string, queries array<string>, v array<double>")
