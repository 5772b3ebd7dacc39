"""Many requests of every mode at once, each answered by its mode's plan, in one result schema.

requests(query_id, mode, text, q, wanted, event_type, project, session_id, tags, memory_type, status, strength_min,
case_sensitive, browse_by, days): all but query_id may be null. Modes are semantic, unified, phrase, regex, timeline and
browse; any other, or null, is semantic. memories are those of the read path, with session_id and memory_type besides.

Defined cases: a request that lacks what its mode needs, or whose pattern can't be used, has no answers and a row in
rejected(); a wanted number out of bounds is brought within them; equal times are ordered by node_id; null contents match
nothing; a request without answers has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemo.operators import filters as fl
from mnemo.operators import readpath as rp
from mnemo.sources.io import written

# Modes, how many answers each gives if none are wanted, and the most; days; patterns; injected rows.
MODES = {"semantic": (10, 1000), "unified": (10, 100), "phrase": (10, 1000), "regex": (10, 1000), "timeline": (10, 100), "browse": (20, 200)}
DAYS, MOST_DAYS = 7, 365
PATTERN_CHARS = 256
NESTED = r"\([^()]*[+*][^()]*\)\s*[+*{]"
PREVIEW = 200
OVERFETCH = 3
CONSTRAINTS, PREFERENCES, INJECTED = 10, 20, 3
ASKS_PREFERENCE = [
    "rule", "rules", "preference", "setting", "configured", "should", "allowed", "policy", "default", "location", "timezone", "where", "how",
]
NEEDS_TEXT = ["semantic", "unified", "phrase", "regex"]
BLOCK = 64  # phrases or patterns that a memory meets at once


def checked(requests: DataFrame) -> DataFrame:
    """requests with their mode settled, wanted and days within bounds, and error: null, or why there is no answer."""
    mode = F.when(F.col("mode").isin(list(MODES)), F.col("mode")).otherwise("semantic")
    of_mode = lambda i: F.coalesce(*(F.when(F.col("mode") == m, v[i]) for m, v in MODES.items()))
    browse = F.coalesce("browse_by", F.lit("recent"))
    text = F.trim(F.coalesce("text", F.lit("")))
    compiles = F.pandas_udf(lambda s: s.map(usable), "boolean")
    empty = F.when(F.col("mode").isin(NEEDS_TEXT) & (text == ""), "text is required")
    lacks = F.when((F.col("mode") == "browse") & (browse == "type") & F.col("event_type").isNull(), "event_type is required")
    lacks = lacks.when((F.col("mode") == "browse") & (browse == "session") & F.col("session_id").isNull(), "session_id is required")
    pattern = F.when(F.col("mode") != "regex", None).when(F.length(text) > PATTERN_CHARS, "pattern is too long")
    pattern = pattern.when(text.rlike(NESTED), "nested quantifiers").when(~F.col("compiles"), "not a pattern")
    r = requests.withColumn("mode", mode).withColumn("text", text)
    r = r.withColumn("compiles", compiles(F.when(F.col("mode") == "regex", F.col("text")).otherwise("")))
    r = r.withColumns({
        "wanted": F.greatest(F.lit(1), F.least(F.coalesce("wanted", of_mode(0)), of_mode(1))), "browse_by": browse,
        "days": F.greatest(F.lit(0), F.least(F.coalesce("days", F.lit(DAYS)), F.lit(MOST_DAYS))),
        "case_sensitive": F.coalesce("case_sensitive", F.lit(False)), "error": F.coalesce(empty, lacks, pattern),
    })
    # Unified requests know no further filters.
    plain = {c: F.when(F.col("mode") != "unified", F.col(c)) for c in ("event_type", "tags", "memory_type", "status", "strength_min")}
    return r.drop("compiles").withColumns(plain)


def usable(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except (re.error, OverflowError):
        return False
    return True


def rejected(requests: DataFrame) -> DataFrame:
    """query_id, mode and error of the requests that can't be answered."""
    return checked(requests).filter("error is not null").select("query_id", "mode", "error")


def newest(found: DataFrame, memories: DataFrame, most: int) -> DataFrame:
    """found(query_id, node_id, wanted) cut to each request's newest: query_id, node_id, place."""
    w = Window.partitionBy("query_id").orderBy(F.desc("created_at"), "node_id")
    dated = found if "created_at" in found.columns else found.join(memories.select("node_id", "created_at"), "node_id")
    # The constant bound is applied before rows are sent; the request's own comes after.
    cut = dated.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    return cut.filter(F.col("place") <= F.col("wanted")).select("query_id", "node_id", "place")


def met(asked: DataFrame, memories: DataFrame, hits) -> DataFrame:
    """query_id, node_id, created_at, wanted of the requests whose text hits a live memory; requests meet memories in blocks.

    Each memory is read once and compared with a block of requests at a time; only hits leave the task."""
    n = max(1, -(-asked.count() // BLOCK))
    of = F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")
    asks = F.struct("query_id", "text", "case_sensitive", "wanted", "event_type", "project")
    blocks = asked.groupBy(of.alias("block")).agg(F.collect_list(asks).alias("asks"))  # BLOCK requests on average
    m = memories.filter(fl.active() & F.col("content").isNotNull()).select("node_id", "content", "event_type", "project", "created_at")
    each = m.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(blocks, "block")
    return each.select("node_id", "created_at", F.explode(hits).alias("x")).select("x.query_id", "node_id", "created_at", "x.wanted")


def in_scope(a: Column) -> Column:
    """Whether a request's type and project allow the memory beside it; memories without project are everyone's."""
    kind = a["event_type"].isNull() | F.coalesce(F.col("event_type") == a["event_type"], F.lit(False))
    free = F.coalesce("project", F.lit("")) == ""
    return kind & ((F.coalesce(a["project"], F.lit("")) == "") | free | (F.col("project") == a["project"]))


def phrases(asked: DataFrame, memories: DataFrame) -> DataFrame:
    """Each phrase's newest memories that hold it as it stands, or in any case."""
    low = F.lower("content")
    holds = lambda a: F.when(a["case_sensitive"], F.contains("content", a["text"])).otherwise(F.contains(low, F.lower(a["text"])))
    found = met(asked, memories, F.filter("asks", lambda a: in_scope(a) & holds(a)))
    return newest(found, memories, MODES["phrase"][1])


def patterns(asked: DataFrame, memories: DataFrame) -> DataFrame:
    """Each pattern's newest matches, by Python's rules, over whole contents; a block's patterns are compiled once a batch."""
    n = max(1, -(-asked.count() // BLOCK))
    of = F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")
    asks = F.struct(F.col("query_id").cast("string").alias("id"), "text", "case_sensitive")
    blocks = asked.groupBy(of.alias("block")).agg(F.collect_list(asks).alias("asks"))
    m = memories.filter(fl.active() & F.col("content").isNotNull()).select("node_id", "content")
    each = m.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(blocks, "block").select("node_id", "content", "block", "asks")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled: dict[int, list] = {}
        for pdf in batches:
            out = []
            for block, part in pdf.groupby("block"):
                if block not in compiled:
                    compiled[block] = [(a["id"], re.compile(a["text"], 0 if a["case_sensitive"] else re.IGNORECASE)) for a in part["asks"].iloc[0]]
                for name, pattern in compiled[block]:
                    hit = part.loc[part["content"].map(lambda s, p=pattern: p.search(s) is not None), "node_id"]
                    out.append(pd.DataFrame({"id": name, "node_id": hit}))
            yield pd.concat(out) if out else pd.DataFrame({"id": [], "node_id": []})

    found = each.mapInPandas(search, "id string, node_id string")
    named = found.join(asked.select(F.col("query_id").cast("string").alias("id"), "query_id", "wanted", F.struct("event_type", "project").alias("a")), "id")
    j = named.join(memories.select("node_id", "created_at", "event_type", "project"), "node_id")
    return newest(j.filter(in_scope(F.col("a"))), memories, MODES["regex"][1])


def timeline(asked: DataFrame, memories: DataFrame, now: Column) -> DataFrame:
    """The newest of each of a request's last days; a day's rows are ranked once, however many ask for it."""
    day, most = F.to_date("created_at"), MODES["timeline"][1]
    w = Window.partitionBy("day").orderBy(F.desc("created_at"), "node_id")
    m = memories.select("node_id", "created_at", day.alias("day")).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    start = F.timestamp_seconds(F.unix_micros(now) / 1e6 - 86400 * F.col("days"))
    last = F.to_date(now)
    a = asked.select("query_id", "wanted", start.alias("start")).withColumn("day", F.explode(F.sequence(F.to_date("start"), last)))
    # Rows before the start share only its first day, where they come after all others.
    j = a.join(m, "day").filter((F.col("created_at") >= F.col("start")) & (F.col("n") <= F.col("wanted")))
    order = Window.partitionBy("query_id").orderBy(F.desc("created_at"), "node_id")
    return j.withColumn("place", F.row_number().over(order)).select("query_id", "node_id", "place")


def browse(asked: DataFrame, memories: DataFrame) -> DataFrame:
    """The newest of a type, of a session, or of all: each asked list is made once and shared by those who ask for it."""
    most, live = MODES["browse"][1], memories.filter(fl.active())
    by = [F.desc("created_at"), "node_id"]

    def listed(column: str, name: str) -> DataFrame:
        a = asked.filter(F.col("browse_by") == name).select("query_id", "wanted", column)
        m = live.select("node_id", "created_at", column).join(a.select(column).distinct(), column)
        best = m.withColumn("place", F.row_number().over(Window.partitionBy(column).orderBy(*by))).filter(F.col("place") <= most)
        return a.join(best, column).filter(F.col("place") <= F.col("wanted")).select("query_id", "node_id", "place")

    last = live.select("node_id", "created_at").orderBy(*by).limit(most)  # 200 rows, met by their places
    last = last.withColumn("place", F.row_number().over(Window.orderBy(*by)))
    rest = asked.filter(~F.col("browse_by").isin("type", "session")).select("query_id", F.explode(F.sequence(F.lit(1), "wanted")).alias("place"))
    recent = rest.join(F.broadcast(last), "place").select("query_id", "node_id", "place")
    return listed("event_type", "type").unionByName(listed("session_id", "session")).unionByName(recent)


def narrowed(asked: DataFrame) -> Column:
    """Requests whose answers are filtered afterwards fetch three times as many."""
    return F.coalesce(F.size("tags") > 0, F.lit(False)) | F.col("memory_type").isNotNull() | F.col("status").isNotNull()


def semantic(
    asked: DataFrame, memories: DataFrame, vectors: DataFrame, edges: DataFrame, now: Column, limits: rp.Limits, scorer: rp.Scorer | None = None, preference: str = "user_preference"
) -> DataFrame:
    """The read path over type, project and text, then type, tags, kind, status and strength: query_id, node_id, place, score.

    limits.limit answers are found for each request, three times as many for those that filter further; what a request
    wants beyond that it doesn't get, so set the limit to the most that is wanted.
    """
    base = F.element_at(F.split(F.rtrim(F.coalesce("project", F.lit("")), F.lit("/")), "/"), -1)
    text = F.trim(F.concat_ws(" ", F.when(base != "", base), "event_type", "text"))
    none = F.lit(None).cast("timestamp")
    for c in ("start", "stop"):
        asked = asked if c in asked.columns else asked.withColumn(c, none)
    asked = written(asked, "semantic-requests")
    ask = asked.select("query_id", text.alias("text"), "q", "start", "stop", F.col("event_type").alias("hint"), narrowed(asked).alias("narrow"))
    wide = replace(limits, limit=limits.limit * OVERFETCH)
    run = lambda a, most: rp.search(a.drop("narrow"), memories, vectors, edges, now, most, scorer, preference)
    found = run(ask.filter(~F.col("narrow")), limits).unionByName(run(ask.filter("narrow"), wide))
    facts = memories.select("node_id", F.col("event_type").alias("kind"), F.transform("tags", F.lower).alias("has"), F.col("memory_type").alias("class"), F.coalesce("status", F.lit("active")).alias("state"))
    j = found.join(asked.select("query_id", "event_type", "tags", "memory_type", "status", "strength_min", "wanted"), "query_id").join(facts, "node_id")
    same = lambda want, has: F.col(want).isNull() | F.coalesce(F.col(want) == F.col(has), F.lit(False))
    tagged = F.coalesce(F.size(F.array_except(F.transform("tags", F.lower), F.coalesce("has", F.array().cast("array<string>")))) <= 0, F.lit(True))
    j = j.filter(same("event_type", "kind") & same("memory_type", "class") & same("status", "state") & tagged)
    j = j.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("n") <= F.col("wanted"))
    j = j.filter(F.coalesce(F.col("strength") >= F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("strength_min"))), F.lit(True)))
    return j.select("query_id", "node_id", F.row_number().over(Window.partitionBy("query_id").orderBy("n")).alias("place"), F.col("strength").alias("score"))


def injected(asked: DataFrame, found: DataFrame, memories: DataFrame, kind: str, pool: int, only: Column) -> DataFrame:
    """Of the pool newest live memories of a kind, those that share a word of three letters with a request and aren't
    among its answers: at most three, the newest first. Requests meet the pool, a few rows, by words."""
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 2)))
    last = memories.filter(fl.active() & (F.col("event_type") == kind)).orderBy(F.desc("created_at"), "node_id").limit(pool)
    a = asked.filter(only & F.coalesce(F.col("event_type") != kind, F.lit(True))).select("query_id", words(F.col("text")).alias("word"))
    j = a.join(F.broadcast(last.select("node_id", "created_at", words(F.col("content")).alias("word"))), "word")
    j = j.select("query_id", "node_id", "created_at").distinct().join(found.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    return newest(j.withColumn("wanted", F.lit(INJECTED)), memories, INJECTED)


def answer(
    requests: DataFrame, memories: DataFrame, vectors: DataFrame, edges: DataFrame, now: Column, limits: rp.Limits | None = None, scorer: rp.Scorer | None = None,
    constraint: str = "constraint", preference: str = "user_preference",
) -> DataFrame:
    """query_id, mode, part (result, constraint, preference), place, node_id, score (of semantic answers), event_type, preview."""
    ok = written(checked(requests).filter("error is null"), "requests")
    present = {r["mode"] for r in ok.select("mode").distinct().collect()}  # six at most: absent modes cost nothing
    of = lambda *m: ok.filter(F.col("mode").isin(*m))
    part = lambda df, name: df.withColumn("part", F.lit(name)).withColumn("score", F.col("score") if "score" in df.columns else F.lit(None).cast("double"))
    plans = {"phrase": lambda a: phrases(a, memories), "regex": lambda a: patterns(a, memories), "timeline": lambda a: timeline(a, memories, now), "browse": lambda a: browse(a, memories)}
    every = [part(plan(of(mode)), "result") for mode, plan in plans.items() if mode in present]
    if present & {"semantic", "unified"} or not present:
        means = of("semantic", "unified")
        found = written(semantic(means, memories, vectors, edges, now, limits or rp.Limits(), scorer, preference), "semantic")
        asks = F.arrays_overlap(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.rtrim(w, F.lit("?.,!"))), F.array(*map(F.lit, ASKS_PREFERENCE)))
        rules = injected(means, found, memories, constraint, CONSTRAINTS, F.lit(True))
        wishes = injected(means, found, memories, preference, PREFERENCES, asks)
        every += [part(found, "result"), part(rules, "constraint"), part(wishes, "preference")]
    every = reduce(DataFrame.unionByName, every)
    shown = F.when(F.length("content") > PREVIEW, F.concat(F.substring("content", 1, PREVIEW), F.lit("..."))).otherwise(F.col("content"))
    j = every.join(ok.select("query_id", "mode"), "query_id").join(memories.select("node_id", "event_type", shown.alias("preview")), "node_id")
    return j.select("query_id", "mode", "part", F.col("place").cast("int").alias("place"), "node_id", "score", "event_type", "preview")
