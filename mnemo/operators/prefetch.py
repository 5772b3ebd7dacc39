"""What a project's work is likely to need next: the files that its used memories name, and the memories that name them.

Defined cases: null contents name nothing; memories without project are every project's; expired and superseded rows are
left out of what is fetched after its limit, as they may take a place there; equal counts and uses are ordered by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemo.operators import filters as fl
from mnemo.operators import retrieval as rt

# Used memories read, stems kept, memories for a stem, and what looks like a file.
USED, STEMS, FETCHED, SHORTEST = 100, 10, 10, 3
FILE = r"\b[\w/.-]+\.\w{1,5}\b"
PIECE = 3


def stems(memories: DataFrame) -> DataFrame:
    """project, stem, n: the file stems that each project's hundred most used memories name most often, ten at most."""
    w = Window.partitionBy("project").orderBy(F.desc("access_count"), "node_id")
    used = memories.filter((F.col("access_count") > 0) & F.col("project").isNotNull())
    hot = used.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= USED)
    files = hot.select("project", F.explode(F.regexp_extract_all("content", F.lit(FILE), F.lit(0))).alias("file"))
    named = files.select("project", F.element_at(F.split("file", "/"), -1).alias("name")).select("project", F.regexp_replace("name", r"^(.+)\.[^.]*$", "$1").alias("stem"))
    n = named.filter(F.length("stem") >= SHORTEST).groupBy("project", "stem").agg(F.count("*").alias("n"))
    return rt.top(n, STEMS, "n", "project", tie="stem").drop("rank")


def pieces(text: Column) -> Column:
    """The distinct runs of three characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (PIECE - 1)), lambda i: F.substring(text, i, PIECE)))


def prefetch(memories: DataFrame, now: Column, named: DataFrame | None = None) -> DataFrame:
    """project, stem, node_id, place: for each of a project's stems (found, or given) its ten most used memories that hold it.

    Memories meet the stems of their own project, which are at most ten; those without project meet all stems over the
    first three characters, so that no text is compared with a stem that it can't hold.
    """
    s = (stems(memories) if named is None else named).select("project", "stem", F.lower("stem").alias("low"))
    m = memories.filter(F.col("content").isNotNull()).withColumn("lower", F.lower("content")).select("node_id", "project", "lower", "access_count")
    own = m.join(s.groupBy("project").agg(F.collect_list(F.struct("stem", "low")).alias("stems")), "project")
    own = own.select("project", "node_id", "access_count", F.explode(F.filter("stems", lambda x: F.contains("lower", x["low"]))).alias("x"))
    own = own.select("project", "x.stem", "node_id", "access_count")
    free = m.filter("project is null and length(lower) >= 3").drop("project").withColumn("piece", F.explode(pieces(F.col("lower"))))
    shared = free.join(s.withColumn("piece", F.substring("low", 1, PIECE)), "piece").filter(F.contains("lower", F.col("low")))
    every = own.unionByName(shared.select("project", "stem", "node_id", "access_count"))
    best = rt.top(every, FETCHED, "access_count", "project", "stem", rank="n")
    live = memories.filter(~fl.expired(now) & F.coalesce(F.col("status") != "superseded", F.lit(True))).select("node_id")
    order = Window.partitionBy("project", "stem").orderBy("n")
    kept = best.select("project", "stem", "node_id", "n").join(live, "node_id", "left_semi")
    return kept.withColumn("place", F.row_number().over(order)).select("project", "stem", "node_id", "place")
