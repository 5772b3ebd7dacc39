"""Typed links: upserts, traversal, classification, discovery, entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemo.sources.io import written


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("source_id", "target_id", "edge_type", "weight").union(edges.select("target_id", "source_id", "edge_type", "weight"))


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Old edges and those new ones that aren't there, weights rounded; the first of equal new ones."""
    key = ["source_id", "target_id", "edge_type"]
    w = Window.partitionBy(*key).orderBy("created_at", "weight")
    first = new.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n").withColumn("weight", F.round("weight", 3))
    return edges.unionByName(first.join(edges.select(*key), key, "left_anti").select(*edges.columns))


def bfs(edges: DataFrame, starts: DataFrame, hops: int = 5, least: float = 0.0, types: list[str] | None = None) -> DataFrame:
    """start_id, node_id and hop of everything within hops of starts(start_id): a frontier join for each hop."""
    e = edges.filter(F.col("weight") >= least)
    if types:
        e = e.filter(F.col("edge_type").isin(types))
    e = both_ways(e).select(F.col("source_id").alias("node_id"), F.col("target_id").alias("to")).distinct()
    seen = starts.select("start_id", F.col("start_id").alias("node_id"), F.lit(0).alias("hop"))
    e, front = written(e, "edges"), seen
    for hop in range(1, hops + 1):
        step = front.join(e, "node_id").select("start_id", F.col("to").alias("node_id")).distinct()
        # Written each hop: the next one's plan reads a table, not all hops before it.
        front = written(step.join(seen, ["start_id", "node_id"], "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        seen = seen.unionByName(front)
    return seen.filter("hop > 0")


def edge_type(same_entity: Column, same_type: Column, gap_hours: Column, similarity: Column) -> Column:
    """The first kind of link that applies, or null."""
    return (
        F.when(same_entity, "same_entity").when(same_type & (similarity >= 0.75), "evolution")
        .when(gap_hours <= 1, "temporal_cluster").when(similarity >= 0.80, "related")
    )


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that isn't a memory."""
    ids = nodes.select("node_id")
    key = ["source_id", "target_id", "edge_type"]
    a = edges.join(ids, edges["source_id"] == ids["node_id"], "left_anti").select(*key)
    b = edges.join(ids, edges["target_id"] == ids["node_id"], "left_anti").select(*key)
    return a.union(b).distinct()


def node_edges(edges: DataFrame, most: int = 20) -> DataFrame:
    """Each node's strongest links, incoming and outgoing."""
    out = edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("other"), "edge_type", "weight", F.lit("out").alias("direction"))
    into = edges.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("other"), "edge_type", "weight", F.lit("in").alias("direction"))
    w = Window.partitionBy("node_id").orderBy(F.desc("weight"), "other", "edge_type", "direction")
    return out.union(into).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def entity_index(log: DataFrame) -> DataFrame:
    """The latest state of each entity of log(entity_id, at, ...)."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("at"), F.desc("seq"))
    return log.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def chains(edges: DataFrame) -> DataFrame:
    """node_id and chain (smallest id of its component) of linked nodes: least labels with pointer jumping until none
    changes, so the rounds grow with the logarithm of a chain's length; each round is written to the shared folder."""
    e = written(both_ways(edges).select("source_id", "target_id").distinct().toDF("a", "b"), "links")
    label = written(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("f")), "labels")
    while True:
        near = e.join(label.toDF("b", "g"), "b").groupBy("a").agg(F.min("g").alias("g")).toDF("id", "g")
        low = label.join(near, "id").select("id", F.least("f", "g").alias("f"), F.col("f").alias("was"))
        jump = written(low.join(low.select(F.col("id").alias("f"), F.col("f").alias("ff")), "f").select("id", F.least("f", "ff").alias("f"), "was"), "labels")
        if not jump.filter("f <> was").limit(1).count():
            return jump.select(F.col("id").alias("node_id"), F.col("f").alias("chain"))
        label = jump.select("id", "f")
