"""Connected components of links in the shared folder: hooking and pointer jumping, a few joins a round."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm import scratch


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id that links reach) of every end of edges(a long, b long).

    Each round hangs a node, and the node it hangs on, below the least grandparent among its neighbours; rounds grow
    with the logarithm of the longest chain. A hub's rows meet in sums only (least values), which combine before they
    are shuffled, and in joins whose skewed side adaptive execution can split.
    """
    both = edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = scratch.materialise(both.distinct(), "links")
    state = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("f"))
    state = scratch.materialise(state, "labels")
    while True:
        up = state.select(F.col("id").alias("f"), F.col("f").alias("g"))
        far = state.join(up, "f")  # id, f, g
        near = links.join(far.select(F.col("id").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("m"))
        each = far.join(near.withColumnRenamed("a", "id"), "id")
        hung = each.groupBy(F.col("f").alias("id")).agg(F.min("m").alias("h"))
        new = each.join(hung, "id", "left").select("id", F.least("g", "m", F.coalesce("h", "g")).alias("f"), F.col("f").alias("was"))
        new = scratch.materialise(new, "labels")
        if not new.filter("f <> was").limit(1).count():
            return new.select("id", F.col("f").alias("component"))
        state = new.select("id", "f")


def least_values(roots: DataFrame, values: DataFrame, salts: int = 16) -> DataFrame:
    """id, component and top (the least value of the component) for roots(id, component) and values(id, value).

    A component may hold a third of all ids: its least value meets them in salted parts.
    """
    j = roots.join(values, "id")
    tops = j.groupBy("component").agg(F.min("value").alias("top"))
    spread = tops.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = j.select("id", "component", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    return own.join(spread, ["component", "salt"]).select("id", "component", "top")


def unite(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position that the pairs (a, b) reach from each of n."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
