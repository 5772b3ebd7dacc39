"""Temporal list join: captures against the list entries that were active when each was fetched.

Dated list changes (an entry is added, later removed, perhaps added again) become validity intervals, one window pass
over the list. An entry names a host; it covers that host and every host below it. Hosts are matched once each, however
many captures they have: the distinct hosts' suffixes meet the entries in an equi-join, each host keeps its intervals
in time order, and a capture looks up its fetch time among its host's intervals. A host with a third of all captures
therefore costs one row of matching. In the last join, hosts with more than a thousandth of all captures, of which there
are less than a thousand, are broadcast, and only the others' captures are shuffled by host.

Defined cases: a null URL or one without a host, and a null fetch time match nothing and are not blocked; equal changes
repeated count once; of changes to an entry at the same instant a removal wins; a change before any addition that
removes does nothing; intervals are closed at their begin and open at their end; repeated captures are evaluated each;
an empty list blocks nothing; an empty table gives no rows. Columns of captures other than the named three are kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemo.llm import scratch

#: A host with more than one in so many captures is hot.
HOT = 1000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without a final dot; null if it has none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(F.length(host) > 0, host)


def suffixes(host: Column) -> Column:
    """The host and every host above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(changes: DataFrame) -> DataFrame:
    """entry, category, valid_from, valid_to (null: still listed) from changes(entry, category, action, changed_at)."""
    clean = (
        changes.filter("entry is not null and changed_at is not null and action in ('add', 'remove')")
        .groupBy(F.lower("entry").alias("entry"), F.coalesce("category", F.lit("")).alias("category"), "changed_at")
        .agg(F.max("action").alias("action"))  # 'remove' is the greater
    )
    order = Window.partitionBy("entry", "category").orderBy("changed_at")
    turns = clean.withColumn("before", F.lag("action").over(order)).filter(~F.col("action").eqNullSafe(F.col("before")))
    return (
        turns.withColumn("valid_to", F.lead("changed_at").over(order))
        .filter("action = 'add'")
        .select("entry", "category", F.col("changed_at").alias("valid_from"), "valid_to")
    )


def evaluate(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """capture_id, host, fetched_at, n_active, entries (array, sorted), blocked for captures(capture_id, url, fetched_at)."""
    seen = captures.select("capture_id", host_of(F.col("url")).alias("host"), "fetched_at")
    hosts = seen.filter("host is not null").groupBy("host").agg(F.count("*").alias("n"))
    span = F.when(F.col("valid_from").isNotNull(), F.struct("valid_from", "valid_to", "entry", "category"))
    listed = (
        hosts.withColumn("entry", F.explode(suffixes(F.col("host"))))
        .join(intervals(changes), "entry", "left")
        .groupBy("host", "n")
        .agg(F.sort_array(F.collect_list(span)).alias("spans"))
    )
    listed = scratch.materialise(listed, "listed-hosts")
    hot = listed.filter(F.col("n") * HOT > captures.count()).drop("n")  # less than HOT rows, listed or not
    met = seen.join(F.broadcast(hot), "host")
    rest = seen.filter("host is not null").join(F.broadcast(hot.select("host")), "host", "left_anti")
    rest = rest.join(listed.filter(F.size("spans") > 0).drop("n"), "host", "left")
    nowhere = seen.filter("host is null").withColumn("spans", F.lit(None).cast(listed.schema["spans"].dataType))
    joined = met.unionByName(rest).unionByName(nowhere)
    active = F.filter(
        "spans",
        lambda s: (s["valid_from"] <= F.col("fetched_at")) & (s["valid_to"].isNull() | (F.col("fetched_at") < s["valid_to"])),
    )
    return (
        joined.withColumn("active", F.coalesce(active, F.array().cast("array<struct<valid_from:timestamp,valid_to:timestamp,entry:string,category:string>>")))
        .select(
            "capture_id", "host", "fetched_at",
            F.size("active").cast("long").alias("n_active"),
            F.array_sort(F.transform("active", lambda s: F.concat_ws(":", s["category"], s["entry"]))).alias("entries"),
            (F.size("active") > 0).alias("blocked"),
        )
    )
