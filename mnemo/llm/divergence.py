"""Which sources of a language differ most, and by which terms: exact integer divergence of term frequencies.

Documents are counted into (language, source, term) once, pre-aggregated in the tasks that read them. The terms of a
language that enough of its documents hold are dealt by hash to blocks; a block and its sources make a dense tile of
int64 counts, one row a source and one column a term. In a tile, all pairs of sources are compared by broadcasting one
row against the others, and each source keeps a heap of its most overrepresented terms. Partial pair sums are added up
over blocks, heaps are merged by a window. A language with more sources than a tile has rows is dealt to groups of
sources as well, of which every two meet in a task, so that no tile outgrows its bounds.

Defined cases: null texts, languages and sources count as empty strings; a source without terms takes part with counts
of 0; a language without kept terms has pairs of value 0 and no terms; one with a single source has no pairs; repeated
rows count each; an empty table gives no rows; other columns are not read. Terms are told apart by 64-bit hashes within
a slice of text (of up to eight bytes: exactly), by their bytes everywhere else. Totals must stay below 9 * 10^15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemo.llm import scratch, tokens

#: Documents that a kept term is in at least, terms reported for each source.
MIN_DOCS, TOP_TERMS = 10, 10
UNIT, SMOOTH = 1_000_000_000, 2
#: Columns and rows of a tile, cells compared at a time, bytes of text counted at a time.
TERMS, SOURCES, CELLS, SLICE = 2048, 512, 1 << 20, 6 << 20
#: Bytes of no term: all of ASCII but letters.
BREAKS = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])
COUNTS = "lang string, source string, term string, n long, docs long"
TILES = "part string, source string, item string, value long, lang string"


def count_slice(data: np.ndarray, offs: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """group, term, occurrences and documents of the terms of some texts, of which each is in a group."""
    w = tokens.words(data, offs, BREAKS)
    doc = np.repeat(np.arange(len(group)), np.diff(w.first))
    order = np.lexsort((w.hash, doc))
    h, d = w.hash[order], doc[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, np.int64)
    times, h, at = np.diff(np.r_[new, len(h)]), h[new], order[new]
    g = group[doc[at]]
    order = np.lexsort((h, g))
    h, g, times, at = h[order], g[order], times[order], at[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.zeros(0, np.int64)
    n = np.add.reduceat(times, new) if len(new) else times
    raw = tokens.FOLD[data].tobytes()
    first = at[new]
    terms = [raw[s:e] for s, e in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
    return g[new], terms, n, np.diff(np.r_[new, len(h)])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = tokens.text_arrays(batch.column("text"))
        pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
        number = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
        names, group = list(number), np.array([number[p] for p in pairs], np.int64)
        for i, j in tokens.slices(offs, SLICE):
            g, terms, n, docs = count_slice(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], group[i:j])
            name = lambda k: pa.array([x[k] for x in names], pa.string()).take(pa.array(g))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [name(0), name(1), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        tokens.release()


def rates(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * count / total) for count <= total, in three steps of a thousand that can't overflow."""
    q, r = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(3):
        r = r * 1000
        q = q * 1000 + r // total
        r = r % total
    return q + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def compare_tile(key: tuple, rows: pa.Table, top: int) -> pa.Table:
    """One block of terms and one or two groups of sources: partial sums of pairs, and each source's best terms.

    Rows without term are the sources, those with one the counts.
    """
    lang, _, a, b = (x.as_py() for x in key)
    is_source = rows.column("term").is_null()
    border = rows.filter(is_source).sort_by([("part", "ascending"), ("gid", "ascending")])
    gids, part = border.column("gid").to_numpy(), border.column("part").to_numpy()
    names, own, vocabulary = border.column("source").to_pylist(), border.column("own").to_numpy(), border.column("v").to_numpy()
    counts = rows.filter(rows.column("term").is_valid())
    words = counts.column("term").combine_chunks().dictionary_encode()
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    terms = words.dictionary
    order = pa.compute.sort_indices(terms).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    terms = terms.take(pa.array(order))
    column = place[words.indices.to_numpy(zero_copy_only=False)] if len(order) else np.zeros(0, np.int64)
    # One column more stands for the block's terms that none of these sources has.
    weight = np.ones(len(terms) + 1, np.int64)
    weight[-1] = border.column("terms")[0].as_py() - len(terms)
    tile, totals = np.zeros((len(gids), len(weight)), np.int64), np.zeros(len(terms), np.int64)
    sorted_gids = np.argsort(gids)
    tile[sorted_gids[np.searchsorted(gids[sorted_gids], counts.column("gid").to_numpy())], column] = counts.column("n").to_numpy()
    totals[column] = counts.column("total").to_numpy()
    p = rates(tile + SMOOTH, (own + SMOOTH * vocabulary)[:, None])
    lefts, rights, sums = [], [], []
    for i in np.flatnonzero(part == a):
        others = np.arange(i + 1, len(gids)) if a == b else np.flatnonzero(part == b)
        step = max(1, CELLS // len(weight))
        for j in range(0, len(others), step):
            some = others[j : j + step]
            sums.append((gap(p[i], p[some]) * weight).sum(1))
            lefts.append(np.full(len(some), i))
            rights.append(some)
    left, right, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lefts, rights, sums))
    out = [["pair"] * len(left), [names[i] for i in left], [names[i] for i in right], value.tolist()]
    if a == b and len(terms):
        q = rates(totals + SMOOTH, border.column("all").to_numpy()[:1] + SMOOTH * vocabulary[:1])
        for i, name in enumerate(names):
            more = np.flatnonzero((tile[i, :-1] > 0) & (p[i, :-1] > q))
            f = gap(p[i, more], q[more])
            best = np.lexsort((more, -f))[:top]
            for x, y in zip((["term"] * len(best), [name] * len(best), terms.take(pa.array(more[best])).to_pylist(), f[best].tolist()), out, strict=True):
                y.extend(x)
    return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()),
                     pa.array(out[3], pa.int64()), pa.array([lang] * len(out[0]), pa.string())], names=["part", "source", "item", "value", "lang"])


def to_tiles(rows: DataFrame) -> DataFrame:
    """rows once for every other group of sources of the language: a and b are the groups that meet, a <= b."""
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    rows = rows.select("*", other)
    return rows.withColumns({"a": F.least("part", "other"), "b": F.greatest("part", "other")}).drop("other", "parts")


def audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block_terms: int = TERMS, block_sources: int = SOURCES
) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item (a source or term), value, rank, for docs(text, lang, source)."""
    spark = docs.sparkSession
    scratch.ship_code(spark)
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(read("lang"), read("source"), read("text"))
    counts = rows.mapInArrow(count_terms, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = scratch.materialise(counts, "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    counts = scratch.materialise(counts.drop("docs").join(kept.drop("docs"), ["lang", "term"]), "kept-counts")
    # Nothing below is marked for broadcast: the planner sees the sizes of these written tables, and decides by them.
    groups = rows.groupBy("lang", "source").agg(F.lit(0).alias("none")).drop("none")
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    numbered = groups.join(own, ["lang", "source"], "left").na.fill(0, ["own"])
    numbered = numbered.withColumn("gid", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    numbered = scratch.materialise(numbered, "term-sources")
    terms = counts.groupBy("lang", "term").agg(F.max("total").alias("total"))
    terms = scratch.materialise(terms, "terms")
    totals = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    langs = numbered.groupBy("lang").agg(F.count("*").alias("sources")).join(totals, "lang", "left").na.fill(0, ["v", "all"])
    langs = scratch.materialise(
        langs.select("lang", "v", "all", F.greatest(F.ceil(F.col("v") / block_terms), F.lit(1)).cast("int").alias("blocks"),
                     F.ceil(F.col("sources") / block_sources).cast("int").alias("parts")), "term-langs"
    )
    part, block = F.pmod("gid", "parts").cast("int"), F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block")
    held = terms.join(langs.select("lang", "blocks"), "lang").groupBy("lang", block).agg(F.count("*").alias("terms"))
    numbers = numbered.select("lang", "source", "gid")
    cells = counts.join(numbers, ["lang", "source"]).join(langs.select("lang", "blocks", "parts"), "lang").select(
        "lang", block, "parts", part.alias("part"), "gid", "term", "n", "total",
        *(F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("own", "long"), ("v", "long"), ("all", "long"), ("terms", "long"))),
    )
    border = numbered.join(langs, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "parts", part.alias("part"), "gid",
        F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"), "source", "own", "v", "all",
    ).join(held, ["lang", "block"], "left").na.fill(0, ["terms"])
    tiles = to_tiles(cells.unionByName(border)).groupBy("lang", "block", "a", "b").applyInArrow(lambda k, t: compare_tile(k, t, top), TILES)
    tiles = scratch.materialise(tiles, "term-tiles")
    sums = tiles.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value")
    pairs = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda t: t.withColumn("rank", F.row_number().over(best).cast("int"))
    heaps = tiles.filter("part = 'term'").select("lang", "source", "part", "item", "value")
    return ranked(pairs).unionByName(ranked(heaps).filter(F.col("rank") <= top))
