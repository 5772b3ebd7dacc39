"""Runs of words that repeat periodically in a text, by the algorithm of Kolpakov and Kucherov.

A run is a stretch of at least max(min_words, 2 * q) words in which words q apart are equal, q being its smallest
period, and which no neighbouring word extends. For each stretch of words that can hold runs: a suffix automaton gives
the factorisation into longest parts that occurred earlier (occurrences may overlap); Main's algorithm finds, at each
border of factors, the runs that cross or touch it and end in the factor after it; runs inside a factor are copied from
its earlier occurrence. All of this is linear in the words.

Which words can be in a run is found for many texts at once: every word of a run is in a window of min_words // 2 words
that occurs again in the run, for the run's halves (or more) repeat each other. Words in no window that recurs in their
text therefore end stretches; the rest is looked at again, stretch by stretch, until nothing changes. Stretches in which
no window repeats cost no more than hashing and sorting their words. Hashes only choose stretches; words are compared
by their bytes.

Collapsing drops, of each run, all words after its first period, and joins the others by a space.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; a null doc_id and repeated rows
are documents like others; very long texts take memory in proportion to their longest stretch that repeats; an empty
table gives no rows; other columns come back as they are.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm import scratch, tokens

MIN_WORDS = 12
SLICE = 2 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Automaton:
    """Suffix automaton of a sequence of numbers. Most states have one way on, kept in arrays; others are in a dict."""

    def __init__(self, w: list[int]):
        n = 2 * len(w) + 1
        self.letter, self.target = array("q", [-1]) * n, array("i", [0]) * n
        self.others: dict[int, dict[int, int]] = {}
        link, length, first = array("i", [-1]) * n, array("i", [0]) * n, array("i", [-1]) * n
        letter, target, others = self.letter, self.target, self.others
        size, last = 1, 0
        for i, c in enumerate(w):
            cur = size
            size += 1
            length[cur] = i + 1
            first[cur] = i
            p = last
            while p >= 0:
                if letter[p] < 0:
                    letter[p], target[p] = c, cur
                elif letter[p] == c or (p in others and c in others[p]):
                    break
                else:
                    others.setdefault(p, {})[c] = cur
                p = link[p]
            if p < 0:
                link[cur] = 0
            else:
                q = target[p] if letter[p] == c else others[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    copy = size
                    size += 1
                    length[copy], link[copy], first[copy] = length[p] + 1, link[q], first[q]
                    letter[copy], target[copy] = letter[q], target[q]
                    if q in others:
                        others[copy] = dict(others[q])
                    while p >= 0:
                        if letter[p] == c:
                            if target[p] != q:
                                break
                            target[p] = copy
                        else:
                            ways = others.get(p)
                            if ways is None or ways.get(c) != q:
                                break
                            ways[c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        self.first = first

    def step(self, state: int, c: int) -> int:
        return self.target[state] if self.letter[state] == c else self.others[state][c]


def factorise(w: list[int]) -> list[tuple[int, int, int]]:
    """(begin, length, begin of an earlier occurrence or -1) of each factor: the longest that also begins earlier."""
    a, out, b, n = Automaton(w), [], 0, len(w)
    first, step = a.first, a.step
    while b < n:
        state, i = 0, b
        while i < n:
            to = step(state, w[i])
            if first[to] >= i:
                break
            state, i = to, i + 1
        size = i - b
        out.append((b, size, first[state] - size + 1) if size else (b, 1, -1))
        b += size or 1
    return out


def matches(s: list[int]) -> list[int]:
    """Z function: how many numbers from each place equal those from the beginning."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def runs_at(w: list[int], b: int, left: int, right: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Main: (start, end, period) of runs within w[left:right] that cross or touch b, of at least `least` words."""
    u, v = w[left:b], w[b:right]
    n, nu, nv = len(w), len(u), len(v)
    u_back = u[::-1]
    after = [*matches(v), 0]  # common beginnings of v and v[q:]
    both = matches([*v, -1, *u, *v])  # of v and what begins anywhere in u + v
    back = [*matches(u_back), 0]  # common ends of u and u[:-q]
    back_both = matches([*u_back, -1, *v[::-1], *u_back])  # of u and what ends anywhere in u + v
    for q in range(1, nv + 1):  # a period right of b
        s, e = b - back_both[nu + 1 + nv - q], b + q + after[q]
        if e - s >= max(least, 2 * q):
            yield s, e, q
    for q in range(1, nu + 1):  # a period left of b
        s, e = b - q - back[q], b + (both[nv + 1 + nu - q] if nv else 0)
        e = min(e, b + nv)
        if e - s >= max(least, 2 * q):
            yield s, e, q


def find_runs(w: list[int], least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of w with at least max(least, 2 * period) words, by start and period."""
    n = len(w)
    factors = [*factorise(w), (n, 0, -1)]
    found: dict[tuple[int, int], int] = {}
    ends: dict[int, list[int]] = {}

    def add(s: int, e: int, q: int) -> None:
        if (s, e) not in found:
            ends.setdefault(s, []).append(e)
            found[s, e] = q
        elif q < found[s, e]:
            found[s, e] = q

    for i in range(1, len(factors)):
        b, size, source = factors[i]
        before = factors[i - 1][1]
        # A run that ends in a factor begins less than a period before the last factor, for that would else be longer.
        if 2 * (size + before) > least:
            left, right = max(0, b - size - 2 * before), b + size
            for s, e, q in runs_at(w, b, left, right, least):
                if (s == left and s and w[s - 1] == w[s - 1 + q]) or (e == right and e < n and w[e] == w[e - q]):
                    continue  # goes on beyond the window: belongs to another border
                add(s, e, q)
        if source >= 0 and size > least:
            away, stop = b - source, source + size
            for s in range(source + 1, stop - least):
                for e in ends.get(s, ()):
                    if e < stop:
                        add(s + away, e + away, found[s, e])
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def stretches(h: np.ndarray, part: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of words, given by hashes, that can hold runs; none spans two parts (ascending)."""
    window = max(1, least // 2)
    at = np.arange(len(h))
    while len(at) >= least:
        g, p = h[at], part[at]
        n = len(at) - window + 1
        same = p[:n] == p[window - 1 :]
        acc = p[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(window):
            acc = tokens.mix(acc ^ g[k : k + n])
        some = np.flatnonzero(same)
        order = some[np.argsort(acc[some], kind="stable")]
        equal = acc[order[1:]] == acc[order[:-1]]
        again = order[np.r_[False, equal] | np.r_[equal, False]] if len(order) else order
        edge = np.zeros(len(at) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + window, -1)
        covered = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        # A part ends where words were left out, or where it ended before.
        new = np.flatnonzero(np.r_[True, (np.diff(covered) > 1) | (np.diff(p[covered]) != 0)]) if len(covered) else covered
        size = np.diff(np.r_[new, len(covered)])
        stays = np.repeat(size >= least, size)
        done = len(covered) == len(at) and stays.all() and len(new) == len(np.unique(p))
        at = at[covered[stays]]
        begins = np.r_[np.repeat(np.arange(len(new)), size)[stays]] if len(covered) else covered
        part = part.copy()
        part[at] = begins
        if done:
            break
    if len(at) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p = part[at]
    new = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    return at[new], at[np.r_[new[1:], len(at)] - 1] + 1


def slice_runs(data: np.ndarray, offs: np.ndarray, least: int) -> tuple[list[list[dict]], list[bytes]]:
    """Runs and collapsed text of each of some texts."""
    w = tokens.words(data, offs, fold=False)
    count = np.diff(w.first)
    begin, end = stretches(w.hash, np.repeat(np.arange(len(count)), count), least)
    doc = np.searchsorted(w.first, begin, "right") - 1
    found: list[list[dict]] = [[] for _ in count]
    raw = data.tobytes()
    for d, x, y in zip(doc.tolist(), begin.tolist(), end.tolist(), strict=True):
        number: dict[bytes, int] = {}
        ids = [number.setdefault(raw[s:e], len(number)) for s, e in zip(w.start[x:y].tolist(), w.end[x:y].tolist(), strict=True)]
        x -= int(w.first[d])
        found[d] += [{"start": x + s, "length": e - s, "period": q} for s, e, q in find_runs(ids, least)]
    texts = []
    for d, some in enumerate(found):
        parts = raw[offs[d] : offs[d + 1]].split()
        if some:
            gone = np.zeros(len(parts) + 1, np.int64)
            for r in some:
                gone[r["start"] + r["period"]] += 1
                gone[r["start"] + r["length"]] -= 1
            parts = [x for x, g in zip(parts, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
        texts.append(b" ".join(parts))
    return found, texts


def collapse(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """docs(text, ...), all columns in a struct doc, with runs (start, length and period in words) and collapsed text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tokens.text_arrays(pa.compute.struct_field(batch.column("doc"), "text"))
            for i, j in tokens.slices(offs, SLICE):
                found, texts = slice_runs(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], least)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(i, j - i), pa.array(found, pa.list_(RUN)), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["doc", "runs", "collapsed"],
                )
            tokens.release()

    scratch.ship_code(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("doc"))
    schema = rows.limit(0).select("doc", F.expr("array(struct(0L as start, 0L as length, 0L as period))").alias("runs"), F.lit("").alias("collapsed")).schema
    return rows.mapInArrow(each, schema)
