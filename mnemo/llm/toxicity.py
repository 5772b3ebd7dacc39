"""Toxicity by a chain of linear classifiers.

Categories are predicted in order. Each has a logistic regression over the presence of words and of word beginnings
(3 to 6 bytes, so that inflected forms share evidence) and over the log odds that the earlier categories' models give.
In training those log odds are out-of-fold: each row's come from models that were fitted without its fold. The last
category decides, against the threshold that does best on the out-of-fold predictions.

Models are fitted in one task on a bounded sample of labelled rows: at most max_rows of at most MAX_BYTES in all, the
least by a hash, half of them from rows with the last category as far as there are such; weights undo the unequal
sampling. A labelled text of more than an eighth of those bytes is scored but not fitted on. Every feature in
enough of those rows is counted by category and fold, however common it is; pairs of row and feature are kept only for
what some fit chooses by these counts. Scoring is one pass over the texts with tables of at most a few thousand features
for each category.

Defined cases: a null or empty text has no features and gets the intercepts' probabilities; null labels count as 0;
labelled rows without a text are not used; a category without positive or without negative rows gets a constant
probability; repeated rows are scored each; an empty table gives no rows; other columns are carried along by clean().
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm import scratch, tokens

MAX_ROWS = 6000
MAX_BYTES = 64 << 20
FOLDS = 3
MAX_FEATURES = 2000
LEAST_ROWS = 3
RIDGE = 1e-3
PREFIXES = (3, 4, 5, 6)
SEPARATORS = tokens.SPACES | tokens.PUNCTUATION
_FILTER_BITS = 22
#: Rows counted at a time.
_COUNTED = 250
#: Bytes of text whose features are made at a time.
SLICE = 1 << 19


def features(data: np.ndarray, offs: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features (64-bit) and their texts, by text; known (a bit table) drops others early."""
    b = tokens.FOLD[data]
    w = tokens.words(b, offs, SEPARATORS, fold=False)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(w.first))
    size = w.end - w.start
    keys, of = [w.hash], [text]
    for k in PREFIXES:
        at = np.flatnonzero(size > k)
        if len(at):
            begun = np.zeros(len(at), np.uint64)
            for i in range(k):
                begun = (begun << np.uint64(8)) | b[w.start[at] + i]
            keys.append(tokens.mix(begun + np.uint64(k << 56)))
            of.append(text[at])
    keys, of = np.concatenate(keys), np.concatenate(of)
    if known is not None:
        some = known[cells(keys)]
        keys, of = keys[some], of[some]
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    return keys[first], of[first]


def all_features(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    data, offs = tokens.text_arrays(texts)
    found = []
    for i, j in tokens.slices(offs, SLICE):
        keys, of = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], known)
        found.append((keys, of + i))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


@dataclass
class Linear:
    """Weights of chosen features and of the earlier categories' log odds."""

    keys: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    intercept: float

    def log_odds(self, keys: np.ndarray, of: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        out = np.full(n, self.intercept) + earlier @ self.chain
        if len(self.keys) and len(keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out += np.bincount(of[hit], self.weights[at[hit]], n)
        return np.clip(out, -30, 30)


def cells(keys: np.ndarray) -> np.ndarray:
    """Where each feature falls in a bit table."""
    return (keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def bit_table(keys: np.ndarray) -> np.ndarray:
    known = np.zeros(1 << _FILTER_BITS, bool)
    known[cells(keys)] = True
    return known


def tally(texts: pa.Array, columns: np.ndarray, fold: np.ndarray, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """The features in at least LEAST_ROWS rows and, for each of them and each fold, the sums of the rows' columns."""
    n, width = columns.shape
    seen = np.zeros(1 << _FILTER_BITS, np.int32)
    for i in range(0, n, _COUNTED):
        at, rows = np.unique(cells(all_features(texts.slice(i, _COUNTED))[0]), return_counts=True)
        seen[at] += rows.astype(np.int32)
    often = seen >= LEAST_ROWS  # a cell has at least its features' rows
    uniq, sums = np.zeros(0, np.uint64), np.zeros((0, folds, width))
    for i in range(0, n, _COUNTED):
        keys, of = all_features(texts.slice(i, _COUNTED), often)
        here, at = np.unique(keys, return_inverse=True)
        at = at * folds + fold[i + of]
        both = np.union1d(uniq, here)
        new = np.zeros((len(both), folds, width))
        new[np.searchsorted(both, uniq)] = sums
        place = np.searchsorted(both, here)
        for c in range(width):
            new[place, :, c] += np.bincount(at, columns[i + of, c], len(here) * folds).reshape(-1, folds)
        uniq, sums = both, new
    return uniq, sums


def choose(rows: np.ndarray, positive: np.ndarray, both: np.ndarray, total: float, n: float) -> np.ndarray:
    """The features that tell most: those commoner with the category, by the likelihood-ratio statistic. Of each: rows
    and weight with the category and in all; total, n: the weight of all rows with the category, and of all."""
    term = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0)
    expected = both * total / n if n else both
    g2 = term(positive, expected) + term(both - positive, both - expected)
    g2 += term(total - positive, total - expected) + term(n - total - both + positive, n - total - both + expected)
    good = np.flatnonzero((rows >= LEAST_ROWS) & (positive > expected) & (g2 > 4))
    return np.sort(good[np.argsort(-g2[good], kind="stable")[:MAX_FEATURES]])


def fit_linear(
    uniq: np.ndarray, chosen: np.ndarray, col: np.ndarray, of: np.ndarray, earlier: np.ndarray, y: np.ndarray, weight: np.ndarray
) -> Linear:
    """Ridge logistic regression on the chosen of uniq by accelerated gradient descent. Row of[i] has the feature
    uniq[col[i]]; weight 0: not used."""
    n, k = earlier.shape
    total = weight.sum()
    mean = float((y * weight).sum() / total) if total else 0.0
    if not 0 < mean < 1:
        return Linear(np.zeros(0, np.uint64), np.zeros(0), np.zeros(k), -12.0 if mean <= 0 else 12.0)
    place = np.full(len(uniq), -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    at = place[col]
    hit = at >= 0
    col, row = at[hit], of[hit]
    scale = np.maximum(np.sqrt((earlier**2).mean(0)), 1e-9)
    dense = earlier / scale
    sizes = np.sqrt(1 + np.bincount(row, minlength=n) + (dense**2).sum(1))
    step = 1 / (0.25 * float((sizes**2 * weight).sum() / total) * 4 + RIDGE)
    w, v = np.zeros(len(chosen) + k + 1), np.zeros(len(chosen) + k + 1)
    w[-1] = v[-1] = np.log(mean / (1 - mean))
    m = len(chosen)
    for t in range(400):
        z = v[-1] + dense @ v[m:-1] + np.bincount(row, v[:m][col], n)
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / total
        grad = np.concatenate([np.bincount(col, off[row], m), off @ dense, [off.sum()]])
        grad[:-1] += RIDGE * v[:-1] / 10
        new = v - step * 4 * grad
        v = new + t / (t + 3) * (new - w)
        w = new
    return Linear(uniq[chosen], w[:m], w[m:-1] / scale, float(w[-1]))


@dataclass
class Chain:
    """A fitted chain, its decision threshold and its out-of-fold quality."""

    categories: list[str]
    models: list[Linear]
    threshold: float
    quality: dict = field(default_factory=dict)

    def __post_init__(self):
        self.known = bit_table(np.concatenate([np.zeros(0, np.uint64), *(m.keys for m in self.models)]))

    def predict(self, texts: pa.Array) -> np.ndarray:
        keys, of = all_features(texts, self.known)
        n = len(texts)
        odds = np.zeros((n, 0))
        for m in self.models:
            odds = np.column_stack([odds, m.log_odds(keys, of, n, odds)])
        return 1 / (1 + np.exp(-odds))


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The threshold with the best F1, halfway to the next lower prediction, and that F1; 0.5 without positive rows."""
    if not (y * weight).any():
        return 0.5, 0.0
    order = np.argsort(-p, kind="stable")
    hits, taken = np.cumsum((y * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hits / np.maximum(taken + (y * weight).sum(), 1e-12)
    f1[:-1][p[order][:-1] == p[order][1:]] = -1  # equal predictions go together
    at = int(f1.argmax())
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + below) / 2), float(f1[at])


def fit_rows(texts: list[str] | pa.Array, labels: np.ndarray, weight: np.ndarray, categories: list[str], folds: int = FOLDS) -> Chain:
    """labels: a column of 0 and 1 for each category, in the chain's order."""
    n = len(texts)
    if not n:
        return Chain(categories, [Linear(np.zeros(0, np.uint64), np.zeros(0), np.zeros(i), -12.0) for i in range(len(categories))], 0.5)
    # Counted first, kept second: most features tell nothing, and those in very many rows have most of the pairs.
    texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    fold = np.arange(n) % folds
    used = np.column_stack([weight > 0, weight, labels * weight[:, None]]).astype(float)
    keys, sums = tally(texts, used, fold, folds)
    totals = np.stack([used[fold == f].sum(0) for f in range(folds)])
    chosen = []
    for k in range(len(categories)):
        for f in range(folds + 1):  # without each fold, and last on all rows
            inside = np.arange(folds) != f
            rows, both, positive = (sums[:, inside, c].sum(1) for c in (0, 1, 2 + k))
            chosen.append(choose(rows, positive, both, totals[inside, 2 + k].sum(), totals[inside, 1].sum()))
    some = np.unique(np.concatenate(chosen))
    uniq, chosen = keys[some], [np.searchsorted(some, x) for x in chosen]
    del keys, sums
    keys, of = all_features(texts, bit_table(uniq))
    hit = np.isin(keys, uniq)
    col, of = np.searchsorted(uniq, keys[hit]).astype(np.int32), of[hit].astype(np.int32)
    del keys
    odds = np.zeros((n, 0))
    models = []
    for k in range(len(categories)):
        y, out = labels[:, k].astype(float), np.zeros(n)
        *without, every = chosen[k * (folds + 1) : (k + 1) * (folds + 1)]
        for f in range(folds):
            inside = fold != f
            m = fit_linear(uniq, without[f], col, of, odds, y, weight * inside)
            known = np.isin(uniq, m.keys)[col]
            out[~inside] = m.log_odds(uniq[col[known]], of[known], n, odds)[~inside]
        models.append(fit_linear(uniq, every, col, of, odds, y, weight))
        odds = np.column_stack([odds, out])
    threshold, f1 = best_threshold(1 / (1 + np.exp(-odds[:, -1])), labels[:, -1].astype(float), weight)
    return Chain(categories, models, threshold, {"out_of_fold_f1": f1, "rows": n})


def fit(labelled: DataFrame, categories: list[str], max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Chain:
    """A chain from labelled(doc_id, text, one column of 0 and 1 for each category)."""
    scratch.ship_code(labelled.sparkSession)
    text = F.col("text").cast("string")
    flags = [F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(f"y{k}") for k, c in enumerate(categories)]
    rows = labelled.filter("text is not null").select(F.xxhash64("doc_id", "text").alias("h"), F.octet_length(text).alias("size"), text.alias("text"), *flags)
    rows = rows.filter(F.col("size") <= max_bytes // 8)  # else one text could take a whole half's share
    rows = scratch.materialise(rows, "labelled")  # the documents are read for them once
    last = f"y{len(categories) - 1}"
    counts = {r[0]: r["n"] for r in rows.groupBy(F.col(last) == 1).agg(F.count("*").alias("n")).collect()}
    parts = []
    positive = min(counts.get(True, 0), max_rows // 2)
    for value, most in ((True, positive), (False, max_rows - positive)):
        part = rows.filter((F.col(last) == 1) == value)
        sizes = [(r["h"], r["size"]) for r in part.select("h", "size").orderBy("h").limit(most).collect()] if most else []
        fits = np.cumsum([s for _, s in sizes]) <= max_bytes // 2
        if fits.any():
            most = int(fits.sum())
            found = part.filter(F.col("h") <= sizes[most - 1][0]).drop("size").limit(most)
            parts.append(found.withColumn("weight", F.lit(float(counts[value] / most))))
    if not parts:
        return fit_rows([], np.zeros((0, len(categories)), np.int64), np.zeros(0), categories)
    sample = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def fit_sample(found: pa.Table) -> pa.Table:
        found = found.combine_chunks().sort_by("h")
        labels = np.column_stack([found[f"y{k}"].to_numpy() for k in range(len(categories))]).astype(np.int64)
        chain = fit_rows(found["text"].combine_chunks(), labels, found["weight"].to_numpy(), categories)
        return pa.table({"model": pa.array([pickle.dumps(chain)], pa.binary())})

    # The sample, bounded in rows and bytes, meets in one task: the driver sees hashes, sizes and the model, never a text.
    return pickle.loads(sample.withColumn("all", F.pmod("h", F.lit(1))).groupBy("all").applyInArrow(fit_sample, "model binary").first()["model"])


def score(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    """doc_id, a probability for each category, toxic."""
    for batch in batches:
        p = chain.predict(batch.column("text"))
        columns = [batch.column("doc_id"), *(pa.array(x) for x in p.T), pa.array(p[:, -1] >= chain.threshold)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"p_{c}" for c in chain.categories), "toxic"])
        del batch, columns
        tokens.release()


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, a probability p_<category> each, toxic (boolean: the last one reaches the threshold)."""
    own = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {own}, " + ", ".join(f"`p_{c}` double" for c in chain.categories) + ", toxic boolean"
    scratch.ship_code(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lambda b: score(b, chain), schema)


def clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of docs that aren't toxic, all columns: one pass over docs, no shuffle."""
    return scratch.keep_rows(docs, lambda texts, _: chain.predict(texts)[:, -1] < chain.threshold, F.lit(0.0))
