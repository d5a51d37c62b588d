"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in Spark tasks.  The trees are grown on
histograms of binned statistics of a bounded sample of labelled documents, and
flattened into arrays (feature, threshold, leaf value by tree and node), so that
a batch of documents descends all trees level by level in numpy.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import per_batch
from .common import materialize, pick
from .langid import held_out

#: Labelled documents the trees are grown on, at most; those of the smallest hashes.
SAMPLE_DOCS = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 60, 4, 32, 0.2, 1.0, 5.0

STATISTICS = ("log_bytes", "log_words", "log_lines", "word_length", "longest_word", "distinct_words", "top_word", "top_word_2",
              "distinct_lines", "repeated_bytes", "upper", "digits", "spaces", "punctuation", "pipes", "exclamations", "sentence_marks",
              "symbols", "non_ascii", "entropy", "words_with_marks", "words_a_line", "capital_words", "distinct_pairs")

_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_PUNCT = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_MARKS = np.isin(np.arange(256), [ord(c) for c in ".,;:?"])


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of a whole text; all of an empty or null one are 0."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    b = np.frombuffer(raw, np.uint8)
    hist = np.bincount(b, minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    w = len(words)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(2)] + [0, 0]
    line_counts = Counter(lines)
    p = hist[hist > 0] / n
    marked = sum(not x[-1:].isalnum() and x[-1] < 128 for x in words)
    return [math.log1p(n), math.log1p(w), math.log1p(len(lines)), (n - len(lines) - w + 1) / max(1, w),
            math.log1p(max(map(len, counts), default=0)), len(counts) / max(1, w), top[0] / max(1, w), top[1] / max(1, w),
            len(line_counts) / len(lines), sum(len(k) * (c - 1) for k, c in line_counts.items()) / n,
            hist[_UPPER].sum() / n, hist[_DIGIT].sum() / n, hist[_SPACE].sum() / n, hist[_PUNCT].sum() / n, hist[124] / n, hist[33] / n,
            hist[_MARKS].sum() / n, (hist[_PUNCT].sum() - hist[_MARKS & _PUNCT].sum()) / n, hist[128:].sum() / n,
            float(-(p * np.log2(p)).sum()), marked / max(1, w), w / len(lines), sum(x[:1].isupper() for x in words) / max(1, w),
            len(set(zip(words, words[1:]))) / max(1, w - 1)]


class Trees:
    """Complete binary trees as arrays: node i of a level has children 2i+1 and 2i+2."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - (2 ** DEPTH - 1)]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees boosted for the logistic loss on histograms of ``BINS`` quantile bins.

    Without a row, or with one label only, the trees are constant.
    """
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    n, m = x.shape
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # bin k: up to edge k
    cell = bins + np.arange(m) * BINS
    features = np.zeros((TREES, inner), np.int64)
    thresholds = np.full((TREES, inner), np.inf)
    values = np.zeros((TREES, leaves))
    total = np.full(n, base)
    for tree in range(TREES):
        p = 1.0 / (1.0 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            width, first = 2 ** depth, 2 ** depth - 1
            at = ((node - first)[:, None] * (m * BINS) + cell).ravel()
            gh, hh = (np.bincount(at, np.repeat(v, m), width * m * BINS).reshape(width, m, BINS).cumsum(axis=2) for v in (g, h))
            gt, ht = gh[:, :, -1:], hh[:, :, -1:]
            gain = gh ** 2 / (hh + L2) + (gt - gh) ** 2 / (ht - hh + L2) - gt ** 2 / (ht + L2)
            gain[(hh < LEAST / 4) | (ht - hh < LEAST / 4)] = -np.inf
            gain[:, :, -1] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            for i, k in enumerate(best):
                if gain.reshape(width, -1)[i, k] > 1e-9:
                    features[tree, first + i] = k // BINS
                    thresholds[tree, first + i] = edges[k // BINS, k % BINS]
            node = 2 * node + 1 + (x[np.arange(n), features[tree, node]] > thresholds[tree, node])
        leaf = node - inner
        values[tree] = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        total += values[tree][leaf]
    return Trees(features, thresholds, values, base)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and an array of STATISTICS for every row of ``docs`` (doc_id, text)."""
    def start() -> Callable:
        return lambda cols: [cols[0], [statistics(t) for t in cols[1]]]
    return per_batch(pick(docs, "doc_id", "text"), "doc_id long, x array<double>", start)


def fit(docs: DataFrame, labels: DataFrame) -> Trees:
    """Trees grown on at most SAMPLE_DOCS labelled documents that are not held out.

    A doc_id labelled more than once counts by the majority, ties as 1; null
    labels are ignored.  Of rows that repeat a doc_id one is used.
    """
    y = pick(labels, "doc_id", "quality").filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = y.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    chosen = materialize(chosen, "quality-sample")
    texts = pick(docs, "doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")  # SAMPLE_DOCS rows
    rows = measured(texts).groupBy("doc_id").agg(F.min("x").alias("x")).join(chosen, "doc_id").orderBy("doc_id").collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, len(STATISTICS))
    return grow(x, np.array([r["y"] for r in rows], float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text).

    score is the probability that ``labels`` (doc_id, quality) mark the text with
    1, by its statistics alone; null and empty texts score by statistics of 0,
    and without labels every score is the same.  Repeated rows each get their row,
    a null doc_id is not held out, an empty table gives an empty result, other
    columns are left aside.
    """
    trees = fit(docs, labels)

    def start() -> Callable:
        def run(cols: list[list]) -> list:
            ids, out, texts = cols
            x = np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))
            p = trees.score(x)
            return [ids, out, p.tolist(), (p >= 0.5).astype(int).tolist()]
        return run

    d = pick(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), "text")
    return per_batch(d, "doc_id long, held_out boolean, score double, predicted int", start)
