"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once and written.  Trees are grown in numpy from
binned statistics of a bounded, hash-chosen sample of labelled rows (``MAX_TRAIN_ROWS``); splits
come from gradient histograms.  The trees are flattened into arrays of feature, threshold and
child, so that a batch of rows walks all trees level by level in vectorised numpy.

Edge cases: a null text counts as empty and its statistics are zeros; null labels and labels of
unknown documents are not used, a document labelled twice counts by the mean of its labels (good
from one half up); without labels of both kinds the score is the share of good ones, or one half;
repeated rows get the same score; a null doc_id is never trained on and not held out; an empty
table gives no rows; extra columns are not used.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm import common

#: Labelled rows that the trees are grown from, at most; chosen by hash.
MAX_TRAIN_ROWS = 40_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_HESSIAN = 60, 4, 64, 0.15, 1.0, 2.0
GOOD = 0.7
FEATURES = ["log_words", "word_length", "word_length_sd", "distinct_share", "top_share", "next_same_share",
            "repeat_share", "log_lines", "line_words", "dup_line_share", "upper_share", "digit_share", "mark_share",
            "symbol_share", "end_mark_share", "bare_mark_share", "blank_share", "title_share"]

_UPPER, _DIGIT = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"\d")
_MARK, _SYMBOL = re.compile(r"[^\w\s]"), re.compile(r"[#*$%&|<>{}\\^~=@_]")


def statistics(text: str) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip()]
    shingles = Counter(zip(words, words[1:], words[2:]))
    chars = len(text)
    last = [w[-1] for w in words]
    return [
        np.log1p(n), lengths.mean(), lengths.std(), len(counts) / n, max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n, (max(0, n - 2) - len(shingles)) / n, np.log1p(len(lines)),
        n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(_UPPER.findall(text)) / chars,
        len(_DIGIT.findall(text)) / chars, len(_MARK.findall(text)) / chars, len(_SYMBOL.findall(text)) / chars,
        sum(not c.isalnum() for c in last) / n, sum(len(w) == 1 and not w.isalnum() for w in counts.elements()) / n,
        1 - int(lengths.sum()) / chars, sum(map(str.istitle, words)) / n]


class Trees:
    """Boosted trees in flat arrays: node -> feature, threshold, left child (right is next), value."""

    def __init__(self, base: float):
        self.base, self.roots = base, []
        self.feature, self.threshold, self.left, self.value = [], [], [], []

    def raw(self, x: np.ndarray) -> np.ndarray:
        feature, threshold = np.array(self.feature, np.int32), np.array(self.threshold)
        left, value = np.array(self.left, np.int32), np.array(self.value)
        out = np.full(len(x), self.base)
        if not self.roots or not len(x):
            return out
        at = np.tile(np.array(self.roots, np.int32), (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            f = feature[at]
            inner = f >= 0
            over = x[rows, np.maximum(f, 0)] > threshold[at]
            at = np.where(inner, left[at] + over, at)
        return out + value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _grow(model: Trees, binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Add one tree; the raw change of each row."""
    change = np.zeros(len(grad))

    def node() -> int:
        for part, empty in ((model.feature, -1), (model.threshold, 0.0), (model.left, -1), (model.value, 0.0)):
            part.append(empty)
        return len(model.feature) - 1

    model.roots.append(node())
    open_nodes = [(model.roots[-1], np.arange(len(grad)), 0)]
    while open_nodes:
        at, rows, depth = open_nodes.pop()
        g, h = grad[rows], hess[rows]
        best = (1e-6, -1, -1)
        if depth < DEPTH and h.sum() >= 2 * LEAST_HESSIAN:
            base = g.sum() ** 2 / (h.sum() + RIDGE)
            for f in range(binned.shape[1]):
                b = binned[rows, f]
                gl = np.bincount(b, g, BINS).cumsum()[:-1]
                hl = np.bincount(b, h, BINS).cumsum()[:-1]
                gain = gl ** 2 / (hl + RIDGE) + (g.sum() - gl) ** 2 / (h.sum() - hl + RIDGE) - base
                gain[(hl < LEAST_HESSIAN) | (h.sum() - hl < LEAST_HESSIAN)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0] and k < len(edges[f]):
                    best = (gain[k], f, k)
        if best[1] < 0:
            model.value[at] = -RATE * g.sum() / (h.sum() + RIDGE)
            change[rows] = model.value[at]
            continue
        _, f, k = best
        model.feature[at], model.threshold[at] = f, float(edges[f][k])
        left, right = node(), node()
        model.left[at] = left
        low = binned[rows, f] <= k
        open_nodes += [(left, rows[low], depth + 1), (right, rows[~low], depth + 1)]
    return change


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for 0/1 labels."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(float(np.log(share / (1 - share))) if len(y) else 0.0)
    if len(np.unique(y)) < 2:
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        raw += _grow(model, binned, edges, p - y, p * (1 - p))
    return model


def _scorer(model: Trees):
    return lambda rows: [model.score(np.array(rows, float).reshape(-1, len(FEATURES)))]


def held_out(key: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    texts = docs.select("doc_id", common.whole_text().alias("__cl_text"))
    measured = common.written(common.with_python(
        texts, "__cl_text", lambda: lambda ts: [[statistics(t) for t in ts]], "x array<double>"), "statistics")
    known = labels.where("quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    learnt = common.written(known.where(~held_out(F.col("doc_id"))).join(measured, "doc_id").select(
        "x", "y", F.xxhash64("doc_id").alias("h")), "learnt")
    sample = common.least_hashed(learnt, most).orderBy("h", "x").limit(most).select("x", "y").toPandas()
    model = fit(np.array(sample["x"].tolist(), float).reshape(-1, len(FEATURES)), sample["y"].to_numpy(float))
    scored = common.with_python(measured, "x", functools.partial(_scorer, model), "score double", 4096)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= GOOD).cast("int").alias("predicted"))
