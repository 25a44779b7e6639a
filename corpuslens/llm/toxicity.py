"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic models over a chosen vocabulary; the model
of each category also sees the probabilities of the earlier ones.  In training these are
out-of-fold predictions, made by models that have not seen the row, so that the later models learn
from probabilities as they will meet them.

The vocabulary is chosen over all labelled documents: for each word, the documents of each
category that contain it are counted and the ``MAX_WORDS`` words with the largest chi-square stay.
The models are fitted on a bounded, hash-chosen sample of labelled rows (``MAX_TRAIN_ROWS``).
Every whole text is scored.

Edge cases: a null or empty text has no words and gets the models' base probability; null labels
and labels of unknown documents are not used, a document labelled twice has a category if the mean
of its labels is one half or more; a category without rows of both kinds gets its share, or zero;
repeated rows get the same scores; a null doc_id is scored, never trained on; an empty table gives
no rows; extra columns are not used.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm import common

#: Words of the vocabulary, and labelled rows that the models are fitted on, at most.
MAX_WORDS, MAX_TRAIN_ROWS = 1_000, 20_000
#: Documents that must contain a word; folds of the chain; Newton steps and turns of each solution.
LEAST_DOCUMENTS = 3
FOLDS, STEPS, TURNS, RIDGE = 3, 8, 15, 0.1
TOXIC = 0.2
_WORD = re.compile(r"[^\W\d_]+")


def categories() -> dict[str, Column]:
    """The chain, in order: what the labels mark, from the commoner fault to both at once."""
    quality, toxic = F.col("quality"), F.col("toxic")
    return {"low_quality": 1 - quality, "toxic": toxic, "toxic_low_quality": toxic * (1 - quality)}


def _words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _placer(words: list[str]):
    place = {w: i for i, w in enumerate(words)}
    return lambda rows: [[[place[w] for w in ws if w in place] for ws in rows]]


def vocabulary(rows: DataFrame, names: list[str], most: int = MAX_WORDS) -> list[str]:
    """The words most associated with a category; ``rows`` has ``words`` and a 0/1 column for each name."""
    totals = rows.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]).first()
    n = float(totals["n"] or 0)
    counted = rows.select(F.explode("words").alias("word"), *names).groupBy("word").agg(
        F.count("*").alias("df"), *[F.sum(c).alias(c) for c in names]).where(F.col("df") >= LEAST_DOCUMENTS)

    def chi(c: str) -> Column:
        p = float(totals[c] or 0) / max(n, 1.0)
        spread = F.lit(max(p * (1 - p), 1e-9)) * F.col("df") * (1 - F.col("df") / max(n, 1.0))
        return F.try_divide(F.pow(F.col(c) - p * F.col("df"), F.lit(2)), spread)

    best = counted.withColumn("chi", F.greatest(*map(chi, names), F.lit(0.0))).orderBy(F.desc("chi"), "word").limit(most)
    return [r["word"] for r in best.select("word").collect()]


class Sparse:
    """0/1 rows as positions: the words of each row, and a dense part for the chain's probabilities."""

    def __init__(self, row: np.ndarray, word: np.ndarray, n: int, width: int, dense: np.ndarray):
        self.row, self.word, self.n, self.width, self.dense = row, word, n, width, dense

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.bincount(self.row, w[self.word], self.n) if self.n else np.zeros(0)
        return out + self.dense @ w[self.width:]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.word, r[self.row], self.width), self.dense.T @ r])

    def part(self, keep: np.ndarray) -> Sparse:
        number = np.cumsum(keep) - 1
        inside = keep[self.row]
        return Sparse(number[self.row[inside]], self.word[inside], int(keep.sum()), self.width, self.dense[keep])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: Sparse, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps with conjugate gradients; the last dense column is one."""
    w = np.zeros(x.width + x.dense.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        w[-1] = -30.0 if not y.any() else 30.0
        return w
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-6
    sign = 2 * y - 1
    loss = lambda w: np.logaddexp(0, -sign * x.times(w)).sum() + 0.5 * (ridge * w * w).sum()
    for _ in range(STEPS):
        p = _sigmoid(x.times(w))
        grad = x.back(p - y) + ridge * w
        h = np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros(len(w)), -grad
        d, size = r.copy(), float(r @ r)
        for _ in range(TURNS):
            if size < 1e-8:
                break
            hd = x.back(h * x.times(d)) + ridge * d
            a = size / float(d @ hd)
            step, r = step + a * d, r - a * hd
            new = float(r @ r)
            d, size = r + new / size * d, new
        before = loss(w)
        for _ in range(20):
            if loss(w + step) <= before:
                break
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_chain(row: np.ndarray, word: np.ndarray, labels: np.ndarray, folds: np.ndarray, width: int) -> list[np.ndarray]:
    """Weights of each category: words, earlier probabilities in order, constant."""
    n, one = len(labels), np.ones((len(labels), 1))
    earlier = np.zeros((n, 0))
    chain = []
    for c in range(labels.shape[1]):
        x, y = Sparse(row, word, n, width, np.hstack([earlier, one])), labels[:, c]
        chain.append(fit_logistic(x, y))
        unseen = np.zeros(n)
        for f in np.unique(folds):
            out = folds == f
            unseen[out] = _sigmoid(x.part(out).times(fit_logistic(x.part(~out), y[~out])))
        earlier = np.hstack([earlier, unseen[:, None]])
    return chain


def _scorer(words: list[str], chain: list[np.ndarray]):
    place = {w: i for i, w in enumerate(words)}
    table = np.array([w[:len(words)] for w in chain])
    tails = [w[len(words):] for w in chain]

    def score(texts: list[str]) -> list:
        out = np.zeros((len(texts), len(chain)))
        for i, text in enumerate(texts):
            raw = table[:, [place[w] for w in _words(text) if w in place]].sum(axis=1)
            for c, tail in enumerate(tails):
                out[i, c] = _sigmoid(raw[c] + out[i, :c] @ tail[:-1] + tail[-1])
        return list(out.T)
    return score


def predict(docs: DataFrame, labels: DataFrame, chain: Mapping[str, Column] | None = None,
            most: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id and a probability ``p_<category>`` for each category of the chain, for every document."""
    chain = chain or categories()
    names = list(chain)
    texts = docs.select("doc_id", common.whole_text().alias("__cl_text"))
    known = labels.select("doc_id", *[c.alias(n) for n, c in chain.items()]).where(" and ".join(
        f"{n} is not null" for n in names)).groupBy("doc_id").agg(*[(F.avg(n) >= 0.5).cast("int").alias(n) for n in names])
    # Few labels are broadcast, so that no text is shuffled; many meet the texts by a shuffle.
    rows = common.written(common.with_python(
        texts.join(common.shared_small(known), "doc_id"), "__cl_text",
        lambda: lambda ts: [[sorted(_words(t)) for t in ts]], "words array<string>"), "labelled", texts=True)
    words = vocabulary(rows, names)
    hashed = common.least_hashed(rows.select(F.xxhash64("doc_id").alias("h"), *names, F.col("words").alias("__cl_words")), most)
    chosen = common.with_python(hashed, "__cl_words", functools.partial(_placer, words), "words array<int>")
    sample = chosen.orderBy("h").limit(most).toPandas()
    found = sample["words"].tolist()
    models = fit_chain(np.repeat(np.arange(len(found)), list(map(len, found))).astype(np.int64),
                       np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64), sample[names].to_numpy(float).reshape(-1, len(names)),
                       (sample["h"] % FOLDS).to_numpy(), len(words))
    return common.with_python(texts, "__cl_text", functools.partial(_scorer, words, models),
                              ", ".join(f"p_{n} double" for n in names))
