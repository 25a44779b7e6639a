import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpus import documents, labels, odd_texts, prose
from corpuslens.llm import quality_model, quality_rules


def base_values(text):
    text = text or ""
    words = [w for w in re.split("[\\x20\\x09-\\x0D]+", text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\\x20\\x09-\\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    marked = {i + k for i, w in enumerate(windows) if w in often for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked))


def test_statistics_equal_brute_force(spark):
    rng = random.Random(3)
    texts = odd_texts() + [(100 + i, "".join(rng.choice(["a", "b", "c#", " ", " ", "\n", "\t", "\x0b", "é|"]) for _ in range(rng.randint(0, 400))))
                           for i in range(60)] + [(300, "a b c d e\n" * 7), (301, "x " * 40)]
    got = quality_rules.statistics(documents(spark, texts), keep=["doc_id", "text"]).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_values(r.text), r.text
    judged = quality_rules.judge(documents(spark, texts), labels(spark, []))
    for r in judged.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed)


@pytest.mark.parametrize("n,risk,level", [(0, 0.01, 1e-3), (50, 0.01, 1e-3), (1500, 0.005, 6e-4), (12_345, 0.005, 6e-4), (400, 0.3, 0.05)])
def test_exact_binomial_bound(spark, n, risk, level):
    from pyspark.sql import functions as F
    got = spark.range(1).select(quality_rules.most_rejections(F.lit(n), risk, F.lit(level))).first()[0]
    total, k = 0.0, -1
    for j in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(risk) + (n - j) * math.log(1 - risk))
        if total > level:
            break
        k = j
    assert got == (k if n else -1)


def test_cutoffs_need_labels_and_keep_good_documents(spark):
    good = [(i, prose(i, 30), "en", "a") for i in range(2000)]
    bad = [(10_000 + i, " ".join(w + "%%%" for w in prose(i, 30).split()), "en", "a") for i in range(100)]
    rare = [(20_000 + i, " ".join(w + "%%%" for w in prose(i, 30).split()), None, "a") for i in range(20)]
    docs = documents(spark, good + bad + rare)
    marks = labels(spark, [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad + rare] + [(None, 0, 0), (5, None, 0), (7, 1, 0)])
    kept = {r.doc_id for r in quality_rules.filtered(docs, marks).collect()}
    assert kept == {r[0] for r in good} | {r[0] for r in rare}
    assert {r.doc_id for r in quality_rules.judge(docs, marks).where("kept").collect()} == kept
    assert quality_rules.filtered(docs, marks).columns == docs.columns
    assert quality_rules.filtered(docs.where("false"), marks).count() == 0
    assert quality_rules.judge(docs.where("false"), marks).count() == 0


def test_trees_separate_and_flat_arrays_agree():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality_model.FEATURES)))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality_model.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97

    def walk(row):
        total = model.base
        for at in model.roots:
            while model.feature[at] >= 0:
                at = model.left[at] + (row[model.feature[at]] > model.threshold[at])
            total += model.value[at]
        return total
    assert np.allclose(model.raw(x[2900:]), [walk(r) for r in x[2900:]])


def test_quality_scores(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality_model.classify(docs, marks).join(marks, "doc_id").toPandas()
    unseen = got[got.held_out]
    assert (unseen.predicted == unseen.quality).mean() > 0.98 and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(got.doc_id, got.held_out))


def test_quality_odd_rows(spark):
    docs = documents(spark, odd_texts())
    for marks in (labels(spark, []), labels(spark, [(5, 1, 0), (5, 1, 0), (7, 0, 0), (None, 1, 0), (3, None, 0)])):
        got = quality_model.classify(docs, marks).collect()
        assert len(got) == len(odd_texts()) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (6, 7)}) == 1
    assert quality_model.classify(docs.where("false"), labels(spark, [])).count() == 0
