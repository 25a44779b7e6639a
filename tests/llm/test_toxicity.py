import random

import numpy as np
from pyspark.sql import functions as F

from corpus import documents, labels, odd_texts, prose
from corpuslens.llm import queries, toxicity


def test_planted_words_are_found(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(600):
        words, toxic = prose(i, 60, 200).split(), int(i % 8 == 0)
        if toxic:
            words[rng.randrange(60)] = rng.choice(["Rotten,", "FOUL", "vile."])
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 5 > 0), toxic))
    docs = documents(spark, rows + [(None, "foul"), (9000, None), (9001, "")])
    got = toxicity.predict(docs, labels(spark, [m for m in marks if m[0] % 3] + [(None, 1, 1), (3, None, 1)])).toPandas()
    assert len(got) == len(rows) + 3
    truth = {i: t for i, _, t in marks}
    unseen = got[(got.doc_id < 600) & (got.doc_id % 3 == 0)]
    assert ((unseen.p_toxic >= toxicity.TOXIC).astype(int) == unseen.doc_id.map(truth)).mean() > 0.97
    assert got.p_toxic.between(0, 1).all() and got.columns.tolist() == ["doc_id", "p_low_quality", "p_toxic", "p_toxic_low_quality"]


def test_earlier_probabilities_feed_later_models():
    rng = np.random.default_rng(0)
    n = 400
    has = rng.random(n) < 0.5
    row, word = np.flatnonzero(has), np.zeros(has.sum(), np.int64)
    chain = toxicity.fit_chain(row, word, np.stack([has, has], 1).astype(float), np.arange(n) % 3, 1)
    assert len(chain[0]) == 2 and len(chain[1]) == 3 and chain[1][1] > 0.1


def test_odd_rows(spark):
    docs = documents(spark, odd_texts())
    got = toxicity.predict(docs, labels(spark, [])).collect()
    assert len(got) == len(odd_texts()) and all(0 <= r.p_toxic <= 1 for r in got)
    assert toxicity.predict(docs.where("false"), labels(spark, [])).count() == 0


def test_the_least_hashed_rows_are_all_there(spark):
    from corpuslens.llm import common
    table = spark.range(50_000).select(F.xxhash64("id").alias("h"), "id").cache()
    few = common.least_hashed(table, 1000)
    assert few.count() < 2000
    assert [r.id for r in few.orderBy("h").limit(1000).collect()] == [r.id for r in table.orderBy("h").limit(1000).collect()]
    assert common.least_hashed(table, 40_000) is table
    same = spark.range(5000).select(F.lit(5).cast("long").alias("h"), "id")
    assert common.least_hashed(same, 100).count() == 5000


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_recall_of_given_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.predict(docs, marks.where("doc_id % 4 <> 1")).join(marks.where("doc_id % 4 = 1"), "doc_id")
    r = got.agg(F.avg(F.when(F.col("toxic") == 1, (F.col("p_toxic") >= toxicity.TOXIC).cast("int"))).alias("found"),
                F.avg(F.when(F.col("toxic") == 0, (F.col("p_toxic") >= toxicity.TOXIC).cast("int"))).alias("false")).first()
    assert r.found > 0.85 and r["false"] < 0.02
