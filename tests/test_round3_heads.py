"""The layered head of all folds: the steps of Spark ML's own classifier, one pass for all folds."""

import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from corpuslens.operators import models, sampling


@pytest.fixture(scope="module")
def rows(spark):
    e = F.array(*[F.rand(i) + (F.col("id") % 2) * 0.3 for i in range(4)])
    return spark.range(0, 384, 1, 1).select(F.col("id").alias("sample_id"), (F.col("id") % 2).cast("int").alias("y"), e.alias("embedding")).cache()


def test_layered_head_takes_the_steps_of_spark_ml(rows):
    for steps in (1, 4, 12):
        head = models.fit_layered(rows, "embedding", "y", hidden=8, max_steps=steps)[0]
        unit = F.array(*[(F.get("embedding", F.lit(i)) - float(m)) / float(s) for i, (m, s) in enumerate(zip(head.mean, head.spread))])
        given = rows.select("*", array_to_vector(unit).alias("x"), F.col("y").cast("double").alias("t"))
        theirs = MultilayerPerceptronClassifier(featuresCol="x", labelCol="t", layers=[4, 8, 2], seed=42, maxIter=steps, tol=1e-6).fit(given)
        assert head.weights == pytest.approx(theirs.weights.toArray(), abs=2e-3)
        both = theirs.transform(given).withColumn("own", models.layered_score({0: head}, F.col("embedding"), F.lit(0)))
        assert all(r["own"] == pytest.approx(r["probability"][1], abs=1e-3) for r in both.select("own", "probability").collect())


def test_one_pass_serves_a_step_of_all_folds(rows, monkeypatch):
    passes, added = [], models._added
    monkeypatch.setattr(models, "_added", lambda *a: passes.append(1) or added(*a))
    folds = sampling.stratified_folds(rows, "y", ["sample_id"], 3).cache()
    together = models.fit_layered(folds, "embedding", "y", "fold", 3, hidden=8, max_steps=10)
    assert len(passes) <= 16
    alone = models.fit_layered(folds.filter("fold <> 1"), "embedding", "y", hidden=8, max_steps=10)[0]
    assert together[1].weights == pytest.approx(alone.weights, abs=2e-3)


def test_layered_scores_of_rows_without_a_vector_are_null(rows):
    odd = rows.select("sample_id", "y", F.when(F.col("sample_id") > 2, F.col("embedding")).alias("embedding"))
    got = models.out_of_fold(odd, "embedding", "y", "sample_id", head="mlp", k=2)
    assert got.count() == 384 and got.filter("p_spoof is null").count() == 3
    assert got.filter("p_spoof < 0 or p_spoof > 1").count() == 0
