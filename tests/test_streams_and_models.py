import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens import schemas
from corpuslens.operators import models, rules, sampling
from corpuslens.operators.rules import RuleViolation
from corpuslens.streaming.ledger_stream import apply_batch, compact, read_ledger, upsert_stream
from corpuslens.streaming.quota import first_per_class


def test_quota_over_several_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(300).withColumn("label", F.when(F.col("id") % 10 == 0, "rare").otherwise("hot"))
    rows.repartition(6).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(src)
    q = (first_per_class(stream, "label", 12).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    assert {r["label"]: r["count"] for r in spark.read.parquet(out).groupBy("label").count().collect()} == {"hot": 12, "rare": 12}


def ledger(spark, rows):
    return spark.createDataFrame([(k, "train", "a.tar", "md5", "m", n, "sha") for k, n in rows], schemas.LEDGER)


def test_ledger_replays_and_refuses(spark, tmp_path):
    root = str(tmp_path / "ledger")
    state = lambda: sorted((r["utt_id"], r["member_size"]) for r in read_ledger(spark, root).collect())
    apply_batch(ledger(spark, [("a", 1), ("b", 1)]), 0, root, "q")
    apply_batch(ledger(spark, [("b", 2), ("c", 2)]), 1, root, "q")
    apply_batch(ledger(spark, [("b", 2), ("c", 2)]), 1, root, "q")
    assert state() == [("a", 1), ("b", 2), ("c", 2)]
    with pytest.raises(RuleViolation, match="duplicate_update"):
        apply_batch(ledger(spark, [("z", 1), ("z", 2)]), 2, root, "q")
    assert state() == [("a", 1), ("b", 2), ("c", 2)]


def test_a_replayed_older_batch_does_not_overrule_a_later_one(spark, tmp_path):
    root = str(tmp_path / "ledger")
    size = lambda: {r["utt_id"]: r["member_size"] for r in read_ledger(spark, root).collect()}
    apply_batch(ledger(spark, [("a", 1)]), 0, root, "A")
    apply_batch(ledger(spark, [("a", 2)]), 0, root, "B")
    apply_batch(ledger(spark, [("a", 1)]), 0, root, "A")
    assert size() == {"a": 2}
    compact(spark, root)
    apply_batch(ledger(spark, [("a", 1)]), 0, root, "A")
    assert size() == {"a": 2}
    apply_batch(ledger(spark, [("a", 3)]), 1, root, "A")
    assert size() == {"a": 3}


def test_snapshots_cover_updates_and_old_ones_go(spark, tmp_path):
    root = str(tmp_path / "ledger")
    for k in range(7):
        apply_batch(ledger(spark, [("a", k), (f"k{k}", k)]), k, root, "q", compact_every=3)
    assert {r["utt_id"]: r["member_size"] for r in read_ledger(spark, root).collect()} == {"a": 6, **{f"k{k}": k for k in range(7)}}
    # Two snapshots at most, and the updates since the one before the last.
    assert len(list((tmp_path / "ledger" / "snapshots").iterdir())) == 2
    assert sorted(int(p.name.split("-")[0]) for p in (tmp_path / "ledger" / "updates" / "q").iterdir()) == [3, 4, 5, 6]
    # A late writer that took an early place does not overrule, yet its new ids count.
    late = ledger(spark, [("a", -1), ("late", 9)]).withColumns({"applied": F.lit(0).cast("long"), "run": F.lit("z"), "batch": F.lit(0).cast("long")})
    late.write.parquet(root + "/updates/z/0-0")
    found = {r["utt_id"]: r["member_size"] for r in read_ledger(spark, root).collect()}
    assert found["a"] == 6 and found["late"] == 9


def test_ledger_keeps_rows_after_a_restart_with_a_fresh_checkpoint(spark, tmp_path):
    root = str(tmp_path / "ledger")
    for k, rows in enumerate([[("a", 1), ("b", 1)], [("b", 2), ("c", 2)], [("d", 3)]]):
        ledger(spark, rows).write.parquet(str(tmp_path / f"in{k}"))
        stream = spark.readStream.schema(schemas.LEDGER).parquet(str(tmp_path / f"in{k}"))
        upsert_stream(stream, root, str(tmp_path / f"state{k}")).awaitTermination()
    found = sorted((r["utt_id"], r["member_size"]) for r in read_ledger(spark, root).collect())
    assert found == [("a", 1), ("b", 2), ("c", 2), ("d", 3)]


@pytest.fixture(scope="module")
def embedded(spark):
    e = F.array(*[F.rand(i) + (F.col("id") % 2) * 0.3 for i in range(4)])
    return spark.range(400).select(F.col("id").alias("sample_id"), (F.col("id") % 2).cast("int").alias("y"), e.alias("embedding")).cache()


def test_out_of_fold_scores_every_row_once(embedded):
    got = models.out_of_fold(embedded, "embedding", "y", "sample_id", k=3)
    assert got.count() == 400 and got.select("sample_id").distinct().count() == 400
    assert got.filter("p_spoof is null").count() == 0


def test_heads_of_all_folds_equal_heads_fitted_alone(embedded):
    folds = sampling.stratified_folds(embedded, "y", ["sample_id"], 3).cache()
    together = models.fit_logistic(folds, "embedding", "y", "fold", 3)
    for f in range(3):
        alone = models.fit_logistic(folds.filter(F.col("fold") != f), "embedding", "y")[0]
        assert together[f].weights == pytest.approx(alone.weights, abs=1e-7) and together[f].bias == pytest.approx(alone.bias, abs=1e-7)
        # The slope of the objective at the solution.
        rows = np.array([(*r["embedding"], r["y"]) for r in folds.filter(F.col("fold") != f).collect()])
        z, y = (rows[:, :-1] - together[f].mean) / together[f].spread, rows[:, -1]
        w = together[f].weights * together[f].spread
        p = 1 / (1 + np.exp(-(rows[:, :-1] @ together[f].weights + together[f].bias)))
        assert np.abs(z.T @ (p - y) + w).max() < 1e-6 and abs((p - y).sum()) < 1e-6


def test_a_separable_class_and_a_constant_column_are_fitted(spark):
    rows = spark.createDataFrame([([float(i), 5.0], int(i >= 10)) for i in range(20)] + [(None, 1)], "e array<double>, y int")
    head = models.fit_logistic(rows, "e", "y")[0]
    assert head.weights[0] > 0 and head.weights[1] == 0 and np.isfinite(head.bias)


def test_unknown_head_lists_choices():
    with pytest.raises(ValueError, match="logistic.*mlp"):
        models.build_head("forest")


def test_adaptation_holdout(embedded):
    train, test = embedded.filter("sample_id < 200"), embedded.filter("sample_id >= 200")
    scores, check = models.adapt(train, test, "embedding", "y", "sample_id", cross_fit=False)
    assert scores.count() == 200 and 0 < check.first()["eer_ad"] < 0.5


def test_baseline_refuses_leakage_and_missing_class(spark):
    rows = [(f"u{i}", f"s{i}", "train" if i < 20 else "dev", "pristine" if i % 2 else "generated", *[float(i + j) for j in range(6)]) for i in range(40)]
    cols = "utt_id string, spk_id string, split string, label string, " + ", ".join(f"{f} double" for f in models.TECHNICAL_FEATURES)
    df = spark.createDataFrame(rows, cols)
    out = models.technical_baseline(df)
    assert out["scores"].count() == 20 and out["coefficients"].count() == 7
    assert 0 <= out["metrics"].first()["balanced_accuracy"] <= 1
    with pytest.raises(rules.RuleViolation, match="speaker_leak"):
        models.technical_baseline(df.withColumn("spk_id", F.lit("same")))
    with pytest.raises(rules.RuleViolation, match="missing_class"):
        models.technical_baseline(df.withColumn("label", F.lit("pristine")))


def test_surrogate_finds_the_feature_that_matters(spark):
    df = spark.range(600).select(F.col("id").alias("sample_id"), F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("p", F.col("a") * 2)
    df = df.cache()
    model, held, fit = models.fit_surrogate(df, ["a", "b"], "p", "sample_id", trees=10)
    assert fit.first()["r2"] > 0.8 and fit.first()["spearman"] > 0.9
    imp = {r["feature"]: r["importance"] for r in models.permutation_importance(model, held, ["a", "b"], "p", "sample_id").collect()}
    assert imp["a"] > 10 * abs(imp["b"])
