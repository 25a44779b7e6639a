"""Replicates are summed four at a time, as the definition sums them one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import keys
from corpuslens.operators import bootstrap, effects
from corpuslens.plans import jobs, load_queries, views


def test_weights_of_digits_are_those_of_numbers(spark):
    firsts = [int(np.ceil(p * 2 ** 32)) + d for p in keys.poisson_cdf() for d in (-1, 0, 1)]
    rows = spark.createDataFrame([(f"{n:08x}",) for n in [0, 1, 2 ** 32 - 1, *firsts] if n < 2 ** 32], "d string")
    two = rows.select(keys.poisson_of_digits(F.col("d")), keys.poisson_weight(keys.hex_number(F.col("d")) / F.lit(2.0 ** 32))).collect()
    assert all(a == b for a, b in two) and {a for a, _ in two} >= set(range(11))


@pytest.mark.parametrize("shared", [False, True])
def test_replicates_are_summed_four_at_a_time(spark, shared):
    rows = spark.createDataFrame([(g, i, float(i * 7 % 11)) for i in range(30) for g in "ab"] + [
        ("a", 30, None), ("b", 31, float("inf")), (None, 1, 2.0)], "g string, id long, v double")
    long = bootstrap.replicates(rows, ["id"], 10, 5).groupBy("g", "_b").agg(F.sum("_w").alias("_m"), F.sum(F.col("v") * F.col("_w")).alias("s"))
    sums = bootstrap.replicate_sums(rows, ["g"], {"s": F.col("v")}, ["id"], 10, 5, shared=shared)
    order = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, sums.collect()), key=order) == sorted(map(tuple, long.collect()), key=order)
    # One hash is the key of four weights, and keys that rows share are hashed before these part again.
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and plan.count("Generate explode(_rows") == shared


def test_rows_around_a_median_are_dealt_before_they_are_drawn(spark):
    rows = spark.range(200).select(F.lit("a").alias("g"), "id", (F.col("id") * 7919 % 53).cast("double").alias("v"))
    ci = bootstrap.median_ci(rows, ["g"], "v", ["id"], n_boot=20)
    plan = ci._jdf.queryExecution().optimizedPlan().toString().split("Generate explode(_asked")
    assert len(plan) == 2 and "RepartitionByExpression" in plan[1]


def test_median_intervals_of_groups_that_share_keys(spark):
    rows = spark.range(120).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("g"), "id").withColumn(
        "v", F.when(F.col("g") == "a", F.col("id") * 7919 % 53).otherwise(F.col("id") * 31 % 7).cast("double"))
    both = [sorted(map(tuple, bootstrap.median_ci(rows, ["g"], "v", ["id"], n_boot=40, shared=s).collect())) for s in (False, True)]
    assert both[0] == both[1] and len(both[0]) == 2


def test_convergence_measures_the_tested_half_once(spark, monkeypatch):
    # The occlusion table of all clips is another result, which this query does not read.
    def unread(*args, **kwargs):
        raise AssertionError("occlusion table")
    seen, drops = [], effects.band_drops
    monkeypatch.setattr(effects, "occlusion_table", unread)
    monkeypatch.setattr(effects, "band_drops", lambda *a, **k: seen.append(1) or drops(*a, **k))
    assert load_queries()[0]["convergence_intervention"](spark, "/root/testdata/sf0.001").count() == 2
    assert len(seen) == 2


def test_occlusion_stage_keeps_its_three_results(spark):
    sf = "/root/testdata/sf0.001"
    signals, scorers = views.signals(spark, sf).select("sample_id", "samples"), {"zs": views.scorer(1), "ad": views.scorer(2)}
    given = (views.BAND_COLUMNS, views.SIGNAL_RATE, views.BAND_EDGES, views.FRAME, views.HOP)
    master = views.master(spark, sf)
    got = jobs.occlusion_stage(master, signals, scorers, *given, n_boot=20)
    assert {name: df.count() for name, df in got.items()} == {"occlusion": 8, "agreement": 2, "convergence": 2}
    drawn = jobs.convergence_test(master, signals, scorers, *given, n_boot=20, per_quadrant=5)
    assert all(0 < r.n_pairs <= 20 for r in drawn.collect())
