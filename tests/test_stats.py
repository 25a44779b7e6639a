import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import tails
from corpuslens.operators import bootstrap, metrics, sampling, stats


def test_tails_match_tabulated_values():
    # Two-sided t: 2.228 at ten degrees, 12.706 at one; F(1, 20) upper five percent at 4.351.
    assert tails.t_two_sided_value(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.t_two_sided_value(12.706204736432095, 1) == pytest.approx(0.05, abs=1e-10)
    assert tails.f_upper_value(4.351243503329, 1, 20) == pytest.approx(0.05, abs=1e-9)
    assert tails.signed_rank_exact_value(8, 10) == pytest.approx(0.048828125)


def test_equal_error_rate_of_separable_scores_is_zero(spark):
    df = spark.createDataFrame([("d", 0.9, 1), ("d", 0.8, 1), ("d", 0.2, 0), ("d", 0.1, 0)], "d string, s double, y int")
    r = metrics.equal_error_rate(df, ["d"], "s", "y").first()
    assert r["eer"] == 0.0 and r["threshold"] == 0.8


def brute_roc(scores, labels):
    """Drop collinear inner points, prepend the empty point."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    last = np.r_[np.where(np.diff(s))[0], len(s) - 1]
    tps = np.cumsum(y)[last].astype(float)
    fps = 1 + last - tps
    if len(fps) > 2:
        keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
        fps, tps, last = fps[keep], tps[keep], last[keep]
    return np.r_[0, fps] / fps[-1], np.r_[0, tps] / tps[-1], np.r_[np.inf, s[last]]


def test_equal_error_rate_with_ties(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300) * 0.6 + y * 0.2, 2)
    fpr, tpr, thr = brute_roc(s, y)
    i = int(np.argmin(np.abs(1 - tpr - fpr)))
    df = spark.createDataFrame([("d", float(a), int(b)) for a, b in zip(s, y)], "d string, s double, y int")
    r = metrics.equal_error_rate(df, ["d"], "s", "y", buckets=6).first()
    assert r["eer"] == pytest.approx((fpr[i] + 1 - tpr[i]) / 2) and r["threshold"] == thr[i]
    assert metrics.roc_points(df, ["d"], "s", "y", buckets=6).count() == len(thr) - 1


def test_probit(spark):
    r = spark.createDataFrame([(0.975,), (0.0,)], "p double").select(tails.probit(F.col("p")).alias("z")).collect()
    assert r[0]["z"] == pytest.approx(1.959963984540054) and r[1]["z"] is None


def test_adjusted_q_values(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    df = spark.createDataFrame([("f", v) for v in p], "family string, p_value double")
    got = {r["p_value"]: r["q_value_fdr"] for r in stats.adjusted(df, ["family"]).collect()}
    assert got[0.01] == pytest.approx(0.04) and got[0.03] == pytest.approx(0.16 / 3)
    assert got[0.04] == pytest.approx(0.16 / 3) and got[0.5] == 0.5


def test_correlation_needs_three_rows_and_finds_direction(spark):
    rows = [(i, 1, i / 10, float(i), float(-i)) for i in range(10)] + [(100, 0, 0.1, 1.0, 1.0), (101, 0, 0.2, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "sample_id long, ground_truth int, p_spoof_ad double, band1_mean double, band1_std double")
    got = {(r["class"], r["feature"]): r["rho"] for r in stats.within_class_correlation(df, ["ad"], ["band1_mean", "band1_std"]).collect()}
    assert got == {("spoof", "band1_mean"): pytest.approx(1.0), ("spoof", "band1_std"): pytest.approx(-1.0)}


def test_bootstrap_brackets_the_mean_and_small_groups_collapse(spark):
    rng = np.random.default_rng(0)
    rows = [("big", i, float(v)) for i, v in enumerate(rng.normal(2, 1, 300))] + [("one", 0, 7.0)]
    df = spark.createDataFrame(rows, "g string, id long, x double")
    got = {r["g"]: r for r in bootstrap.mean_ci(df, ["g"], ["x"], ["id"], n_boot=200).collect()}
    b = got["big"]
    assert b["ci_low"] < b["mean"] < b["ci_high"] and b["ci_high"] - b["ci_low"] == pytest.approx(4 / math.sqrt(300), rel=0.25)
    assert got["one"]["ci_low"] == got["one"]["ci_high"] == 7.0


def test_poisson_weights_have_mean_one(spark):
    from corpuslens.functions.keys import key_uniform, md5_key, poisson_weight
    w = spark.range(20000).select(poisson_weight(key_uniform(md5_key(1, "id"))).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert w[0] == pytest.approx(1, abs=0.03) and w[1] == pytest.approx(1, abs=0.05)


def test_signed_rank_exact_and_zero(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5, -6, 7, 8, 9, 10)] + [("z", 0.0), ("z", 0.0)], "g string, d double")
    got = {r["g"]: r for r in stats.signed_rank(df, ["g"], "d").collect()}
    assert got["a"]["w_minus"] == 6 and got["a"]["wilcoxon_p"] == pytest.approx(tails.signed_rank_exact_value(6, 10))
    assert got["z"]["wilcoxon_p"] is None


def test_rare_first_takes_all_rare_rows(spark):
    rows = [(i, 1, "FN" if i < 3 else "TP") for i in range(50)] + [(100 + i, 0, "TN") for i in range(30)]
    df = spark.createDataFrame(rows, "sample_id long, ground_truth int, quadrant string")
    got = sampling.rare_first(df, "ground_truth", "quadrant", ["sample_id"], 20).groupBy("quadrant").count().collect()
    assert {r["quadrant"]: r["count"] for r in got} == {"FN": 3, "TP": 17, "TN": 20}


def test_folds_and_halves_cover_everything(spark):
    df = spark.range(101).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    folds = sampling.stratified_folds(df, "y", ["id"], 5)
    sizes = {(r["y"], r["fold"]): r["count"] for r in folds.groupBy("y", "fold").count().collect()}
    assert folds.count() == 101 and max(sizes[(1, f)] for f in range(5)) - min(sizes[(1, f)] for f in range(5)) <= 1
    halves = {r["half"]: r["count"] for r in sampling.halves(df, ["id"]).groupBy("half").count().collect()}
    assert halves == {0: 50, 1: 51}


def test_sampling_is_repeatable(spark):
    df = spark.range(200).withColumn("y", (F.col("id") % 2).cast("int"))
    one = {r["id"] for r in sampling.up_to(df, ["y"], ["id"], 5).collect()}
    assert one == {r["id"] for r in sampling.up_to(df.repartition(5), ["y"], ["id"], 5).collect()} and len(one) == 10


def test_label_order_puts_unknown_runs_last(spark):
    from corpuslens.operators.compare import in_label_order
    df = spark.createDataFrame([("x",), ("b",), ("a",)], "run string")
    assert [r["run"] for r in in_label_order(df, "run", ["b", "a"]).collect()] == ["b", "a", "x"]


def test_tails_at_large_degrees_of_freedom():
    from corpuslens.functions import tails

    def edge(x, v):
        """Two-sided tail by the normal tail and two terms of the expansion in 1 / v."""
        density = math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        return math.erfc(x / math.sqrt(2)) + density * ((x**3 + x) / (2 * v) + x * (3 * x**6 - 7 * x**4 - 5 * x * x - 3) / (48 * v * v))
    for v in (1e7, 1e9, 1e11, 1e13):
        for x in (0.1, 1.0, 3.0, 5.0):
            assert tails.t_two_sided_value(x, v) == pytest.approx(edge(x, v), rel=1e-12)
    # Both methods meet where one takes over, and the sum over the line of the density agrees.
    nodes, weights = np.polynomial.legendre.leggauss(60)
    for v in (5, 39.9, 40, 41, 75, 150, 199, 201, 1000):
        for x in (0.01, 0.5, 2.0, 5.0, 9.0):
            density = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
            total, low, step = 0.0, x, 0.25
            while step < 1e9:
                at = low + step * (nodes + 1) / 2
                total += density * step * (weights * np.exp(-(v + 1) / 2 * np.log1p(at * at / v))).sum()
                low, step = low + step, step * 1.12
            assert tails.t_two_sided_value(x, v) == pytest.approx(total, rel=2e-11)


def test_native_probit(spark):
    from statistics import NormalDist

    from corpuslens.functions import tails
    p = [1e-300, 1e-20, 1e-9, 0.01, 0.0749, 0.075, 0.3, 0.5, 0.9, 0.925, 0.9999, 1 - 1e-12]
    got = spark.createDataFrame([(x,) for x in p] + [(0.0,), (1.0,), (None,)], "p double").select(tails.probit(F.col("p"))).collect()
    assert [r[0] for r in got[:-3]] == pytest.approx([NormalDist().inv_cdf(x) for x in p], rel=1e-14, abs=1e-15)
    assert all(r[0] is None for r in got[-3:])
