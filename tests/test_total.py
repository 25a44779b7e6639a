"""Odd groups give rows with nulls and leave the other groups alone."""

import math

import numpy as np
from pyspark.sql import functions as F

from corpuslens.functions import signal
from corpuslens.operators import audit, bootstrap, metrics, order, reconcile, sampling, stats
from corpuslens.profiles import Profile


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(None if i % 4 == 0 else f"g{i % 4}", i, float(i)) for i in range(40)], "g string, id long, v double")
    assert order.average_ranks(df, ["g"], "v").count() == 40
    assert order.with_average_rank(df, ["g"], "v", "r").count() == 40
    assert order.hash_positions(df, ["g"], F.md5(F.col("id").cast("string")), "p").count() == 40
    assert sampling.up_to(df, ["g"], ["id"], 100, 1).count() == 40
    quartiles = {r.g: r.q for r in order.exact_quantiles(df, ["g"], "v", {"q": 0.5}).collect()}
    assert quartiles[None] == 18.0 and len(quartiles) == 4


def test_one_class_detector(spark):
    rows = [("both", i / 10, i % 2) for i in range(10)] + [("one", i / 10, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "detector string, score double, y int")
    points = metrics.roc_points(df, ["detector"], "score", "y").where("detector = 'one'").collect()
    assert points and all(r.fpr is None for r in points)
    auc = {r.detector: r.roc_auc for r in metrics.area_under_curve(df, ["detector"], "score", "y").collect()}
    assert auc["one"] is None and auc["both"] is not None


def test_constant_feature(spark):
    rows = [(f, s, 1.0 if f == "flat" else float(i)) for f in ("flat", "live") for s in ("a", "b") for i in range(6)]
    df = spark.createDataFrame(rows, "feature string, side string, value double")
    for out in (stats.welch(df, ["feature"], "side", "a", "b"), stats.brown_forsythe(df, ["feature"], "side", "a", "b")):
        found = {r.feature: r.statistic for r in out.collect()}
        assert found["flat"] is None and found["live"] is not None


def test_many_ties(spark):
    df = spark.range(3_000_000).select(F.lit("x").alias("g"), F.lit(1.0).alias("d"))
    r = stats.signed_rank(df, ["g"], "d").first()
    assert r.n_nonzero == 3_000_000 and math.isfinite(r.w_plus)


def test_empty_signal(spark):
    df = spark.createDataFrame([([],), ([1.0, -1.0],)], "x array<double>")
    got = df.select(signal.average(F.col("x")).alias("a"), signal.silence_ratio(F.col("x")).alias("s")).collect()
    assert got[0].a is None and got[0].s is None and got[1].a == 0.0


def test_an_id_that_changes_its_split_is_missing_and_extra(spark):
    left = spark.createDataFrame([("u1", "train", "pristine", "s", "f"), ("u2", "dev", "pristine", "s", "f")],
                                 "utt_id string, split string, label string, spk_id string, gender string")
    right = spark.createDataFrame([("u1", "dev", "bonafide", "s", "f"), ("u2", "dev", "bonafide", "s", "f")],
                                  "utt_id string, split string, key string, spk_id string, gender string")
    from corpuslens.plans.corpus_queries import P
    assert isinstance(P, Profile)
    rows = {(r.split, r.utt_id): (r.is_missing, r.is_extra) for r in reconcile.paired(left, right, P).collect()}
    assert rows == {("train", "u1"): (True, False), ("dev", "u1"): (False, True), ("dev", "u2"): (False, False)}
    assert [r.utt_id for r in reconcile.reduce_to(right, left).collect()] == ["u2"]


def nullable_rows(spark):
    rows = [(None if i % 3 == 0 else f"d{i % 3}", i, (i * 37 % 101) / 101, i % 2, i * 0.25) for i in range(300)]
    return spark.createDataFrame(rows, "detector string, id long, score double, y int, v double")


def test_a_null_group_gets_what_another_group_gets(spark):
    """The null group, renamed, gives the same numbers in every operator that works by groups."""
    df = nullable_rows(spark)
    named = df.withColumn("detector", F.coalesce("detector", F.lit("none")))
    jobs = {
        "mean_ci": lambda d: bootstrap.mean_ci(d, ["detector"], ["v"], ["id"], n_boot=40),
        "median_ci": lambda d: bootstrap.median_ci(d, ["detector"], "v", ["id"], n_boot=40),
        "paired": lambda d: stats.paired_test(d, ["detector"], "v", "score", ["id"], n_boot=40),
        "evaluate": lambda d: metrics.evaluate(d, ["detector"], "score", "y"),
        "rates": lambda d: metrics.threshold_rates(d, ["detector"], "score", "y", 41),
        "classification": lambda d: metrics.classification(d, ["detector"], "score", "y"),
        "signed_rank": lambda d: stats.signed_rank(d, ["detector"], "v"),
        "rare_first": lambda d: sampling.rare_first(d.where("id % 3 != 2"), "y", "detector", ["id"], 80).select("detector", "id"),
        "distributions": lambda d: audit.distributions(d, ["v"], ["detector"]),
        "overlap": lambda d: reconcile.key_overlap(d, d.where("id < 200"), "id", "detector"),
        "roc": lambda d: metrics.roc_points(d, ["detector"], "score", "y"),
    }
    for name, job in jobs.items():
        got = {tuple("none" if c == "detector" and v is None else v for c, v in r.asDict().items()) for r in job(df).collect()}
        assert got == {tuple(r.asDict().values()) for r in job(named).collect()}, name
        assert any("none" in r for r in got), name


def test_thresholds_reached_equals_counting(spark):
    grid = metrics.logit_grid(801)
    rng = np.random.default_rng(1)
    scores = [0.0, 1.0, -1.0, 2.0, 1e-300, 1 - 1e-16, *grid, *np.nextafter(grid, 0), *np.nextafter(grid, 1), *rng.random(500), *rng.random(200) ** 20]
    rows = spark.createDataFrame([(float(s),) for s in scores], "s double").select("s", metrics.thresholds_reached(F.col("s")).alias("n")).collect()
    assert all(r.n == sum(t <= r.s for t in grid) for r in rows)


def test_correlation_with_missing_cells(spark):
    rng = np.random.default_rng(2)
    n = 240
    p, f, g = rng.random(n).round(2), rng.random(n).round(1), rng.random(n)
    rows = []
    for i in range(n):
        cell = lambda x, m: None if i % m == 0 else float("nan") if i % m == 1 else float(x)
        rows.append((i, i % 2, cell(p[i], 11), float(p[-i]), cell(f[i], 7), float(g[i])))
    df = spark.createDataFrame(rows, "sample_id long, ground_truth int, p_spoof_zs double, p_spoof_ad double, f double, g double")

    def ranks(x):
        x = np.asarray(x)
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    def want(tag, feature, side, pairwise):
        at = {"zs": 2, "ad": 3, "f": 4, "g": 5}
        x = [(r[at[tag]], r[at[feature]]) for r in rows if r[1] == side]
        kept = [(a, b) for a, b in x if a is not None and b is not None and not math.isnan(a) and not math.isnan(b)]
        if not pairwise and len(kept) < len(x):
            return None, len(x)
        return np.corrcoef(ranks([a for a, _ in kept]), ranks([b for _, b in kept]))[0, 1], len(kept)

    for missing in ("propagate", "pairwise"):
        got = {(r.detector, r.feature, r["class"]): (r.rho, r.n) for r in stats.within_class_correlation(df, ["zs", "ad"], ["f", "g"], missing=missing).collect()}
        assert len(got) == 8
        for (tag, feature, name), (rho, k) in got.items():
            r, m = want(tag, feature, int(name == "spoof"), missing == "pairwise")
            assert k == m and (rho is None if r is None else abs(rho - r) < 1e-12), (missing, tag, feature)
    q = stats.association(df, ["zs", "ad"], ["f", "g"]).collect()
    assert all((r.q_value_fdr is None) == (r.rho is None) for r in q) and sum(r.rho is not None for r in q) == 2


def test_median_interval_draws_like_the_definition(spark):
    rows = [("a", i, float((i * 7919) % 53)) for i in range(200)] + [("b", i, 1.5) for i in range(5)] + [("b", 9, None)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    got = {r.g: (r.ci_low, r.ci_high) for r in bootstrap.median_ci(df, ["g"], "v", ["id"], n_boot=60, seed=3).collect()}
    drawn = bootstrap.replicates(df, ["id"], 60, 3).collect()
    for g in ("a", "b"):
        medians = []
        for b in range(60):
            x = [v for r in drawn if r.g == g and r["_b"] == b and r.v is not None for v in [r.v] * r["_w"]]
            medians += [np.median(x)] if x else []
        assert got[g] == (np.percentile(medians, 2.5), np.percentile(medians, 97.5))
