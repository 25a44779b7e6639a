"""Association and group tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions import signal, tails
from corpuslens.operators import bootstrap
from corpuslens.operators.order import average_ranks, exact_quantiles, join_groups, prefix_sums, with_average_rank

CLASS_NAME = {0: "bonafide", 1: "spoof"}


def class_name(truth: Column) -> Column:
    return F.when(truth == 1, CLASS_NAME[1]).otherwise(CLASS_NAME[0])


def unpivot(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str = "feature",
            value: str = "value") -> DataFrame:
    """Long form inside the row: no shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value))
                      for c in columns])
    return df.select(*keep, F.explode(cells).alias("_c")).select(*keep, f"_c.{name}", f"_c.{value}")


def _known(x: Column) -> Column:
    """Whether a value has a place in an order: infinities have, nulls and NaN have not."""
    return x.isNotNull() & ~F.isnan(x)


def _flat_correlations(sums: DataFrame, label: str, pairs: Sequence[tuple[str, str]], n: Sequence[Column], rho: Sequence[Column]) -> DataFrame:
    # A constant column has no correlation.
    cells = F.array(*[F.struct(F.lit(t).alias("detector"), F.lit(f).alias("feature"), F.nanvl(r, F.lit(None)).alias("rho"), k.alias("n"))
                      for (t, f), k, r in zip(pairs, n, rho, strict=True)])
    return sums.select(label, F.explode(cells).alias("c")).filter(F.col("c.n") >= 3).select(
        "c.detector", "c.feature", class_name(F.col(label)).alias("class"), "c.rho", "c.n")


def within_class_correlation(master: DataFrame, tags: Sequence[str], features: Sequence[str],
                             label: str = "ground_truth", key: str = "sample_id", missing: str = "propagate") -> DataFrame:
    """Spearman correlation of every feature with every score inside each class.

    Scores and features are ranked together in one pass over the long form; the ranks of a
    clip come back into one row, and every correlation is an aggregate of those rows.
    Classes with fewer than three rows give no row.

    ``missing`` says what a null or NaN does.  ``propagate``: a class with one in either column has no
    rho there, and n counts all its rows.  ``pairwise``: each correlation takes the rows that have both
    values, ranked among themselves, n counts these, and pairs with fewer than three give no row.
    """
    if missing == "pairwise":
        return _pairwise_correlation(master, tags, features, label, key)
    if missing != "propagate":
        raise ValueError(f"unknown rule for missing values {missing!r}; use 'propagate' or 'pairwise'")
    scores = [f"p_spoof_{t}" for t in tags]
    columns = [*scores, *features]
    long = unpivot(master, [key, label], columns)
    ranked = with_average_rank(long, [label, "feature"], "value", "_rank")
    rows = ranked.groupBy(key, label).agg(*[
        F.max(F.when((F.col("feature") == c) & _known(F.col("value")), F.col("_rank"))).alias(f"_r{i}") for i, c in enumerate(columns)])
    spot = {c: F.col(f"_r{i}") for i, c in enumerate(columns)}
    pairs = [(t, f) for t in tags for f in features]
    sums = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), *[F.count(spot[c]).alias(f"_k{i}") for i, c in enumerate(columns)], *[
        F.corr(spot[f], spot[f"p_spoof_{t}"]).alias(f"_{i}") for i, (t, f) in enumerate(pairs)])
    full = {c: F.col(f"_k{i}") == F.col("_n") for i, c in enumerate(columns)}
    rho = [F.when(full[f] & full[f"p_spoof_{t}"], F.col(f"_{i}")) for i, (t, f) in enumerate(pairs)]
    return _flat_correlations(sums, label, pairs, [F.col("_n")] * len(pairs), rho)


def _pairwise_correlation(master: DataFrame, tags: Sequence[str], features: Sequence[str], label: str, key: str) -> DataFrame:
    """Correlations over the rows that have both values.

    A value's rank among the rows that also have the other column is its place in one order of all
    values of its column, counting only such rows.  So each column is ordered once, each distinct value
    with the numbers of its rows that have each counterpart, and all ranks are prefix sums of these
    numbers: no row is copied for a pair.
    """
    scores = [f"p_spoof_{t}" for t in tags]
    columns, pairs = [*scores, *features], [(t, f) for t in tags for f in features]
    # Counterparts of a score are the features, of a feature the scores; both lists share the slots.
    width = max(len(scores), len(features))
    has = F.array(*[F.array(*[_known(F.col(c).cast("double")) for c in side]) for side in (features, scores)])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                               F.get(F.col("_has"), F.lit(0 if c in scores else 1)).alias("other")) for c in columns])
    long = master.withColumn("_has", has).select(key, label, F.explode(cells).alias("c")).select(key, label, "c.*").filter(
        _known(F.col("value")))
    group = [label, "feature"]
    slots = [F.coalesce(F.get("other", F.lit(j)), F.lit(False)) for j in range(width)]
    counts = long.groupBy(*group, "value").agg(*[F.count_if(s).alias(f"_c{j}") for j, s in enumerate(slots)])
    placed = prefix_sums(counts, group, "value", {f"_b{j}": F.col(f"_c{j}") for j in range(width)})
    ranks = placed.select(*group, "value", F.array(*[
        F.col(f"_b{j}") + (F.col(f"_c{j}") + 1) / F.lit(2.0) for j in range(width)]).alias("_ranks"))
    ranked = join_groups(long, ranks, [*group, "value"])
    rows = ranked.groupBy(key, label).agg(*[
        F.max(F.when(F.col("feature") == c, F.col("_ranks"))).alias(f"_r{i}") for i, c in enumerate(columns)])
    place = {c: i for i, c in enumerate(columns)}
    sides = []
    for t, f in pairs:
        of_score, of_feature = F.col(f"_r{place[f'p_spoof_{t}']}"), F.col(f"_r{place[f]}")
        both = of_score.isNotNull() & of_feature.isNotNull()
        sides.append((F.when(both, F.get(of_feature, F.lit(tags.index(t)))), F.when(both, F.get(of_score, F.lit(features.index(f))))))
    sums = rows.groupBy(label).agg(*[F.count(x).alias(f"_n{i}") for i, (x, _) in enumerate(sides)],
                                   *[F.corr(x, y).alias(f"_{i}") for i, (x, y) in enumerate(sides)])
    return _flat_correlations(sums, label, pairs, [F.col(f"_n{i}") for i in range(len(pairs))], [F.col(f"_{i}") for i in range(len(pairs))])


def rank_p_value(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation by the t distribution."""
    df = n - 2
    t = F.when(F.abs(rho) >= 1.0, F.lit(float("inf"))).otherwise(
        rho * F.sqrt(df / ((1.0 - rho) * (1.0 + rho))))
    return tails.t_two_sided(t, df)


def adjusted(df: DataFrame, family: Sequence[str], p: str = "p_value", out: str = "q_value_fdr") -> DataFrame:
    """Benjamini-Hochberg q-values per family.

    A family holds one row per test, bounded by the number of columns of the tested table.  Tests
    without a p are no part of the family.
    """
    order = Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last())
    falling = (Window.partitionBy(*family).orderBy(F.col("_r").desc())
               .rowsBetween(Window.unboundedPreceding, 0))
    m = F.count(p).over(Window.partitionBy(*family))
    ranked = df.withColumn("_r", F.row_number().over(order)).withColumn("_m", m)
    stepped = F.min(F.col(p) * F.col("_m") / F.col("_r")).over(falling)
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), stepped))).drop("_r", "_m")


def association(master: DataFrame, tags: Sequence[str], features: Sequence[str], missing: str = "propagate") -> DataFrame:
    """Correlation, p and q per detector."""
    rho = within_class_correlation(master, tags, features, missing=missing)
    with_p = rho.withColumn("p_value", rank_p_value(F.col("rho"), F.col("n")))
    return adjusted(with_p, ["detector"])


def top_features(correlations: DataFrame, n: int) -> DataFrame:
    """Features of largest |rho| over classes and detectors (D25); n rows are the feature."""
    return (correlations.groupBy("feature").agg(F.max(F.abs("rho")).alias("strength"))
            .orderBy(F.col("strength").desc(), "feature").limit(n))


def band_strength(correlations: DataFrame, tags: Sequence[str], n_bands: int) -> DataFrame:
    """Per detector and band the largest |rho| and the signed rho behind it.

    Bands without a value stay with nulls.  Of equal |rho| the first feature wins.
    """
    spark = correlations.sparkSession
    grid = spark.createDataFrame([(t, b) for t in tags for b in range(n_bands)],
                                 "detector string, band int")
    best = F.max_by("rho", F.struct(F.abs("rho"), -F.col("_pos")))
    pos = F.when(F.col("feature").endswith("_std"), n_bands).otherwise(0) + F.col("band") + \
        F.when(F.col("class") == "spoof", 2 * n_bands).otherwise(0)
    found = (correlations.withColumn("band", signal.band_number(F.col("feature")))
             .withColumn("_pos", pos).groupBy("detector", "band")
             .agg(F.max(F.abs("rho")).alias("strength"), best.alias("signed")))
    return grid.join(found, ["detector", "band"], "left")


def signed_profile(correlations: DataFrame, left: str = "zs", right: str = "ad") -> DataFrame:
    """Signed rho of largest |rho| per feature for two detectors and whether the sign flips."""
    # Of equal |rho| the first class in name order wins.
    best = F.max_by("rho", F.struct(F.abs("rho"), F.when(F.col("class") == "bonafide", 1).otherwise(0)))
    per = correlations.groupBy("detector", "feature").agg(best.alias("rho"))
    wide = per.groupBy("feature").agg(
        F.max(F.when(F.col("detector") == left, F.col("rho"))).alias(f"rho_{left}"),
        F.max(F.when(F.col("detector") == right, F.col("rho"))).alias(f"rho_{right}"))
    return wide.withColumn("sign_flip", F.coalesce(
        F.col(f"rho_{left}") * F.col(f"rho_{right}") < 0, F.lit(False)))


# --- group tests ------------------------------------------------------------------------------

def quadrant_values(master: DataFrame, tags: Sequence[str], features: Sequence[str],
                    key: str = "sample_id", extra: Sequence[str] = ()) -> DataFrame:
    """(detector, quadrant, feature, value) rows of the master table."""
    long = unpivot(master, [key, *extra, *[f"quadrant_{t}" for t in tags]], features)
    cells = F.array(*[F.struct(F.lit(t).alias("detector"), F.col(f"quadrant_{t}").alias("quadrant"))
                      for t in tags])
    return long.select(key, *extra, "feature", "value", F.explode(cells).alias("q")).select(
        key, *extra, "q.detector", "q.quadrant", "feature", "value")


def _two_groups(df: DataFrame, by: Sequence[str], side: str, left: str, right: str, value: str) -> DataFrame:
    aggs = []
    for tag, name in (("l", left), ("r", right)):
        x = F.when(F.col(side) == name, F.col(value))
        aggs += [F.count(x).alias(f"n{tag}"), F.avg(x).alias(f"m{tag}"), F.var_samp(x).alias(f"v{tag}")]
    return df.groupBy(*by).agg(*aggs)


def welch(df: DataFrame, by: Sequence[str], side: str, left: str, right: str, value: str = "value") -> DataFrame:
    """Unequal-variance t statistic and its degrees of freedom; more than one row per side."""
    g = _two_groups(df, by, side, left, right, value).filter((F.col("nl") > 1) & (F.col("nr") > 1))
    a, b = F.col("vl") / F.col("nl"), F.col("vr") / F.col("nr")
    return g.select(*by, F.try_divide(F.col("ml") - F.col("mr"), F.sqrt(a + b)).alias("statistic"),
                    F.try_divide((a + b) * (a + b), a * a / (F.col("nl") - 1) + b * b / (F.col("nr") - 1)).alias("df"))


def brown_forsythe(df: DataFrame, by: Sequence[str], side: str, left: str, right: str,
                   value: str = "value") -> DataFrame:
    """Spread test around medians; more than two rows per side."""
    two = df.filter(F.col(side).isin(left, right))
    centres = exact_quantiles(two, [*by, side], value, {"_c": 0.5})
    spread = join_groups(two, centres, [*by, side]).withColumn("_z", F.abs(F.col(value) - F.col("_c")))
    g = _two_groups(spread, by, side, left, right, "_z").filter((F.col("nl") > 2) & (F.col("nr") > 2))
    nl, nr, ml, mr = (F.col(c) for c in ("nl", "nr", "ml", "mr"))
    grand = (nl * ml + nr * mr) / (nl + nr)
    between = nl * (ml - grand) * (ml - grand) + nr * (mr - grand) * (mr - grand)
    within = (nl - 1) * F.col("vl") + (nr - 1) * F.col("vr")
    df2 = nl + nr - 2
    return g.select(*by, F.try_divide(df2 * between, within).alias("statistic"), df2.cast("double").alias("df"))


def confirmatory(values: DataFrame) -> DataFrame:
    """Welch on TN vs FP and spread on TP vs FN per (detector, feature), with p and q."""
    by = ["detector", "feature"]
    w = welch(values, by, "quadrant", "TN", "FP").select(
        *by, F.lit("welch_TN_vs_FP").alias("test"), "statistic",
        tails.t_two_sided(F.col("statistic"), F.col("df")).alias("p_value"))
    l = brown_forsythe(values, by, "quadrant", "TP", "FN").select(
        *by, F.lit("levene_TP_vs_FN").alias("test"), "statistic",
        tails.f_upper(F.col("statistic"), F.lit(1.0), F.col("df")).alias("p_value"))
    return adjusted(w.unionByName(l), ["detector"])


def effect_sizes(values: DataFrame) -> DataFrame:
    """Standardised TN-FP difference and log2 spread ratio TP/FN."""
    by = ["detector", "feature"]
    mean = _two_groups(values, by, "quadrant", "TN", "FP", "value").select(*by, bootstrap.pooled_effect(
        *[F.col(c) for c in ("nl", "ml", "vl", "nr", "mr", "vr")]).alias("cohens_d"))
    spread = _two_groups(values, by, "quadrant", "TP", "FN", "value").select(*by, bootstrap.log2_spread_ratio(
        *[F.col(c) for c in ("nl", "ml", "vl", "nr", "mr", "vr")]).alias("log2_std_ratio"))
    return join_groups(mean, spread, by)


def energy_distribution(master: DataFrame, features: Sequence[str], label: str = "ground_truth") -> DataFrame:
    """Per class and feature: mean and quartiles, with the standardised class difference."""
    long = unpivot(master, [label], features)
    means = long.groupBy("feature", label).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    q = exact_quantiles(long, ["feature", label], "value", {"q25": 0.25, "q75": 0.75})
    d = _two_groups(long, ["feature"], label, 1, 0, "value").select("feature", bootstrap.pooled_effect(
        *[F.col(c) for c in ("nl", "ml", "vl", "nr", "mr", "vr")]).alias("cohens_d"))
    return join_groups(join_groups(means, q, ["feature", label]), d, ["feature"]).select(
        "feature", class_name(F.col(label)).alias("class"), "n", "mean", "q25", "q75", "cohens_d")


# --- paired test ------------------------------------------------------------------------------

def signed_rank(df: DataFrame, by: Sequence[str], diff: str, exact_up_to: int = 50) -> DataFrame:
    """Wilcoxon signed-rank sums with average ties, zeros left out.

    p is exact up to ``exact_up_to`` pairs (fifty at most) without ties or zeros, else the normal form with
    the tie term; null when every difference is zero.
    """
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    nz = df.filter(F.col(diff) != 0).withColumn("_abs", F.abs(diff))
    sides = nz.groupBy(*by, "_abs").agg(F.count(F.lit(1)).alias("ties"),
                                        F.count_if(F.col(diff) > 0).alias("_up"))
    ranks = average_ranks(sides, by, "_abs", weight="ties")
    t = F.col("ties")
    sums = join_groups(ranks, sides.drop("ties"), [*by, "_abs"]).groupBy(*by).agg(
        F.sum(t).alias("_n"), F.sum(F.col("rank") * F.col("_up")).alias("w_plus"),
        F.sum(F.col("rank") * (t - F.col("_up"))).alias("w_minus"),
        F.sum(t.cast("double") * t * t - t).alias("_tie"))
    n = F.col("_n").cast("double")
    low = F.least("w_plus", "w_minus")
    se = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("_tie") / 2) / 24)
    z = F.try_divide(low - n * (n + 1) / 4, se)
    out = join_groups(rows, sums, by, "left")
    exact_ok = (F.col("_all") <= min(exact_up_to, 50)) & (F.col("_tie") == 0) & (F.col("_n") == F.col("_all"))
    return out.select(*by, "w_plus", "w_minus", F.col("_n").alias("n_nonzero"), F.coalesce(
        F.when(exact_ok, tails.signed_rank_exact(low, F.col("_n"))),
        tails.normal_two_sided(z)).alias("wilcoxon_p"), z.alias("wilcoxon_z"))


def paired_test(df: DataFrame, by: Sequence[str], top: str, bottom: str, key: Sequence[str], *,
                n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Median difference with interval, standardised effect, signed-rank p and means."""
    d = df.withColumn("_diff", F.col(top) - F.col(bottom))
    sd = F.stddev_samp("_diff")
    base = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.when(sd > 0, F.avg("_diff") / sd).alias("cohen_dz"),
        F.avg(top).alias("mean_drop_top"), F.avg(bottom).alias("mean_drop_bottom"))
    median = exact_quantiles(d, by, "_diff", {"median_diff": 0.5})
    ci = bootstrap.median_ci(d, by, "_diff", key, n_boot=n_boot, seed=seed, shared=bool(by))
    wil = signed_rank(d, by, "_diff").select(*by, "wilcoxon_p")
    out = base
    for part in (median, ci, wil):
        out = join_groups(out, part, by, "left")
    return out
