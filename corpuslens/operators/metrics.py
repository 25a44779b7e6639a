"""Detector metrics (D29-D34, D60, D62): error rates from counted distinct scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions import tails
from corpuslens.operators.order import attach_row, join_groups, prefix_sums


def score_counts(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score: a partial aggregation before any ordering."""
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum(1 - F.col(label).cast("long")).alias("neg"))


def _points(df: DataFrame, by: Sequence[str], score: str, label: str, buckets: int | None) -> DataFrame:
    """Operating points with their counts, collinear inner points left out.

    A point is collinear when the next threshold adds exactly the counts that this one added.
    """
    counts = score_counts(df, by, score, label).withColumn("_order", -F.col("score"))
    placed = prefix_sums(counts, by, "_order", {"_tp": F.col("pos"), "_fp": F.col("neg")},
                         following=["pos", "neg"], buckets=buckets)
    nxt = F.col("following")
    keep = ((F.col("_tp") + F.col("_fp") == 0) | nxt.isNull()
            | (nxt["pos"] != F.col("pos")) | (nxt["neg"] != F.col("neg")))
    rows = placed.filter(keep).select(
        *by, F.col("score").alias("threshold"), (F.col("_tp") + F.col("pos")).alias("tp"),
        (F.col("_fp") + F.col("neg")).alias("fp"), F.col("_tp_total").alias("p"), F.col("_fp_total").alias("n"))
    return rows.withColumn("fpr", F.try_divide("fp", "n")).withColumn(
        "fnr", F.lit(1.0) - F.try_divide("tp", "p"))


def roc_points(df: DataFrame, by: Sequence[str], score: str, label: str,
               buckets: int | None = None) -> DataFrame:
    """Operating points by falling threshold."""
    return _points(df, by, score, label, buckets).select(*by, "threshold", "fpr", "fnr")


def _best_point(df: DataFrame, by: Sequence[str], score: str, label: str, buckets: int | None) -> DataFrame:
    """First point of least |fnr - fpr| per group, starting from the empty point at infinity."""
    inf = F.lit(float("inf"))
    zero = F.lit(0).cast("bigint")

    def candidate(gap: Column, order: Column, *values: Column) -> Column:
        names = ("fpr", "fnr", "threshold", "tp", "fp")
        return F.struct(gap.alias("gap"), order.alias("order"), *[v.alias(n) for v, n in zip(values, names)])

    here = candidate(F.abs(F.col("fnr") - F.col("fpr")), -F.col("threshold"), F.col("fpr"), F.col("fnr"),
                     F.col("threshold"), F.col("tp"), F.col("fp"))
    start = candidate(F.lit(1.0), -inf, F.lit(0.0), F.lit(1.0), inf, zero, zero)
    best = _points(df, by, score, label, buckets).groupBy(*by).agg(
        F.least(F.min(here), start).alias("b"), F.max("p").alias("p"), F.max("n").alias("n"))
    return best.select(*by, ((F.col("b.fpr") + F.col("b.fnr")) / 2).alias("eer"), "b.threshold", "b.tp", "b.fp",
                       "p", "n")


def equal_error_rate(df: DataFrame, by: Sequence[str], score: str, label: str,
                     buckets: int | None = None) -> DataFrame:
    """EER and the threshold that reaches it."""
    return _best_point(df, by, score, label, buckets).select(*by, "eer", "threshold")


def det_points(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Points with both rates positive on normal-deviate axes."""
    points = roc_points(df, by, score, label).filter((F.col("fpr") > 0) & (F.col("fnr") > 0))
    return points.withColumn("fpr_deviate", tails.probit(F.col("fpr"))).withColumn(
        "fnr_deviate", tails.probit(F.col("fnr")))


def confusion(df: DataFrame, by: Sequence[str], label: str, pred: Column) -> DataFrame:
    """The four counts per group."""
    t, p = F.col(label) == 1, pred
    return df.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"),
        F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))


def matthews(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    tp, tn, fp, fn = (c.cast("double") for c in (tp, tn, fp, fn))
    den = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.when(den == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / den)


def _accuracy(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    return (tp + tn) / (tp + tn + fp + fn)


def evaluate(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """EER in percent with MCC and accuracy at its threshold and at one half."""
    # The point itself holds the counts at its threshold, so the rows are not met again.
    best = _best_point(df, by, score, label, None)
    half = confusion(df, by, label, F.col(score) >= 0.5).select(
        *by, *[F.col(c).alias(f"_{c}") for c in ("tp", "tn", "fp", "fn")])
    at_eer = [F.col("tp"), F.col("n") - F.col("fp"), F.col("fp"), F.col("p") - F.col("tp")]
    at_half = [F.col(f"_{c}") for c in ("tp", "tn", "fp", "fn")]
    return join_groups(best, half, by).select(
        *by, (F.col("eer") * 100.0).alias("eer"), F.col("threshold").alias("eer_threshold"),
        matthews(*at_eer).alias("mcc_eer"), _accuracy(*at_eer).alias("acc_eer"),
        matthews(*at_half).alias("mcc_half"), _accuracy(*at_half).alias("acc_half"))


def confusion_grid(df: DataFrame, by: Sequence[str], label: str, pred: Column) -> DataFrame:
    """Confusion counts in long form, absent cells as zero."""
    c = confusion(df, by, label, pred)
    cells = F.array(*[F.struct(F.lit(t).alias("truth"), F.lit(p).alias("pred"), F.col(n).alias("count"))
                      for t, p, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return c.select(*by, F.explode(cells).alias("c")).select(*by, "c.truth", "c.pred", "c.count")


def logit_grid(steps: int = 801, reach: float = 8.0) -> list[float]:
    return [1.0 / (1.0 + math.exp(-(-reach + 2.0 * reach * i / (steps - 1)))) for i in range(steps)]


def thresholds_reached(score: Column, steps: int = 801, reach: float = 8.0) -> Column:
    """How many thresholds of :func:`logit_grid` are at or below a score, without comparing it to each.

    The scaled logit names the place, and the thresholds on both sides of it settle rounding.  A NaN
    reaches all thresholds, as it is the largest number in Spark's order.
    """
    cuts = F.array(*[F.lit(t) for t in logit_grid(steps, reach)])
    place = (F.log(score / (F.lit(1.0) - score)) + F.lit(reach)) * F.lit((steps - 1) / (2.0 * reach)) + 1
    near = F.when(score <= 0, 0.0).when(score < 1, F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(steps))).otherwise(float(steps)).cast("int")

    def settled(k: Column) -> Column:
        down = F.when((k > 0) & (F.get(cuts, k - 1) > score), 1).otherwise(0)
        up = F.when((k < steps) & (F.get(cuts, k) <= score), 1).otherwise(0)
        return k - down + up
    return F.get(F.transform(F.array(near), settled), F.lit(0))


def threshold_rates(df: DataFrame, by: Sequence[str], score: str, label: str, steps: int = 801, reach: float = 8.0) -> DataFrame:
    """Error rates at thresholds equally spaced in logits.

    Every row is reduced to the number of thresholds at or below its score and counted map-side, so the
    rates are cumulative sums over at most ``steps + 1`` rows per group.  Null scores are left out.
    """
    cuts = F.array(*[F.lit(t) for t in logit_grid(steps, reach)])
    positive = F.col(label).cast("long")
    placed = df.where(F.col(score).isNotNull()).select(*by, thresholds_reached(F.col(score).cast("double"), steps, reach).alias("_at"), positive.alias("_pos"))
    per_step = placed.groupBy(*by, "_at").agg(F.sum("_pos").alias("pos"), F.sum(1 - F.col("_pos")).alias("neg"))
    spots = F.explode(F.sequence(F.lit(0), F.lit(steps)))
    frame = per_step.select(*by).distinct().select(*by, spots.alias("_at"))
    full = join_groups(frame, per_step, [*by, "_at"], "left").na.fill(0, ["pos", "neg"])
    below = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*by)
    out = full.select(
        *by, "_at",
        F.try_divide(F.sum("pos").over(below), F.sum("pos").over(everything)).alias("fnr"),
        (F.lit(1.0) - F.try_divide(F.sum("neg").over(below), F.sum("neg").over(everything))).alias("fpr"))
    return out.filter(F.col("_at") > 0).select(
        *by, (F.col("_at") - 1).alias("step"), F.get(cuts, F.col("_at") - 1).alias("threshold"),
        "fpr", "fnr")


def area_under_curve(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """ROC area from the rank sum of positives with average ranks."""
    counts = score_counts(df, by, score, label)
    placed = prefix_sums(counts, by, "score", {"_b": F.col("pos") + F.col("neg")})
    rank = F.col("_b") + (F.col("pos") + F.col("neg") + 1) / F.lit(2.0)
    sums = placed.groupBy(*by).agg(F.sum(rank * F.col("pos")).alias("_r"),
                                   F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    p, n = F.col("_p").cast("double"), F.col("_n").cast("double")
    return sums.select(*by, F.try_divide(F.col("_r") - p * (p + 1) / 2, p * n).alias("roc_auc"))


def classification(df: DataFrame, by: Sequence[str], score: str, label: str,
                   threshold: float = 0.5) -> DataFrame:
    """Balanced accuracy, F1 and ROC area."""
    c = confusion(df, by, label, F.col(score) >= threshold)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    scores = c.select(
        *by, ((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        F.when(2 * tp + fp + fn == 0, 0.0).otherwise(2 * tp / (2 * tp + fp + fn)).alias("f1"))
    return join_groups(scores, area_under_curve(df, by, score, label), by)


def with_decisions(master: DataFrame, tags: Sequence[str], label: str = "ground_truth") -> DataFrame:
    """Decisions and error quadrants at each detector's EER threshold (H9, trap: ``>=``)."""
    from corpuslens.functions.signal import quadrant
    long = _scores_long(master, tags, label)
    limits = equal_error_rate(long, ["detector"], "score", label)
    wide = limits.groupBy().agg(*[
        F.max(F.when(F.col("detector") == t, F.col("threshold"))).alias(f"_thr_{t}") for t in tags])
    out = attach_row(master, wide)
    for t in tags:
        out = out.withColumn(f"pred_{t}", (F.col(f"p_spoof_{t}") >= F.col(f"_thr_{t}")).cast("int"))
        out = out.withColumn(f"quadrant_{t}", quadrant(F.col(label), F.col(f"pred_{t}")))
    return out.drop(*[f"_thr_{t}" for t in tags])


def _scores_long(master: DataFrame, tags: Sequence[str], label: str, *extra: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(t).alias("detector"), F.col(f"p_spoof_{t}").alias("score"))
                      for t in tags])
    return master.select(label, *extra, F.explode(pairs).alias("s")).select(
        label, *extra, "s.detector", "s.score")


scores_long = _scores_long
