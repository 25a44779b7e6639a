"""Comparison across runs."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from corpuslens.functions.text import hertz_label
from corpuslens.operators.order import ordinal_ranks


def common_keys(df: DataFrame, run: str, key: Sequence[str], n_runs: int) -> DataFrame:
    """Rows whose key every run has (C15); the key counts are a partial aggregation."""
    full = df.groupBy(*key).agg(F.countDistinct(run).alias("_r")).filter(F.col("_r") == n_runs)
    return df.join(full.select(*key), list(key), "left_semi")


def rank_agreement(df: DataFrame, runs: Sequence[str], run: str, key: str, value: str,
                   minimum: int = 3) -> DataFrame:
    """Rank correlation of every pair of runs over their common keys.

    Ranks are ordinal.  The runs become columns, so each pair is one aggregate and no row
    meets another run's row more than once.
    """
    both = common_keys(df.filter(F.col(run).isin(*runs)), run, [key], len(runs))
    ranked = ordinal_ranks(both, [run], value, [key], "_rank")
    wide = ranked.groupBy(key).pivot(run, list(runs)).agg(F.first("_rank"))
    pairs = list(combinations(sorted(runs), 2))
    sums = wide.agg(F.count(F.lit(1)).alias("n"), *[
        F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("run_a"), F.lit(b).alias("run_b"), F.col(f"c{i}").alias("spearman"))
                      for i, (a, b) in enumerate(pairs)])
    return sums.filter(F.col("n") >= minimum).select("n", F.explode(cells).alias("c")).select("c.*", "n")


def top_bands(df: DataFrame, run: str, centre: str, value: str, k: int = 5) -> DataFrame:
    """The k bands of largest absolute value per run (D53); runs hold one row per band."""
    w = Window.partitionBy(run).orderBy(F.abs(value).desc(), centre)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        run, "rank", F.round(centre, 1).alias("band_center_hz"), hertz_label(F.col(centre)).alias("band"),
        F.round(F.abs(value), 4).alias("abs_relevance"), F.round(value, 4).alias("signed_relevance"))


def runs_by_first_band(top: DataFrame, run: str) -> DataFrame:
    """Runs grouped by their first band; one row per run goes in."""
    return top.filter(F.col("rank") == 1).groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(run)), ", ").alias("runs"))


def preferred_backend(df: DataFrame, run: str, backend: str, preferred: str) -> DataFrame:
    """Per run only the rows of its preferred backend, else of the first other one."""
    order = F.struct(F.when(F.col(backend) == preferred, 0).otherwise(1), F.col(backend))
    chosen = df.groupBy(run).agg(F.min_by(backend, order).alias(backend))
    return df.join(chosen, [run, backend], "left_semi")


def latest_runs(df: DataFrame, encoder: str, run: str) -> DataFrame:
    """Newest run per encoder; runs named smoke only when there is no other."""
    order = F.struct(F.when(F.col(run).startswith("smoke"), 0).otherwise(1), F.col(run))
    return df.groupBy(encoder).agg(F.max_by(run, order).alias(run))


def comparison_table(performance: DataFrame, run: str) -> DataFrame:
    """One row per run: adapted metrics and the zero-shot EER if there is one, by EER."""
    def of(tag: str, column: str):
        return F.max(F.when(F.col("detector") == tag, F.col(column)))

    return performance.groupBy(run).agg(
        of("ad", "eer").alias("eer_ad"), of("ad", "mcc").alias("mcc_ad"),
        of("ad", "accuracy").alias("accuracy_ad"), of("zs", "eer").alias("eer_zs")).orderBy("eer_ad", run)


def score_lookup(chosen: DataFrame, scores: DataFrame, runs: Sequence[str], key: str = "sample_id",
                 score: str = "p_spoof") -> DataFrame:
    """Chosen clips with each run's score, null where a run lacks the clip."""
    wide = scores.join(chosen.select(key), key, "left_semi").groupBy(key).pivot(
        "run", list(runs)).agg(F.first(score))
    return chosen.join(wide, key, "left")


def in_label_order(df: DataFrame, run: str, order: Sequence[str]) -> DataFrame:
    """Runs in a given order, unknown ones last."""
    place = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        place = F.when(F.col(run) == name, i).otherwise(place)
    return df.orderBy(place, run)
