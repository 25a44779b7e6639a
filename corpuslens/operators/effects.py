"""Effects of removing parts of a signal, relevance profiles, faithfulness."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions import dsp, signal
from corpuslens.operators import bootstrap, sampling, stats
from corpuslens.operators.order import attach_row

Scorer = Callable[[Column], Column]


def assign_band(hz: Column, edges: Sequence[float], rule: str = "half_open") -> Column:
    """Band of a frequency under one of three edge rules; null when outside.

    The edges are a literal, so the range join is a column expression and nothing is shuffled.
    """
    cuts = F.array(*[F.lit(float(e)) for e in edges])
    last = len(edges) - 2
    at = F.size(F.filter(cuts, lambda e: e <= hz)) - 1
    if rule == "clipped":
        return F.greatest(F.lit(0), F.least(F.lit(last), at))
    if rule == "last_closed":
        at = F.when(hz == float(edges[-1]), last).otherwise(at)
    return F.when((at >= 0) & (at <= last), at)


def band_sums(values: Column, freqs: Sequence[float], edges: Sequence[float], rule: str) -> Column:
    """Sum of a spectrum inside each band; the bins of a band are one slice of the array."""
    masks = dsp.band_masks(_np(freqs), edges, rule)
    out = []
    for row in masks:
        hit = row.nonzero()[0]
        out.append(signal.total(F.slice(values, int(hit[0]) + 1, len(hit))) if len(hit) else F.lit(0.0))
    return F.array(*out)


def _np(freqs: Sequence[float]):
    import numpy as np
    return np.asarray(freqs, dtype=np.float64)


# --- band removal -----------------------------------------------------------------------------

@dataclass(frozen=True)
class LinearScorer:
    """A detector with one weight for each sample: ``link`` turns the weighted sum into a score.

    What removing or keeping bands does to it follows from each band's share of the sum, so it needs
    no altered signals; any other function from samples to scores works too, on signals that are made.
    """

    weights: tuple[float, ...]
    link: Callable[[Column], Column]

    def __call__(self, samples: Column) -> Column:
        w = F.array(*[F.lit(x) for x in self.weights])
        return self.link(signal.total(F.zip_with(samples, w, lambda a, b: a * b)))

    def shares(self, samples: Column, rate: int, edges: Sequence[float], win: int, hop: int) -> Column:
        return dsp.band_projections(samples, self.weights, rate, edges, win, hop)


def _sum_of(parts: Column, bands: Column) -> Column:
    """Sum of the numbers of some bands."""
    return F.aggregate(F.zip_with(parts, F.sequence(F.lit(0), F.size(parts) - 1), lambda v, b: F.when(F.array_contains(bands, b), v).otherwise(0.0)),
                       F.lit(0.0), lambda s, v: s + v)


def band_drops(df: DataFrame, scorer: Scorer, rate: int, edges: Sequence[float], win: int, hop: int,
               samples: str = "samples", bands: Sequence[int] | None = None) -> DataFrame:
    """Add ``drop_<band>``: score of the whole signal minus score without that band (C11).

    A clip is transformed once, whatever the number of bands: removing one takes its part from the sum
    of all parts.  The clip x band product is a set of columns of one row; samples are not shuffled.
    """
    chosen = range(len(edges) - 1) if bands is None else bands
    rows = df.withColumn("_base", scorer(F.col(samples)))
    if isinstance(scorer, LinearScorer):
        rows = rows.withColumn("_parts", scorer.shares(F.col(samples), rate, edges, win, hop)).withColumn("_all", signal.total(F.col("_parts")))
        without = [scorer.link(F.col("_all") - F.get("_parts", F.lit(b))) for b in chosen]
    else:
        add = lambda x, y: F.zip_with(x, y, lambda p, q: p + q)
        rows = rows.withColumn("_parts", dsp.band_parts(F.col(samples), rate, edges, win, hop)).withColumn("_all", F.aggregate(
            F.slice("_parts", F.lit(2), F.size("_parts")), F.get("_parts", F.lit(0)), add))
        without = [scorer(F.zip_with("_all", F.get("_parts", F.lit(b)), lambda p, q: p - q)) for b in chosen]
    return rows.select(*df.columns, *[(F.col("_base") - s).alias(f"drop_{b}") for b, s in zip(chosen, without, strict=True)])


def group_drop(df: DataFrame, scorer: Scorer, bands: Column, rate: int, edges: Sequence[float],
               win: int, hop: int, samples: str = "samples") -> DataFrame:
    """Add ``group_drop``: several bands removed together; an empty group gives zero."""
    out = df.withColumn("_bands", bands)
    if isinstance(scorer, LinearScorer):
        out = out.withColumn("_without", scorer.shares(F.col(samples), rate, edges, win, hop))
        rest = scorer.link(signal.total(F.col("_without")) - _sum_of(F.col("_without"), F.col("_bands")))
    else:
        out = out.withColumn("_without", dsp.drop_bands(F.col(samples), F.col("_bands"), rate, edges, win, hop))
        rest = scorer(F.col("_without"))
    return out.withColumn("group_drop", F.when(F.size("_bands") == 0, F.lit(0.0)).otherwise(scorer(F.col(samples)) - rest)).drop(
        "_bands", "_without")


def occlusion_table(drops: DataFrame, detector: str, edges: Sequence[float], key: Sequence[str], *,
                    n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Mean drop, interval and n per band."""
    columns = [f"drop_{b}" for b in range(len(edges) - 1)]
    ci = bootstrap.mean_ci(drops, [], columns, key, n_boot=n_boot, seed=seed)
    band = F.substring_index("column", "_", -1).cast("int")
    lo, hi = signal.band_bounds(F.col("band"), list(edges))
    return ci.withColumn("band", band).select(
        F.lit(detector).alias("detector"), "band", lo.alias("band_hz_low"), hi.alias("band_hz_high"),
        F.col("mean").alias("mean_p_spoof_drop"), "ci_low", "ci_high", "n")


def profile_agreement(occlusion: DataFrame, strength: DataFrame) -> DataFrame:
    """Rank correlation of causal and associative band profiles, at least three bands (C14)."""
    both = occlusion.select("detector", "band", F.abs("mean_p_spoof_drop").alias("causal")).join(
        strength.select("detector", "band", "strength"), ["detector", "band"]).filter(
        F.col("strength").isNotNull())
    # One row per band: ranks are a small window, bounded by the band grid.
    def avg_rank(c: str) -> Column:
        w = Window.partitionBy("detector")
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(
            Window.partitionBy("detector", c)) - 1) / F.lit(2.0)
    ranked = both.select("detector", avg_rank("causal").alias("rc"), avg_rank("strength").alias("ra"))
    out = ranked.groupBy("detector").agg(F.corr("rc", "ra").alias("rho"), F.count(F.lit(1)).alias("n_bands"))
    rho = F.when(F.col("n_bands") >= 3, F.col("rho"))
    return out.select("detector", rho.alias("rho_causal_vs_assoc"),
                      stats.rank_p_value(rho, F.col("n_bands")).alias("p_value"), "n_bands")


def oriented_effects(drops: DataFrame, strength: DataFrame, detector: str, k: int, n_bands: int) -> DataFrame:
    """Per clip the mean drop times the association sign over the top and bottom bands."""
    chosen = sampling.top_and_bottom(strength.filter(F.col("detector") == detector), k)
    sign = F.signum(F.coalesce("signed", F.lit(0.0)))
    def weights(rank: str) -> list[Column]:
        return [F.coalesce(F.max(F.when((F.col("band") == b) & (F.col(rank) <= k), sign)), F.lit(0.0))
                / F.lit(float(k)) for b in range(n_bands)]
    w = chosen.agg(F.array(*weights("top_rank")).alias("_top"), F.array(*weights("bottom_rank")).alias("_bottom"))
    d = F.array(*[F.col(f"drop_{b}") for b in range(n_bands)])
    def mean(which: str) -> Column:
        return signal.total(F.zip_with(d, F.col(which), lambda a, b: a * b))
    return attach_row(drops, w).withColumn("top_effect", mean("_top")).withColumn(
        "bottom_effect", mean("_bottom")).drop("_top", "_bottom")


# --- time windows -----------------------------------------------------------------------------

def time_drops(df: DataFrame, scorer: Scorer, rate: int, width: int, step: int, keep: Sequence[str],
               samples: str = "samples") -> DataFrame:
    """Score drop of each zeroed time window, with the window centre in seconds."""
    n = F.size(samples)
    starts = F.sequence(F.lit(0), n - width, F.lit(step))
    rows = df.filter(n >= width).withColumn("_base", scorer(F.col(samples))).withColumn(
        "start", F.explode(starts))
    cut = scorer(signal.zero_span(F.col(samples), F.col("start"), width))
    return rows.select(*keep, "start", ((F.col("start") + width / 2.0) / rate).alias("centre"),
                       (F.col("_base") - cut).alias("drop"),
                       F.slice(samples, F.col("start") + 1, width).alias("span"))


def speech_share(drops: DataFrame, level: float) -> DataFrame:
    """Mean drop by frame class and its difference to the overall mean in percent."""
    loud = F.sqrt(signal.mean_square(F.col("span"))) >= level
    rows = drops.select(loud.alias("_loud"), "drop")
    m = rows.agg(
        F.coalesce(F.avg(F.when(F.col("_loud"), F.col("drop"))), F.lit(0.0)).alias("mean_speech"),
        F.coalesce(F.avg(F.when(~F.col("_loud"), F.col("drop"))), F.lit(0.0)).alias("mean_silence"),
        F.coalesce(F.avg("drop"), F.lit(0.0)).alias("_all"),
        F.count_if("_loud").alias("n_speech"), F.count_if(~F.col("_loud")).alias("n_silence"))
    def rel(c: str) -> Column:
        return F.when(F.col("_all") != 0, 100.0 * (F.col(c) - F.col("_all")) / F.col("_all")).otherwise(0.0)
    return m.select("n_speech", "n_silence", "mean_speech", "mean_silence",
                    rel("mean_speech").alias("rel_speech"), rel("mean_silence").alias("rel_silence"))


def degraded_scores(df: DataFrame, scorer: Scorer, conditions: Mapping[str, Callable[[Column], Column]],
                    keep: Sequence[str], samples: str = "samples") -> DataFrame:
    """Score of every row under every degradation, long form."""
    cells = F.array(*[F.struct(F.lit(name).alias("condition"), scorer(fn(F.col(samples))).alias("score"))
                      for name, fn in conditions.items()])
    return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.condition", "c.score")


# --- relevance --------------------------------------------------------------------------------

def relevance_table(df: DataFrame, bands: str, edges: Sequence[float], key: Sequence[str],
                    by: Sequence[str] = (), *, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Mean relevance and interval per band, overall or by predicted class.

    A class with fewer than two rows is left out.
    """
    n = len(edges) - 1
    wide = df.select(*by, *key, *[F.get(bands, F.lit(b)).alias(f"band_{b}") for b in range(n)])
    ci = bootstrap.mean_ci(wide, list(by), [f"band_{b}" for b in range(n)], key, n_boot=n_boot, seed=seed)
    band = F.substring_index("column", "_", -1).cast("int")
    lo, hi = signal.band_bounds(F.col("band"), list(edges))
    out = ci.withColumn("band", band).select(
        *by, "band", lo.alias("band_hz_low"), hi.alias("band_hz_high"),
        F.col("mean").alias("mean_relevance"), "ci_low", "ci_high", "n")
    return out.filter(F.col("n") >= 2) if by else out


def salience_share(magnitudes: Column) -> Column:
    """Distribution of absolute relevance over bins of one clip; zeros stay zeros."""
    whole = signal.total(magnitudes)
    share = signal.against(magnitudes, F.nullif(whole, F.lit(0.0)), lambda v, t: v / t)
    return F.when(whole > 0, share).otherwise(magnitudes)


def completeness(df: DataFrame, relevance_sum: str, logit_without_bias: str) -> DataFrame:
    """Means of both sides and the share the inner biases carry."""
    gap = F.col(logit_without_bias) - F.col(relevance_sum)
    return df.agg(
        F.avg(relevance_sum).alias("mean_relevance"), F.avg(logit_without_bias).alias("mean_logit"),
        F.avg(gap).alias("mean_gap"),
        (F.avg(F.abs(gap)) / (F.avg(F.abs(logit_without_bias)) + F.lit(1e-12))).alias("bias_share"))


def population_map(maps: DataFrame, by: Sequence[str], r_tf: str = "r_tf") -> DataFrame:
    """Mean absolute, positive and negative relevance per (frame, bin) over clips."""
    frames = maps.select(*by, F.posexplode(r_tf).alias("t", "_row"))
    cells = frames.select(*by, "t", F.posexplode("_row").alias("f", "_r"))
    r = F.col("_r")
    return cells.groupBy(*by, "t", "f").agg(
        F.avg(F.abs(r)).alias("magnitude"), F.avg(F.greatest(r, F.lit(0.0))).alias("toward_spoof"),
        F.avg(F.greatest(-r, F.lit(0.0))).alias("toward_bonafide"))


def frequency_profile(population: DataFrame, by: Sequence[str]) -> DataFrame:
    """Time-averaged profile: share, own-maximum scale and direction share per bin.

    The windows run over one row per bin of a group.
    """
    marg = population.groupBy(*by, "f").agg(*[
        F.avg(c).alias(c) for c in ("magnitude", "toward_spoof", "toward_bonafide")])
    w = Window.partitionBy(*by)
    tiny = F.lit(1e-12)
    both = F.sum("toward_spoof").over(w) + F.sum("toward_bonafide").over(w) + tiny
    top = F.greatest(F.max("toward_spoof").over(w), F.max("toward_bonafide").over(w)) + tiny
    return marg.select(
        *by, "f", "magnitude",
        (100.0 * F.col("magnitude") / (F.sum("magnitude").over(w) + tiny)).alias("share_pct"),
        (F.col("magnitude") / (F.max("magnitude").over(w) + tiny)).alias("relative"),
        (100.0 * F.col("toward_spoof") / both).alias("spoof_share_pct"),
        (100.0 * F.col("toward_bonafide") / both).alias("bonafide_share_pct"),
        (F.col("toward_spoof") / top).alias("spoof_relative"),
        (F.col("toward_bonafide") / top).alias("bonafide_relative"))


def band_profile(population: DataFrame, by: Sequence[str], bin_hz: float, edges: Sequence[float]) -> DataFrame:
    """Mean marginal inside each band (last band closed; empty bands zero), scaled by its maximum."""
    n = len(edges) - 1
    marg = population.groupBy(*by, "f").agg(F.avg("magnitude").alias("magnitude"))
    band = assign_band(F.col("f") * bin_hz, edges, "last_closed")
    means = marg.withColumn("band", band).groupBy(*by).agg(*[
        F.coalesce(F.avg(F.when(F.col("band") == b, F.col("magnitude"))), F.lit(0.0)).alias(f"b{b}")
        for b in range(n)])
    top = F.greatest(*[F.col(f"b{b}") for b in range(n)]) if n > 1 else F.col("b0")
    cells = F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"b{b}").alias("magnitude"),
                               (F.col(f"b{b}") / (top + 1e-12)).alias("relative")) for b in range(n)])
    return means.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


# --- faithfulness -----------------------------------------------------------------------------

CONDITIONS = ("keep_top", "delete_top", "keep_random", "delete_random")


def intervention_grid(df: DataFrame, ks: Sequence[int], draws: int, n_bands: int, key: str,
                      ranking: str = "ranking", seed: int = 0) -> DataFrame:
    """Condition x k x draw of every clip with the bands it keeps.

    The grid is a literal exploded inside the row.
    """
    cells = [F.struct(F.lit(c).alias("condition"), F.lit(k).alias("k"), F.lit(d).alias("draw"))
             for k in ks for c in CONDITIONS for d in range(draws if c.endswith("random") else 1)]
    rows = df.withColumn("_g", F.explode(F.array(*cells))).select("*", "_g.*").drop("_g")
    top = F.slice(ranking, F.lit(1), F.col("k"))
    rand = sampling.random_bands(n_bands, F.col("k"), F.lit(str(seed)), key, "k", "draw")
    picked = F.when(F.col("condition").endswith("random"), rand).otherwise(top)
    kept = F.when(F.col("condition").startswith("keep"), picked).otherwise(
        sampling.complement(n_bands, picked))
    return rows.withColumn("kept", kept)


def intervention_scores(grid: DataFrame, scorer: Scorer, rate: int, edges: Sequence[float], win: int,
                        hop: int, by: Sequence[str], samples: str = "samples", shares: str = "shares") -> DataFrame:
    """Probability of the predicted class per (clip, condition, k), random draws averaged.

    ``predicted`` (boolean) orients the probability; ``by`` names the clip columns kept.  For a linear scorer
    the rows hold each band's ``shares`` of the sum instead of samples, so a cell of the grid costs a few numbers.
    """
    if isinstance(scorer, LinearScorer):
        p = scorer.link(_sum_of(F.col(shares), F.col("kept")))
        y = grid
    else:
        y = grid.withColumn("_y", dsp.keep_bands(F.col(samples), F.col("kept"), rate, edges, win, hop))
        p = scorer(F.col("_y"))
    oriented = y.withColumn("_p", F.when(F.col("predicted"), p).otherwise(1.0 - p))
    return oriented.groupBy(*by, "condition", "k").agg(F.avg("_p").alias("p_pred"))


def faithfulness_curves(rows: DataFrame, key: Sequence[str], *, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and interval per (class, condition, k)."""
    by = ["true_class", "condition", "k"]
    ci = bootstrap.mean_ci(rows, by, ["p_pred"], key, n_boot=n_boot, seed=seed, shared=True)
    return ci.select(*by, *[F.round(c, 5).alias(o) for c, o in (
        ("mean", "p_pred_mean"), ("ci_low", "ci_low"), ("ci_high", "ci_high"))],
        F.col("n").alias("n_clips"))


def curve_areas(rows: DataFrame, n_ks: int, key: str, original: str = "p_orig") -> DataFrame:
    """Per clip the mean of its curve; clips lacking a k are left out."""
    kept = F.col("condition").startswith("keep")
    value = F.when(kept, F.col("p_pred")).otherwise(F.col(original) - F.col("p_pred"))
    metric = F.when(kept, "sufficiency").otherwise("comprehensiveness")
    return (rows.groupBy(key, "true_class", "condition", metric.alias("metric"))
            .agg(F.avg(value).alias("aopc"), F.countDistinct("k").alias("_ks"))
            .filter(F.col("_ks") == n_ks).drop("_ks"))


def area_means(areas: DataFrame) -> DataFrame:
    """Means of :func:`area_table` alone, for readers that need no interval: no replicate is drawn."""
    return areas.groupBy("metric", "condition", "true_class").agg(F.round(F.avg("aopc"), 5).alias("aopc"), F.count(F.lit(1)).alias("n_clips"))


def area_table(areas: DataFrame, key: str, *, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    by = ["metric", "condition", "true_class"]
    ci = bootstrap.mean_ci(areas, by, ["aopc"], [key], n_boot=n_boot, seed=seed, shared=True)
    return ci.select(*by, *[F.round(c, 5).alias(o) for c, o in (
        ("mean", "aopc"), ("ci_low", "ci_low"), ("ci_high", "ci_high"))], F.col("n").alias("n_clips"))


def area_comparison(tables: DataFrame, by: Sequence[str] = ("run", "metric", "true_class")) -> DataFrame:
    """Explanation against random per run, metric and class."""
    top = F.max(F.when(F.col("condition").endswith("top"), F.col("aopc")))
    rand = F.max(F.when(F.col("condition").endswith("random"), F.col("aopc")))
    return tables.groupBy(*by).agg(top.alias("explained"), rand.alias("random"),
                                   (top - rand).alias("gain"))
