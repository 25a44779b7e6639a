"""Signal columns in native higher-order functions: they stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """Evaluate ``values`` once per row and hand them to ``body`` as fields of one variable.

    Inside a lambda an outer expression would be evaluated again for every element, which
    turns a linear pass over a signal into a quadratic one.
    """
    bound = F.array(F.struct(*[c.alias(n) for n, c in values.items()]))
    return F.get(F.transform(bound, body), F.lit(0))


def against(x: Column, scalar: Column, fn: Callable[[Column, Column], Column]) -> Column:
    """``fn(value, scalar)`` for every element; the scalar is evaluated once per row.

    No lambda reads a variable of an outer one, so the result may feed a Python kernel.
    """
    return F.zip_with(x, F.array_repeat(scalar, F.size(x)), fn)


# --- grids (driver-side constants) -----------------------------------------------------------

def mel_edges(n_bands: int = 8, f_min: float = 20.0, f_max: float = 7900.0) -> list[float]:
    """Band edges equally spaced on the mel scale."""
    lo, hi = (2595.0 * math.log10(1.0 + f / 700.0) for f in (f_min, f_max))
    return [700.0 * (10.0 ** ((lo + (hi - lo) * i / n_bands) / 2595.0) - 1.0)
            for i in range(n_bands + 1)]


def band_columns(n_bands: int) -> list[str]:
    return [f"band{k}_{stat}" for stat in ("mean", "std") for k in range(1, n_bands + 1)]


def band_number(feature: Column) -> Column:
    """Zero-based band of ``band<k>_<stat>``; null for another name."""
    k = F.regexp_extract(feature, "^band([0-9]+)_(mean|std)$", 1)
    return F.when(k != "", k.cast("int") - 1)


def band_bounds(band: Column, edges: list[float]) -> tuple[Column, Column]:
    arr = F.array(*[F.lit(float(e)) for e in edges])
    return F.get(arr, band), F.get(arr, band + 1)


def band_group(feature: Column, edges: list[float], low: float = 500.0, high: float = 2000.0) -> Column:
    lo, hi = band_bounds(band_number(feature), edges)
    centre = (lo + hi) / 2
    return F.when(centre < low, "low").when(centre < high, "mid").otherwise("high")


def band_label(feature: Column, edges: list[float]) -> Column:
    lo, hi = band_bounds(band_number(feature), edges)
    sign = F.when(feature.endswith("_mean"), "\u03bc").otherwise("\u03c3")
    return F.concat(F.format_string("%.2f", lo / 1000), F.lit("\u2013"),
                    F.format_string("%.2f", hi / 1000), F.lit(" kHz\u00b7"), sign)


def kept_bands_label(bands: Column, edges: list[float]) -> Column:
    """Kept bands in kHz, sorted by frequency."""
    arr = F.array(*[F.lit(float(e)) for e in edges])
    return F.array_join(F.transform(F.array_sort(bands), lambda i: F.concat(
        F.format_string("%.2f", F.get(arr, i) / 1000), F.lit("-"),
        F.format_string("%.2f", F.get(arr, i + 1) / 1000))), "; ")


# --- sums -------------------------------------------------------------------------------------

def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def average(x: Column) -> Column:
    return F.try_divide(total(x), F.size(x))


def mean_square(x: Column) -> Column:
    return F.try_divide(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v), F.size(x))


# --- shaping ----------------------------------------------------------------------------------

def mono(channels: Column) -> Column:
    """Average over channels of frames given as arrays of channel values (G1).

    Each value is divided before it is added, so large values do not overflow.
    """
    return F.transform(channels, lambda frame: F.aggregate(
        against(frame, F.size(frame), lambda v, n: v / n), F.lit(0.0), lambda s, v: s + v))


def clip_unit(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)))


def fix_length(x: Column, n: int) -> Column:
    """Truncate, or repeat the signal until it is long enough."""
    repeats = F.ceil(F.lit(n) / F.size(x)).cast("int")
    return F.when(F.size(x) >= n, F.slice(x, 1, n)).otherwise(
        F.slice(F.flatten(F.array_repeat(x, repeats)), 1, n))


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    """Zero mean and unit population variance."""
    mean = average(x)
    spread = F.sqrt(mean_square(x) - mean * mean + F.lit(eps))
    return against(against(x, mean, lambda v, m: v - m), spread, lambda v, s: v / s)


def peak_norm(x: Column) -> Column:
    scaled = against(x, F.nullif(peak(x), F.lit(0.0)), lambda v, p: v / p)
    return F.when(peak(x) > 0, scaled).otherwise(x)


def frames(x: Column, width: int, hop: int) -> Column:
    """Complete frames of ``width`` samples every ``hop`` samples."""
    starts = F.when(F.size(x) >= width, F.sequence(F.lit(0), F.size(x) - width, F.lit(hop))).otherwise(
        F.array().cast("array<int>"))
    return let(lambda r: F.transform(r["at"], lambda s: F.slice(r["x"], s + 1, width)), x=x, at=starts)


def tiles(x: Column, width: Column) -> Column:
    """Consecutive frames, the short tail kept."""
    starts = F.sequence(F.lit(0), F.size(x) - 1, width)
    return let(lambda r: F.transform(r["at"], lambda s: F.slice(r["x"], s + 1, r["w"])),
               x=x, at=starts, w=width)


# --- measures ---------------------------------------------------------------------------------

def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v)))


def rms(x: Column) -> Column:
    """Overflow-safe root mean square: scaled by the peak first."""
    top = peak(x)
    scaled = against(x, F.nullif(top, F.lit(0.0)), lambda v, p: v / p)
    return F.when(top == 0, F.lit(0.0)).otherwise(top * F.sqrt(mean_square(scaled)))


def silence_ratio(x: Column, threshold: float = 1e-4) -> Column:
    return F.try_divide(F.size(F.filter(x, lambda v: F.abs(v) <= threshold)), F.size(x))


def dbfs(level: Column) -> Column:
    return F.when(level > 0, F.lit(20.0) * F.log10(level))


def dbfs_reason(level: Column) -> Column:
    return F.when(~(level > 0), "decoded RMS is zero")


def frame_width(rate: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(rate * F.lit(0.02)).cast("int"))


def snr_parts(x: Column, rate: Column) -> tuple[Column, Column]:
    """(estimate, reason): total RMS over the first decile of positive 20 ms frame RMS."""
    levels = F.transform(tiles(x, frame_width(rate)), lambda f: F.sqrt(mean_square(f)))
    positive = F.array_sort(F.filter(levels, lambda v: v > 0))

    def judge(r: Column) -> Column:
        n = F.size(r["v"])
        spot = F.lit(0.1) * (n - 1)
        lo, hi = F.get(r["v"], F.floor(spot).cast("int")), F.get(r["v"], F.ceil(spot).cast("int"))
        noise = lo + (hi - lo) * (spot - F.floor(spot))
        reason = (F.when(r["level"] == 0, "decoded signal RMS is zero")
                  .when(n < 2, "insufficient non-silent 20 ms frames for noise-floor proxy")
                  .when(noise <= 0, "estimated noise-floor proxy is zero"))
        return F.struct(reason.alias("reason"), F.when(
            reason.isNull(), F.lit(20.0) * F.log10(r["level"] / noise)).alias("snr"))

    found = let(judge, v=positive, level=F.sqrt(mean_square(x)))
    return found["snr"], found["reason"]


# --- degradations -----------------------------------------------------------------------------

def add_noise(x: Column, snr_db: float, draws: Column) -> Column:
    """White noise at a target signal-to-noise ratio from standard normal draws."""
    sigma = F.sqrt(mean_square(x) / F.lit(10.0 ** (snr_db / 10.0)))
    return F.zip_with(x, against(draws, sigma, lambda z, s: z * s), lambda v, n: v + n)


def mu_law(x: Column, mu: int = 255) -> Column:
    """Eight-bit mu-law round trip of samples in [-1, 1]."""
    def one(v: Column) -> Column:
        c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
        packed = F.signum(c) * F.log1p(F.lit(float(mu)) * F.abs(c)) / F.lit(math.log1p(mu))
        level = F.floor((packed + 1) / 2 * mu + F.lit(0.5))
        back = level / F.lit(float(mu)) * 2 - 1
        return F.signum(back) * (F.pow(F.lit(1.0 + mu), F.abs(back)) - 1) / F.lit(float(mu))
    return F.transform(x, one)


def zero_span(x: Column, start: Column, width: int) -> Column:
    """The signal with samples ``start .. start + width`` set to zero."""
    tail = F.slice(x, start + width + 1, F.greatest(F.size(x) - start - width, F.lit(0)))
    return F.concat(F.slice(x, F.lit(1), start), F.array_repeat(F.lit(0.0), width), tail)


# --- relevance maps ---------------------------------------------------------------------------

def envelopes(relevance: Column) -> tuple[Column, Column]:
    """Per frame, the sums of positive and of negative relevance."""
    up = F.transform(relevance, lambda row: F.aggregate(
        row, F.lit(0.0), lambda s, v: s + F.greatest(v, F.lit(0.0))))
    down = F.transform(relevance, lambda row: F.aggregate(
        row, F.lit(0.0), lambda s, v: s + F.greatest(-v, F.lit(0.0))))
    return up, down


def conservation_error(relevance: Column, by_frequency: Column) -> Column:
    """Absolute difference of the two totals."""
    return F.abs(total(by_frequency) - total(relevance))


def quadrant(truth: Column, pred: Column) -> Column:
    return (F.when((truth == 1) & (pred == 1), "TP").when((truth == 0) & (pred == 0), "TN")
            .when((truth == 0) & (pred == 1), "FP").when((truth == 1) & (pred == 0), "FN"))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
