"""Spectral columns: numpy kernels on Arrow batches.

Spark reads, partitions and shuffles the signals; each function below is a
scalar Arrow UDF that maps a batch of arrays to a batch of arrays.  Signals of
equal length in a batch are stacked and transformed together; values go from Arrow
buffers to matrices and back, so a worker never holds an object for each number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from corpuslens.functions import signal


def kernel_udf(schema: str):
    """Scalar Arrow UDF that the optimizer leaves in a projection of its own.

    A deterministic UDF would be inlined into every expression that reads its result; the mark
    keeps one evaluation per row.  The kernels themselves are pure.
    """
    def wrap(fn):
        return F.arrow_udf(fn, schema).asNondeterministic()
    return wrap


CHUNK_VALUES = 1 << 18  # samples one matrix may hold, so that what kernels make of them stays small

#: Rows of a batch and the result of a kernel for them, one entry per row.
Parts = list[tuple[np.ndarray, np.ndarray]]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of all rows end to end, where each row starts, and its length, -1 for a null row."""
    offsets = column.offsets.to_numpy()
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), -1)
    return column.values.cast(pa.float64()).to_numpy(zero_copy_only=False), offsets[:-1], lengths


def by_length(columns: Sequence[pa.Array], kernel: Callable[..., np.ndarray], *aligned: np.ndarray,
              usable: np.ndarray | None = None, least: int = 0) -> Parts:
    """Apply a matrix kernel to rows of equal length, in bounded chunks.

    The kernel gets a matrix for each column.  ``aligned`` arrays have one entry per row and are cut like the
    rows.  Rows that are not ``usable``, lack a column, are shorter than ``least`` or differ in length are left out.
    """
    flat = [_flat(c) for c in columns]
    length = flat[0][2]
    taken = length >= least
    for _, _, other in flat[1:]:
        taken &= other == length
    if usable is not None:
        taken &= usable
    out = []
    for n in np.unique(length[taken]):
        rows = np.flatnonzero(taken & (length == n))
        step = max(1, CHUNK_VALUES // max(1, int(n)))
        for start in range(0, len(rows), step):
            part = rows[start:start + step]
            matrices = [values[starts[part][:, None] + np.arange(n)] for values, starts, _ in flat]
            out.append((part, kernel(*matrices, *[a[part] for a in aligned])))
    return out


def _lists(values: np.ndarray) -> pa.Array:
    """One list per row of a matrix, one list of lists per matrix of a stack."""
    out = pa.array(np.ascontiguousarray(values, np.float64).reshape(-1))
    for axis in range(values.ndim - 1, 0, -1):
        ends = np.arange(math.prod(values.shape[:axis]) + 1, dtype=np.int32) * np.int32(values.shape[axis])
        out = pa.ListArray.from_arrays(pa.array(ends), out)
    return out


def in_order(parts: Parts, n: int, depth: int = 1) -> pa.Array:
    """Results of ``n`` rows in the order of the batch, as lists or as lists of lists; null for rows left out."""
    kind = pa.float64()
    for _ in range(depth):
        kind = pa.list_(kind)
    place = np.full(n, -1)
    place[np.concatenate([rows for rows, _ in parts] or [np.zeros(0, int)])] = np.arange(sum(len(rows) for rows, _ in parts))
    found = pa.concat_arrays([_lists(v) for _, v in parts] or [pa.nulls(0, kind)])
    if n == len(found) and (place == np.arange(n)).all():
        return found
    return found.take(pa.array(place, mask=place < 0))


def band_masks(freqs: np.ndarray, edges: Sequence[float], rule: str) -> np.ndarray:
    """(bands, bins) membership under one of the three edge rules.

    ``half_open``: lo <= f < hi.  ``last_closed``: the last band also takes its upper
    edge.  ``clipped``: every bin belongs to exactly one band, outer bins to the ends.
    """
    e = np.asarray(edges, dtype=np.float64)
    if rule == "clipped":
        owner = np.clip(np.searchsorted(e, freqs, side="right") - 1, 0, len(e) - 2)
        return owner[None, :] == np.arange(len(e) - 1)[:, None]
    masks = (freqs[None, :] >= e[:-1, None]) & (freqs[None, :] < e[1:, None])
    if rule == "last_closed":
        masks[-1] |= freqs == e[-1]
    return masks


def _framed_power(x: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """Power spectrum of centred frames with reflected ends and a periodic Hann window."""
    half = frame // 2
    padded = np.pad(x, ((0, 0), (half, half)), mode="reflect")
    view = np.lib.stride_tricks.sliding_window_view(padded, frame, axis=1)[:, ::hop]
    window = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(frame) / frame)
    return np.abs(np.fft.rfft(view * window, axis=-1)) ** 2


def power_spectrum(samples: Column, frame: int, hop: int) -> Column:
    """Frames x bins of power."""
    @kernel_udf("array<array<double>>")
    def run(x: pa.Array) -> pa.Array:
        return in_order(by_length([x], lambda m: _framed_power(m, frame, hop)), len(x), 2)
    return run(samples)


def log_band_energy(samples: Column, rate: int, edges: Sequence[float], frame: int, hop: int,
                    eps: float = 1e-10) -> Column:
    """Mean and population deviation over frames of the log energy of each band."""
    masks = band_masks(np.fft.rfftfreq(frame, 1.0 / rate), edges, "half_open").astype(np.float64)

    @kernel_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        def kernel(m: np.ndarray) -> np.ndarray:
            logs = np.log(_framed_power(m, frame, hop) @ masks.T + eps)
            return np.concatenate([logs.mean(axis=1), logs.std(axis=1)], axis=1)
        return in_order(by_length([x], kernel), len(x))
    return run(samples)


def _fold(n: int) -> np.ndarray:
    """How often each bin of a real transform of length ``n`` stands for one of the whole transform."""
    k = np.arange(n // 2 + 1)
    return 2.0 - (k == 0) - (2 * k == n)


def _real_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.real * b.real + a.imag * b.imag


def _spectral_relevance(x: np.ndarray, relevance: np.ndarray, eps: float) -> np.ndarray:
    """Relevance of bins by the identity sum(x * g) = sum(fold * Re(X conj G)) / n, with g the relevance of a
    unit of each sample; samples of no more than ``eps`` carry none."""
    unit = np.divide(relevance, x, out=np.zeros_like(x), where=np.abs(x) > eps)
    n = x.shape[-1]
    return _real_product(np.fft.rfft(x), np.fft.rfft(unit)) * (_fold(n) / n)


def frequency_relevance(samples: Column, relevance: Column, eps: float = 1e-9) -> Column:
    """Relevance per frequency bin of whole signals."""
    @kernel_udf("array<double>")
    def run(x: pa.Array, r: pa.Array) -> pa.Array:
        return in_order(by_length([x, r], lambda m, n: _spectral_relevance(m, n, eps)), len(x))
    return run(samples, relevance)


class Frames:
    """Windowed frames of signals of one length, which are framed as a stack and added up by one scatter.

    A signal has half a window of zeros on both sides.  ``share`` undoes the overlap of the windows: the
    comb of frame starts convolved with the window tells how much of it covers each sample.
    """

    def __init__(self, n: int, win: int, hop: int) -> None:
        self.n, self.win, self.hop, self.side = n, win, hop, win // 2
        self.length = n + 2 * self.side
        self.starts = np.arange(0, self.length - win + 1, hop)
        self.window = np.hanning(win)
        comb = np.zeros(max(1, self.length - win + 1))
        comb[self.starts] = 1.0
        cover = np.convolve(comb, self.window)[:self.length]
        self.share = np.divide(1.0, cover, out=np.ones_like(cover), where=cover > 0)

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (self.side, self.side)))

    def cut(self, padded: np.ndarray) -> np.ndarray:
        """Rows x frames x window of rows that are padded; a view."""
        if not len(self.starts):
            return np.zeros((len(padded), 0, self.win))
        return np.lib.stride_tricks.sliding_window_view(padded, self.win, axis=1)[:, ::self.hop]

    def spectra(self, x: np.ndarray) -> np.ndarray:
        return np.fft.rfft(self.cut(self.padded(x)) * self.window)

    def joined(self, spectra: np.ndarray) -> np.ndarray:
        """Signals from the spectra of their frames."""
        parts = np.fft.irfft(spectra, n=self.win)
        place = (self.starts[:, None] + np.arange(self.win)).ravel()
        at = np.arange(len(parts))[:, None] * self.length + place
        whole = np.bincount(at.ravel(), parts.ravel(), minlength=len(parts) * self.length).reshape(len(parts), self.length)
        return (whole * self.share)[:, self.side:self.side + self.n]


def _framed_relevance(frames: Frames, x: np.ndarray, r: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Windowed frames of signals and the relevance of their bins, rows x frames x bins."""
    heard = frames.cut(frames.padded(x)) * frames.window
    said = frames.cut(frames.padded(r) * frames.share) * frames.window
    return heard, _spectral_relevance(heard, said, eps)


def bin_relevance(samples: Column, relevance: Column, win: int, hop: int, eps: float = 1e-9) -> Column:
    """Relevance of each bin over all frames: :func:`time_frequency_relevance` summed over time, without its maps.

    Signals shorter than the window give null.
    """
    def kernel(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        return _framed_relevance(Frames(x.shape[1], win, hop), x, r, eps)[1].sum(axis=1)

    @kernel_udf("array<double>")
    def run(x: pa.Array, r: pa.Array) -> pa.Array:
        return in_order(by_length([x, r], kernel, least=win), len(x))
    return run(samples, relevance)


def time_frequency_relevance(samples: Column, relevance: Column, rate: int, win: int, hop: int,
                             eps: float = 1e-9) -> Column:
    """Struct of times, freqs, relevance map and magnitude map, frames x bins.

    Each sample's relevance is shared between the frames that cover it in proportion to the
    window, so the total is kept.  Signals shorter than the window give null.
    """
    schema = ("times array<double>, freqs array<double>, r_tf array<array<double>>, "
              "s_tf array<array<double>>")

    def kernel(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        heard, shared = _framed_relevance(Frames(x.shape[1], win, hop), x, r, eps)
        return np.stack([shared, np.abs(np.fft.rfft(heard))], axis=1)

    freqs = np.fft.rfftfreq(win, 1.0 / rate)

    @kernel_udf(schema)
    def run(x: pa.Array, r: pa.Array) -> pa.Array:
        maps = by_length([x, r], kernel, least=win)

        def column(made: Callable[[np.ndarray], np.ndarray], depth: int = 1) -> pa.Array:
            return in_order([(rows, made(m)) for rows, m in maps], len(x), depth)

        def same(values: np.ndarray, count: int) -> np.ndarray:
            return np.broadcast_to(values, (count, len(values)))

        return pa.StructArray.from_arrays([
            column(lambda m: same((np.arange(m.shape[2]) * hop + (win / 2.0 - win // 2)) / rate, len(m))), column(lambda m: same(freqs, len(m))),
            column(lambda m: m[:, 0], 2), column(lambda m: m[:, 1], 2)], ["times", "freqs", "r_tf", "s_tf"])
    return run(samples, relevance)


def _owners(rate: int, edges: Sequence[float], win: int) -> np.ndarray:
    """(bands, bins): every bin belongs to one band."""
    return band_masks(np.fft.rfftfreq(win, 1.0 / rate), edges, "clipped")


def band_parts(samples: Column, rate: int, edges: Sequence[float], win: int, hop: int) -> Column:
    """Bands x samples: what each band adds to the signal; one analysis, and a synthesis for each band."""
    owners = _owners(rate, edges, win)

    def kernel(m: np.ndarray) -> np.ndarray:
        frames = Frames(m.shape[1], win, hop)
        spectra = frames.spectra(m)
        return np.stack([frames.joined(spectra * o) for o in owners], axis=1)

    @kernel_udf("array<array<double>>")
    def run(x: pa.Array) -> pa.Array:
        return in_order(by_length([x], kernel), len(x), 2)
    return run(samples)


def band_projections(samples: Column, weights: Sequence[float], rate: int, edges: Sequence[float], win: int, hop: int) -> Column:
    """For each band the inner product of fixed weights with what the band adds to the signal.

    By the same identity as for relevance these are sums over the frames' bins, so a signal is analysed
    once and nothing is synthesised.  Signals of another length than the weights give null.
    """
    owners, w = _owners(rate, edges, win).astype(np.float64), np.asarray(weights, np.float64)

    def kernel(m: np.ndarray) -> np.ndarray:
        frames = Frames(m.shape[1], win, hop)
        seen = np.fft.rfft(frames.cut(frames.padded(w[None, :]) * frames.share))
        return _real_product(frames.spectra(m), seen).sum(axis=1) * (_fold(win) / win) @ owners.T

    @kernel_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        return in_order(by_length([x], kernel, usable=_flat(x)[2] == len(w)), len(x))
    return run(samples)


def keep_bands(samples: Column, kept: Column, rate: int, edges: Sequence[float], win: int,
               hop: int) -> Column:
    """The signal with only the bands listed in ``kept``.

    Keeping all bands gives the signal back; keeping none gives zeros.
    """
    owners = _owners(rate, edges, win)

    def kernel(m: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        frames = Frames(m.shape[1], win, hop)
        return frames.joined(frames.spectra(m) * (chosen @ owners)[:, None, :])

    @kernel_udf("array<double>")
    def run(x: pa.Array, bands: pa.Array) -> pa.Array:
        numbers, starts, lengths = _flat(bands)
        chosen = np.zeros((len(x), len(owners)))
        for row in np.flatnonzero(lengths > 0):
            chosen[row] = np.isin(np.arange(len(owners)), numbers[starts[row]:starts[row] + lengths[row]])
        return in_order(by_length([x], kernel, chosen, usable=lengths >= 0), len(x))
    return run(samples, kept)


def drop_bands(samples: Column, dropped: Column, rate: int, edges: Sequence[float], win: int,
               hop: int) -> Column:
    """The signal without the bands listed in ``dropped``."""
    everything = F.array(*[F.lit(i) for i in range(len(edges) - 1)])
    return keep_bands(samples, F.array_except(everything, dropped), rate, edges, win, hop)


def _to_rate(m: np.ndarray, source: int, target: int) -> np.ndarray:
    """Rows at another rate: rational resampling with a Kaiser low-pass (beta 5, ten zero crossings per side).

    The taps of one phase after the other are added for all rows and places at once.
    """
    if source == target:
        return m
    g = math.gcd(source, target)
    up, down = target // g, source // g
    widest = max(up, down)
    half = 10 * widest
    spots = np.arange(-half, half + 1)
    taps = np.sinc(spots / widest) / widest * np.kaiser(2 * half + 1, 5.0)
    taps = up * taps / taps.sum()
    n = m.shape[1]
    centre = np.arange(-(-n * up // down)) * down + half
    out = np.zeros((len(m), len(centre)))
    for step in range(-(-len(taps) // up)):
        source_at, tap = centre // up - step, centre % up + step * up
        ok = np.flatnonzero((source_at >= 0) & (source_at < n) & (tap < len(taps)))
        out[:, ok] += m[:, source_at[ok]] * taps[tap[ok]]
    return out


def _by_rate(samples: Column, source_rate: Column, kernel: Callable[[np.ndarray, int], np.ndarray]) -> Column:
    """Apply a kernel to rows of one rate and length together."""
    @kernel_udf("array<double>")
    def run(x: pa.Array, rates: pa.Array) -> pa.Array:
        parts = []
        for rate in pc.unique(rates.drop_null()).to_pylist():
            same = pc.equal(rates, rate).fill_null(False).to_numpy(zero_copy_only=False)
            parts += by_length([x], lambda m, r=int(rate): kernel(m, r), usable=same)
        return in_order(parts, len(x))
    return run(samples, source_rate)


def resample(samples: Column, source_rate: Column, target_rate: int) -> Column:
    """Signal at ``target_rate``; its length is ceil(n * target / source)."""
    return _by_rate(samples, source_rate, lambda m, rate: _to_rate(m, rate, target_rate))


def standardise(channels: Column, source_rate: Column, target_rate: int) -> Column:
    """Channel average, target rate, values clipped to [-1, 1].

    ``channels`` holds frames of channel values.
    """
    return _by_rate(signal.mono(channels), source_rate, lambda m, rate: np.clip(_to_rate(m, rate, target_rate), -1.0, 1.0))


def _layer_norm(m: np.ndarray) -> np.ndarray:
    return (m - m.mean(axis=1, keepdims=True)) / np.sqrt(m.var(axis=1, keepdims=True) + 1e-5)


def _peak_norm(m: np.ndarray) -> np.ndarray:
    top = np.abs(m).max(axis=1, keepdims=True)
    return m / np.where(top > 0, top, 1.0)


def prepare(channels: Column, source_rate: Column, target_rate: int, length: int,
            mode: str = "layer_norm") -> Column:
    """Channel average, target rate, fixed length and normalisation in one Arrow pass (G6); empty signals give null."""
    norms = {"layer_norm": _layer_norm, "peak": _peak_norm}
    if mode not in norms:
        raise ValueError(f"unknown normalisation {mode!r}; use 'layer_norm' or 'peak'")

    def kernel(m: np.ndarray, rate: int) -> np.ndarray:
        y = _to_rate(m, rate, target_rate)
        return norms[mode](y[:, np.arange(length) % y.shape[1]])
    mono = signal.mono(channels)
    return _by_rate(F.when(F.size(channels) > 0, mono), source_rate, kernel)


def telephony(samples: Column, rate: int, narrow: int = 8000) -> Column:
    """Narrow band, eight-bit mu-law and back to the original rate."""
    thin = resample(samples, F.lit(rate), narrow)
    return resample(signal.mu_law(thin), F.lit(narrow), rate)
