import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import dsp, signal
from corpuslens.operators import effects

RNG = np.random.default_rng(11)
EDGES = signal.mel_edges(8, 20.0, 7900.0)


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rows)], "id long, x array<double>")


def values(df, expr):
    return [r[0] for r in df.orderBy("id").select(expr).collect()]


def test_edges_are_mel_spaced():
    e = np.array(EDGES)
    assert e[0] == pytest.approx(20) and e[-1] == pytest.approx(7900) and len(e) == 9
    assert np.ptp(np.diff(2595 * np.log10(1 + e / 700))) < 1e-8


def test_fixed_length_and_norms(spark):
    df = frame(spark, [np.ones(10), np.arange(30)])
    assert [len(v) for v in values(df, signal.fix_length(F.col("x"), 25))] == [25, 25]
    norm = values(df, signal.layer_norm(F.col("x")))[1]
    assert np.mean(norm) == pytest.approx(0, abs=1e-9) and np.var(norm) == pytest.approx(1, abs=1e-3)
    assert max(values(df, signal.peak_norm(F.col("x")))[1]) == 1.0
    assert values(frame(spark, [np.zeros(4)]), signal.peak_norm(F.col("x")))[0] == [0.0] * 4


def test_statistics_survive_large_and_zero_signals(spark):
    df = frame(spark, [[3e200, -3e200], [0.0, 0.0]])
    assert values(df, signal.rms(F.col("x"))) == [pytest.approx(3e200), 0.0]
    assert values(df, signal.dbfs_reason(signal.rms(F.col("x"))))[1] == "decoded RMS is zero"


def test_silence_and_noise_proxy(spark):
    quarter = np.r_[np.zeros(100), np.full(300, 0.5)]
    df = frame(spark, [quarter, np.zeros(400)])
    assert values(df, signal.silence_ratio(F.col("x"))) == [0.25, 1.0]
    snr, why = signal.snr_parts(F.col("x"), F.lit(1000))
    assert values(df, why) == [None, "decoded signal RMS is zero"]
    assert values(df, snr)[0] == pytest.approx(20 * math.log10(math.sqrt(0.1875) / 0.5))


@pytest.mark.parametrize("n", [8, 9, 16, 33, 64, 65])
def test_relevance_is_conserved(spark, n):
    x, r = RNG.normal(size=n), RNG.normal(size=n)
    df = spark.createDataFrame([(x.tolist(), r.tolist())], "x array<double>, r array<double>")
    got = df.select(dsp.frequency_relevance(F.col("x"), F.col("r"))).first()[0]
    assert len(got) == n // 2 + 1 and sum(got) == pytest.approx(r.sum(), abs=1e-9)
    # The explicit double sum of the same rule.
    k, m = np.arange(n // 2 + 1)[:, None], np.arange(n)
    y = (x * np.exp(-2j * np.pi * k * m / n)).sum(1)
    g = (r / x * np.exp(-2j * np.pi * k * m / n)).sum(1)
    fold = np.where((np.arange(n // 2 + 1) == 0) | ((n % 2 == 0) & (np.arange(n // 2 + 1) == n // 2)), 1, 2)
    assert got == pytest.approx(((y * g.conj()).real * fold / n).tolist(), abs=1e-9)


def test_time_frequency_map_conserves(spark):
    x, r = RNG.normal(size=300), RNG.normal(size=300)
    df = spark.createDataFrame([(x.tolist(), r.tolist()), ([1.0], [1.0])], "x array<double>, r array<double>")
    rows = [v[0] for v in df.select(dsp.time_frequency_relevance(F.col("x"), F.col("r"), 100, 64, 32)).collect()]
    assert sum(map(sum, rows[0]["r_tf"])) == pytest.approx(r.sum(), abs=1e-6)
    assert len(rows[0]["freqs"]) == 33 and rows[1]["r_tf"] is None


def test_band_mask_is_invertible_and_additive(spark):
    x = np.sin(2 * np.pi * 440 * np.arange(4000) / 16000) + 0.1 * RNG.normal(size=4000)
    df = frame(spark, [x])
    def keep(bands):
        return np.array(values(df, dsp.keep_bands(F.col("x"), F.array(*[F.lit(b) for b in bands]).cast("array<int>"), 16000, EDGES, 512, 128))[0])
    assert keep(range(8)) == pytest.approx(x, abs=1e-9)
    assert np.abs(keep([])).max() == 0
    assert keep([0, 1, 2]) + keep([3, 4, 5, 6, 7]) == pytest.approx(x, abs=1e-9)


def test_band_energy_follows_a_tone(spark):
    tone = np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)
    got = values(frame(spark, [tone]), dsp.log_band_energy(F.col("x"), 16000, EDGES, 400, 160))[0]
    assert len(got) == 16
    assert int(np.argmax(got[:8])) == int(np.searchsorted(EDGES, 1000) - 1)


@pytest.mark.parametrize("source,target", [(8000, 16000), (22050, 16000), (16000, 16000)])
def test_resample_length_and_tone(spark, source, target):
    x = np.sin(2 * np.pi * 200 * np.arange(source // 4) / source)
    df = spark.createDataFrame([(x.tolist(), source)], "x array<double>, rate int")
    y = np.array(df.select(dsp.resample(F.col("x"), F.col("rate"), target)).first()[0])
    assert len(y) == -(-len(x) * target // source)
    want = np.sin(2 * np.pi * 200 * np.arange(len(y)) / target)
    assert np.abs(y[200:-200] - want[200:-200]).max() < 2e-3


def test_preparation_chain(spark):
    x = RNG.normal(size=(50, 2))
    df = spark.createDataFrame([(x.tolist(), 16000)], "x array<array<double>>, rate int")
    y = df.select(dsp.prepare(F.col("x"), F.col("rate"), 16000, 120)).first()[0]
    assert len(y) == 120 and np.mean(y) == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        dsp.prepare(F.col("x"), F.col("rate"), 16000, 120, "loud")


def test_three_edge_rules(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (4.0,), (9.0,)], "f double")
    got = df.select(*[effects.assign_band(F.col("f"), [1.0, 2.0, 4.0], r) for r in ("half_open", "last_closed", "clipped")]).collect()
    assert [tuple(r) for r in got] == [(None, None, 0), (0, 0, 0), (None, 1, 1), (None, None, 1)]


def test_group_removal(spark):
    df = frame(spark, [RNG.normal(size=2000)])
    score = lambda x: signal.total(F.transform(x, lambda v: v * v))
    none = effects.group_drop(df, score, F.array().cast("array<int>"), 16000, EDGES, 512, 128, "x").first()["group_drop"]
    every = effects.group_drop(df, score, F.array(*[F.lit(i) for i in range(8)]), 16000, EDGES, 512, 128, "x").first()
    assert none == 0.0 and every["group_drop"] == pytest.approx(sum(v * v for v in every["x"]))


def test_mu_law_and_zero_span(spark):
    df = frame(spark, [[-1.0, 0.0, 0.5, 1.0]])
    got = values(df, signal.mu_law(F.col("x")))[0]
    assert got == pytest.approx([-1, 0, 0.5, 1], abs=0.03)
    assert values(df, signal.zero_span(F.col("x"), F.lit(1), 2))[0] == [-1.0, 0.0, 0.0, 1.0]


def test_linear_and_made_signals_agree(spark):
    n = 1200
    df = spark.createDataFrame([(i, RNG.normal(size=n).tolist()) for i in range(5)] + [(9, None)], "sample_id long, samples array<double>")
    scorer = effects.LinearScorer(tuple(RNG.normal(size=n) / 30), signal.sigmoid)
    grid = (16000, EDGES, 256, 64)
    fast = effects.band_drops(df, scorer, *grid).drop("samples").collect()
    slow = {r.sample_id: r for r in effects.band_drops(df, lambda x: scorer(x), *grid).drop("samples").collect()}
    assert fast[0].asDict().keys() == {"sample_id", *[f"drop_{b}" for b in range(8)]}
    for r in fast:
        for b in range(8):
            other = slow[r.sample_id][f"drop_{b}"]
            assert (r[f"drop_{b}"] is None) == (other is None) == (r.sample_id == 9) and (other is None or abs(r[f"drop_{b}"] - other) < 1e-9)
    bands = F.array(F.lit(0), F.lit(3), F.lit(7))
    a, b = (effects.group_drop(df, s, bands, *grid).where("samples is not null").select("sample_id", "group_drop").orderBy("sample_id").collect()
            for s in (scorer, lambda x: scorer(x)))
    assert [r.group_drop for r in a] == pytest.approx([r.group_drop for r in b], abs=1e-9)


def test_one_transform_of_a_clip_whatever_the_bands(spark):
    df = spark.createDataFrame([(1, RNG.normal(size=400).tolist())], "sample_id long, samples array<double>")
    edges = signal.mel_edges(24)
    plan = effects.band_drops(df, effects.LinearScorer(tuple([0.1] * 400), signal.sigmoid), 16000, edges, 128, 32)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    assert plan.count("run(") <= 2


def test_parts_of_bands_add_up_and_short_signals_give_zeros(spark):
    x = RNG.normal(size=1000)
    df = frame(spark, [x, x[:3]])
    parts = values(df, dsp.band_parts(F.col("x"), 16000, EDGES, 512, 128))
    assert np.array(parts[0]).sum(axis=0) == pytest.approx(x, abs=1e-9) and len(parts[1]) == 8
    one = values(df, dsp.keep_bands(F.col("x"), F.array(F.lit(2)), 16000, EDGES, 512, 128))[0]
    assert parts[0][2] == pytest.approx(one, abs=1e-12)


@pytest.mark.parametrize("n,win,hop", [(100, 16, 8), (101, 16, 5), (40, 64, 16), (5, 64, 16), (64, 16, 16)])
def test_frames_by_the_definition(n, win, hop):
    frames = dsp.Frames(n, win, hop)
    side, window = win // 2, np.hanning(win)
    starts = [s for s in range(0, n + 2 * side, hop) if s + win <= n + 2 * side]
    cover = np.zeros(n + 2 * side)
    for s in starts:
        cover[s:s + win] += window
    assert frames.starts.tolist() == starts
    assert 1 / frames.share == pytest.approx(np.where(cover > 0, cover, 1), abs=1e-12)
    x = RNG.normal(size=(3, n))
    back = frames.joined(frames.spectra(x))
    whole = np.where(cover > 0, 1, 0)[side:side + n]
    assert back == pytest.approx(x * whole, abs=1e-9)


def test_rates_and_lengths_in_one_batch(spark):
    rows = [(RNG.normal(size=k).tolist(), r) for k in (50, 81) for r in (8000, 16000, 44100)] + [(None, 8000), ([1.0], None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, x array<double>, rate int").coalesce(1)
    got = values(df, dsp.resample(F.col("x"), F.col("rate"), 16000))
    for (x, rate), y in zip(rows, got, strict=True):
        if x is None or rate is None:
            assert y is None
        else:
            assert y == pytest.approx(dsp._to_rate(np.array([x]), rate, 16000)[0].tolist()) and len(y) == -(-len(x) * 16000 // rate)


def test_channels_are_measured_together(spark):
    from corpuslens.plans import jobs
    left, right = np.r_[np.zeros(100), np.full(300, 0.5)], np.r_[np.full(100, 0.25), np.full(300, 0.5)]
    df = spark.createDataFrame([(1, np.stack([left, right], axis=1).tolist(), 1000)], "id long, samples array<array<double>>, rate int")
    r = jobs.audited(df, "samples", "rate").first()
    assert r.source_silence_ratio == 100 / 800 and r.source_peak == 0.5
    assert r.source_rms == pytest.approx(np.sqrt((np.r_[left, right] ** 2).mean()))
    mono = (left + right) / 2
    noise = np.quantile([np.sqrt((mono[i:i + 20] ** 2).mean()) for i in range(0, 400, 20)], 0.1)
    assert r.source_estimated_snr_db == pytest.approx(20 * np.log10(np.sqrt((mono ** 2).mean()) / noise))
