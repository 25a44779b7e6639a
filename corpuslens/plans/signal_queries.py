"""Registered queries: signal functions, effects of removal, relevance, faithfulness."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import dsp, signal, text
from corpuslens.functions.keys import key_normal, md5_key
from corpuslens.operators import effects, metrics, sampling, stats
from corpuslens.plans import detector_sql as S, jobs, views as V
from corpuslens.plans.corpus_queries import rounded
from corpuslens.plans.detector_queries import BOOT, _r
from corpuslens.plans.oracle_views import VIEWS, dot, h, weights
from corpuslens.plans.registry import query
from corpuslens.session import freeze

RATE, EDGES, WIN, HOP = V.SIGNAL_RATE, V.BAND_EDGES, V.FRAME, V.HOP
NB = V.BAND_COUNT


def _digest(df, column: str, key: str = "sample_id"):
    """Size, sum and position-weighted sum of an array column."""
    weighted = F.aggregate(F.transform(column, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return df.select(key, F.size(column).alias("n"),
                     (F.round(signal.total(F.col(column)), 6) + F.lit(0.0)).alias("total"),
                     (F.round(weighted, 6) + F.lit(0.0)).alias("weighted"))


def _digest_sql(expr: str, source: str = "signals") -> str:
    return (f"SELECT sample_id, len(y)::INTEGER AS n, round(list_sum(y),6)+0.0 AS total, "
            f"round(list_sum(list_transform(y, lambda v, i: v*i)),6)+0.0 AS weighted FROM (SELECT sample_id, {expr} AS y FROM {source})")


def _signals(spark, sf, expr):
    return _digest(V.signals(spark, sf).withColumn("y", expr), "y")


def _x():
    return F.col("samples")


@query("signal_mono", _digest_sql("list_transform(samples, lambda v: (v + v*-0.5)/2)"), "signals")
def _(spark, sf):
    return _signals(spark, sf, signal.mono(F.transform(_x(), lambda v: F.array(v, v * -0.5))))


@query("signal_clip", _digest_sql("list_transform(samples, lambda v: greatest(-1.0, least(1.0, v*8)))"), "signals")
def _(spark, sf):
    return _signals(spark, sf, signal.clip_unit(F.transform(_x(), lambda v: v * 8)))


@query("signal_fixed_length", _digest_sql("list_transform(range(0,150), lambda i: samples[(i%64)+1])"), "signals")
def _(spark, sf):
    return _signals(spark, sf, signal.fix_length(_x(), 150))


_MEAN, _MS = "(list_sum(samples)/64)", "(list_sum(list_transform(samples, lambda v: v*v))/64)"


@query("signal_layer_norm", _digest_sql(f"list_transform(samples, lambda v: (v-{_MEAN})/sqrt({_MS.replace('lambda v: v*v', 'lambda u: u*u')}-{_MEAN}*{_MEAN}+1e-5))"), "signals")
def _(spark, sf):
    return _signals(spark, sf, signal.layer_norm(_x()))


_PEAK = "list_max(list_transform(samples, lambda u: abs(u)))"


@query("signal_peak_norm", _digest_sql(f"list_transform(samples, lambda v: v/{_PEAK})"), "signals")
def _(spark, sf):
    return _signals(spark, sf, signal.peak_norm(_x()))


@query("signal_prepared", _digest_sql("list_transform(y0, lambda v: (v-list_sum(y0)/100)/sqrt(list_sum(list_transform(y0, lambda u: u*u))/100-pow(list_sum(y0)/100,2)+1e-5))",
       "(SELECT sample_id, list_transform(range(0,100), lambda i: samples[(i%64)+1]) AS y0 FROM signals)"), "signals")
def _(spark, sf):
    # Mono, resampled to the same rate, fixed length, normalised: the whole preparation chain.
    two = V.signals(spark, sf).withColumn("c", F.transform(_x(), lambda v: F.array(v, v)))
    return _digest(two.withColumn("y", dsp.prepare(F.col("c"), F.col("sample_rate"), RATE, 100)), "y")


@query("signal_frames", """
SELECT sample_id, m::INTEGER AS m, round(list_sum(samples[m*8+1:m*8+16]),6)+0.0 AS total FROM signals, range(0,7) r(m)""", "signals")
def _(spark, sf):
    f = V.signals(spark, sf).select("sample_id", F.posexplode(signal.frames(_x(), WIN, HOP)).alias("m", "frame"))
    return rounded(f.select("sample_id", "m", signal.total(F.col("frame")).alias("total")), "total")


@query("signal_power_spectrum", "SELECT sample_id, m::INTEGER AS m, k::INTEGER AS k, round(power,6)+0.0 AS power FROM frame_power", "frame_power")
def _(spark, sf):
    s = V.signals(spark, sf).select("sample_id", F.posexplode(dsp.power_spectrum(_x(), WIN, HOP)).alias("m", "row"))
    return rounded(s.select("sample_id", "m", F.posexplode("row").alias("k", "power")), "power")


@query("band_range_join", """
SELECT p.sample_id, a.band AS half_open, b.band AS last_closed, greatest(0, least(3, (SELECT count(*) FROM edges WHERE lo<=p.hz) + (p.hz >= (SELECT max(hi) FROM edges))::INTEGER - 1))::INTEGER AS clipped,
  round(sum(p.power),6)+0.0 AS power FROM frame_power p LEFT JOIN edges a ON p.hz>=a.lo AND p.hz<a.hi
 LEFT JOIN edges b ON p.hz>=b.lo AND (p.hz<b.hi OR (b.band=3 AND p.hz=b.hi)) GROUP BY ALL""", "frame_power", "edges")
def _(spark, sf):
    s = V.signals(spark, sf).select("sample_id", F.explode(dsp.power_spectrum(_x(), WIN, HOP)).alias("row"))
    s = s.select("sample_id", F.posexplode("row").alias("k", "power")).withColumn("hz", F.col("k") * (RATE / WIN))
    bands = [effects.assign_band(F.col("hz"), EDGES, r).alias(r) for r in ("half_open", "last_closed", "clipped")]
    return rounded(s.groupBy("sample_id", *bands).agg(F.sum("power").alias("power")), "power")


@query("band_labels", f"""
SELECT detector, feature, class, band, round(lo,6) AS lo, round(hi,6) AS hi, CASE WHEN (lo+hi)/2<8 THEN 'low' WHEN (lo+hi)/2<16 THEN 'mid' ELSE 'high' END AS band_group,
 printf('%.2f',lo/1000)||'–'||printf('%.2f',hi/1000)||' kHz·'||CASE WHEN suffix(feature,'_mean') THEN 'μ' ELSE 'σ' END AS label
FROM (SELECT c.*, e.lo, e.hi, e.band FROM correlations c JOIN edges e ON e.band=regexp_extract(feature,'band([0-9]+)_',1)::INTEGER-1)""", "correlations", "edges")
def _(spark, sf):
    c = stats.within_class_correlation(V.master(spark, sf), V.DETECTORS, V.BAND_COLUMNS)
    f = F.col("feature")
    lo, hi = signal.band_bounds(signal.band_number(f), EDGES)
    return c.select("detector", "feature", "class", signal.band_number(f).alias("band"), F.round(lo, 6).alias("lo"),
                    F.round(hi, 6).alias("hi"), signal.band_group(f, EDGES, 8.0, 16.0).alias("band_group"),
                    signal.band_label(f, EDGES).alias("label"))


@query("frequency_relevance", "SELECT sample_id, k::INTEGER AS k, round(r,6)+0.0 AS relevance FROM freq_relevance", "freq_relevance")
def _(spark, sf):
    r = V.relevance(spark, sf).select("sample_id", F.posexplode(dsp.frequency_relevance(_x(), F.col("relevance"))).alias("k", "relevance"))
    return rounded(r, "relevance")


@query("relevance_conservation", "SELECT sample_id, 0.0::DOUBLE AS error FROM signals", "signals")
def _(spark, sf):
    r = V.relevance(spark, sf).withColumn("rf", dsp.frequency_relevance(_x(), F.col("relevance")))
    return rounded(r.select("sample_id", signal.conservation_error(F.col("relevance"), F.col("rf")).alias("error")), "error")


def _maps(spark, sf):
    r = V.relevance(spark, sf)
    return r.withColumn("_tf", dsp.time_frequency_relevance(_x(), F.col("relevance"), RATE, WIN, HOP)).select(
        "sample_id", "ground_truth", "logit", F.col("_tf.r_tf").alias("r_tf"), F.col("_tf.s_tf").alias("s_tf"))


@query("time_frequency_relevance", "SELECT sample_id, m::INTEGER AS m, k::INTEGER AS k, round(r,6)+0.0 AS r, round(mag,6)+0.0 AS magnitude FROM tf_relevance", "tf_relevance")
def _(spark, sf):
    m = _maps(spark, sf).select("sample_id", F.posexplode("r_tf").alias("m", "row"), "s_tf")
    cells = m.select("sample_id", "m", F.posexplode("row").alias("k", "r"), F.get("s_tf", F.col("m")).alias("mags"))
    return rounded(cells.select("sample_id", "m", "k", "r", F.get("mags", F.col("k")).alias("magnitude")), "r", "magnitude")


@query("relevance_envelopes", """
SELECT sample_id, m::INTEGER AS m, round(sum(greatest(r,0)),6)+0.0 AS up, round(sum(greatest(-r,0)),6)+0.0 AS down FROM tf_relevance GROUP BY ALL""", "tf_relevance")
def _(spark, sf):
    up, down = signal.envelopes(F.col("r_tf"))
    e = _maps(spark, sf).select("sample_id", up.alias("u"), down.alias("d"))
    rows = e.select("sample_id", F.posexplode("u").alias("m", "up"), "d").select(
        "sample_id", "m", "up", F.get("d", F.col("m")).alias("down"))
    return rounded(rows, "up", "down")


@query("band_keep", "SELECT sample_id, round(sum(l2) FILTER (WHERE band IN (0,2)),6)+0.0 AS logit FROM band_logits GROUP BY ALL", "band_logits")
def _(spark, sf):
    s = V.signals(spark, sf).withColumn("y", dsp.keep_bands(_x(), F.array(F.lit(0), F.lit(2)), RATE, EDGES, WIN, HOP))
    return rounded(s.select("sample_id", V.linear_logit(F.col("y"), 2).alias("logit")), "logit")


@query("band_group_drop", """
SELECT sample_id, round(round(1/(1+exp(-t)),9) - round(1/(1+exp(-k)),9),6)+0.0 AS group_drop FROM (
 SELECT sample_id, sum(l2) AS t, sum(l2) FILTER (WHERE band NOT IN (1,3)) AS k FROM band_logits GROUP BY ALL)""", "band_logits")
def _(spark, sf):
    g = effects.group_drop(V.signals(spark, sf), V.scorer(2), F.array(F.lit(1), F.lit(3)), RATE, EDGES, WIN, HOP)
    return rounded(g.select("sample_id", "group_drop"), "group_drop")


@query("time_window_occlusion", f"""
WITH b AS (SELECT sample_id, samples, s.start, {dot('samples', 2)} AS t FROM signals, range(0,49,8) s(start))
SELECT sample_id, start::INTEGER AS start, (start+8)/64.0 AS centre, round(round(1/(1+exp(-t)),9) - round(1/(1+exp(-(t - list_sum(list_transform(range(start+1,start+17), lambda i: samples[i]*({weights(2)})[i]))))),9),6)+0.0 AS "drop" FROM b""", "signals")
def _(spark, sf):
    d = effects.time_drops(V.signals(spark, sf), V.scorer(2), RATE, 16, 8, ["sample_id"])
    return rounded(d.select("sample_id", "start", "centre", "drop"), "drop")


_TIME = f"""
WITH b AS (SELECT sample_id, samples, s.start, {dot('samples', 2)} AS t, sqrt(list_sum(list_transform(samples[s.start+1:s.start+16], lambda v: v*v))/16) AS level FROM signals, range(0,49,16) s(start)),
 d AS (SELECT level>=0.12 AS loud, round(1/(1+exp(-t)),9) - round(1/(1+exp(-(t - list_sum(list_transform(range(start+1,start+17), lambda i: samples[i]*({weights(2)})[i]))))),9) AS d FROM b),
 m AS (SELECT count(*) FILTER (WHERE loud) AS n_speech, count(*) FILTER (WHERE NOT loud) AS n_silence, avg(d) FILTER (WHERE loud) AS sp, avg(d) FILTER (WHERE NOT loud) AS si, avg(d) AS al FROM d)"""


@query("speech_silence_share", _TIME + f""" SELECT n_speech, n_silence, {_r('sp','mean_speech')}, {_r('si','mean_silence')}, {_r('100*(sp-al)/al','rel_speech',4)}, {_r('100*(si-al)/al','rel_silence',4)} FROM m""", "signals")
def _(spark, sf):
    d = effects.time_drops(V.signals(spark, sf), V.scorer(2), RATE, 16, 16, ["sample_id"])
    return rounded(rounded(effects.speech_share(d, 0.12), "mean_speech", "mean_silence"), "rel_speech", "rel_silence", digits=4)


_NOISE = ("list_transform(samples, lambda v, i: v + sqrt({ms}/pow(10.0,1.0)) * sqrt(-2.0*ln((('0x'||substr(md5('7:'||sample_id||':'||(i-1)),1,8))::BIGINT+1)/4294967296.0))"
          "*cos(2*pi()*('0x'||substr(md5('7:'||sample_id||':'||(i-1)),9,8))::BIGINT/4294967296.0))").format(
              ms="(list_sum(list_transform(samples, lambda u: u*u))/64)")
_LAW = ("list_transform(list_transform(samples, lambda v: floor((sign(greatest(-1.0,least(1.0,v)))*ln(1+255*abs(greatest(-1.0,least(1.0,v))))/ln(256)+1)/2*255+0.5)/255.0*2-1), "
        "lambda b: sign(b)*(pow(256.0,abs(b))-1)/255.0)")


def _draws():
    return F.transform(F.sequence(F.lit(0), F.size("samples") - 1),
                       lambda i: key_normal(md5_key(7, "sample_id", i)))


@query("signal_noise", _digest_sql(_NOISE), "signals")
def _(spark, sf):
    return _signals(spark, sf, signal.add_noise(_x(), 10.0, _draws()))


@query("signal_mu_law", _digest_sql(_LAW), "signals")
def _(spark, sf):
    return _signals(spark, sf, signal.mu_law(_x()))


_COND = f"""degraded AS (SELECT sample_id, ground_truth, condition, round(1/(1+exp(-{dot('y', 2)})),9) AS score FROM (
  SELECT sample_id, ground_truth, 'clean' AS condition, samples AS y FROM signals UNION ALL SELECT sample_id, ground_truth, 'noise_10db', {_NOISE} FROM signals
  UNION ALL SELECT sample_id, ground_truth, 'mu_law', {_LAW} FROM signals))"""


@query("robustness_table", f"""
WITH {_COND}, p AS ({S.roc('degraded','condition','score','ground_truth')}), e AS ({S.eer('p','condition')}),
 c AS (SELECT s.condition, any_value(e.eer) AS eer, any_value(e.threshold) AS threshold, count(*) AS n, """ + ", ".join(
    f"count(*) FILTER (WHERE ground_truth={g} AND {'' if p else 'NOT '}(score >= {t})) AS {c}{i}"
    for i, t in ((1, "threshold"), (2, "0.5")) for c, g, p in (("a", 1, 1), ("b", 0, 0), ("c", 0, 1), ("d", 1, 0))) + f"""
   FROM degraded s JOIN e ON s.condition=e.condition GROUP BY s.condition)
SELECT condition, {_r('eer*100','eer')}, threshold AS eer_threshold, {_r(S.mcc('a1','b1','c1','d1'),'mcc_eer')}, {_r('(a1+b1)/n','acc_eer')},
 {_r(S.mcc('a2','b2','c2','d2'),'mcc_half')}, {_r('(a2+b2)/n','acc_half')} FROM c""", "signals")
def _(spark, sf):
    conditions = {"clean": lambda x: x, "noise_10db": lambda x: signal.add_noise(x, 10.0, _draws()),
                  "mu_law": signal.mu_law}
    d = effects.degraded_scores(V.signals(spark, sf), V.scorer(2), conditions, ["sample_id", "ground_truth"])
    return rounded(metrics.evaluate(d, ["condition"], "score", "ground_truth"), "eer", "mcc_eer", "acc_eer", "mcc_half", "acc_half")


@query("signal_statistics", f"""
WITH l AS (SELECT sample_id, sqrt(list_sum(list_transform(samples[j*8+1:j*8+8], lambda v: v*v))/8) AS lv FROM signals, range(0,8) r(j)),
 q AS (SELECT sample_id, quantile_cont(lv,0.1) AS noise FROM l WHERE lv>0 GROUP BY ALL)
SELECT s.sample_id, {_r(_PEAK,'source_peak')}, {_r(f'sqrt({_MS})','source_rms')}, {_r("len(list_filter(samples, lambda v: abs(v)<=0.01))/64",'silence_ratio')},
 {_r(f'20*log10(sqrt({_MS}))','source_rms_dbfs')}, NULL::VARCHAR AS source_rms_dbfs_unavailable_reason, {_r(f'20*log10(sqrt({_MS})/noise)','source_estimated_snr_db')}, NULL::VARCHAR AS source_estimated_snr_db_unavailable_reason
FROM signals s JOIN q ON s.sample_id=q.sample_id""", "signals")
def _(spark, sf):
    s = V.signals(spark, sf).withColumn("rate", F.lit(400)).withColumn("silence_ratio", signal.silence_ratio(_x(), 0.01))
    a = jobs.audited(s, "samples", "rate")
    return rounded(a.drop("samples", "rate", "source_silence_ratio", "class_id", "ground_truth", "sample_rate"),
                   "source_peak", "source_rms", "silence_ratio", "source_rms_dbfs", "source_estimated_snr_db")


_STEREO = "list_concat(samples, list_transform(samples, lambda v: v*-0.25))"
_MONO = "list_transform(samples, lambda v: v*0.375)"


@query("stereo_signal_statistics", f"""
WITH s AS (SELECT sample_id, {_STEREO} AS x, {_MONO} AS y FROM signals),
 l AS (SELECT sample_id, sqrt(list_sum(list_transform(y[j*8+1:j*8+8], lambda v: v*v))/8) AS lv FROM s, range(0,8) r(j)),
 q AS (SELECT sample_id, quantile_cont(lv,0.1) AS noise FROM l WHERE lv>0 GROUP BY ALL),
 m AS (SELECT sample_id, sqrt(list_sum(list_transform(x, lambda v: v*v))/128) AS rms, sqrt(list_sum(list_transform(y, lambda v: v*v))/64) AS mono, x FROM s)
SELECT m.sample_id, {_r('list_max(list_transform(x, lambda v: abs(v)))','source_peak')}, {_r('rms','source_rms')}, {_r("len(list_filter(x, lambda v: abs(v)<=0.0001))/128",'source_silence_ratio')},
 {_r('20*log10(rms)','source_rms_dbfs')}, NULL::VARCHAR AS source_rms_dbfs_unavailable_reason, {_r('20*log10(mono/noise)','source_estimated_snr_db')}, NULL::VARCHAR AS source_estimated_snr_db_unavailable_reason
FROM m JOIN q ON m.sample_id=q.sample_id""", "signals")
def _(spark, sf):
    s = V.signals(spark, sf).select("sample_id", F.lit(400).alias("rate"), F.transform(_x(), lambda v: F.array(v, v * -0.25)).alias("samples"))
    a = jobs.audited(s, "samples", "rate").drop("samples", "rate")
    return rounded(a, "source_peak", "source_rms", "source_silence_ratio", "source_rms_dbfs", "source_estimated_snr_db")


@query("signal_resampled")
def _(spark, sf):
    return _digest(V.signals(spark, sf).withColumn("y", dsp.resample(_x(), F.col("sample_rate"), 48)), "y")


_SRC = "list_concat(samples, list_transform(samples, lambda v: v*0.5))"
_OUT = "list_transform(samples, lambda v: greatest(-1.0, least(1.0, v*0.75)))"


@query("signal_enriched", f"""
SELECT sample_id, 64::BIGINT AS source_sample_rate, 2::BIGINT AS source_channels, 64::BIGINT AS source_frames, 1.0::DOUBLE AS source_duration_seconds, {_r('list_max(list_transform(x, lambda v: abs(v)))','source_peak')},
 {_r('sqrt(list_sum(list_transform(x, lambda v: v*v))/128)','source_rms')}, 64::BIGINT AS processed_sample_rate, 1::BIGINT AS processed_channels, 64::BIGINT AS processed_frames, 1.0::DOUBLE AS processed_duration_seconds,
 {_r('list_max(list_transform(y, lambda v: abs(v)))','processed_peak')}, {_r('sqrt(list_sum(list_transform(y, lambda v: v*v))/64)','processed_rms')} FROM (SELECT sample_id, {_SRC} AS x, {_OUT} AS y FROM signals)""", "signals")
def _(spark, sf):
    s = V.signals(spark, sf).withColumn("samples", F.transform(_x(), lambda v: F.array(v, v * 0.5)))
    e = jobs.enrich(V.signals(spark, sf).select("sample_id"), s, "sample_id", RATE)
    return rounded(e, "source_peak", "source_rms", "processed_peak", "processed_rms")


@query("signal_enriched_resampled")
def _(spark, sf):
    s = V.signals(spark, sf).withColumn("samples", F.transform(_x(), lambda v: F.array(v, v * 0.5)))
    return jobs.enrich(V.signals(spark, sf).select("sample_id"), s, "sample_id", 48)


@query("processed_measures_verified", f"""
SELECT 'source_peak_differs' AS rule, sample_id::VARCHAR AS key FROM signals WHERE {h('vp','sample_id')}%30=0
UNION ALL SELECT 'processed_frames_differs', sample_id::VARCHAR FROM signals WHERE {h('vp','sample_id')}%30=1""", "signals")
def _(spark, sf):
    s = V.signals(spark, sf).withColumn("samples", F.transform(_x(), lambda v: F.array(v, v * 0.5)))
    m = freeze(jobs.enrich(V.signals(spark, sf).select("sample_id"), s, "sample_id", 48))
    d = V.draw("vp", "sample_id", 30)
    told = m.withColumn("source_peak", F.when(d == 0, F.col("source_peak") * 1.001).otherwise(F.col("source_peak"))).withColumn(
        "processed_frames", F.when(d == 1, F.col("processed_frames") + 1).otherwise(F.col("processed_frames")))
    return jobs.verify_processed(told, m, "sample_id").select("rule", "key")


@query("positive_class_names", f"""
SELECT positive::INTEGER AS positive, count(*) AS n FROM (SELECT coalesce(CASE WHEN contains(lower(lang),'spoof') OR contains(lower(lang),'fake') THEN 0
  WHEN contains(lower(x),'spoof') OR contains(lower(x),'fake') THEN 1 WHEN contains(lower(y),'spoof') OR contains(lower(y),'fake') THEN 2 END, 1) AS positive
 FROM (SELECT lang, CASE {h('n1','doc_id')}%3 WHEN 0 THEN 'Spoofed' ELSE source END AS x, CASE {h('n2','doc_id')}%3 WHEN 0 THEN 'DEEPFAKE' ELSE source END AS y FROM documents)) GROUP BY ALL""")
def _(spark, sf):
    d = V.table(spark, sf, "documents")
    names = F.array("lang", F.when(V.draw("n1", "doc_id", 3) == 0, "Spoofed").otherwise(F.col("source")),
                    F.when(V.draw("n2", "doc_id", 3) == 0, "DEEPFAKE").otherwise(F.col("source")))
    return d.groupBy(text.spoof_label_of(names).alias("positive")).agg(F.count(F.lit(1)).alias("n"))


@query("url_slugs", "SELECT page_id, trim(regexp_replace(lower(url),'[^a-z0-9]+','-','g'),'-') AS slug FROM pages")
def _(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


# --- effects ----------------------------------------------------------------------------------

def _drops(spark, sf, tag="ad"):
    s = V.signals(spark, sf).select("sample_id", "samples")
    return freeze(effects.band_drops(s, V.scorer(1 if tag == "zs" else 2), RATE, EDGES, WIN, HOP).drop("samples"))


@query("clip_band_drops", "SELECT sample_id, band, round(drop_ad,6)+0.0 AS \"drop\" FROM band_drops", "band_drops")
def _(spark, sf):
    long = stats.unpivot(_drops(spark, sf), ["sample_id"], [f"drop_{b}" for b in range(NB)], "name", "drop")
    return rounded(long.select("sample_id", F.substring_index("name", "_", -1).cast("int").alias("band"), "drop"), "drop")


def _boot_sql(source: str, by: str, key: str, value: str, n_boot: int = BOOT) -> str:
    """Per group: mean, n and the replicate interval of ``value``."""
    return f"""(SELECT a.*, ci_low, ci_high FROM (SELECT {by}, avg({value}) AS mean, count(*) AS n FROM {source} GROUP BY ALL) a JOIN (
      SELECT {by}, quantile_cont(mb,0.025) AS ci_low, quantile_cont(mb,0.975) AS ci_high FROM (
        SELECT {by}, b, sum({value}*w)/sum(w) AS mb FROM (SELECT s.*, b, {S.boot_weight(42, key)} AS w FROM {source} s, range(0,{n_boot}) r(b)) GROUP BY {by}, b) GROUP BY {by}) c USING ({by}))"""


@query("occlusion_table", f"""
SELECT 'ad' AS detector, band, {_r('e.lo','band_hz_low')}, {_r('e.hi','band_hz_high')}, {_r('mean','mean_p_spoof_drop')}, {_r('ci_low','ci_low')}, {_r('ci_high','ci_high')}, n
FROM {_boot_sql('band_drops','band','sample_id','drop_ad')} JOIN edges e USING (band)""", "band_drops", "edges")
def _(spark, sf):
    t = effects.occlusion_table(_drops(spark, sf), "ad", EDGES, ["sample_id"], n_boot=BOOT)
    return rounded(t, "band_hz_low", "band_hz_high", "mean_p_spoof_drop", "ci_low", "ci_high")


_AGREE = f"""
WITH o AS (SELECT 'zs' AS detector, band, abs(avg(drop_zs)) AS causal FROM band_drops GROUP BY ALL UNION ALL SELECT 'ad', band, abs(avg(drop_ad)) FROM band_drops GROUP BY ALL),
 r AS (SELECT o.detector, rank() OVER (PARTITION BY o.detector ORDER BY causal) AS rc, rank() OVER (PARTITION BY o.detector ORDER BY strength) AS ra FROM o JOIN strengths s ON o.detector=s.detector AND o.band=s.band),
 c AS (SELECT detector, corr(rc,ra) AS rho, count(*) AS n FROM r GROUP BY detector)
SELECT detector, {_r('rho','rho_causal_vs_assoc')}, n AS n_bands FROM c"""


@query("profile_agreement", _AGREE, "band_drops", "strengths")
def _(spark, sf):
    m = V.master(spark, sf)
    strength = freeze(stats.band_strength(stats.within_class_correlation(m, V.DETECTORS, V.BAND_COLUMNS), V.DETECTORS, NB))
    occ = effects.occlusion_table(_drops(spark, sf, "zs"), "zs", EDGES, ["sample_id"]).unionByName(
        effects.occlusion_table(_drops(spark, sf), "ad", EDGES, ["sample_id"]))
    return rounded(effects.profile_agreement(occ, strength).drop("p_value"), "rho_causal_vs_assoc")


@query("oriented_band_effects", f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY strength DESC, band DESC) AS t, row_number() OVER (ORDER BY strength, band) AS b FROM strengths WHERE detector='ad')
SELECT sample_id, {_r('sum(drop_ad*sign(signed)) FILTER (WHERE t<=2)/2','top_effect')}, {_r('sum(drop_ad*sign(signed)) FILTER (WHERE b<=2)/2','bottom_effect')}
FROM band_drops d JOIN r ON d.band=r.band GROUP BY sample_id""", "band_drops", "strengths")
def _(spark, sf):
    strength = freeze(stats.band_strength(stats.within_class_correlation(V.master(spark, sf), V.DETECTORS, V.BAND_COLUMNS), V.DETECTORS, NB))
    e = effects.oriented_effects(_drops(spark, sf), strength, "ad", 2, NB)
    return rounded(e.select("sample_id", "top_effect", "bottom_effect"), "top_effect", "bottom_effect")


VIEWS["halved"] = (("master",), """
  SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('42:'||sample_id)) <= (SELECT count(*)//2 FROM master) THEN 0 ELSE 1 END AS half FROM master""")
VIEWS["half_strengths"] = (("halved",), f"""
  SELECT detector, band, max(abs(rho)) AS strength, arg_max(rho, abs(rho)) AS signed FROM (
   SELECT *, regexp_extract(feature,'band([0-9]+)_',1)::INTEGER - 1 AS band FROM ({S.correlations('(SELECT * FROM halved WHERE half=0)')})) GROUP BY ALL""")
VIEWS["effects"] = (("half_strengths", "band_drops"), """
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY strength DESC, band DESC) AS t, row_number() OVER (PARTITION BY detector ORDER BY strength, band) AS b FROM half_strengths),
   p AS (SELECT 'zs' AS detector, sample_id, row_number() OVER (PARTITION BY quadrant_zs ORDER BY md5('42:'||sample_id)) AS rn FROM halved WHERE half=1
     UNION ALL SELECT 'ad', sample_id, row_number() OVER (PARTITION BY quadrant_ad ORDER BY md5('42:'||sample_id)) FROM halved WHERE half=1),
   d AS (SELECT 'zs' AS detector, sample_id, band, drop_zs AS d FROM band_drops UNION ALL SELECT 'ad', sample_id, band, drop_ad FROM band_drops)
  SELECT p.detector, p.sample_id, sum(d*sign(signed)) FILTER (WHERE t=1) AS top, sum(d*sign(signed)) FILTER (WHERE b=1) AS bottom,
    any_value(r.band) FILTER (WHERE t=1) AS top_band, any_value(r.band) FILTER (WHERE b=1) AS bottom_band
  FROM p JOIN d ON p.detector=d.detector AND p.sample_id=d.sample_id JOIN r ON r.detector=d.detector AND r.band=d.band GROUP BY p.detector, p.sample_id""")


@query("convergence_intervention", f"""
WITH x AS (SELECT *, top-bottom AS diff FROM effects),
 k AS (SELECT *, {S.average_rank('detector','abs(diff)')} AS rk FROM x WHERE diff<>0),
 tie AS (SELECT detector, sum(c*c*c-c) AS tie FROM (SELECT detector, count(*)::DOUBLE AS c FROM k GROUP BY detector, abs(diff)) GROUP BY detector),
 w AS (SELECT k.detector, count(*) AS n, coalesce(sum(rk) FILTER (WHERE diff>0),0) AS up, coalesce(sum(rk) FILTER (WHERE diff<0),0) AS dn, any_value(tie) AS tie FROM k JOIN tie USING (detector) GROUP BY k.detector),
 z AS (SELECT detector, (least(up,dn)-n*(n+1)/4.0)/sqrt((n*(n+1)*(2*n+1)-tie/2)/24) AS z FROM w),
 m AS (SELECT detector, b, quantile_cont(diff,0.5) AS med FROM (SELECT detector, diff, b, unnest(range(0, wt)) AS _ FROM (SELECT detector, diff, b, {S.boot_weight(42,'sample_id')} AS wt FROM x, range(0,{BOOT}) t(b))) GROUP BY ALL),
 c AS (SELECT detector, quantile_cont(med,0.025) AS lo, quantile_cont(med,0.975) AS hi FROM m GROUP BY ALL)
SELECT detector, 1 AS k_bands, any_value(top_band)::VARCHAR AS top_bands, any_value(bottom_band)::VARCHAR AS bottom_bands, count(*) AS n_pairs, {_r('median(diff)','median_diff')}, {_r('any_value(lo)','ci_low')},
 {_r('any_value(hi)','ci_high')}, {_r('avg(diff)/stddev_samp(diff)','cohen_dz')}, {_r(S.normal_two_sided('any_value(z)'),'wilcoxon_p')}, {_r('avg(top)','mean_drop_top')}, {_r('avg(bottom)','mean_drop_bottom')}
FROM x JOIN c USING (detector) JOIN z USING (detector) GROUP BY detector""", "effects")
def _(spark, sf):
    test = jobs.convergence_test(V.master(spark, sf), V.signals(spark, sf).select("sample_id", "samples"), {"zs": V.scorer(1), "ad": V.scorer(2)},
                                 V.BAND_COLUMNS, RATE, EDGES, WIN, HOP, n_boot=BOOT)
    return rounded(test, "median_diff", "ci_low", "ci_high", "cohen_dz", "wilcoxon_p",
                   "mean_drop_top", "mean_drop_bottom")


# --- relevance --------------------------------------------------------------------------------

VIEWS["relevance_bands"] = (("freq_relevance", "edges", "signals"), f"""
  SELECT f.sample_id, e.band, sum(f.r) AS r, any_value({dot('s.samples', 2)})>0 AS spoof FROM freq_relevance f JOIN signals s ON s.sample_id=f.sample_id
  JOIN edges e ON f.k>=e.lo AND (f.k<e.hi OR (e.band=3 AND f.k=e.hi)) GROUP BY ALL""")


def _relevance_bands(spark, sf):
    r = V.relevance(spark, sf).withColumn("rf", dsp.frequency_relevance(_x(), F.col("relevance")))
    freqs = [i * RATE / 64 for i in range(33)]
    return freeze(r.select("sample_id", "logit", "relevance", "rf", stats.class_name((F.col("logit") > 0).cast("int")).alias("pred_class"),
                           effects.band_sums(F.col("rf"), freqs, EDGES, "last_closed").alias("bands")))


_REL = ("mean_relevance", "ci_low", "ci_high", "band_hz_low", "band_hz_high")


@query("relevance_by_band", f"""
SELECT band, {_r('e.lo','band_hz_low')}, {_r('e.hi','band_hz_high')}, {_r('mean','mean_relevance')}, {_r('ci_low','ci_low')}, {_r('ci_high','ci_high')}, n
FROM {_boot_sql('relevance_bands','band','sample_id','r')} JOIN edges e USING (band)""", "relevance_bands")
def _(spark, sf):
    return rounded(effects.relevance_table(_relevance_bands(spark, sf), "bands", EDGES, ["sample_id"], n_boot=BOOT), *_REL)


@query("relevance_by_predicted_class", f"""
WITH c AS (SELECT *, CASE WHEN spoof THEN 'spoof' ELSE 'bonafide' END AS pred_class FROM relevance_bands)
SELECT pred_class, band, {_r('e.lo','band_hz_low')}, {_r('e.hi','band_hz_high')}, {_r('mean','mean_relevance')}, {_r('ci_low','ci_low')}, {_r('ci_high','ci_high')}, n
FROM {_boot_sql('c','band, pred_class','sample_id','r')} JOIN edges e USING (band) WHERE n>=2""", "relevance_bands")
def _(spark, sf):
    t = effects.relevance_table(_relevance_bands(spark, sf), "bands", EDGES, ["sample_id"], ["pred_class"], n_boot=BOOT)
    return rounded(t, *_REL)


_BINS = 10
_SAL_EDGES = [1.0 + 30.0 * i / _BINS for i in range(_BINS + 1)]


@query("salience_spectrum", f"""
WITH b AS (SELECT sample_id, i::INTEGER AS band, coalesce(sum(abs(r)),0) AS v FROM freq_relevance, range(0,{_BINS}) t(i) WHERE k>=1+3*i AND (k<4+3*i OR (i={_BINS - 1} AND k=31)) GROUP BY ALL),
 s AS (SELECT sample_id, band, 100*v/sum(v) OVER (PARTITION BY sample_id) AS share FROM b)
SELECT band, {_r('mean','attention_share_pct')}, {_r('ci_low','ci_low')}, {_r('ci_high','ci_high')}, n FROM {_boot_sql('s','band','sample_id','share')}""", "freq_relevance")
def _(spark, sf):
    r = _relevance_bands(spark, sf)
    mags = F.transform("rf", lambda v: F.abs(v))
    freqs = [i * RATE / 64 for i in range(33)]
    sal = r.select("sample_id", effects.band_sums(mags, freqs, _SAL_EDGES, "last_closed").alias("_m"))
    share = sal.select("sample_id", F.transform(effects.salience_share(F.col("_m")), lambda v: v * 100).alias("share"))
    t = effects.relevance_table(share, "share", _SAL_EDGES, ["sample_id"], n_boot=BOOT)
    return rounded(t.select("band", F.col("mean_relevance").alias("attention_share_pct"), "ci_low", "ci_high", "n"),
                   "attention_share_pct", "ci_low", "ci_high")


@query("completeness_split", f"""
WITH t AS (SELECT {dot('samples', 2)} AS s FROM signals), g AS (SELECT s AS r, s*1.25+0.1 AS l FROM t)
SELECT {_r('avg(r)','mean_relevance')}, {_r('avg(l)','mean_logit')}, {_r('avg(l-r)','mean_gap')}, {_r('avg(abs(l-r))/(avg(abs(l))+1e-12)','bias_share')} FROM g""", "signals")
def _(spark, sf):
    r = V.relevance(spark, sf).select(signal.total(F.col("relevance")).alias("r"), (F.col("logit") * 1.25 + 0.1).alias("l"))
    return rounded(effects.completeness(r, "r", "l"), "mean_relevance", "mean_logit", "mean_gap", "bias_share")


_POP = """pop AS (SELECT ground_truth, m AS t, k AS f, avg(abs(r)) AS magnitude, avg(greatest(r,0)) AS toward_spoof, avg(greatest(-r,0)) AS toward_bonafide
 FROM tf_relevance JOIN signals USING (sample_id) GROUP BY ALL)"""


@query("population_relevance", f"WITH {_POP} SELECT ground_truth, t::INTEGER AS t, f::INTEGER AS f, {_r('magnitude','magnitude')}, {_r('toward_spoof','toward_spoof')}, {_r('toward_bonafide','toward_bonafide')} FROM pop", "tf_relevance", "signals")
def _(spark, sf):
    p = jobs.population_relevance(V.relevance(spark, sf), ["ground_truth"], RATE, WIN, HOP)
    return rounded(p, "magnitude", "toward_spoof", "toward_bonafide")


_PCOLS = ("magnitude", "share_pct", "relative", "spoof_share_pct", "bonafide_share_pct", "spoof_relative", "bonafide_relative")


@query("frequency_profile", f"""
WITH {_POP}, m AS (SELECT ground_truth, f, avg(magnitude) AS g, avg(toward_spoof) AS s, avg(toward_bonafide) AS b FROM pop GROUP BY ALL),
 w AS (SELECT *, sum(g) OVER p AS gs, max(g) OVER p AS gm, sum(s) OVER p + sum(b) OVER p + 1e-12 AS bo, greatest(max(s) OVER p, max(b) OVER p)+1e-12 AS tp FROM m WINDOW p AS (PARTITION BY ground_truth))
SELECT ground_truth, f::INTEGER AS f, {_r('g','magnitude')}, {_r('100*g/(gs+1e-12)','share_pct')}, {_r('g/(gm+1e-12)','relative')}, {_r('100*s/bo','spoof_share_pct')}, {_r('100*b/bo','bonafide_share_pct')},
 {_r('s/tp','spoof_relative')}, {_r('b/tp','bonafide_relative')} FROM w""", "tf_relevance", "signals")
def _(spark, sf):
    p = jobs.population_relevance(V.relevance(spark, sf), ["ground_truth"], RATE, WIN, HOP)
    return rounded(effects.frequency_profile(p, ["ground_truth"]), *_PCOLS)


@query("band_profile", f"""
WITH {_POP}, m AS (SELECT ground_truth, f, avg(magnitude) AS g FROM pop GROUP BY ALL),
 b AS (SELECT ground_truth, e.band, coalesce(avg(g) FILTER (WHERE f*4.0>=e.lo AND (f*4.0<e.hi OR (e.band=3 AND f*4.0=e.hi))),0) AS g FROM m, edges e GROUP BY ALL)
SELECT ground_truth, band, {_r('g','magnitude')}, {_r('g/(max(g) OVER (PARTITION BY ground_truth)+1e-12)','relative')} FROM b""", "tf_relevance", "signals", "edges")
def _(spark, sf):
    p = jobs.population_relevance(V.relevance(spark, sf), ["ground_truth"], RATE, WIN, HOP)
    return rounded(effects.band_profile(p, ["ground_truth"], RATE / WIN, EDGES), "magnitude", "relative")


# --- faithfulness -----------------------------------------------------------------------------

KS, DRAWS = (1, 2, 3), 3
VIEWS["faith"] = (("tf_relevance", "band_logits", "edges", "signals"), f"""
  WITH br AS (SELECT t.sample_id, e.band, sum(r) AS r FROM tf_relevance t JOIN edges e ON t.k*4.0>=e.lo AND (t.k*4.0<e.hi OR (e.band=3 AND t.k*4.0=e.hi)) GROUP BY ALL),
   g AS (SELECT sample_id, ground_truth, {dot('samples', 2)} AS logit FROM signals),
   rk AS (SELECT l.sample_id, l.band, l.l2, g.logit, g.ground_truth, row_number() OVER (PARTITION BY l.sample_id ORDER BY CASE WHEN logit>0 THEN -coalesce(r,0) ELSE coalesce(r,0) END, l.band) AS place
     FROM band_logits l JOIN g USING (sample_id) LEFT JOIN br USING (sample_id, band)),
   ks AS (SELECT unnest([1,2,3]) AS k), dr AS (SELECT unnest([0,1,2]) AS draw),
   top AS (SELECT sample_id, k, 'keep_top' AS condition, 0 AS draw, sum(l2) FILTER (WHERE place<=k) AS z FROM rk, ks GROUP BY ALL
     UNION ALL SELECT sample_id, k, 'delete_top', 0, sum(l2) FILTER (WHERE place>k) FROM rk, ks GROUP BY ALL),
   rp AS (SELECT sample_id, band, l2, k, draw, row_number() OVER (PARTITION BY sample_id, k, draw ORDER BY md5('0:'||sample_id||':'||k||':'||draw||':'||band)) AS place FROM rk, ks, dr),
   rnd AS (SELECT sample_id, k, 'keep_random' AS condition, draw, sum(l2) FILTER (WHERE place<=k) AS z FROM rp GROUP BY ALL
     UNION ALL SELECT sample_id, k, 'delete_random', draw, sum(l2) FILTER (WHERE place>k) FROM rp GROUP BY ALL),
   a AS (SELECT * FROM top UNION ALL SELECT * FROM rnd)
  SELECT a.sample_id, CASE WHEN ground_truth=1 THEN 'spoof' ELSE 'bonafide' END AS true_class, condition, k,
    avg(CASE WHEN logit>0 THEN round(1/(1+exp(-z)),9) ELSE 1-round(1/(1+exp(-z)),9) END) AS p_pred,
    any_value(CASE WHEN logit>0 THEN round(1/(1+exp(-logit)),9) ELSE 1-round(1/(1+exp(-logit)),9) END) AS p_orig
  FROM a JOIN g USING (sample_id) GROUP BY a.sample_id, ground_truth, condition, k""")
VIEWS["areas"] = (("faith",), """
  SELECT sample_id, true_class, condition, CASE WHEN starts_with(condition,'keep') THEN 'sufficiency' ELSE 'comprehensiveness' END AS metric,
    avg(CASE WHEN starts_with(condition,'keep') THEN p_pred ELSE p_orig-p_pred END) AS aopc FROM faith GROUP BY ALL HAVING count(DISTINCT k)=3""")


def _faith(spark, sf):
    return freeze(jobs.faithfulness_rows(V.relevance(spark, sf), V.scorer(2), RATE, EDGES, WIN, HOP, KS, DRAWS))


@query("faithfulness_rows", f"SELECT sample_id, true_class, condition, k, {_r('p_pred','p_pred')}, {_r('p_orig','p_orig',9)} FROM faith", "faith")
def _(spark, sf):
    return rounded(rounded(_faith(spark, sf), "p_pred"), "p_orig", digits=9)


@query("faithfulness_curves", f"""
SELECT true_class, condition, k, {_r('mean','p_pred_mean',5)}, {_r('ci_low','ci_low',5)}, {_r('ci_high','ci_high',5)}, n AS n_clips FROM {_boot_sql('faith','true_class, condition, k','sample_id','p_pred')}""", "faith")
def _(spark, sf):
    return rounded(effects.faithfulness_curves(_faith(spark, sf), ["sample_id"], n_boot=BOOT), "p_pred_mean", "ci_low", "ci_high", digits=5)


_AREA = f"SELECT metric, condition, true_class, {_r('mean','aopc',5)}, {_r('ci_low','ci_low',5)}, {_r('ci_high','ci_high',5)}, n AS n_clips FROM {_boot_sql('areas','metric, condition, true_class','sample_id','aopc')}"


@query("faithfulness_areas", _AREA, "areas")
def _(spark, sf):
    a = effects.curve_areas(_faith(spark, sf), len(KS), "sample_id")
    return rounded(effects.area_table(a, "sample_id", n_boot=BOOT), "aopc", "ci_low", "ci_high", digits=5)


@query("faithfulness_comparison", f"""
WITH t AS (SELECT metric, condition, true_class, round(avg(aopc),5) AS aopc FROM areas GROUP BY ALL)
SELECT 'enc_a' AS run, metric, true_class, max(aopc) FILTER (WHERE suffix(condition,'top')) AS explained, max(aopc) FILTER (WHERE suffix(condition,'random')) AS random,
 {_r("max(aopc) FILTER (WHERE suffix(condition,'top')) - max(aopc) FILTER (WHERE suffix(condition,'random'))",'gain')} FROM t GROUP BY metric, true_class""", "areas")
def _(spark, sf):
    t = effects.area_means(effects.curve_areas(_faith(spark, sf), len(KS), "sample_id"))
    return rounded(effects.area_comparison(t.withColumn("run", F.lit("enc_a"))), "gain")


@query("clip_band_ranking", """
SELECT sample_id, string_agg(band::VARCHAR, ',' ORDER BY place) AS ranking FROM (
 SELECT e.sample_id, e.band, row_number() OVER (PARTITION BY e.sample_id ORDER BY CASE WHEN spoof THEN -r ELSE r END, e.band) AS place FROM relevance_bands e) GROUP BY ALL""", "relevance_bands")
def _(spark, sf):
    r = _relevance_bands(spark, sf)
    return r.select("sample_id", F.array_join(sampling.ranked_bands(F.col("bands"), F.col("logit") > 0), ",").alias("ranking"))


@query("random_band_subsets", """
SELECT sample_id, string_agg(band::VARCHAR, ',' ORDER BY place) AS kept, (SELECT string_agg(x::VARCHAR, ',' ORDER BY x) FROM range(0,4) q(x) WHERE NOT list_contains(list(band), x)) AS complement FROM (
 SELECT sample_id, band, row_number() OVER (PARTITION BY sample_id ORDER BY md5('5:'||sample_id||':'||band)) AS place FROM signals, range(0,4) r(band)) WHERE place<=2 GROUP BY sample_id""", "signals")
def _(spark, sf):
    k = sampling.random_bands(NB, F.lit(2), F.lit("5"), "sample_id")
    return V.signals(spark, sf).select("sample_id", F.array_join(k, ",").alias("kept"),
                                       F.array_join(sampling.complement(NB, k), ",").alias("complement"))


_KHZ = "printf('%.2f',e.lo/1000)||'-'||printf('%.2f',e.hi/1000)"


@query("clip_export_manifest", f"""
WITH c AS (SELECT sample_id, CASE WHEN ground_truth=1 THEN 'spoof' ELSE 'bonafide' END AS true_class, samples FROM (SELECT *, row_number() OVER (PARTITION BY quadrant ORDER BY CASE WHEN p_spoof_ad>0.5 THEN -p_spoof_ad ELSE p_spoof_ad END, sample_id) AS rn
   FROM (SELECT *, {S.quadrant('p_spoof_ad > 0.5')} AS quadrant FROM scored)) WHERE rn<=2),
 b AS (SELECT c.sample_id, c.true_class, r.band, r.spoof, l.l2, {dot('c.samples', 2)} AS logit, {_KHZ} AS khz,
   row_number() OVER (PARTITION BY c.sample_id ORDER BY CASE WHEN r.spoof THEN -r.r ELSE r.r END, r.band) AS top, row_number() OVER (PARTITION BY c.sample_id ORDER BY md5('0:'||c.sample_id||':'||r.band)) AS rnd
   FROM c JOIN relevance_bands r ON r.sample_id=c.sample_id JOIN band_logits l ON l.sample_id=c.sample_id AND l.band=r.band JOIN edges e ON e.band=r.band),
 v AS (SELECT *, 'keep_top2' AS variant, top<=2 AS kept FROM b UNION ALL SELECT *, 'delete_top2', top>2 FROM b UNION ALL SELECT *, 'keep_rand2', rnd<=2 FROM b UNION ALL SELECT *, 'delete_rand2', rnd>2 FROM b
   UNION ALL SELECT *, 'original', true FROM b),
 g AS (SELECT sample_id, true_class, spoof, variant, CASE WHEN variant='original' THEN any_value(logit) ELSE sum(l2) FILTER (WHERE kept) END AS z,
   CASE WHEN variant='original' THEN 'all' ELSE string_agg(khz, '; ' ORDER BY band) FILTER (WHERE kept) END AS kept_bands_khz FROM v GROUP BY sample_id, true_class, spoof, variant)
SELECT sample_id, true_class, CASE WHEN spoof THEN 'spoof' ELSE 'bonafide' END AS pred, variant, kept_bands_khz, round(CASE WHEN spoof THEN round(1/(1+exp(-z)),9) ELSE 1-round(1/(1+exp(-z)),9) END,4) AS p_pred FROM g""",
       "scored", "relevance_bands", "band_logits", "edges")
def _(spark, sf):
    r = _relevance_bands(spark, sf).withColumn("predicted", F.col("logit") > 0)
    best = sampling.confident_per_quadrant(V.scored(spark, sf), "ground_truth", "p_spoof_ad", "sample_id", 2).select(
        "sample_id", stats.class_name(F.col("ground_truth")).alias("true_class"), "samples")
    clips = best.join(r.select("sample_id", "predicted", sampling.ranked_bands(F.col("bands"), F.col("predicted")).alias("ranking")), "sample_id")
    return jobs.clip_export(clips, V.scorer(2), RATE, EDGES, WIN, HOP, 2)


# --- relevance across runs --------------------------------------------------------------------

VIEWS["run_relevance"] = (("signals", "edges"), " UNION ALL ".join(f"""
  SELECT '{run}' AS run, band, (lo+hi)/2 AS band_center_hz, avg(r) AS relevance FROM (
   SELECT sample_id, e.band, e.lo, e.hi, sum((CASE WHEN k IN (0,32) THEN 1 ELSE 2 END)*(xr*gr+xi*gi)/64.0) AS r FROM (
    SELECT sample_id, k, sum(x*cos(2*pi()*k*i/64.0)) AS xr, -sum(x*sin(2*pi()*k*i/64.0)) AS xi, sum(g*cos(2*pi()*k*i/64.0)) AS gr, -sum(g*sin(2*pi()*k*i/64.0)) AS gi FROM (
     SELECT sample_id, k, i, samples[i+1] AS x, CASE WHEN abs(samples[i+1])>1e-9 THEN ({weights(3 + n)})[i+1] ELSE 0 END AS g FROM signals, range(0,33) a(k), range(0,64) b(i)) GROUP BY ALL) f
   JOIN edges e ON f.k>=e.lo AND (f.k<e.hi OR (e.band=3 AND f.k=e.hi)) GROUP BY ALL) GROUP BY band, lo, hi""" for n, run in enumerate(V.RUNS)))


def _run_relevance(spark, sf):
    freqs = [i * RATE / 64 for i in range(33)]
    out = None
    for n, run in enumerate(V.RUNS):
        r = V.relevance(spark, sf, 3 + n)
        bands = effects.band_sums(dsp.frequency_relevance(_x(), F.col("relevance")), freqs, EDGES, "last_closed")
        part = r.select(F.posexplode(bands).alias("band", "r")).groupBy("band").agg(F.avg("r").alias("relevance")).select(
            F.lit(run).alias("run"), "band", "relevance")
        out = part if out is None else out.unionByName(part)
    lo, hi = signal.band_bounds(F.col("band"), EDGES)
    return freeze(out.withColumn("band_center_hz", (lo + hi) / 2))


@query("run_band_agreement", f"""
WITH r AS (SELECT run, band, row_number() OVER (PARTITION BY run ORDER BY relevance) AS rk FROM run_relevance)
SELECT a.run AS run_a, b.run AS run_b, {_r('corr(a.rk,b.rk)','spearman')}, count(*) AS n FROM r a JOIN r b ON a.band=b.band AND a.run<b.run GROUP BY ALL""", "run_relevance")
def _(spark, sf):
    from corpuslens.operators import compare
    return rounded(compare.rank_agreement(_run_relevance(spark, sf), V.RUNS, "run", "band", "relevance"), "spearman")


@query("run_top_bands", f"""
SELECT run, rank::INTEGER AS rank, round(band_center_hz,1) AS band_center_hz, printf('%.0f',band_center_hz)||' Hz' AS band, {_r('abs(relevance)','abs_relevance',4)}, {_r('relevance','signed_relevance',4)} FROM (
 SELECT *, row_number() OVER (PARTITION BY run ORDER BY abs(relevance) DESC, band_center_hz) AS rank FROM run_relevance) WHERE rank<=2""", "run_relevance")
def _(spark, sf):
    from corpuslens.operators import compare
    t = compare.top_bands(_run_relevance(spark, sf), "run", "band_center_hz", "relevance", 2)
    return rounded(t, "abs_relevance", "signed_relevance", digits=4)


@query("runs_by_first_band", """
SELECT printf('%.0f',band_center_hz)||' Hz' AS band, count(*) AS n, string_agg(run, ', ' ORDER BY run) AS runs FROM (
 SELECT *, row_number() OVER (PARTITION BY run ORDER BY abs(relevance) DESC, band_center_hz) AS rank FROM run_relevance) WHERE rank=1 GROUP BY 1""", "run_relevance")
def _(spark, sf):
    from corpuslens.operators import compare
    return compare.runs_by_first_band(compare.top_bands(_run_relevance(spark, sf), "run", "band_center_hz", "relevance", 2), "run")


_BACKENDS = "SELECT run, band, relevance, CASE WHEN run='enc_b' THEN 'gxi' WHEN band%2=0 THEN 'conservative' ELSE 'gxi' END AS backend FROM run_relevance"


@query("preferred_backend_rows", f"""
WITH b AS ({_BACKENDS}) SELECT run, backend, band, {_r('relevance','relevance')} FROM b WHERE backend = CASE WHEN run='enc_b' THEN 'gxi' ELSE 'conservative' END""", "run_relevance")
def _(spark, sf):
    from corpuslens.operators import compare
    b = F.when(F.col("run") == "enc_b", "gxi").when(F.col("band") % 2 == 0, "conservative").otherwise("gxi")
    r = _run_relevance(spark, sf).withColumn("backend", b)
    return rounded(compare.preferred_backend(r, "run", "backend", "conservative").select("run", "backend", "band", "relevance"), "relevance")
