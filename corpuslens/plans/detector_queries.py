"""Registered queries: detector metrics, association, tests, bootstrap, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import text
from corpuslens.operators import bootstrap, compare, metrics, sampling, stats
from corpuslens.plans import detector_sql as S, views as V
from corpuslens.plans.corpus_queries import rounded
from corpuslens.plans.registry import query

TAGS, FEATS = V.DETECTORS, V.BAND_COLUMNS
#: Bootstrap replicates of every query.
BOOT = 1000


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr},{digits})+0.0 AS {name}"


# --- error rates ------------------------------------------------------------------------------

@query("roc_points", f"SELECT detector, threshold, {_r('fpr','fpr',9)}, {_r('fnr','fnr',9)} FROM points", "points")
def _(spark, sf):
    return rounded(metrics.roc_points(V.scored_long(spark, sf), ["detector"], "score", "ground_truth"), "fpr", "fnr", digits=9)


@query("equal_error_rate", f"SELECT detector, {_r('eer','eer',9)}, threshold FROM eers", "eers")
def _(spark, sf):
    return rounded(metrics.equal_error_rate(V.scored_long(spark, sf), ["detector"], "score", "ground_truth"), "eer", digits=9)


@query("det_points", f"SELECT detector, threshold, {_r('fpr','fpr',9)}, {_r('fnr','fnr',9)} FROM points WHERE fpr>0 AND fnr>0", "points")
def _(spark, sf):
    d = metrics.det_points(V.scored_long(spark, sf), ["detector"], "score", "ground_truth")
    return rounded(d.drop("fpr_deviate", "fnr_deviate"), "fpr", "fnr", digits=9)


@query("det_deviates", f"""
SELECT detector, threshold, {_r(S.normal_quantile('fpr'),'fpr_deviate',7)}, {_r(S.normal_quantile('fnr'),'fnr_deviate',7)} FROM points WHERE fpr>0 AND fnr>0 AND fpr<1 AND fnr<1""", "points")
def _(spark, sf):
    d = metrics.det_points(V.scored_long(spark, sf), ["detector"], "score", "ground_truth")
    return rounded(d.filter((F.col("fpr") < 1) & (F.col("fnr") < 1)).drop("fpr", "fnr"), "fpr_deviate", "fnr_deviate", digits=7)


@query("threshold_error_rates", f"""
SELECT detector, step::INTEGER AS step, {_r('avg((score >= t)::INTEGER) FILTER (WHERE ground_truth=0)','fpr',9)},
  {_r('avg((score < t)::INTEGER) FILTER (WHERE ground_truth=1)','fnr',9)}
FROM scores_long, (SELECT i AS step, ([{','.join(repr(t) for t in metrics.logit_grid(801))}]::DOUBLE[])[i+1] AS t FROM range(0,801) r(i)) GROUP BY detector, step""",
       "scores_long")
def _(spark, sf):
    d = metrics.threshold_rates(V.scored_long(spark, sf), ["detector"], "score", "ground_truth", 801)
    return rounded(d.drop("threshold"), "fpr", "fnr", digits=9)


_EVAL = f"""
SELECT detector, {_r('eer*100','eer')}, threshold AS eer_threshold, {_r(S.mcc('a1','b1','c1','d1'),'mcc_eer')}, {_r('(a1+b1)/n','acc_eer')},
  {_r(S.mcc('a2','b2','c2','d2'),'mcc_half')}, {_r('(a2+b2)/n','acc_half')}
FROM (SELECT s.detector, e.eer, e.threshold, count(*) AS n, """ + ", ".join(
    f"count(*) FILTER (WHERE ground_truth={g} AND {'' if p else 'NOT '}(score >= {t})) AS {c}{i}"
    for i, t in ((1, "e.threshold"), (2, "0.5")) for c, g, p in (("a", 1, 1), ("b", 0, 0), ("c", 0, 1), ("d", 1, 0))) + """
  FROM scores_long s JOIN eers e ON s.detector=e.detector GROUP BY ALL)"""


@query("detector_evaluation", _EVAL, "scores_long", "eers")
def _(spark, sf):
    d = metrics.evaluate(V.scored_long(spark, sf), ["detector"], "score", "ground_truth")
    return rounded(d, "eer", "mcc_eer", "acc_eer", "mcc_half", "acc_half")


@query("detector_performance", f"""
SELECT m.detector, {_r('e.eer','eer')}, {_r(S.mcc(),'mcc')}, {_r('(tp+tn)/(tp+tn+fp+fn)','accuracy')} FROM (
  SELECT detector, count(*) FILTER (WHERE q='TP') tp, count(*) FILTER (WHERE q='TN') tn, count(*) FILTER (WHERE q='FP') fp, count(*) FILTER (WHERE q='FN') fn
  FROM (SELECT 'zs' AS detector, quadrant_zs AS q FROM master UNION ALL SELECT 'ad', quadrant_ad FROM master) GROUP BY detector) m
JOIN eers e ON m.detector=e.detector""", "master", "eers")
def _(spark, sf):
    from corpuslens.plans.jobs import performance
    return rounded(performance(V.master(spark, sf), TAGS), "eer", "mcc", "accuracy")


@query("confusion_grid", """
SELECT d.detector, t AS truth, p AS pred, count(s.sample_id) AS count FROM (VALUES ('zs'),('ad')) d(detector), (VALUES (0),(1)) a(t), (VALUES (0),(1)) b(p)
LEFT JOIN scores_long s ON s.detector=d.detector AND s.ground_truth=t AND (s.score>=0.5)::INTEGER=p GROUP BY ALL""", "scores_long")
def _(spark, sf):
    return metrics.confusion_grid(V.scored_long(spark, sf), ["detector"], "ground_truth", F.col("score") >= 0.5)


_CLS = f"""
SELECT c.detector, {_r('(tp/(tp+fn)+tn/(tn+fp))/2','balanced_accuracy')}, {_r('2*tp/(2*tp+fp+fn)','f1')}, {_r('roc_auc','roc_auc')} FROM (
  SELECT detector, count(*) FILTER (WHERE ground_truth=1 AND score>=0.5) tp, count(*) FILTER (WHERE ground_truth=0 AND score<0.5) tn,
   count(*) FILTER (WHERE ground_truth=0 AND score>=0.5) fp, count(*) FILTER (WHERE ground_truth=1 AND score<0.5) fn FROM scores_long GROUP BY ALL) c
JOIN (SELECT detector, (sum(r) FILTER (WHERE ground_truth=1) - p*(p+1)/2.0)/(p*(count(*)-p)) AS roc_auc FROM (
  SELECT *, {S.average_rank('detector','score')} AS r, sum(ground_truth) OVER (PARTITION BY detector) AS p FROM scores_long) GROUP BY detector, p) a ON c.detector=a.detector"""


@query("classification_metrics", _CLS, "scores_long")
def _(spark, sf):
    d = metrics.classification(V.scored_long(spark, sf), ["detector"], "score", "ground_truth")
    return rounded(d, "balanced_accuracy", "f1", "roc_auc")


@query("master_table", "SELECT sample_id, ground_truth, p_spoof_zs, pred_zs, quadrant_zs, p_spoof_ad, pred_ad, quadrant_ad, "
       + ", ".join(FEATS) + " FROM master", "master")
def _(spark, sf):
    return V.master(spark, sf)


# --- association ------------------------------------------------------------------------------

@query("within_class_correlation", f"SELECT detector, feature, class, {_r('rho','rho')}, n FROM correlations", "correlations")
def _(spark, sf):
    return rounded(stats.within_class_correlation(V.master(spark, sf), TAGS, FEATS), "rho")


_ASSOC = "SELECT *, " + S.t_two_sided("rho*sqrt((n-2)/((1-rho)*(1+rho)))", "(n-2)") + " AS p_value FROM correlations"


@query("association_table", f"""
WITH tested AS ({_ASSOC}) SELECT detector, feature, class, {_r('rho','rho')}, n, {_r('p_value','p_value')}, {_r('q_value_fdr','q_value_fdr')}
FROM ({S.adjusted('tested', 'detector')})""", "correlations")
def _(spark, sf):
    return rounded(stats.association(V.master(spark, sf), TAGS, FEATS), "rho", "p_value", "q_value_fdr")


@query("top_features", f"""
SELECT feature, {_r('strength','strength')} FROM (SELECT feature, max(abs(rho)) AS strength FROM correlations GROUP BY feature) ORDER BY strength DESC, feature LIMIT 5""", "correlations")
def _(spark, sf):
    return rounded(stats.top_features(stats.within_class_correlation(V.master(spark, sf), TAGS, FEATS), 5), "strength")


@query("band_strength", f"SELECT detector, band, {_r('strength','strength')}, {_r('signed','signed')} FROM strengths", "strengths")
def _(spark, sf):
    return rounded(stats.band_strength(stats.within_class_correlation(V.master(spark, sf), TAGS, FEATS), TAGS, V.BAND_COUNT), "strength", "signed")


@query("signed_profile", f"""
SELECT feature, {_r('z','rho_zs')}, {_r('a','rho_ad')}, coalesce(z*a<0,false) AS sign_flip FROM (
  SELECT feature, arg_max(rho,abs(rho)) FILTER (WHERE detector='zs') AS z, arg_max(rho,abs(rho)) FILTER (WHERE detector='ad') AS a FROM correlations GROUP BY feature)""", "correlations")
def _(spark, sf):
    return rounded(stats.signed_profile(stats.within_class_correlation(V.master(spark, sf), TAGS, FEATS)), "rho_zs", "rho_ad")


# --- group tests ------------------------------------------------------------------------------

_WELCH = """SELECT detector, feature, (m1-m2)/sqrt(v1/n1+v2/n2) AS statistic,
 pow(v1/n1+v2/n2,2)/(pow(v1/n1,2)/(n1-1)+pow(v2/n2,2)/(n2-1)) AS df FROM (SELECT detector, feature,
 count(value) FILTER (WHERE quadrant='TN') n1, avg(value) FILTER (WHERE quadrant='TN') m1, var_samp(value) FILTER (WHERE quadrant='TN') v1,
 count(value) FILTER (WHERE quadrant='FP') n2, avg(value) FILTER (WHERE quadrant='FP') m2, var_samp(value) FILTER (WHERE quadrant='FP') v2
 FROM quadrant_rows GROUP BY ALL) WHERE n1>1 AND n2>1"""
_LEVENE = """SELECT detector, feature, (n1+n2-2)*(n1*pow(m1-g,2)+n2*pow(m2-g,2))/((n1-1)*v1+(n2-1)*v2) AS statistic, (n1+n2-2)::DOUBLE AS df FROM (
 SELECT *, (n1*m1+n2*m2)/(n1+n2) AS g FROM (SELECT detector, feature,
 count(z) FILTER (WHERE quadrant='TP') n1, avg(z) FILTER (WHERE quadrant='TP') m1, var_samp(z) FILTER (WHERE quadrant='TP') v1,
 count(z) FILTER (WHERE quadrant='FN') n2, avg(z) FILTER (WHERE quadrant='FN') m2, var_samp(z) FILTER (WHERE quadrant='FN') v2
 FROM (SELECT *, abs(value - median(value) OVER (PARTITION BY detector, feature, quadrant)) AS z FROM quadrant_rows WHERE quadrant IN ('TP','FN'))
 GROUP BY ALL)) WHERE n1>2 AND n2>2"""


def _values(spark, sf):
    return stats.quadrant_values(V.master(spark, sf), TAGS, FEATS)


@query("welch_statistics", f"SELECT detector, feature, {_r('statistic','statistic')}, {_r('df','df')} FROM ({_WELCH})", "quadrant_rows")
def _(spark, sf):
    return rounded(stats.welch(_values(spark, sf), ["detector", "feature"], "quadrant", "TN", "FP"), "statistic", "df")


@query("spread_statistics", f"SELECT detector, feature, {_r('statistic','statistic')}, {_r('df','df')} FROM ({_LEVENE})", "quadrant_rows")
def _(spark, sf):
    return rounded(stats.brown_forsythe(_values(spark, sf), ["detector", "feature"], "quadrant", "TP", "FN"), "statistic", "df")


@query("confirmatory_tests", f"""
WITH tested AS (SELECT detector, feature, 'welch_TN_vs_FP' AS test, statistic, {S.t_two_sided('statistic','df')} AS p_value FROM ({_WELCH})
 UNION ALL SELECT detector, feature, 'levene_TP_vs_FN', statistic, {S.t_two_sided('sqrt(statistic)','df')} FROM ({_LEVENE}))
SELECT detector, feature, test, {_r('statistic','statistic')}, {_r('p_value','p_value')}, {_r('q_value_fdr','q_value_fdr')} FROM ({S.adjusted('tested','detector')})""",
       "quadrant_rows")
def _(spark, sf):
    return rounded(stats.confirmatory(_values(spark, sf)), "statistic", "p_value", "q_value_fdr")


@query("effect_sizes", f"""
SELECT detector, feature, {_r('(m1-m2)/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2))','cohens_d')}, {_r('log2(sqrt(v3)/sqrt(v4))','log2_std_ratio')} FROM (
 SELECT detector, feature, """ + ", ".join(
    f"count(value) FILTER (WHERE quadrant='{q}') n{i}, avg(value) FILTER (WHERE quadrant='{q}') m{i}, var_samp(value) FILTER (WHERE quadrant='{q}') v{i}"
    for i, q in ((1, "TN"), (2, "FP"), (3, "TP"), (4, "FN"))) + " FROM quadrant_rows GROUP BY ALL)", "quadrant_rows")
def _(spark, sf):
    return rounded(stats.effect_sizes(_values(spark, sf)), "cohens_d", "log2_std_ratio")


@query("energy_distribution", f"""
WITH long AS (""" + " UNION ALL ".join(f"SELECT ground_truth, '{f}' AS feature, {f} AS value FROM featured" for f in FEATS) + f"""),
 d AS (SELECT feature, (m1-m0)/sqrt(((n1-1)*v1+(n0-1)*v0)/(n1+n0-2)) AS cohens_d FROM (SELECT feature, """ + ", ".join(
    f"count(*) FILTER (WHERE ground_truth={g}) n{g}, avg(value) FILTER (WHERE ground_truth={g}) m{g}, var_samp(value) FILTER (WHERE ground_truth={g}) v{g}" for g in (0, 1)) + f""" FROM long GROUP BY feature))
SELECT l.feature, CASE WHEN ground_truth=1 THEN 'spoof' ELSE 'bonafide' END AS class, count(*) AS n, {_r('avg(value)','mean')}, {_r('quantile_cont(value,0.25)','q25',11)},
 {_r('quantile_cont(value,0.75)','q75',11)}, {_r('any_value(d.cohens_d)','cohens_d')} FROM long l JOIN d ON l.feature=d.feature GROUP BY l.feature, ground_truth""", "featured")
def _(spark, sf):
    from corpuslens.session import freeze
    d = stats.energy_distribution(freeze(V.featured(spark, sf).drop("samples")), FEATS)
    return rounded(rounded(d, "mean", "cohens_d"), "q25", "q75", digits=11)


@query("significance_stars", f"""
WITH tested AS ({_ASSOC}), q AS ({S.adjusted('tested','detector')})
SELECT detector, feature, class, CASE WHEN q_value_fdr<0.001 THEN '***' WHEN q_value_fdr<0.01 THEN '**' WHEN q_value_fdr<0.05 THEN '*' ELSE 'ns' END AS stars FROM q""", "correlations")
def _(spark, sf):
    a = stats.association(V.master(spark, sf), TAGS, FEATS)
    return a.select("detector", "feature", "class", text.stars(F.col("q_value_fdr")).alias("stars"))


# --- bootstrap --------------------------------------------------------------------------------

@query("bootstrap_mean_intervals", f"""
WITH reps AS (SELECT b, """ + ", ".join(f"sum({f}*w)/sum(w) AS {f}" for f in FEATS) + f""" FROM (SELECT f.*, b, {S.boot_weight(42,'sample_id')} AS w FROM featured f, range(0,{BOOT}) r(b)) GROUP BY b)
""" + " UNION ALL ".join(
    f"SELECT '{f}' AS \"column\", (SELECT {_r(f'avg({f})','mean')} FROM featured) AS mean, {_r(f'quantile_cont({f},0.025)','ci_low')}, {_r(f'quantile_cont({f},0.975)','ci_high')}, (SELECT count(*) FROM featured) AS n FROM reps" for f in FEATS),
       "featured")
def _(spark, sf):
    from corpuslens.session import freeze
    f = freeze(V.featured(spark, sf).drop("samples"))
    return rounded(bootstrap.mean_ci(f, [], FEATS, ["sample_id"], n_boot=BOOT), "mean", "ci_low", "ci_high")


@query("bootstrap_effect_intervals", f"""
WITH s AS (SELECT detector, feature, b, """ + ", ".join(
    f"sum(w) FILTER (WHERE quadrant='{q}') AS n{i}, sum(w*value) FILTER (WHERE quadrant='{q}') AS s{i}, sum(w*value*value) FILTER (WHERE quadrant='{q}') AS q{i}"
    for i, q in ((1, "TN"), (2, "FP"))) + f""" FROM (SELECT r.*, b, {S.boot_weight(42,'sample_id')} AS w FROM quadrant_rows r, range(0,{BOOT}) t(b)) GROUP BY ALL),
 v AS (SELECT *, (q1-s1*s1/n1)/(n1-1) AS v1, (q2-s2*s2/n2)/(n2-1) AS v2 FROM s WHERE n1>=2 AND n2>=2),
 d AS (SELECT detector, feature, b, (s1/n1-s2/n2)/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)) AS d FROM v)
SELECT detector, feature, {_r('quantile_cont(d,0.025)','ci_low',5)}, {_r('quantile_cont(d,0.975)','ci_high',5)} FROM d GROUP BY ALL""", "quadrant_rows")
def _(spark, sf):
    m = bootstrap.with_weights(V.master(spark, sf), ["sample_id"], BOOT, 42)
    values = stats.quadrant_values(m, TAGS, FEATS, extra=["_weights"])
    d = bootstrap.two_sample_ci(values, ["detector", "feature"], "quadrant", "TN", "FP", "value",
                                ["sample_id"], bootstrap.pooled_effect, n_boot=BOOT)
    return rounded(d, "ci_low", "ci_high", digits=5)


# Wilcoxon and the paired test on the two detectors' scores of the same clip.
_SR = f"""
WITH d AS (SELECT ground_truth, p_spoof_ad - p_spoof_zs AS diff FROM scored),
 r AS (SELECT *, {S.average_rank('ground_truth','abs(diff)')} AS rk FROM d WHERE diff<>0),
 t AS (SELECT ground_truth, sum(c*c*c-c) AS tie FROM (SELECT ground_truth, count(*)::DOUBLE AS c FROM r GROUP BY ground_truth, abs(diff)) GROUP BY ground_truth),
 s AS (SELECT r.ground_truth, count(*) AS n, coalesce(sum(rk) FILTER (WHERE diff>0),0) AS w_plus, coalesce(sum(rk) FILTER (WHERE diff<0),0) AS w_minus, any_value(tie) AS tie FROM r JOIN t ON r.ground_truth=t.ground_truth GROUP BY r.ground_truth),
 z AS (SELECT *, (least(w_plus,w_minus)-n*(n+1)/4.0)/sqrt((n*(n+1)*(2*n+1)-tie/2)/24) AS z FROM s)"""


@query("signed_rank_test", _SR + f"""
SELECT ground_truth, {_r('w_plus','w_plus')}, {_r('w_minus','w_minus')}, n AS n_nonzero, {_r('z','wilcoxon_z')}, {_r(S.normal_two_sided('z'),'wilcoxon_p')} FROM z""", "scored")
def _(spark, sf):
    d = V.scored(spark, sf).select("ground_truth", (F.col("p_spoof_ad") - F.col("p_spoof_zs")).alias("diff"))
    return rounded(stats.signed_rank(d, ["ground_truth"], "diff"), "w_plus", "w_minus", "wilcoxon_z", "wilcoxon_p")


_PAIRED = _SR + f""",
 m AS (SELECT ground_truth, b, quantile_cont(diff,0.5) AS med FROM (
   SELECT ground_truth, diff, b, unnest(range(0, w)) AS _ FROM (SELECT ground_truth, p_spoof_ad - p_spoof_zs AS diff, b, {S.boot_weight(42,'sample_id')} AS w FROM scored, range(0,{BOOT}) t(b))) GROUP BY ALL),
 c AS (SELECT ground_truth, quantile_cont(med,0.025) AS lo, quantile_cont(med,0.975) AS hi FROM m GROUP BY ALL)
SELECT d.ground_truth, count(*) AS n_pairs, {_r('median(diff)','median_diff',11)}, {_r('any_value(lo)','ci_low')}, {_r('any_value(hi)','ci_high')}, {_r('avg(diff)/stddev_samp(diff)','cohen_dz')},
 {_r('any_value(p)','wilcoxon_p')}, (SELECT {_r('avg(p_spoof_ad)','x')} FROM scored s WHERE s.ground_truth=d.ground_truth) AS mean_drop_top, (SELECT {_r('avg(p_spoof_zs)','x')} FROM scored s WHERE s.ground_truth=d.ground_truth) AS mean_drop_bottom
FROM d JOIN c ON d.ground_truth=c.ground_truth JOIN (SELECT ground_truth, {S.normal_two_sided('z')} AS p FROM z) w ON w.ground_truth=d.ground_truth GROUP BY d.ground_truth"""


@query("paired_test", _PAIRED, "scored")
def _(spark, sf):
    s = V.scored(spark, sf).select("sample_id", "ground_truth", "p_spoof_ad", "p_spoof_zs")
    d = stats.paired_test(s, ["ground_truth"], "p_spoof_ad", "p_spoof_zs", ["sample_id"], n_boot=BOOT)
    return rounded(rounded(d, "median_diff", digits=11), "ci_low", "ci_high", "cohen_dz", "wilcoxon_p", "mean_drop_top", "mean_drop_bottom")


# --- sampling ---------------------------------------------------------------------------------

def _hash(seed: int, key: str) -> str:
    return f"md5('{seed}:'||{key})"


@query("stratified_sample", f"""
SELECT sample_id, quadrant_ad FROM (SELECT *, row_number() OVER (PARTITION BY quadrant_ad ORDER BY {_hash(42,'sample_id')}) AS rn FROM master) WHERE rn<=20""", "master")
def _(spark, sf):
    return sampling.up_to(V.master(spark, sf), ["quadrant_ad"], ["sample_id"], 20).select("sample_id", "quadrant_ad")


_QUOTA = """q AS (SELECT ground_truth, quadrant_ad, n, row_number() OVER (PARTITION BY ground_truth ORDER BY n, CASE WHEN quadrant_ad IN ('FN','FP') THEN 0 ELSE 1 END) AS o,
   count(*) OVER (PARTITION BY ground_truth) AS k FROM (SELECT ground_truth, quadrant_ad, count(*) AS n FROM master GROUP BY ALL)),
 t AS (SELECT a.ground_truth, a.quadrant_ad, least(a.n, CASE WHEN a.k=1 THEN 120 WHEN a.o=1 THEN 60 ELSE 120-least(b.n,60) END) AS quota
   FROM q a LEFT JOIN q b ON a.ground_truth=b.ground_truth AND b.o=1)"""


@query("rare_first_sample", f"""
WITH {_QUOTA} SELECT m.sample_id, m.ground_truth, m.quadrant_ad FROM (SELECT *, row_number() OVER (PARTITION BY ground_truth, quadrant_ad ORDER BY {_hash(42,'sample_id')}) AS rn FROM master) m
JOIN t ON m.ground_truth=t.ground_truth AND m.quadrant_ad=t.quadrant_ad WHERE rn<=quota""", "master")
def _(spark, sf):
    return sampling.rare_first(V.master(spark, sf), "ground_truth", "quadrant_ad", ["sample_id"], 120).select(
        "sample_id", "ground_truth", "quadrant_ad")


@query("confident_per_quadrant", f"""
SELECT sample_id, quadrant, place, p_spoof_ad FROM (SELECT *, row_number() OVER (PARTITION BY quadrant ORDER BY CASE WHEN p_spoof_ad>0.5 THEN -p_spoof_ad ELSE p_spoof_ad END, sample_id) AS place
 FROM (SELECT *, {S.quadrant('p_spoof_ad > 0.5')} AS quadrant FROM scored)) WHERE place<=3""", "scored")
def _(spark, sf):
    return sampling.confident_per_quadrant(V.scored(spark, sf), "ground_truth", "p_spoof_ad", "sample_id", 3).select(
        "sample_id", "quadrant", "place", "p_spoof_ad")


@query("most_confident_clip", """
SELECT quadrant_ad, sample_id, p_spoof_ad FROM (SELECT *, row_number() OVER (PARTITION BY quadrant_ad ORDER BY CASE WHEN quadrant_ad IN ('TP','FP') THEN -p_spoof_ad ELSE p_spoof_ad END, sample_id) AS rn FROM master) WHERE rn=1""", "master")
def _(spark, sf):
    return sampling.most_confident(V.master(spark, sf), "quadrant_ad", "p_spoof_ad", "sample_id")


@query("balanced_sample", f"""
SELECT sample_id, ground_truth, row_number() OVER (ORDER BY {_hash(43,'sample_id')}) AS position FROM (
 SELECT *, row_number() OVER (PARTITION BY ground_truth ORDER BY {_hash(42,'sample_id')}) AS rn FROM signals) WHERE rn<=100""", "signals")
def _(spark, sf):
    return sampling.balanced(V.signals(spark, sf), "ground_truth", ["sample_id"], 100).select("sample_id", "ground_truth", "position")


@query("random_halves", f"""
SELECT sample_id, CASE WHEN rn <= n//2 THEN 0 ELSE 1 END AS half FROM (SELECT sample_id, row_number() OVER (ORDER BY {_hash(42,'sample_id')}) AS rn, count(*) OVER () AS n FROM signals)""", "signals")
def _(spark, sf):
    return sampling.halves(V.signals(spark, sf), ["sample_id"]).select("sample_id", "half")


@query("stratified_folds", f"""
SELECT sample_id, ((row_number() OVER (PARTITION BY ground_truth ORDER BY {_hash(42,'sample_id')}) - 1) % 5)::INTEGER AS fold FROM signals""", "signals")
def _(spark, sf):
    return sampling.stratified_folds(V.signals(spark, sf), "ground_truth", ["sample_id"], 5).select("sample_id", "fold")


@query("holdout_split", f"""
SELECT sample_id, CASE WHEN ('0x'||substr({_hash(42,'sample_id')},1,8))::BIGINT/4294967296.0 < 0.3 THEN 'test' ELSE 'train' END AS part FROM signals""", "signals")
def _(spark, sf):
    return sampling.holdout(V.signals(spark, sf), ["sample_id"]).select("sample_id", "part")


@query("convergence_bands", """
SELECT detector, band, top_rank, bottom_rank FROM (SELECT detector, band, row_number() OVER (PARTITION BY detector ORDER BY strength DESC, band DESC) AS top_rank,
  row_number() OVER (PARTITION BY detector ORDER BY strength, band) AS bottom_rank FROM strengths) WHERE top_rank<=1 OR bottom_rank<=1""", "strengths")
def _(spark, sf):
    c = stats.within_class_correlation(V.master(spark, sf), TAGS, FEATS)
    return sampling.top_and_bottom(stats.band_strength(c, TAGS, V.BAND_COUNT), 1).select(
        "detector", "band", "top_rank", "bottom_rank")


@query("extreme_examples", """
WITH pool AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY sample_id)-1 AS pos FROM scored) WHERE pos%7=0)
SELECT sample_id, p_spoof_ad, 'high' AS "end" FROM (SELECT * FROM pool ORDER BY p_spoof_ad DESC, sample_id LIMIT 3)
UNION ALL SELECT sample_id, p_spoof_ad, 'low' FROM (SELECT * FROM pool ORDER BY p_spoof_ad, sample_id LIMIT 2)""", "scored")
def _(spark, sf):
    return sampling.extreme_examples(V.scored(spark, sf), "sample_id", "p_spoof_ad", 5, 7)


# --- across runs ------------------------------------------------------------------------------

@query("run_rank_agreement", f"""
WITH r AS (SELECT run, sample_id, row_number() OVER (PARTITION BY run ORDER BY p_spoof, md5(sample_id::VARCHAR)) AS rk FROM run_scores)
SELECT a.run AS run_a, b.run AS run_b, {_r('corr(a.rk,b.rk)','spearman')}, count(*) AS n FROM r a JOIN r b ON a.sample_id=b.sample_id AND a.run<b.run GROUP BY ALL""", "run_scores")
def _(spark, sf):
    return rounded(compare.rank_agreement(V.run_scores(spark, sf), V.RUNS, "run", "sample_id", "p_spoof", 50), "spearman")


@query("runs_common_keys", """
SELECT run, sample_id, p_spoof FROM run_scores WHERE sample_id IN (SELECT sample_id FROM run_scores GROUP BY sample_id HAVING count(DISTINCT run)=3)""", "run_scores")
def _(spark, sf):
    return compare.common_keys(V.run_scores(spark, sf), "run", ["sample_id"], 3).select("run", "sample_id", "p_spoof")


_RUNPERF = f"""
WITH p AS ({S.roc('run_scores','run','p_spoof','ground_truth')}), e AS ({S.eer('p','run')}),
 c AS (SELECT s.run, any_value(e.eer) AS eer, count(*) FILTER (WHERE ground_truth=1 AND p_spoof>=threshold) tp, count(*) FILTER (WHERE ground_truth=0 AND p_spoof<threshold) tn,
  count(*) FILTER (WHERE ground_truth=0 AND p_spoof>=threshold) fp, count(*) FILTER (WHERE ground_truth=1 AND p_spoof<threshold) fn FROM run_scores s JOIN e ON s.run=e.run GROUP BY s.run)"""


@query("run_comparison", _RUNPERF + f"""
SELECT run, {_r('eer','eer_ad')}, {_r(S.mcc(),'mcc_ad')}, {_r('(tp+tn)/(tp+tn+fp+fn)','accuracy_ad')}, NULL::DOUBLE AS eer_zs FROM c""", "run_scores")
def _(spark, sf):
    e = metrics.evaluate(V.run_scores(spark, sf), ["run"], "p_spoof", "ground_truth")
    perf = e.select("run", F.lit("ad").alias("detector"), (F.col("eer") / 100).alias("eer"),
                    F.col("mcc_eer").alias("mcc"), F.col("acc_eer").alias("accuracy"))
    return rounded(compare.comparison_table(perf, "run"), "eer_ad", "mcc_ad", "accuracy_ad", "eer_zs")


@query("run_score_lookup", """
WITH c AS (SELECT quadrant_ad, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY quadrant_ad ORDER BY CASE WHEN quadrant_ad IN ('TP','FP') THEN -p_spoof_ad ELSE p_spoof_ad END, sample_id) AS rn FROM master) WHERE rn=1)
SELECT c.quadrant_ad, c.sample_id, max(p_spoof) FILTER (WHERE run='enc_a') AS enc_a, max(p_spoof) FILTER (WHERE run='enc_b') AS enc_b, max(p_spoof) FILTER (WHERE run='enc_c') AS enc_c
FROM c LEFT JOIN run_scores r ON c.sample_id=r.sample_id GROUP BY ALL""", "master", "run_scores")
def _(spark, sf):
    chosen = sampling.most_confident(V.master(spark, sf), "quadrant_ad", "p_spoof_ad", "sample_id").drop("p_spoof_ad")
    return compare.score_lookup(chosen, V.run_scores(spark, sf), V.RUNS)
