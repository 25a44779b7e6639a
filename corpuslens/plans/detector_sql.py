"""SQL pieces that check the detector queries: tails, bootstrap, spectra."""

from __future__ import annotations

from corpuslens.plans import views as V
from corpuslens.plans.oracle_views import VIEWS, poisson, weights

FEATURES = V.BAND_COLUMNS


def simpson(f: str, upper: str, steps: int = 2000) -> str:
    """Integral of ``f`` (an expression in ``x``) from zero to ``upper``."""
    body = f.replace("{x}", f"(i*({upper})/{steps}.0)")
    return (f"(list_sum(list_transform(range(0,{steps + 1}), lambda i: "
            f"(CASE WHEN i=0 OR i={steps} THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END) * {body})) * ({upper})/{steps * 3}.0)")


def t_two_sided(t: str, df: str) -> str:
    density = (f"exp(lgamma((({df})+1)/2.0)-lgamma(({df})/2.0))/sqrt(({df})*pi())"
               f"*pow(1+{{x}}*{{x}}/({df}), -(({df})+1)/2.0)")
    return f"(1 - 2*{simpson(density, f'abs({t})')})"


def normal_two_sided(z: str) -> str:
    return f"(1 - 2*{simpson('exp(-0.5*{x}*{x})/sqrt(2*pi())', f'abs({z})')})"


def normal_quantile(p: str) -> str:
    """Newton's method from zero on the integral of the density."""
    density = "exp(-0.5*acc*acc)/sqrt(2*pi())"
    step = f"acc - (0.5 + {simpson('exp(-0.5*{x}*{x})/sqrt(2*pi())', 'acc', 1000)} - ({p}))/({density})"
    return f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(0,12), lambda k: k::DOUBLE)), lambda acc, k: {step})"


def boot_weight(seed: int, key: str) -> str:
    return poisson(f"(('0x'||substr(md5('{seed}:'||(b//4)||':'||{key}),(1+8*(b%4))::INTEGER,8))::BIGINT/4294967296.0)")


def adjusted(source: str, family: str, p: str = "p_value") -> str:
    """Benjamini-Hochberg over ``source`` by the step-up definition."""
    return (f"SELECT *, least(1.0, min({p}*m/r) OVER (PARTITION BY {family} ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q_value_fdr "
            f"FROM (SELECT *, row_number() OVER (PARTITION BY {family} ORDER BY {p}) AS r, count(*) OVER (PARTITION BY {family}) AS m FROM {source})")


def roc(source: str, by: str, score: str, label: str) -> str:
    w = f"(PARTITION BY {by} ORDER BY {score} DESC)"
    return f"""SELECT {by}, {score} AS threshold, fp/nn AS fpr, 1.0 - tp/pp AS fnr FROM (
      SELECT *, sum(pos) OVER {w} AS tp, sum(neg) OVER {w} AS fp, lead(pos) OVER {w} AS lp, lead(neg) OVER {w} AS ln,
        row_number() OVER {w} AS rn, sum(pos) OVER (PARTITION BY {by}) AS pp, sum(neg) OVER (PARTITION BY {by}) AS nn
      FROM (SELECT {by}, {score}, sum({label}) AS pos, sum(1-{label}) AS neg FROM {source} GROUP BY ALL))
      WHERE rn=1 OR lp IS NULL OR lp<>pos OR ln<>neg"""


def eer(points: str, by: str) -> str:
    return (f"SELECT {by}, (fpr+fnr)/2 AS eer, threshold FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY {by} ORDER BY abs(fnr-fpr), threshold DESC) AS rk FROM {points}) WHERE rk=1")


def mcc(tp="tp", tn="tn", fp="fp", fn="fn") -> str:
    den = f"(sqrt({tp}+{fp})*sqrt({tp}+{fn})*sqrt({tn}+{fp})*sqrt({tn}+{fn}))"
    return f"CASE WHEN {den}=0 THEN 0.0 ELSE ({tp}::DOUBLE*{tn}-{fp}::DOUBLE*{fn})/{den} END"


def quadrant(pred: str) -> str:
    return (f"CASE WHEN ground_truth=1 AND {pred} THEN 'TP' WHEN ground_truth=0 AND NOT {pred} THEN 'TN' "
            f"WHEN ground_truth=0 THEN 'FP' ELSE 'FN' END")


def average_rank(by: str, value: str) -> str:
    return (f"(rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1)/2.0)")


def correlations(source: str) -> str:
    """Within-class rank correlations of every band column with both scores."""
    long = " UNION ALL ".join(
        f"SELECT '{d}' AS detector, sample_id, ground_truth, p_spoof_{d} AS p, '{f}' AS feature, {f} AS value FROM {source}"
        for d in V.DETECTORS for f in FEATURES)
    return f"""SELECT detector, feature, CASE WHEN ground_truth=1 THEN 'spoof' ELSE 'bonafide' END AS class, corr(rx,ry) AS rho, count(*) AS n
      FROM (SELECT *, {average_rank('detector,ground_truth,feature', 'value')} AS rx, {average_rank('detector,ground_truth,feature', 'p')} AS ry FROM ({long}))
      GROUP BY detector, feature, ground_truth"""


def quadrant_rows(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT sample_id, '{d}' AS detector, quadrant_{d} AS quadrant, '{f}' AS feature, {f} AS value FROM {source}"
        for d in V.DETECTORS for f in FEATURES)


VIEWS |= {
    "scores_long": (("scored",), " UNION ALL ".join(
        f"SELECT sample_id, ground_truth, '{d}' AS detector, p_spoof_{d} AS score FROM scored" for d in V.DETECTORS)),
    "points": (("scores_long",), roc("scores_long", "detector", "score", "ground_truth")),
    "eers": (("points",), eer("points", "detector")),
    "master": (("featured", "eers"), "SELECT f.* EXCLUDE (samples), "
        + ", ".join(f"(p_spoof_{d} >= {d}.threshold)::INTEGER AS pred_{d}, {quadrant(f'p_spoof_{d} >= {d}.threshold')} AS quadrant_{d}"
                    for d in V.DETECTORS)
        + " FROM featured f, (SELECT threshold FROM eers WHERE detector='zs') zs, (SELECT threshold FROM eers WHERE detector='ad') ad"),
    "correlations": (("master",), correlations("master")),
    "quadrant_rows": (("master",), quadrant_rows("master")),
    "strengths": (("correlations",), f"""
        SELECT detector, band, max(abs(rho)) AS strength, arg_max(rho, abs(rho)) AS signed FROM (
          SELECT *, regexp_extract(feature,'band([0-9]+)_',1)::INTEGER - 1 AS band FROM correlations) GROUP BY ALL"""),
    # Symmetric Hann window, frames of a signal padded by half a window on both sides.
    "hann": ((), "SELECT n::INTEGER AS n, 0.5-0.5*cos(2*pi()*n/15.0) AS w FROM range(0,16) r(n)"),
    "cover": (("hann",), "SELECT m*8+n AS pos, sum(w) AS c FROM hann, range(0,9) r(m) GROUP BY ALL"),
    "framed": (("signals", "hann", "cover"), f"""
        SELECT s.sample_id, m::INTEGER AS m, h.n, c.pos, c.c,
          CASE WHEN c.pos BETWEEN 8 AND 71 THEN samples[c.pos-7] ELSE 0 END AS x, h.w,
          CASE WHEN c.pos BETWEEN 8 AND 71 THEN ({weights(2)})[c.pos-7] ELSE 0 END AS lin
        FROM signals s, range(0,9) r(m), hann h JOIN cover c ON c.pos = m*8+h.n"""),
    "stft": (("framed",), """
        SELECT sample_id, m, k, sum(x*w*cos(2*pi()*k*n/16.0)) AS re, -sum(x*w*sin(2*pi()*k*n/16.0)) AS im
        FROM framed, range(0,9) r(k) GROUP BY ALL"""),
    "bin_band": (("edges",), """
        SELECT k, greatest(0, least(3, (SELECT count(*) FROM edges WHERE lo <= k*4.0) + (k*4.0 >= (SELECT max(hi) FROM edges))::INTEGER - 1))::INTEGER AS band FROM range(0,9) r(k)"""),
    # Logit of the part of a signal that one band holds, for the two linear scorers.
    "band_logits": (("stft", "bin_band", "hann", "cover"), f"""
        SELECT s.sample_id, b.band,
          sum(v * ({weights(1)})[pos-7]) AS l1, sum(v * ({weights(2)})[pos-7]) AS l2 FROM (
            SELECT s.sample_id, s.k, c.pos, (CASE WHEN s.k IN (0,8) THEN 1 ELSE 2 END)/16.0/c.c
              * (s.re*cos(2*pi()*s.k*h.n/16.0) - s.im*sin(2*pi()*s.k*h.n/16.0)) AS v
            FROM stft s, hann h JOIN cover c ON c.pos = s.m*8+h.n WHERE c.pos BETWEEN 8 AND 71) s
          JOIN bin_band b ON s.k = b.k GROUP BY ALL"""),
    "band_drops": (("band_logits",), """
        SELECT sample_id, band,
          round(1/(1+exp(-t1)), 9) - round(1/(1+exp(-(t1-l1))), 9) AS drop_zs,
          round(1/(1+exp(-t2)), 9) - round(1/(1+exp(-(t2-l2))), 9) AS drop_ad
        FROM (SELECT *, sum(l1) OVER (PARTITION BY sample_id) AS t1, sum(l2) OVER (PARTITION BY sample_id) AS t2 FROM band_logits)"""),
    "freq_relevance": (("signals",), f"""
        WITH t AS (SELECT sample_id, k, i, samples[i+1] AS x, CASE WHEN abs(samples[i+1])>1e-9 THEN ({weights(2)})[i+1] ELSE 0 END AS g
            FROM signals, range(0,33) a(k), range(0,64) b(i)),
          s AS (SELECT sample_id, k, sum(x*cos(2*pi()*k*i/64.0)) AS xr, -sum(x*sin(2*pi()*k*i/64.0)) AS xi,
            sum(g*cos(2*pi()*k*i/64.0)) AS gr, -sum(g*sin(2*pi()*k*i/64.0)) AS gi FROM t GROUP BY ALL)
        SELECT sample_id, k, (CASE WHEN k IN (0,32) THEN 1 ELSE 2 END)*(xr*gr+xi*gi)/64.0 AS r FROM s"""),
    "tf_relevance": (("framed",), """
        WITH t AS (SELECT sample_id, m, n, x*w AS xw, CASE WHEN abs(x*w)>1e-9 THEN (x*lin*w/c)/(x*w) ELSE 0 END AS g FROM framed),
          s AS (SELECT sample_id, m, k, sum(xw*cos(2*pi()*k*n/16.0)) AS xr, -sum(xw*sin(2*pi()*k*n/16.0)) AS xi,
            sum(g*cos(2*pi()*k*n/16.0)) AS gr, -sum(g*sin(2*pi()*k*n/16.0)) AS gi FROM t, range(0,9) r(k) GROUP BY ALL)
        SELECT sample_id, m, k, (CASE WHEN k IN (0,8) THEN 1 ELSE 2 END)*(xr*gr+xi*gi)/16.0 AS r, sqrt(xr*xr+xi*xi) AS mag FROM s"""),
}
