"""Bootstrap intervals (D35, D36) with Poisson weights.

Each row enters replicate ``b`` as often as a Poisson(1) draw from its hash: one md5 of
(seed, b div 4, row key) gives the draws of four replicates.  A row is repeated once for each four
replicates, which are summed side by side map-side, so only ``groups x replicates`` sums are shuffled,
for medians times a few dozen value ranges; no row is ever looked up by index.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions.keys import hex_number, md5_key, poisson_of_digits, poisson_weight
from corpuslens.operators.order import join_groups
from corpuslens.session import freeze, spread

#: Replicates whose draws one hash gives.
DRAWS = 4
_SPAN = 4294967296.0


def _draws(digest: Column) -> list[Column]:
    """The uniform draws that a hash gives, in [0, 1)."""
    return [hex_number(F.substring(digest, 1 + 8 * i, 8)) / F.lit(_SPAN) for i in range(DRAWS)]


def with_weights(df: DataFrame, key: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """Add ``_weights``, one integer per replicate, drawn once per row before it is unpivoted."""
    digests = F.transform(F.sequence(F.lit(0), F.lit((n_boot - 1) // DRAWS)), lambda q: md5_key(F.lit(str(seed)), q, *key))
    draws = F.flatten(F.transform(digests, lambda h: F.array(*_draws(h))))
    return spread(df, *key).withColumn("_weights", F.transform(F.slice(draws, 1, n_boot), poisson_weight))


def replicates(df: DataFrame, key: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """Rows times replicates with an integer weight; rows of weight zero are kept out.

    Weights already drawn by :func:`with_weights` are used as they are.
    """
    if "_weights" in df.columns:
        rows = df.select(*[c for c in df.columns if c != "_weights"],
                         F.posexplode("_weights").alias("_b", "_w"))
    else:
        hashed = spread(df, *key).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // DRAWS)))).withColumn(
            "_h", md5_key(F.lit(str(seed)), "_q", *key))
        rows = hashed.select(*df.columns, "_q", F.posexplode(F.array(*_draws(F.col("_h")))).alias("_i", "_u"))
        rows = rows.select(*df.columns, (F.col("_q") * DRAWS + F.col("_i")).alias("_b"), poisson_weight(F.col("_u")).alias("_w"))
        rows = rows.filter(F.col("_b") < n_boot)
    return rows.filter(F.col("_w") > 0)


def replicate_sums(df: DataFrame, by: Sequence[str], sums: Mapping[str, Column], key: Sequence[str], n_boot: int, seed: int, *,
                   shared: bool = False) -> DataFrame:
    """Per group and replicate ``_b`` the sum of weights ``_m`` and of weighted values, the same as sums over
    :func:`replicates`.

    ``shared``: a few rows of different groups have one key; they are gathered first, so that a key is drawn
    once for all of them.
    """
    names = list(sums)
    rows = df.select(*by, *key, *[value.alias(f"_v{j}") for j, value in enumerate(sums.values())])
    rest = [c for c in rows.columns if c not in key]
    rows = spread(rows, *key)
    if shared:
        rows = rows.groupBy(*key).agg(F.collect_list(F.struct(*rest)).alias("_rows"))
        rest = ["_rows"]
    rows = rows.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // DRAWS)))).select(
        *rest, "_q", md5_key(F.lit(str(seed)), "_q", *key).alias("_h"))
    rows = rows.select(*rest, "_q", *[F.substring("_h", 1 + 8 * i, 8).alias(f"_d{i}") for i in range(DRAWS)])
    drawn = [f"_w{i}" for i in range(DRAWS)]
    rows = rows.select(*rest, "_q", *[poisson_of_digits(F.col(f"_d{i}")).alias(w) for i, w in enumerate(drawn)])
    if shared:
        rows = rows.select("_q", *drawn, F.explode("_rows").alias("_row")).select("_q", *drawn, "_row.*")
    own = [F.sum(w).alias(f"_m{w}") for w in drawn]
    # A row that is not drawn adds nothing, whatever its value.
    own += [F.sum(F.when(F.col(w) > 0, F.col(f"_v{j}") * F.col(w))).alias(f"_s{w}_{j}") for w in drawn for j in range(len(names))]
    blocks = rows.groupBy(*by, "_q").agg(*own)
    cells = F.array(*[F.struct(
        (F.col("_q") * DRAWS + i).alias("_b"), F.col(f"_m{w}").alias("_m"),
        *[F.col(f"_s{w}_{j}").alias(name) for j, name in enumerate(names)]) for i, w in enumerate(drawn)])
    return blocks.select(*by, F.explode(cells).alias("_c")).select(*by, "_c.*").filter((F.col("_b") < n_boot) & (F.col("_m") > 0))


def _bounds(alpha: float) -> Column:
    return F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))


def mean_ci(df: DataFrame, by: Sequence[str], values: Sequence[str], key: Sequence[str], *,
            n_boot: int = 1000, alpha: float = 0.05, seed: int = 42,
            name: str = "column", shared: bool = False) -> DataFrame:
    """Mean and percentile interval of several columns at once.

    All columns of a row share its weights.  Groups with fewer than two rows get the mean
    as both bounds.  ``shared`` tells that a key has a few rows in different groups.
    """
    base = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[
        F.avg(v).alias(f"_m_{i}") for i, v in enumerate(values)])
    reps = replicate_sums(df, by, {f"_r_{i}": F.col(v) for i, v in enumerate(values)}, key, n_boot, seed, shared=shared)
    reps = reps.select(*by, *[(F.col(f"_r_{i}") / F.col("_m")).alias(f"_r_{i}") for i in range(len(values))])
    bounds = reps.groupBy(*by).agg(*[
        F.percentile(f"_r_{i}", _bounds(alpha)).alias(f"_q_{i}") for i in range(len(values))])
    joined = join_groups(base, bounds, by, "left")
    few = F.col("n") < 2
    cells = F.array(*[F.struct(
        F.lit(v).alias(name), F.col(f"_m_{i}").alias("mean"),
        F.when(few | F.col(f"_q_{i}").isNull(), F.col(f"_m_{i}")).otherwise(F.col(f"_q_{i}")[0]).alias("ci_low"),
        F.when(few | F.col(f"_q_{i}").isNull(), F.col(f"_m_{i}")).otherwise(F.col(f"_q_{i}")[1]).alias("ci_high"))
        for i, v in enumerate(values)])
    return joined.select(*by, "n", F.explode(cells).alias("c")).select(*by, "c.*", "n")


#: Quantiles that part the values into ranges, closest around the median, where its replicates lie.
_STEPS = [m * 10.0 ** -e for e in range(1, 6) for m in (5, 2, 1) if m * 10.0 ** -e < 0.5]
RANGES = sorted([0.5 - s for s in _STEPS] + [0.5] + [0.5 + s for s in _STEPS])
ACCURACY = 100_000


def median_ci(df: DataFrame, by: Sequence[str], value: str, key: Sequence[str], *,
              n_boot: int = 1000, alpha: float = 0.05, seed: int = 42, shared: bool = False) -> DataFrame:
    """Percentile interval of the median: exact weighted medians per replicate.

    First the weights of each replicate are summed per value range, map-side, which tells the range
    that holds its median.  Only the rows of such ranges are drawn again, for those replicates alone,
    and sorted within range and replicate.  The ranges narrow towards the median, so for n rows these
    are about the square root of n rows for each replicate; where the cut points lie changes no result.
    Null values are left out.  ``shared`` tells that a key has a few rows in different groups.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.struct(*by).alias("_g") if by else F.lit(0).alias("_g"), *key, F.col(value).alias("_v"))
    cuts = rows.groupBy("_g").agg(F.array_sort(F.array_distinct(F.percentile_approx(
        "_v", F.array(*[F.lit(q) for q in RANGES]), ACCURACY))).alias("_cuts"))
    # Frozen: a second run of the approximation must not move the cut points between the two passes.
    ranged = rows.join(freeze(cuts), "_g").withColumn("_at", F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))).drop("_cuts")
    masses = replicate_sums(ranged, ["_g", "_at"], {}, key, n_boot, seed, shared=shared)
    upto = Window.partitionBy("_g", "_b").orderBy("_at")
    masses = masses.select("_g", "_b", "_at", (F.sum("_m").over(upto) - F.col("_m")).alias("_before"), F.col("_m"),
                           F.sum("_m").over(Window.partitionBy("_g", "_b")).alias("_all"))
    # The median is the mean of two places, equal for an odd mass; each lies in one range.
    sides = F.explode(F.array(F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)))
    wanted = masses.select("_g", "_b", "_at", "_before", "_m", sides.alias("_place")).filter(
        (F.col("_place") >= F.col("_before")) & (F.col("_place") < F.col("_before") + F.col("_m")))
    asked = freeze(wanted.groupBy("_g", "_at").agg(F.collect_set(F.struct("_b", (F.col("_place") - F.col("_before")).alias("place"))).alias("_asked")))
    # Few rows, each asked for by many replicates: they are dealt over all slots before they are drawn.
    drawn = spread(ranged.join(asked, ["_g", "_at"]), *key).select("_g", "_at", *key, "_v", F.explode("_asked").alias("_a"))
    drawn = drawn.select("_g", "_at", "_v", F.col("_a._b").alias("_b"), F.col("_a.place").alias("_place"), *key)
    digest = md5_key(F.lit(str(seed)), F.floor(F.col("_b") / DRAWS), *key)
    drawn = drawn.withColumn("_h", digest).withColumn("_d", F.substring("_h", 1 + 8 * (F.col("_b") % DRAWS), F.lit(8)))
    counted = drawn.withColumn("_w", poisson_of_digits(F.col("_d"))).filter(F.col("_w") > 0).groupBy(
        "_g", "_b", "_at", "_place", "_v").agg(F.sum("_w").alias("_w"))
    inside = Window.partitionBy("_g", "_b", "_at", "_place").orderBy("_v")
    found = counted.withColumn("_end", F.sum("_w").over(inside)).filter(
        (F.col("_place") < F.col("_end")) & (F.col("_place") >= F.col("_end") - F.col("_w")))
    # A replicate of odd mass asks for one place only, as a set holds it once.
    medians = found.groupBy("_g", "_b").agg(F.avg("_v").alias("_median"))
    bounds = medians.groupBy("_g").agg(F.percentile("_median", _bounds(alpha)).alias("_q"))
    return bounds.select(*[F.col(f"_g.`{c}`").alias(c) for c in by], F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))


def pooled_effect(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Standardised mean difference with pooled variance; null below two rows per side."""
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    return F.when((n1 >= 2) & (n2 >= 2) & (pooled > 0), (m1 - m2) / pooled)


def log2_spread_ratio(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    return F.when((n1 >= 2) & (n2 >= 2) & (v1 > 0) & (v2 > 0), F.log2(F.sqrt(v1) / F.sqrt(v2)))


def two_sample_ci(df: DataFrame, by: Sequence[str], side: str, left: str, right: str, value: str,
                  key: Sequence[str], statistic, *, n_boot: int = 1000, alpha: float = 0.05,
                  seed: int = 42) -> DataFrame:
    """Interval of a statistic of two groups from replicate moments."""
    drawn = ["_weights"] if "_weights" in df.columns else []
    reps = replicates(df.select(*by, side, *key, value, *drawn), key, n_boot, seed)
    w, x = F.col("_w"), F.col(value)
    aggs = []
    for tag, name in (("l", left), ("r", right)):
        on = F.col(side) == name
        aggs += [F.sum(F.when(on, w)).alias(f"_n{tag}"), F.sum(F.when(on, w * x)).alias(f"_s{tag}"),
                 F.sum(F.when(on, w * x * x)).alias(f"_q{tag}")]
    sums = reps.groupBy(*by, "_b").agg(*aggs)

    def moments(tag: str):
        n, s, q = F.col(f"_n{tag}"), F.col(f"_s{tag}"), F.col(f"_q{tag}")
        return n, s / n, F.when(n > 1, (q - s * s / n) / (n - 1))

    stat = sums.withColumn("_stat", statistic(*moments("l"), *moments("r")))
    bounds = F.percentile("_stat", _bounds(alpha))
    return stat.groupBy(*by).agg(bounds.alias("_q")).select(
        *by, F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))
