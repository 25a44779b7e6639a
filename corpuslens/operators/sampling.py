"""Deterministic sampling (E3-E15): every draw is an order by hash, so it can be repeated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions.keys import key_uniform, md5_key
from corpuslens.operators.order import attach_row, hash_positions, join_groups


def draw_key(seed: int, *key: str) -> Column:
    return md5_key(F.lit(str(seed)), *key)


def up_to(df: DataFrame, strata: Sequence[str], key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows of each stratum by hash order."""
    return hash_positions(df, strata, draw_key(seed, *key), "_pos", limit=n).drop("_pos")


def balanced(df: DataFrame, label: str, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows per class with their shuffled position."""
    picked = up_to(df, [label], key, n, seed).withColumn("_one", F.lit(0))
    return hash_positions(picked, ["_one"], draw_key(seed + 1, *key), "position").drop("_one")


def halves(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Disjoint random halves: 0 holds floor(n/2) rows, 1 the rest."""
    placed = hash_positions(df.withColumn("_one", F.lit(0)), ["_one"], draw_key(seed, *key), "_pos")
    total = df.agg(F.floor(F.count(F.lit(1)) / 2).alias("_half"))
    return attach_row(placed, total).withColumn(
        "half", F.when(F.col("_pos") <= F.col("_half"), 0).otherwise(1)).drop("_pos", "_half", "_one")


def stratified_folds(df: DataFrame, label: str, key: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Fold number per row, balanced inside each class."""
    placed = hash_positions(df, [label], draw_key(seed, *key), "_pos")
    return placed.withColumn("fold", F.pmod(F.col("_pos") - 1, F.lit(k)).cast("int")).drop("_pos")


def holdout(df: DataFrame, key: Sequence[str], share: float = 0.3, seed: int = 42) -> DataFrame:
    """Train or held-out by a hash threshold."""
    return df.withColumn("part", F.when(key_uniform(draw_key(seed, *key)) < share, "test").otherwise("train"))


def rare_first_quotas(df: DataFrame, label: str, quadrant: str, per_class: int) -> DataFrame:
    """Rows to take per (class, quadrant): the rarer takes up to half, the other the rest.

    Two counted rows per class; equal counts keep the error quadrant first.
    """
    counts = df.groupBy(label, quadrant).agg(F.count(F.lit(1)).alias("_n"))
    err = F.when(F.col(quadrant).isin("FN", "FP"), 0).otherwise(1)
    both = counts.groupBy(label).agg(F.array_sort(F.collect_list(F.struct(
        F.col("_n").alias("n"), err.alias("e"), F.col(quadrant).alias("q")))).alias("_g"))
    # With one quadrant absent its pool is empty and the other may take the whole quota.
    first, second = F.get("_g", F.lit(0)), F.get("_g", F.lit(1))
    lone = second.isNull()
    take1 = F.when(lone, F.least(first["n"], F.lit(per_class))).otherwise(
        F.least(first["n"], F.floor(F.lit(per_class) / 2)))
    take2 = F.least(second["n"], F.lit(per_class) - take1)
    cells = F.array_compact(F.array(
        F.struct(first["q"].alias("q"), take1.cast("bigint").alias("quota")),
        F.when(~lone, F.struct(second["q"].alias("q"), take2.cast("bigint").alias("quota")))))
    return both.select(label, F.explode(cells).alias("c")).select(
        label, F.col("c.q").alias(quadrant), "c.quota")


def rare_first(df: DataFrame, label: str, quadrant: str, key: Sequence[str], per_class: int,
               seed: int = 42) -> DataFrame:
    """Stratified selection with rare-first quotas."""
    quotas = rare_first_quotas(df, label, quadrant, per_class)
    placed = hash_positions(df, [label, quadrant], draw_key(seed, *key), "_pos", limit=per_class)
    return join_groups(placed, quotas, [label, quadrant]).filter(
        F.col("_pos") <= F.col("quota")).drop("_pos", "quota")


def confident_per_quadrant(df: DataFrame, label: str, score: str, key: str, n: int,
                           cut: float = 0.5) -> DataFrame:
    """Per quadrant at ``cut`` the ``n`` rows furthest on the predicted side (E5).

    The rank limit is pushed below the shuffle, so each task sends at most ``n`` rows per quadrant.
    """
    from corpuslens.functions.signal import quadrant
    pred = (F.col(score) > cut).cast("int")
    rows = df.withColumn("quadrant", quadrant(F.col(label), pred))
    order = F.when(pred == 1, -F.col(score)).otherwise(F.col(score))
    w = Window.partitionBy("quadrant").orderBy(order, key)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def most_confident(df: DataFrame, quadrant: str, score: str, key: str) -> DataFrame:
    """One row per quadrant: highest score where predicted positive, else lowest."""
    positive = F.col(quadrant).isin("TP", "FP")
    order = F.struct(F.when(positive, -F.col(score)).otherwise(F.col(score)).alias("o"), F.col(key).alias("k"))
    return df.groupBy(quadrant).agg(F.min_by(key, order).alias(key), F.min_by(score, order).alias(score))


def extreme_examples(df: DataFrame, key: str, score: str, n: int, step: int) -> DataFrame:
    """Evenly spaced pool by id order, then the most extreme scores at both ends."""
    from corpuslens.operators.order import prefix_sums
    placed = prefix_sums(df.withColumn("_one", F.lit(0)), ["_one"], key, {"_at": F.lit(1)})
    pool = placed.filter(F.pmod(F.col("_at"), F.lit(step)) == 0)
    up = (n + 1) // 2
    high = pool.orderBy(F.col(score).desc(), key).limit(up).withColumn("end", F.lit("high"))
    low = pool.orderBy(F.col(score), key).limit(n - up).withColumn("end", F.lit("low"))
    return high.unionByName(low).select(key, score, "end")


# --- bands of one clip, inside the row --------------------------------------------------------

def ranked_bands(relevance: Column, predicted_positive: Column) -> Column:
    """Bands from most to least relevant, oriented by the predicted class."""
    signed = F.transform(relevance, lambda v, i: F.struct(
        F.when(predicted_positive, -v).otherwise(v).alias("v"), i.alias("i")))
    return F.transform(F.array_sort(signed), lambda s: s["i"])


def random_bands(n_bands: int, k: Column, *key: Column | str) -> Column:
    """``k`` bands by hash order of the key."""
    everything = F.array(*[F.lit(i) for i in range(n_bands)])
    keyed = F.transform(everything, lambda i: F.struct(md5_key(*key, i).alias("h"), i.alias("i")))
    return F.slice(F.transform(F.array_sort(keyed), lambda s: s["i"]), F.lit(1), k)


def complement(n_bands: int, bands: Column) -> Column:
    """The other bands."""
    return F.array_except(F.array(*[F.lit(i) for i in range(n_bands)]), bands)


def top_and_bottom(strength: DataFrame, k: int) -> DataFrame:
    """Per detector the k strongest and k weakest bands; bands without a value count as weakest."""
    s = F.coalesce("strength", F.lit(float("-inf")))
    top = Window.partitionBy("detector").orderBy(s.desc(), F.col("band").desc())
    low = Window.partitionBy("detector").orderBy(s, "band")
    return strength.withColumn("top_rank", F.row_number().over(top)).withColumn(
        "bottom_rank", F.row_number().over(low)).filter(
        (F.col("top_rank") <= k) | (F.col("bottom_rank") <= k))
