"""Distributed order statistics: prefix sums, ranks and exact quantiles.

A window over a whole class would put that class into one task.  Here the value
range is cut into buckets, bucket totals are summed by a small window, and only
the rows inside one bucket are ordered by a window of their own.  Equal values
are first collapsed into one counted row, so a hot value costs one row; where
rows must stay apart, a hot value is split further by a hash.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions.keys import key_number, md5_key
from corpuslens.session import default_buckets, freeze

MAX_BROADCAST_CUTS = 100_000


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the group columns, a null being a group like any other.

    The columns go into one struct, which is never null itself and whose null fields are equal, so the
    join is a plain equality on one key.
    """
    if not by:
        return left.join(F.broadcast(right), how=how)
    own = right.select(F.struct(*by).alias("_joined"), *[c for c in right.columns if c not in by])
    return left.withColumn("_joined", F.struct(*by)).join(own, "_joined", how).drop("_joined")


def _as_group(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The group columns as one non-null key ``_g``: nulls are groups, and every exchange hashes the same column."""
    key = F.struct(*by) if by else F.lit(0)
    return df.withColumn("_g", key).drop(*by)


def _group_columns(by: Sequence[str]) -> list[Column]:
    return [F.col(f"_g.`{c}`").alias(c) for c in by]


def _cut_points(df: DataFrame, value: str, buckets: int) -> tuple[DataFrame, bool]:
    """Per group, distinct approximate quantiles.  Their values only steer balance.

    Few groups: the cut points come to the driver (at most ``MAX_BROADCAST_CUTS``
    numbers) and become literal data.  Many groups: they are frozen in the shared folder.
    Either way both users of the cut points see the same numbers.
    """
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = df.groupBy("_g").agg(
        F.array_sort(F.array_distinct(F.percentile_approx(value, probs, buckets * 20))).alias("_cuts"))
    most = MAX_BROADCAST_CUTS // buckets
    head = edges.limit(most + 1).collect()
    if len(head) > most:
        return freeze(edges), False
    return df.sparkSession.createDataFrame(head, edges.schema), True


def _with_bucket(df: DataFrame, value: str, tie: str | None, buckets: int) -> DataFrame:
    edges, small = _cut_points(df, value, buckets)
    # Every step-th cut point first, then the few between two of them: about 2 * sqrt(buckets)
    # comparisons per row.
    step = max(2, math.isqrt(buckets))
    edges = edges.withColumn("_coarse_cuts", F.filter("_cuts", lambda e, i: i % step == 0))
    out = df.join(F.broadcast(edges) if small else edges, "_g", "left")
    v = F.col(value)
    out = out.withColumn("_cut_block", F.size(F.filter("_coarse_cuts", lambda e: e < v)))
    between = F.slice("_cuts", (F.greatest(F.col("_cut_block"), F.lit(1)) - 1) * step + 2, F.lit(step - 1))
    below = F.when(F.col("_cut_block") == 0, 0).otherwise(
        (F.col("_cut_block") - 1) * step + 1 + F.size(F.filter(between, lambda e: e < v)))
    out = out.withColumn("_cuts_below", below)
    on_cut = F.coalesce(F.get("_cuts", F.col("_cuts_below")) == v, F.lit(False))
    out = out.withColumn("_vb", F.col("_cuts_below") * 2 + F.when(on_cut, 1).otherwise(0))
    if tie is None:
        return out.withColumn("_hb", F.lit(0)).drop("_cuts", "_coarse_cuts", "_cut_block", "_cuts_below")
    split = F.when(on_cut, F.pmod(F.floor(F.col(tie) * buckets), F.lit(buckets))).otherwise(0)
    return out.withColumn("_hb", split.cast("int")).drop("_cuts", "_coarse_cuts", "_cut_block", "_cuts_below")


def _sum_before(df: DataFrame, bucket: Sequence[str], order: Sequence[Column], weights: Mapping[str, Column],
                following: Sequence[str], by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sum of each weight over all earlier rows of the group ``_g``, given a monotone bucket."""
    keyed = df
    for name, weight in weights.items():
        keyed = keyed.withColumn(f"_w_{name}", weight)
    ahead = F.struct(*[F.col(c) for c in following]) if following else F.lit(None)
    totals = keyed.groupBy("_g", *bucket).agg(
        *[F.sum(f"_w_{name}").alias(f"_t_{name}") for name in weights],
        *([F.min_by(ahead, order[0]).alias("_first")] if following else []))
    across = Window.partitionBy("_g").orderBy(*bucket)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_g")
    totals = totals.select(
        "_g", *bucket,
        *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_o_{name}") for name in weights],
        *[F.sum(f"_t_{name}").over(whole).alias(f"{name}_total") for name in weights],
        *([F.lead("_first").over(across).alias("_ahead")] if following else []))
    here = Window.partitionBy("_g", *bucket).orderBy(*order)
    inside = here.rowsBetween(Window.unboundedPreceding, -1)
    joined = keyed.join(totals, ["_g", *bucket])
    out = [*_group_columns(by), *[F.col(c) for c in columns if c not in by]]
    out += [(F.col(f"_o_{name}") + F.coalesce(F.sum(f"_w_{name}").over(inside), F.lit(0))).alias(name) for name in weights]
    out += [F.col(f"{name}_total") for name in weights]
    if following:
        out.append(F.coalesce(F.lead(ahead).over(here), F.col("_ahead")).alias("following"))
    return joined.select(*out)


def prefix_sums(df: DataFrame, by: Sequence[str], value: str, weights: Mapping[str, Column], *,
                tie: str | None = None, following: Sequence[str] = (),
                buckets: int | None = None) -> DataFrame:
    """Add, per weight, its sum over the rows of the group that come strictly before, and
    as ``<weight>_total`` its sum over the whole group.

    Order is by ``value`` and then by ``tie`` (a number in [0, 1)).  Without a tie
    column the values must be distinct inside a group.  ``following`` names columns
    whose values in the next row are added as one struct, null in the last row.
    """
    n = buckets or default_buckets(df.sparkSession)
    order = [F.col(value)] + ([F.col(tie)] if tie else [])
    grouped = _with_bucket(_as_group(df, by), value, tie, n)
    return _sum_before(grouped, ["_vb", "_hb"], order, weights, following, by, df.columns)


def average_ranks(df: DataFrame, by: Sequence[str], value: str, *, weight: str | None = None,
                  buckets: int | None = None) -> DataFrame:
    """One row per distinct value of a group: ``ties`` rows share the average ``rank``."""
    counts = df.groupBy(*by, value).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("ties"))
    ranked = prefix_sums(counts, by, value, {"_before": F.col("ties")}, buckets=buckets)
    rank = F.col("_before") + (F.col("ties") + 1) / F.lit(2.0)
    return ranked.withColumn("rank", rank).drop("_before", "_before_total")


def with_average_rank(df: DataFrame, by: Sequence[str], value: str, out: str, *,
                      buckets: int | None = None) -> DataFrame:
    """Attach the average rank of ``value`` inside its group to every row.

    The rank table is unique per (group, value); a hot value makes the row side
    skewed, which the adaptive join splits.
    """
    ranks = average_ranks(df, by, value, buckets=buckets).select(
        *by, value, F.col("rank").alias(out))
    return join_groups(df, ranks, [*by, value])


def hash_positions(df: DataFrame, by: Sequence[str], key: Column, out: str, *,
                   limit: int | None = None, buckets: int | None = None) -> DataFrame:
    """1-based position of every row in the order of a hex hash key inside its group.

    Hash keys are uniform, so equal slices of the key range are balanced whatever
    the group sizes are.  With ``limit`` whole slices beyond it are dropped early.
    """
    n = buckets or default_buckets(df.sparkSession)
    slice_of = F.floor(key_number(F.col("_key")) * F.lit(n) / F.lit(4294967296)).cast("int")
    keyed = _as_group(df.withColumn("_key", key).withColumn("_slice", slice_of), by)
    totals = keyed.groupBy("_g", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_g").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_o", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    if limit is not None:
        totals = totals.filter(F.col("_o") < limit)
    inside = Window.partitionBy("_g", "_slice").orderBy("_key")
    place = (F.col("_o") + F.row_number().over(inside)).alias(out)
    placed = keyed.join(totals, ["_g", "_slice"]).select(*_group_columns(by), *[c for c in df.columns if c not in by], place)
    placed = placed.select(*df.columns, out)
    return placed if limit is None else placed.filter(F.col(out) <= limit)


def ordinal_ranks(df: DataFrame, by: Sequence[str], value: str, key: Sequence[str], out: str, *,
                  buckets: int | None = None) -> DataFrame:
    """1-based ordinal rank by value, ties settled by the hash of ``key``."""
    keyed = df.withColumn("_tie", key_number(md5_key(*key)).cast("double") / F.lit(4294967296.0))
    placed = prefix_sums(keyed, by, value, {"_before": F.lit(1)}, tie="_tie", buckets=buckets)
    return placed.withColumn(out, F.col("_before") + 1).drop("_before", "_before_total", "_tie")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], *,
                    weight: str | None = None, buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per entry of ``probs``."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    if weight:
        counts = counts.filter(F.col("_c") > 0)
    placed = prefix_sums(counts, by, value, {"_pre": F.col("_c")}, buckets=buckets)
    aggs = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("_pre_total") - 1)
        for side, k in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            hit = (F.col("_pre") <= k) & (k < F.col("_pre") + F.col("_c"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}_{name}"))
    picked = placed.groupBy(*by).agg(F.max("_pre_total").alias("_n"), *aggs)
    out = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (spot - F.floor(spot))).alias(name))
    return picked.select(*by, *out)


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate (exactly one row) to every row."""
    return df.withColumn("_k", F.lit(0)).join(
        F.broadcast(one_row.withColumn("_k", F.lit(0))), "_k").drop("_k")
