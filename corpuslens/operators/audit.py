"""Audit of a processed manifest."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.operators.order import exact_quantiles, join_groups
from corpuslens.operators.rules import is_finite
from corpuslens.profiles import Profile

# Dimensions of the count tables and their display names.
DIMENSIONS = {"split": "split", "label": "label", "spk_id": "speaker", "attack_id": "attack"}


def grouping_counts(df: DataFrame) -> DataFrame:
    """All fifteen count tables of four dimensions in one cube.

    ``counted`` names the joined dimensions of a row's table; the other dimensions are null.
    """
    dims = list(DIMENSIONS)
    cube = df.cube(*dims).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("count"))
    used = [F.when(F.col("_g").bitwiseAND(1 << (len(dims) - 1 - i)) == 0, F.lit(DIMENSIONS[d]))
            for i, d in enumerate(dims)]
    return cube.filter(F.col("_g") < (1 << len(dims)) - 1).select(
        F.concat_ws("_", *used).alias("counted"),
        *[F.col(d).alias(DIMENSIONS[d]) for d in dims], "count")


def structured_counts(df: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """Counts of several dimension tuples in long form, nulls kept as a group.

    A tuple with a column the table lacks gives no rows.  All tuples share one pass.
    """
    wanted = [list(dims) for dims in groups if all(d in df.columns for d in dims)]
    if not wanted:
        return df.sparkSession.createDataFrame([], "counted string, value string, count long")
    columns = list(dict.fromkeys(d for dims in wanted for d in dims))
    counts = df.groupingSets(wanted, *columns).agg(F.grouping_id(*columns).alias("_g"), F.count(F.lit(1)).alias("count"))
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for dims in wanted:
        bits = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in dims)
        here = F.col("_g") == bits
        name = F.when(here, "_".join(dims)).otherwise(name)
        value = F.when(here, F.concat_ws("|", *[
            F.coalesce(F.col(d).cast("string"), F.lit("<null>")) for d in dims])).otherwise(value)
    return counts.select(name.alias("counted"), value.alias("value"), "count")


def group_counts(df: DataFrame, column: str = "source_group_id") -> DataFrame:
    """Rows per non-empty source group (D3)."""
    return _grouped_rows(df, column).groupBy(column).count()


def _grouped_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.coalesce(F.col(column), F.lit("")) != "")


def members_of_repeated(df: DataFrame, column: str, *members: str) -> DataFrame:
    """Every row whose value occurs at least twice, with that count.

    The count is a partial aggregation and only repeated values go into the join, so a
    value shared by a third of the rows costs one row on the counted side; the adaptive
    join splits the other side.
    """
    repeated = df.groupBy(column).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return df.select(column, *members).join(repeated, column)


def duplicate_groups(df: DataFrame, *members: str) -> DataFrame:
    return members_of_repeated(_grouped_rows(df, "source_group_id"), "source_group_id", *members)


def cross_split_groups(df: DataFrame, profile: Profile, column: str = "source_group_id") -> DataFrame:
    """Groups that reach several splits, splits in canonical order."""
    return _split_sets(_grouped_rows(df, column), column, profile).filter(
        F.size("_in") > 1).select(column, F.array_join("_in", ",").alias("splits"))


def _split_sets(df: DataFrame, column: str, profile: Profile) -> DataFrame:
    """The splits of each value, in profile order.  The splits are few and fixed."""
    flags = [F.max(F.when(F.col("split") == s, F.lit(s))) for s in profile.splits]
    return df.groupBy(column).agg(F.array_compact(F.array(*flags)).alias("_in"))


def cross_split_speakers(df: DataFrame, profile: Profile, column: str = "spk_id") -> DataFrame:
    """Ordered pairs of splits that share a speaker.

    The pairs come from the fixed list of splits, not from a self-join of rows.
    """
    pairs = [F.when(F.array_contains("_in", l) & F.array_contains("_in", r),
                    F.struct(F.lit(l).alias("left_split"), F.lit(r).alias("right_split")))
             for l, r in combinations(profile.splits, 2)]
    return (_split_sets(df, column, profile)
            .select(column, F.explode(F.array_compact(F.array(*pairs))).alias("p"))
            .select("p.left_split", "p.right_split", column))


def missing_values(df: DataFrame, members: Sequence[str] = ("utt_id", "split")) -> DataFrame:
    """One row per null cell (D7).  An empty string is a value."""
    cells = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in df.columns]))
    return df.select(F.explode(cells).alias("column"), *members)


def distributions(df: DataFrame, measures: Sequence[str], by: Sequence[str] = ("split", "label"),
                  buckets: int | None = None) -> DataFrame:
    """Moments and exact quartiles of every measure per group.

    Non-finite values are left out of the statistics and counted.
    """
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
        for m in measures])).alias("m")).select(*by, "m.measure", "m.value")
    v = F.when(is_finite(F.col("value")), F.col("value"))
    keys = ["measure", *by]
    moments = long.groupBy(*keys).agg(
        F.count(v).alias("count"), (F.count(F.lit(1)) - F.count(v)).alias("missing_or_nonfinite"),
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"))
    quartiles = exact_quantiles(long.withColumn("value", v), keys, "value",
                                {"p25": 0.25, "median": 0.5, "p75": 0.75}, buckets=buckets)
    return join_groups(moments, quartiles, keys, "left")


def audit_summary(df: DataFrame, profile: Profile, hash_column: str = "sha256_source") -> DataFrame:
    """Size of every audit table, one row each."""
    def n(name: str, part: DataFrame) -> DataFrame:
        return part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("report"), "n")

    parts = [n("samples", df), n("cross_split_speakers", cross_split_speakers(df, profile)),
             n("duplicate_hash_members", members_of_repeated(df, hash_column)),
             n("missing_values", missing_values(df)),
             n("cross_split_source_groups", cross_split_groups(df, profile)),
             n("duplicate_source_group_members", duplicate_groups(df))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def class_counts(df: DataFrame, splits: Sequence[str] = ("train", "dev"),
                 labels: Sequence[str] = ("generated", "pristine")) -> DataFrame:
    """Rows per split and label, completed with zeros."""
    grid = df.sparkSession.createDataFrame([(s, l) for s in splits for l in labels],
                                           "split string, label string")
    have = df.groupBy("split", "label").count()
    return grid.join(have, ["split", "label"], "left").na.fill(0, ["count"])


def canonical_order(df: DataFrame, profile: Profile) -> DataFrame:
    """Split order of the profile, then label, then id."""
    return df.orderBy(profile.split_order(F.col("split")), "label", "utt_id")
