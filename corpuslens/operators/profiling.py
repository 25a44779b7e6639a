"""Metadata profiles (D10-D16).  Values of sensitive fields are never emitted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def counts_by_split(df: DataFrame) -> DataFrame:
    """Rows per split."""
    return df.groupBy("split").count()


def _cells(df: DataFrame, keep: Sequence[str], fields: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
                      for f in fields])
    return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.field", "c.value")


def value_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Value counts of categorical fields in long form."""
    return _cells(df, [], fields).groupBy("field", "value").count()


def length_statistics(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Count, least, mean and greatest length in code points."""
    n = F.length("value")
    return _cells(df, [], fields).groupBy("field").agg(
        F.count(n).alias("count"), F.min(n).alias("min_length"), F.avg(n).alias("mean_length"),
        F.max(n).alias("max_length"))


def numeric_statistics(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Statistics of digit strings, empties skipped."""
    v = F.col("value").try_cast("bigint")
    return _cells(df, [], fields).groupBy("field").agg(
        F.count(v).alias("non_missing_count"), F.min(v).alias("min"), F.avg(v).alias("mean"),
        F.max(v).alias("max"))


def field_profiles(df: DataFrame, fields: Sequence[str], *, length_fields: Sequence[str] = (),
                   vote_fields: Sequence[str] = (), descriptions: Mapping[str, str] | None = None,
                   approximate: bool = False) -> DataFrame:
    """One row per field: distinct (an empty string is a value), missing, nullable and the
    block of its class (D14).

    Distinct values are counted by two partial aggregations over (field, value), so one
    field with very many values is spread over all tasks; ``approximate`` uses a sketch.
    """
    cells = _cells(df, [], fields)
    v = F.col("value")
    is_len = F.col("field").isin(*length_fields) if length_fields else F.lit(False)
    is_vote = F.col("field").isin(*vote_fields) if vote_fields else F.lit(False)
    size, number = F.when(is_len, F.length("value")), F.when(is_vote, v.try_cast("bigint"))
    stats = dict(
        missing_count=F.count_if(v == ""),
        min_length=F.min(size), max_length=F.max(size), mean_length=F.avg(size),
        min=F.min(number), max=F.max(number), mean=F.avg(number), non_missing_count=F.count(number))
    base = cells.groupBy("field").agg(*[c.alias(n) for n, c in stats.items()])
    if approximate:
        distinct = cells.groupBy("field").agg(F.approx_count_distinct("value").alias("distinct_count"))
    else:
        # A missing cell counts as one value of its own.  Long values travel as their digest.
        short = F.when(F.length("value") <= 64, F.concat(F.lit("v"), F.col("value"))).otherwise(
            F.concat(F.lit("h"), F.sha2("value", 256)))
        distinct = cells.select("field", short.alias("_v")).distinct().groupBy("field").agg(F.count(F.lit(1)).alias("distinct_count"))
    out = base.join(distinct, "field").withColumn("nullable", F.col("missing_count") > 0)
    kind = F.when(is_len, "length").when(is_vote, "numeric").otherwise("categorical")
    out = out.withColumn("block", kind).withColumn(
        "non_missing_count", F.when(is_vote, F.col("non_missing_count")))
    for field, words in (descriptions or {}).items():
        if "description" not in out.columns:
            out = out.withColumn("description", F.lit(""))
        out = out.withColumn("description", F.when(F.col("field") == field, words).otherwise(F.col("description")))
    return out


def availability(df: DataFrame, column: str) -> DataFrame:
    """Resolved and missing file paths."""
    return df.agg(F.count_if(F.col(column) != "").alias("resolved_count"),
                  F.count_if(F.col(column) == "").alias("missing_count"))


def source_profile(df: DataFrame, source: str, categorical: Sequence[str], votes: Sequence[str] = (),
                   path: str | None = None) -> DataFrame:
    """Long source profile: sizes, split counts, distributions and vote quality."""
    src = F.lit(source).alias("source")
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(src, F.lit("sample_count").alias("block"), F.lit("").alias("field"),
                                                   F.lit("").alias("value"), "n"),
        counts_by_split(df).select(src, F.lit("split").alias("block"), F.lit("split").alias("field"),
                                   F.col("split").alias("value"), F.col("count").alias("n")),
        value_counts(df, categorical).select(src, F.lit("distribution").alias("block"), "field", "value",
                                             F.col("count").alias("n"))]
    if votes:
        filled = F.when(F.col("value") == "", "missing").otherwise("non_missing")
        parts.append(_cells(df, [], votes).groupBy("field", filled.alias("value")).count().select(
            src, F.lit("quality").alias("block"), "field", "value", F.col("count").alias("n")))
    if path:
        state = F.when(F.col(path) == "", "missing").otherwise("resolved")
        parts.append(df.groupBy(state.alias("value")).count().select(
            src, F.lit("availability").alias("block"), F.lit(path).alias("field"), "value", F.col("count").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def characteristic_matrix(df: DataFrame, sources: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Which source has which characteristic, and the field that holds it.

    The corpora are distinct: ``paired`` is always false.
    """
    names = sorted({c for fields in sources.values() for c in fields})
    rows = [(c, s, c in f, f.get(c), False) for c in names for s, f in sources.items()]
    return df.sparkSession.createDataFrame(
        rows, "characteristic string, source string, available boolean, field string, paired boolean")
