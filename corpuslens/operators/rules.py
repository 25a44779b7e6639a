"""Constraint rules (B): every rule returns its violations as rows.

A violation is ``(rule, key, detail)``.  Rules are unioned, counted or asserted
by the caller; nothing stops at the first failure.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions import text
from corpuslens.profiles import Profile
from corpuslens.schemas import MANIFEST_COLUMNS, PROCESSED_COLUMNS, VOTE_COLUMNS

VIOLATION = "rule string, key string, detail string"


class RuleViolation(ValueError):
    """Raised by :func:`assert_clean`."""


def check_rows(df: DataFrame, key: Column, rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """One pass over the rows; each rule is ``name -> (failed, detail)``."""
    found = [F.when(failed, F.struct(F.lit(name).alias("rule"), key.cast("string").alias("key"),
                                     detail.cast("string").alias("detail")))
             for name, (failed, detail) in rules.items()]
    return (df.select(F.explode(F.array_compact(F.array(*found))).alias("v"))
            .select("v.rule", "v.key", "v.detail"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def assert_clean(violations: DataFrame, preview: int = 10) -> None:
    """Raise with counts per rule and the first few sorted examples; silent when there are none."""
    counts = {r["rule"]: r["count"] for r in violations.groupBy("rule").count().collect()}
    if not counts:
        return
    shown = violations.orderBy("rule", "key", "detail").limit(preview).collect()
    listed = ", ".join(f"{r['rule']}({r['key']}: {r['detail']})" for r in shown)
    more = sum(counts.values()) - len(shown)
    raise RuleViolation(f"{sorted(counts.items())}: {listed}" + (f", ... and {more} more" if more else ""))


# --- schemas and keys -------------------------------------------------------------------------

def schema_problems(actual: Sequence[str], expected: Sequence[str]) -> list[str]:
    """Missing, extra and reordered columns are three different problems (B1)."""
    missing = [c for c in expected if c not in actual]
    extra = [c for c in actual if c not in expected]
    found = []
    if missing:
        found.append("missing columns: " + ", ".join(missing))
    if extra:
        found.append("extra columns: " + ", ".join(extra))
    if not found and list(actual) != list(expected):
        found.append("columns are not in the required order")
    return found


def require_schema(df: DataFrame, expected: Sequence[str], source: str) -> DataFrame:
    found = schema_problems(df.columns, expected)
    if found:
        raise RuleViolation(f"Invalid {source} schema ({'; '.join(found)})")
    return df


def duplicate_keys(df: DataFrame, columns: Sequence[str], rule: str = "duplicate_key") -> DataFrame:
    """Keys that occur more than once, with their count."""
    return (df.groupBy(*columns).count().filter(F.col("count") > 1)
            .select(F.lit(rule).alias("rule"), F.concat_ws("|", *columns).alias("key"),
                    F.col("count").cast("string").alias("detail")))


def unsupported_splits(df: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Splits outside the profile (B2)."""
    return outside_domain(df, "split", splits, "unsupported_split")


def outside_domain(df: DataFrame, column: str, allowed: Sequence[str], rule: str) -> DataFrame:
    """Distinct values outside a fixed domain, with their row count."""
    return (df.filter(~F.coalesce(F.col(column), F.lit("")).isin(*allowed)).groupBy(column).count()
            .select(F.lit(rule).alias("rule"), F.col(column).alias("key"),
                    F.col("count").cast("string").alias("detail")))


def other_languages(df: DataFrame, profile: Profile, rule: str = "other_language") -> DataFrame:
    """Languages besides the profile's, with their row count; nulls are one of them."""
    return outside_domain(df, "language", [profile.language], rule)


def protocol_rules(left: DataFrame, right: DataFrame, profile: Profile) -> DataFrame:
    """What has to hold before two publishers are compared (I1): ids are unique within a split and well
    formed on both sides, labels are known, and the left side holds one language."""
    return union_all([
        duplicate_keys(left, ["split", "utt_id"], "duplicate_left_id"), duplicate_keys(right, ["split", "utt_id"], "duplicate_right_id"),
        malformed_ids(left, profile).withColumn("rule", F.lit("malformed_left_id")),
        malformed_ids(right, profile).withColumn("rule", F.lit("malformed_right_id")),
        outside_domain(left, "label", list(profile.label_equivalence), "unsupported_left_label"),
        outside_domain(right, "key", list(profile.label_equivalence.values()), "unsupported_right_label"),
        other_languages(left, profile)])


def malformed_ids(df: DataFrame, profile: Profile, column: str = "utt_id") -> DataFrame:
    """Ids must be ``<split prefix>_`` and ten digits."""
    ok = F.lit(False)
    for split, prefix in profile.prefixes.items():
        ok = ok | ((F.col("split") == split) & F.col(column).rlike(f"^{prefix}_[0-9]{{10}}$"))
    return check_rows(df, F.col(column), {"malformed_id": (~ok, F.col("split"))})


def path_rules(df: DataFrame, column: str = "file_path") -> DataFrame:
    """Relative path rules, all that fail."""
    p = F.col(column)
    return check_rows(df, p, {
        "empty_path": (p == "", F.col("split")),
        "absolute_path": (p.startswith("/"), p),
        "backslash_in_path": (p.contains("\\"), p),
        "parent_reference": (p.contains(".."), p),
        "wrong_split_prefix": (~p.startswith(F.concat(F.col("split"), F.lit("/"))), p)})


def non_digit_votes(df: DataFrame, key: str, columns: Sequence[str] = VOTE_COLUMNS) -> DataFrame:
    """Vote columns hold digits or nothing."""
    return check_rows(df, F.col(key), {
        f"invalid_{c}": (~text.is_digits_or_empty(F.col(c)), F.col(c)) for c in columns})


def combination_kind(profile: Profile) -> Column:
    """Kind of a disallowed (label, dataset) pair within the language; null when allowed."""
    generated = (F.col("label") == "generated") & (F.col("dataset") == profile.generated_dataset)
    pristine = (F.col("label") == "pristine") & (F.col("dataset") == profile.pristine_dataset)
    invalid = (F.col("language") == profile.language) & ~(generated | pristine)
    return (F.when(invalid & (F.col("label") == "generated"), "unexpected_dataset")
            .when(invalid & (F.col("dataset") == profile.generated_dataset), "unexpected_label")
            .when(invalid, "unexpected_combination"))


def bad_combinations(df: DataFrame, profile: Profile) -> DataFrame:
    """Row counts per kind and offending value."""
    kind = combination_kind(profile)
    value = F.when(F.col("rule") == "unexpected_dataset", F.col("dataset")).otherwise(F.col("label"))
    return (df.withColumn("rule", kind).filter(F.col("rule").isNotNull())
            .groupBy("rule", value.alias("key")).count()
            .select("rule", "key", F.col("count").cast("string").alias("detail")))


def generated_subset(df: DataFrame, profile: Profile) -> DataFrame:
    """Language, label and dataset filter; reaches the scan."""
    return df.filter((F.col("language") == profile.language) & (F.col("label") == "generated")
                     & (F.col("dataset") == profile.generated_dataset))


def sparse_field_values(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Columns that must be constant: unexpected values with counts."""
    pairs = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v"), F.lit(e).alias("e"))
                      for c, e in expected.items()])
    return (df.select(F.explode(pairs).alias("p")).filter(F.col("p.v") != F.col("p.e"))
            .groupBy("p.f", "p.v").count()
            .select(F.concat(F.lit("unexpected_"), F.col("f")).alias("rule"), F.col("v").alias("key"),
                    F.col("count").cast("string").alias("detail")))


def count_differences(df: DataFrame, expected: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per group against an expected table, both sides kept."""
    actual = df.groupBy(*by).agg(F.count(F.lit(1)).alias("actual"))
    both = actual.join(expected, list(by), "full_outer").select(
        *by, F.coalesce("actual", F.lit(0)).alias("actual"),
        F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.withColumn("difference", F.col("actual") - F.col("expected"))


def resolved_path_rules(df: DataFrame, inventory: DataFrame, root: Column, path: str = "source_path",
                        key: str = "utt_id") -> DataFrame:
    """File exists, stays under its root, and no two rows share it."""
    missing = df.join(inventory.select(F.col("path").alias(path)), path, "left_anti").select(
        F.lit("missing_file").alias("rule"), F.col(key).alias("key"), F.col(path).alias("detail"))
    p = F.col(path)
    outside = check_rows(df, F.col(key), {"outside_root": (
        ~p.startswith(F.concat(root, F.lit("/"))) | text.has_parent_part(p), p)})
    return union_all([missing, outside, duplicate_keys(df, [path], "duplicate_path")])


# --- manifest ---------------------------------------------------------------------------------

REQUIRED = [c for c in MANIFEST_COLUMNS if c not in (
    "protocol_codec", "source_group_id", "processed_path", "sha256_processed")]


def manifest_rules(df: DataFrame, profile: Profile) -> DataFrame:
    """All row and set rules of the canonical manifest."""
    c = F.col
    rules: dict[str, tuple[Column, Column]] = {
        f"empty_{name}": (text.is_blank(c(name)), F.lit("")) for name in REQUIRED}
    rules |= {
        "invalid_gender": (~c("gender").isin("F", "M"), c("gender")),
        "invalid_language": (c("language") != profile.language, c("language")),
        "invalid_dataset": (~c("dataset").isin(profile.generated_dataset, profile.pristine_dataset),
                            c("dataset")),
        "invalid_split": (~c("split").isin(*profile.splits), c("split")),
        "invalid_label": (~c("label").isin(*profile.label_equivalence), c("label")),
        "pristine_with_attack": ((c("label") == "pristine") & (c("attack_id") != "pristine"),
                                 c("attack_id")),
        "generated_without_attack": ((c("label") == "generated") & (c("attack_id") == "pristine"),
                                     c("attack_id")),
        "invalid_metadata_source": (c("metadata_source") != profile.metadata_source,
                                    c("metadata_source")),
        "half_processed": (text.is_blank(c("processed_path")) != text.is_blank(c("sha256_processed")),
                           c("processed_path"))}
    return union_all([check_rows(df, c("utt_id"), rules), duplicate_keys(df, ["utt_id"]),
                      duplicate_keys(df, ["source_path"], "duplicate_path")])


def manifest_stage(columns: Sequence[str]) -> str:
    """``raw`` or ``processed`` by the exact column list."""
    if list(columns) == MANIFEST_COLUMNS:
        return "raw"
    if list(columns) == PROCESSED_COLUMNS:
        return "processed"
    raise RuleViolation("Manifest columns must be the raw or processed canonical schema")


def raw_fields_filled(df: DataFrame) -> DataFrame:
    """A raw manifest must not carry processed fields."""
    filled = ~text.is_blank(F.col("processed_path")) | ~text.is_blank(F.col("sha256_processed"))
    return check_rows(df, F.col("utt_id"), {"raw_with_processed_fields": (
        filled, F.col("processed_path"))})


def output_plan_rules(df: DataFrame, destination: str, output: str = "output_path",
                      root: str = "output_root") -> DataFrame:
    """Planned outputs are unique, stay under their root and never meet the manifest."""
    out, base, src = F.col(output), F.col(root), F.col("source_path")
    rows = check_rows(df, F.col("utt_id"), {
        "escapes_root": (~out.startswith(F.concat(base, F.lit("/"))) | text.has_parent_part(out), out),
        "manifest_is_source": (src == destination, src),
        "manifest_is_output": ((out == destination) | (base == destination), out),
        "manifest_is_ancestor": (out.startswith(destination + "/"), out)})
    return union_all([rows, duplicate_keys(df, [output], "duplicate_destination")])


def measure_differences(declared: DataFrame, measured: DataFrame, key: str,
                        integers: Sequence[str], floats: Sequence[str],
                        tolerance: float = 1e-12) -> DataFrame:
    """Declared against recomputed measures: integers equal, floats within tolerance."""
    m = measured.select(F.col(key), *[F.col(n).alias(f"_m_{n}") for n in [*integers, *floats]])
    both = declared.join(m, key)
    rules = {f"{n}_differs": (~F.col(n).eqNullSafe(F.col(f"_m_{n}")), F.col(f"_m_{n}"))
             for n in integers}
    for n in floats:
        a, b = F.col(n), F.col(f"_m_{n}")
        differs = F.coalesce(~(F.abs(a - b) <= tolerance), ~a.eqNullSafe(b))
        rules[f"{n}_differs"] = (differs, b)
    return check_rows(both, F.col(key), rules)


def non_finite(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Null, NaN or infinite feature values."""
    return check_rows(df, F.col(key), {
        f"non_finite_{c}": (~is_finite(F.col(c)), F.col(c)) for c in columns})


def is_finite(c: Column) -> Column:
    v = c.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def partition_gate(df: DataFrame, train: str = "train", dev: str = "dev") -> DataFrame:
    """Unique ids, both classes in both splits, no shared speaker."""
    labels = F.array(F.lit("pristine"), F.lit("generated"))
    wanted = df.sparkSession.createDataFrame([(train,), (dev,)], "split string").select(
        "split", F.explode(labels).alias("label"))
    have = df.select("split", "label").distinct()
    absent = wanted.join(have, ["split", "label"], "left_anti").select(
        F.lit("missing_class").alias("rule"), F.col("split").alias("key"), F.col("label").alias("detail"))
    shared = shared_between_splits(df, "spk_id", train, dev).select(
        F.lit("speaker_leak").alias("rule"), F.col("spk_id").alias("key"),
        F.lit(f"{train},{dev}").alias("detail"))
    return union_all([duplicate_keys(df, ["utt_id"]), absent, shared])


def shared_between_splits(df: DataFrame, column: str, left: str, right: str) -> DataFrame:
    """Values present in both splits: one partial aggregation, no join."""
    return (df.groupBy(column).agg(F.max(F.col("split") == left).alias("_l"),
                                   F.max(F.col("split") == right).alias("_r"))
            .filter(F.col("_l") & F.col("_r")).select(column))


# --- archives and reports ---------------------------------------------------------------------

MEMBER_PATTERN = "^(train|test)/wav/([^/]+)/([^/]+)[.]wav$"


def member_parts(name: Column) -> list[Column]:
    """Split, speaker and id of a tracked signal member; empty when the name is another."""
    return [F.regexp_extract(name, MEMBER_PATTERN, i).alias(n)
            for i, n in ((1, "split"), (2, "speaker"), (3, "utt_id"))]


def misplaced_members(df: DataFrame, tracked: Sequence[str] = ()) -> DataFrame:
    """Unsafe, irregular and misfiled members, each judged by its own row."""
    name = F.col("name")
    split, speaker, utt = member_parts(name)
    follows = split != ""
    return check_rows(df, name, {
        "unsafe_member": (text.is_unsafe_member(name), name),
        "irregular_member": (~F.col("is_regular") & (follows | name.isin(*tracked)), name),
        "speaker_mismatch": (follows & (speaker != F.substring(utt, 1, 7)), utt)})


def member_rules(df: DataFrame, tracked: Sequence[str] = ()) -> DataFrame:
    """Unsafe, irregular, repeated and misfiled members."""
    return union_all([misplaced_members(df, tracked), duplicate_keys(df, ["name"], "duplicate_member")])


def set_difference_rules(expected: DataFrame, actual: DataFrame, column: str) -> DataFrame:
    """Exact set equality; both differences in one full outer join."""
    e = expected.select(column).distinct().withColumn("_e", F.lit(True))
    a = actual.select(column).distinct().withColumn("_a", F.lit(True))
    return (e.join(a, column, "full_outer").filter(F.col("_e").isNull() | F.col("_a").isNull())
            .select(F.when(F.col("_a").isNull(), "missing").otherwise("unexpected").alias("rule"),
                    F.col(column).cast("string").alias("key"), F.lit("").alias("detail")))


def missing_names(inventory: DataFrame, required: Sequence[str], column: str = "name") -> DataFrame:
    """Required inputs that the inventory does not hold."""
    wanted = inventory.sparkSession.createDataFrame([(n,) for n in required], f"{column} string")
    return wanted.join(inventory.select(column).distinct(), column, "left_anti").select(
        F.lit("missing_input").alias("rule"), F.col(column).alias("key"), F.lit("").alias("detail"))


def report_gate(reports: DataFrame, splits: Sequence[str]) -> DataFrame:
    """One complete, error-free, fingerprinted report for each configured split."""
    c = F.col
    rows = check_rows(reports, c("split"), {
        "unsupported_split": (~c("split").isin(*splits), c("split")),
        "missing_fingerprint": (text.is_blank(c("left_fingerprint")) | text.is_blank(c("right_fingerprint")),
                                F.lit("")),
        "has_errors": ((c("missing_ids") + c("extra_ids") + c("mismatched")) > 0,
                       c("missing_ids") + c("extra_ids") + c("mismatched")),
        "incomplete": ((c("pristine_matched") != c("pristine_expected"))
                       | (c("generated_matched") != c("generated_expected")),
                       c("pristine_matched") + c("generated_matched"))})
    absent = missing_names(reports, splits, "split").withColumn("rule", F.lit("missing_report"))
    return union_all([rows, duplicate_keys(reports, ["split"], "duplicate_report"), absent])


def stale_reports(stored: DataFrame, current: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields whose stored value is no longer the current one, null-safe."""
    cur = current.select(key, *[F.col(f).alias(f"_c_{f}") for f in fields])
    old = stored.select(key, *fields).withColumn("_stored", F.lit(True))
    both = old.join(cur.withColumn("_current", F.lit(True)), key, "full_outer")
    absent = F.col("_stored").isNull() | F.col("_current").isNull()
    rules = {"absent": (absent, F.when(F.col("_stored").isNull(), "stored").otherwise("current"))}
    rules |= {f"stale_{f}": (~absent & ~F.col(f).eqNullSafe(F.col(f"_c_{f}")),
                             F.col(f"_c_{f}")) for f in fields}
    return check_rows(both, F.col(key), rules)


def standard_signal_rules(df: DataFrame, rate: int, key: str = "utt_id",
                          expected_frames: str | None = None) -> DataFrame:
    """One channel, the target rate, the expected length, finite values."""
    bad = F.exists("samples", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    rules = {"channels": (F.col("channels") != 1, F.col("channels")),
             "sample_rate": (F.col("sample_rate") != rate, F.col("sample_rate")),
             "empty": (F.size("samples") == 0, F.lit("0")),
             "non_finite": (bad, F.lit(""))}
    if expected_frames:
        rules["frames"] = (F.size("samples") != F.col(expected_frames), F.size("samples"))
    return check_rows(df, F.col(key), rules)


def present_detectors(columns: Sequence[str], tags: Sequence[str] = ("zs", "ad")) -> list[str]:
    """Detectors whose score column exists, in fixed order."""
    return [t for t in tags if f"p_spoof_{t}" in columns]
