"""Strict readers of protocol and metadata tables.

Every column is read as a string and an empty field stays the empty string.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpuslens import schemas
from corpuslens.operators import rules
from corpuslens.profiles import Profile
from corpuslens.sources.text_lines import file_name, numbered_lines, with_row_numbers

# Python's split() knows more blanks than Java's \s; these are the ones Java's \s leaves out.
_BLANKS = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def strict_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, source: str, *,
               multiline: bool = True) -> DataFrame:
    """CSV with an exact ordered header.

    The header is compared before the scan, so missing, extra and reordered columns give their
    own messages.  ``multiline`` allows quoted line breaks, at one task per file; switch it off
    for large files that have none.
    """
    names = [f.name for f in schema.fields]
    options = dict(header=True, escape='"', multiLine=multiline, encoding="UTF-8")
    found = spark.read.options(**options).csv(path).columns
    problems = rules.schema_problems(found, names)
    if problems:
        raise rules.RuleViolation(f"Invalid {source} schema ({'; '.join(problems)})")
    strings = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.options(enforceSchema=False, **options).schema(strings).csv(path)
    filled = df.na.fill("")
    return filled.select(*[F.col(f.name).cast(f.dataType) if not isinstance(f.dataType, T.StringType)
                           else F.col(f.name) for f in schema.fields])


def with_row_number(df: DataFrame) -> DataFrame:
    """Add ``_file`` and ``_row``: the record's number plus two, as the header is line one (trap of the filter)."""
    return with_row_numbers(df.withColumn("_file", F.col("_metadata.file_path")), "_row", first=2)


def read_protocol(spark: SparkSession, path: str, split: str, profile: Profile, *,
                  language: str | None = None, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """Left publisher's protocol and its violations (A1).

    The language filter comes before the id checks, and reaches the scan.
    """
    df = strict_csv(spark, path, schemas.PROTOCOL, "protocol", multiline=multiline)
    if language is not None:
        df = df.filter(F.col("language") == language)
    tagged = df.withColumn("split", F.lit(split))
    problems = rules.union_all([
        rules.unsupported_splits(tagged, tuple(profile.prefixes)),
        rules.duplicate_keys(tagged, ["utt_id"]), rules.malformed_ids(tagged, profile),
        rules.outside_domain(tagged, "label", list(profile.label_equivalence), "unsupported_label")])
    return tagged, problems


def read_counterpart(spark: SparkSession, path: str, split: str, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """Right publisher's blank-separated protocol, exactly ten fields per line (A2)."""
    lines = spark.read.text(path)
    parts = F.split(F.regexp_replace("value", f"^{_BLANKS}|{_BLANKS}$", ""), _BLANKS)
    cut = lines.withColumn("_p", parts)
    width = len(schemas.COUNTERPART_COLUMNS)
    bad = rules.check_rows(cut, F.col("value"), {"field_count": (F.size("_p") != width, F.size("_p"))})
    df = cut.filter(F.size("_p") == width).select(*[
        F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(schemas.COUNTERPART_COLUMNS)],
        F.lit(split).alias("split"))
    problems = rules.union_all([
        bad, rules.duplicate_keys(df, ["utt_id"]), rules.malformed_ids(df, profile),
        rules.outside_domain(df, "key", list(profile.label_equivalence.values()), "unsupported_key")])
    return df, problems


def read_crowd(spark: SparkSession, paths: Mapping[str, str], *, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """Crowd metadata of several splits with traceability columns."""
    parts = []
    for split, path in paths.items():
        df = with_row_number(strict_csv(spark, path, schemas.CROWD, "crowd metadata", multiline=multiline))
        parts.append(df.select(*schemas.CROWD_COLUMNS, F.lit(split).alias("split"),
                               file_name(F.col("_file")).alias("metadata_source_file"),
                               F.col("_row").cast("string").alias("metadata_source_row")))
    out = rules.union_all(parts)
    problems = rules.union_all([rules.path_rules(out), rules.non_digit_votes(out, "file_path"),
                                rules.duplicate_keys(out, ["split", "file_path"])])
    return out, problems


def read_generated(spark: SparkSession, path: str, split: str, profile: Profile, *, root: str,
                   inventory: DataFrame | None = None, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """Generated subset of a protocol: pairs, filter, ids, counts, paths, traceability (A4).

    The row number is the one before the filter.
    """
    whole = with_row_number(strict_csv(spark, path, schemas.PROTOCOL, "protocol", multiline=multiline))
    picked = rules.generated_subset(whole, profile)
    out = picked.select(
        *schemas.PROTOCOL_COLUMNS, F.lit(split).alias("split"),
        file_name(F.col("_file")).alias("metadata_source_file"),
        F.col("_row").cast("string").alias("metadata_source_row"),
        generated_path(F.lit(root), F.lit(split), F.col("utt_id"), profile).alias("audio_path"))
    problems = [rules.bad_combinations(whole, profile), rules.malformed_ids(out, profile),
                rules.duplicate_keys(out, ["utt_id"])]
    if profile.sparse_fields:
        problems.append(rules.sparse_field_values(out, profile.sparse_fields))
    expected = profile.expected_counts.get((split, "generated"))
    if expected is not None:
        n = F.count(F.lit(1))
        problems.append(out.agg(n.alias("_n")).filter(F.col("_n") != expected).select(
            F.lit("expected_count").alias("rule"), F.lit(split).alias("key"), F.col("_n").cast("string").alias("detail")))
    if inventory is not None:
        base = F.concat_ws("/", F.lit(root), F.lit(profile.generated_root), F.lit(split), F.lit("wav"))
        problems.append(rules.resolved_path_rules(out, inventory, base, "audio_path"))
    return out, rules.union_all(problems)


def generated_path(root, split, utt_id, profile: Profile):
    """Path of a generated signal."""
    return F.concat_ws("/", root, F.lit(profile.generated_root), split, F.lit("wav"),
                       F.concat(utt_id, F.lit(".wav")))


def read_manifest(spark: SparkSession, path: str, *, processed: bool = False) -> DataFrame:
    """A stored manifest, raw as strings or processed with its measure types."""
    schema = schemas.PROCESSED if processed else schemas.MANIFEST
    return strict_csv(spark, path, schema, "manifest")


# --- text members of an archive ---------------------------------------------------------------

def _kept(lines: DataFrame) -> DataFrame:
    v = F.trim(F.col("value"))
    return lines.withColumn("value", v).filter((v != "") & ~v.startswith("#"))


def parse_speakers(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, age, gender, accent`` separated by tabs; comments and blanks skipped."""
    cut = _kept(lines).withColumn("_p", F.split("value", "\t"))
    bad = rules.check_rows(cut, F.col("value"), {"speaker_fields": (F.size("_p") < 4, F.size("_p"))})
    p = [F.get("_p", F.lit(i)) for i in range(4)]
    df = cut.filter(F.size("_p") >= 4).select(p[0].alias("speaker_id"), p[2].alias("gender"),
                                             p[1].alias("age"), p[3].alias("accent"))
    return df, rules.union_all([bad, rules.duplicate_keys(df, ["speaker_id"])])


def parse_content(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id<TAB>text`` with the physical line number; ``.wav`` removed from the id."""
    cut = lines.withColumn("value", F.trim(F.col("value"))).filter(F.col("value") != "").withColumn(
        "_p", F.split("value", "\t", 2))
    bad = rules.check_rows(cut, F.col("line_no"), {"content_fields": (F.size("_p") < 2, F.col("value"))})
    df = cut.filter(F.size("_p") == 2).select(
        "split", F.regexp_replace(F.col("_p")[0], "[.]wav$", "").alias("utt_id"),
        F.col("_p")[1].alias("transcription"), "line_no")
    return df, rules.union_all([bad, rules.duplicate_keys(df, ["split", "utt_id"])])


def parse_labels(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id|label``; comments skipped."""
    cut = _kept(lines).withColumn("_p", F.split("value", "\\|", 2))
    bad = rules.check_rows(cut, F.col("value"), {"label_fields": (F.size("_p") < 2, F.col("value"))})
    df = cut.filter(F.size("_p") == 2).select(F.col("_p")[0].alias("utt_id"), F.col("_p")[1].alias("pinyin"))
    return df, rules.union_all([bad, rules.duplicate_keys(df, ["utt_id"])])


def read_content_files(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Numbered lines of the content file of each split."""
    return rules.union_all([numbered_lines(spark, p).withColumn("split", F.lit(s)) for s, p in paths.items()])


def read_archive_manifest(members: DataFrame, content: DataFrame, speakers: DataFrame, labels: DataFrame,
                          tracked: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Reconciled manifest of an archive from its member table and its text members (A5)."""
    from corpuslens.operators import reconcile
    split, speaker, utt = rules.member_parts(F.col("name"))
    wavs = members.filter(F.col("is_regular")).select("name", "size", split, speaker, utt).filter(
        F.col("split") != "")
    lines, bad_lines = parse_content(content)
    people, bad_people = parse_speakers(speakers)
    tags, bad_tags = parse_labels(labels)
    pairs = reconcile.two_sided(lines, wavs)
    manifest, unknown = reconcile.archive_manifest(pairs, people, tags)
    problems = rules.union_all([rules.member_rules(members, tracked), bad_lines, bad_people, bad_tags, unknown,
                                rules.duplicate_keys(wavs, ["split", "utt_id"], "duplicate_signal")])
    return {"manifest": manifest, "reconciliation": reconcile.side_counts(pairs), "pairs": pairs,
            "problems": problems}
