"""Reconciliation joins and set operations (C1-C9, F)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from corpuslens.functions import keys, text
from corpuslens.profiles import Profile
from corpuslens.session import freeze


def one_per_key(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key, the least of its copies.

    Repeated keys are violations of their own; collapsing them map-side keeps a join one to
    one, so a key with very many copies never multiplies.  The later join reuses the shuffle.
    """
    return df.groupBy(*key).agg(F.min(F.struct(*columns)).alias("_row")).select(*key, "_row.*")


def reduce_to(right: DataFrame, left: DataFrame, key: str = "utt_id") -> DataFrame:
    """Rows of the right side whose key the left side knows in the same split."""
    return right.join(left.select("split", key), ["split", key], "left_semi")


def paired(left: DataFrame, right: DataFrame, profile: Profile,
           fields: Sequence[str] = ("spk_id", "gender"), key: str = "utt_id") -> DataFrame:
    """Full outer join of two protocols, split by split, with a list of differing fields per shared id.

    An id that changes its split is missing in one and extra in the other.
    """
    l = one_per_key(left, ["split", key], ["label", *fields]).select(
        F.col(key), F.col("split"), F.col("split").alias("_ls"), F.col("label").alias("left_label"),
        *[F.col(f).alias(f"_l_{f}") for f in fields])
    r = one_per_key(right, ["split", key], ["key", *fields]).select(
        F.col(key), F.col("split"), F.col("split").alias("_rs"), F.col("key").alias("right_label"),
        *[F.col(f).alias(f"_r_{f}") for f in fields])
    both = l.join(r, ["split", key], "full_outer")
    shared = F.col("_ls").isNotNull() & F.col("_rs").isNotNull()
    agrees = profile.equivalent_label(F.col("left_label")) == F.col("right_label")

    def entry(name: str, a: str, b: str):
        return F.struct(F.lit(name).alias("field"), F.col(a).alias("left"), F.col(b).alias("right"))

    found = [F.when(shared & (F.col(f"_l_{f}") != F.col(f"_r_{f}")), entry(f, f"_l_{f}", f"_r_{f}"))
             for f in fields]
    found.append(F.when(shared & ~agrees, entry("label", "left_label", "right_label")))
    return both.select(
        key, "split", "left_label", "right_label",
        F.col("_rs").isNull().alias("is_missing"), F.col("_ls").isNull().alias("is_extra"),
        (shared & agrees).alias("label_matched"),
        F.array_compact(F.array(*found)).alias("mismatches"))


def correspondence(pairs: DataFrame) -> DataFrame:
    """Report per split.  A row counts as matched when the label agrees, whatever else differs."""
    def n(cond):
        return F.count_if(cond)

    label = F.col("left_label")
    return pairs.groupBy("split").agg(
        n(label == "pristine").alias("pristine_expected"),
        n(label == "generated").alias("generated_expected"),
        n(F.col("label_matched") & (label == "pristine")).alias("pristine_matched"),
        n(F.col("label_matched") & (label == "generated")).alias("generated_matched"),
        n("is_missing").alias("missing_ids"), n("is_extra").alias("extra_ids"),
        n(F.size("mismatches") > 0).alias("mismatched"))


def correspondence_problems(pairs: DataFrame, key: str = "utt_id") -> DataFrame:
    """Missing ids, extra ids and every differing field, one row each."""
    none = F.struct(F.lit("").alias("field"), F.lit("").alias("left"), F.lit("").alias("right"))
    listed = (F.when(F.col("is_missing") | F.col("is_extra"), F.array(none))
              .otherwise(F.col("mismatches")))
    kind = (F.when(F.col("is_missing"), "missing").when(F.col("is_extra"), "extra")
            .otherwise("mismatch"))
    return pairs.select("split", key, kind.alias("kind"), F.explode(listed).alias("m")).select(
        "split", "kind", key, "m.field", "m.left", "m.right")


def overlap_evidence(pairs: DataFrame, profile: Profile) -> DataFrame:
    """Counts and overlaps by label of a pair of protocols known to disagree."""
    aggs = []
    for left, right in profile.label_equivalence.items():
        is_l, is_r = F.col("left_label") == left, F.col("right_label") == right
        aggs += [F.count_if(is_l).alias(f"left_{left}"), F.count_if(is_r).alias(f"right_{right}"),
                 F.count_if(is_l & is_r).alias(f"overlap_{left}_{right}")]
    shared = ~F.col("is_missing") & ~F.col("is_extra")
    return pairs.groupBy("split").agg(
        *aggs, F.count_if(shared).alias("id_overlap"),
        F.count_if("is_missing").alias("left_only"), F.count_if("is_extra").alias("right_only"),
        (F.count_if(~shared | ~F.col("label_matched")) == 0).alias("now_corresponds"))


def with_evidence(left: DataFrame, right: DataFrame, key: str = "utt_id") -> DataFrame:
    """Optional codec and group of the other publisher, empty when absent."""
    r = one_per_key(right, [key], ["codec", "tmp"]).select(
        F.col(key), F.col("codec").alias("_codec"), F.col("tmp").alias("_tmp"))
    return left.join(r, key, "left").withColumn(
        "protocol_codec", text.strip_dashes(F.col("_codec"))).withColumn(
        "source_group_id", text.strip_dashes(F.col("_tmp"))).drop("_codec", "_tmp")


def two_sided(content: DataFrame, members: DataFrame) -> DataFrame:
    """Content lines against signal members, one row per id with side flags (C4)."""
    c = one_per_key(content, ["split", "utt_id"], ["line_no", "transcription"]).withColumn("_c", F.lit(True))
    m = one_per_key(members, ["split", "utt_id"], ["name"]).select(
        "split", "utt_id", F.col("name").alias("archive_member_path"), F.lit(True).alias("_m"))
    return c.join(m, ["split", "utt_id"], "full_outer").withColumn(
        "side", F.when(F.col("_m").isNull(), "content_only").when(F.col("_c").isNull(), "member_only")
        .otherwise("both")).drop("_c", "_m")


def side_counts(pairs: DataFrame) -> DataFrame:
    n = F.count_if
    side = F.col("side")
    return pairs.groupBy("split").agg(
        n(side != "member_only").alias("content_lines"), n(side != "content_only").alias("members"),
        n(side == "both").alias("matched"), n(side == "content_only").alias("content_without_member"),
        n(side == "member_only").alias("member_without_content"))


def divergence_note(counts: DataFrame, official: int, split: str = "test") -> DataFrame:
    """Sentence with thousands separators about a differing published count."""
    return counts.filter(F.col("split") == split).select(F.concat(
        F.lit("observed "), F.lit(split), F.lit(" content lines: "),
        F.format_number("content_lines", 0), F.lit("; published: "),
        F.format_number(F.lit(official), 0)).alias("note"))


def archive_manifest(pairs: DataFrame, speakers: DataFrame, labels: DataFrame,
                     source_file: str = "content.txt") -> tuple[DataFrame, DataFrame]:
    """Manifest of matched ids with speaker and label lookups, and unknown speakers."""
    matched = pairs.filter(F.col("side") == "both").withColumn(
        "speaker_id", F.substring("utt_id", 1, 7))
    s = one_per_key(speakers, ["speaker_id"], ["gender", "age", "accent"]).withColumn("_known", F.lit(True))
    tagged = one_per_key(labels, ["utt_id"], ["pinyin"]).withColumn("_tagged", F.lit(True))
    full = matched.join(s, "speaker_id", "left").join(tagged, "utt_id", "left")
    unknown = full.filter(F.col("_known").isNull()).select(
        F.lit("unknown_speaker").alias("rule"), F.col("utt_id").alias("key"),
        F.col("speaker_id").alias("detail"))
    out = full.filter(F.col("_known").isNotNull()).select(
        "utt_id", "split", "archive_member_path", "speaker_id", "gender", "age", "accent",
        "transcription", F.coalesce("pinyin", F.lit("")).alias("pinyin"),
        F.when(F.col("_tagged").isNotNull(), "yes").otherwise("no").alias("prosody_available"),
        F.lit(source_file).alias("metadata_source_file"),
        F.col("line_no").cast("string").alias("metadata_source_row"))
    return out, unknown


def held_extractions(ledger: DataFrame, archives: DataFrame, inventory: DataFrame) -> DataFrame:
    """(utt_id, split) of ledger rows whose archive checksum holds and whose content hash is in the inventory.

    Copies in the inventory collapse in a hashed aggregate, so a ledger row meets one row at most; ids with very
    many ledger rows are split by adaptive skew join.  No sets are collected: their aggregate would sort both
    tables before and after the shuffle.
    """
    a = archives.select("archive_name", F.lower("checksum").alias("_md5"))
    fresh = ledger.withColumn("_md5", F.lower("archive_md5")).join(a, ["archive_name", "_md5"], "left_semi")
    held = inventory.select("utt_id", F.col("sha256").alias("_sha")).distinct()
    return fresh.select("utt_id", F.col("sha256_extracted").alias("_sha"), "split").join(
        held, ["utt_id", "_sha"], "left_semi").select("utt_id", "split")


def valid_extractions(targets: DataFrame, ledger: DataFrame, archives: DataFrame,
                      inventory: DataFrame) -> DataFrame:
    """Targets whose ledger row, archive checksum and content hash all hold."""
    held = held_extractions(ledger, archives, inventory)
    return targets.select("utt_id", "split").join(held, ["utt_id", "split"], "left_semi")


def ledger_order(ledger: DataFrame) -> DataFrame:
    """Split, then id."""
    return ledger.orderBy("split", "utt_id")


def outstanding(targets: DataFrame, valid: DataFrame, inventoried: DataFrame) -> DataFrame:
    """Per split: targets, valid, still to do, and never seen in any inventory.

    Copies of a target are counted first.  Then the ids of all three tables meet in one aggregate of two
    marks, which is hashed and not sorted, and the counted targets look their marks up.  Targets with a null
    id are never valid and never inventoried.
    """
    counted = targets.groupBy("utt_id", "split").agg(F.count(F.lit(1)).alias("_n"))
    sides = valid.select("utt_id", F.lit(True).alias("_v")).unionByName(inventoried.select("utt_id", F.lit(False).alias("_v")))
    marks = sides.groupBy("utt_id").agg(F.bool_or("_v").alias("_v"), F.bool_or(~F.col("_v")).alias("_i"))
    flagged = counted.join(marks, "utt_id", "left").na.fill(False, ["_v", "_i"])
    n = F.col("_n")
    return flagged.groupBy("split").agg(
        F.sum(n).alias("targets"), F.sum(F.when(F.col("_v"), n).otherwise(0)).alias("valid"),
        F.sum(F.when(F.col("_v"), 0).otherwise(n)).alias("outstanding"),
        F.sum(F.when(F.col("_i"), 0).otherwise(n)).alias("never_inventoried"))


def missing_preview(targets: DataFrame, inventoried: DataFrame, shown: int = 10) -> DataFrame:
    """First missing keys and how many more there are (E13).  The preview itself is the feature."""
    # Frozen, as the count and the head both read it: else both tables would meet twice.
    missing = freeze(targets.join(inventoried.select("utt_id"), "utt_id", "left_anti").select(
        F.concat_ws(":", "split", "utt_id").alias("item")))
    total = missing.agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("preview"),
                        F.lit(0).cast("bigint").alias("listed"))
    head = missing.orderBy("item").limit(shown).agg(
        F.lit(0).cast("bigint").alias("n"),
        F.array_join(F.array_sort(F.collect_list("item")), ", ").alias("preview"),
        F.count(F.lit(1)).alias("listed"))
    return total.unionByName(head).agg(
        F.max("n").alias("n"), F.max("preview").alias("preview"),
        (F.max("n") - F.max("listed")).alias("remainder"))


# --- set operations ---------------------------------------------------------------------------

def key_overlap(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """Sizes of difference and intersection of two key sets per group."""
    sides = left.select(by, key, F.lit(True).alias("_l")).union(right.select(by, key, F.lit(False)))
    # One shuffle by key: whether a key has rows on either side; null groups and keys are values like others.
    both = sides.groupBy(by, key).agg(F.bool_or("_l").alias("_l"), F.bool_or(~F.col("_l")).alias("_r"))
    return both.groupBy(by).agg(
        F.count_if(~F.col("_r")).alias("left_only"), F.count_if(~F.col("_l")).alias("right_only"),
        F.count_if(F.col("_l") & F.col("_r")).alias("shared"),
        (F.count_if(~F.col("_l") | ~F.col("_r")) == 0).alias("equal"))


def upsert(current: DataFrame, updates: DataFrame, key: str = "utt_id") -> DataFrame:
    """New rows replace old rows by key; the caller rejects repeated keys first."""
    kept = current.join(updates.select(key), key, "left_anti")
    return kept.unionByName(updates)


def table_fingerprint(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fingerprint per group: row order does not matter; column order, copies and group do.

    Row digests are cut into four numbers and summed, so the fingerprint is a plain
    partial aggregation however many rows the table has.
    """
    digest = df.select(*by, keys.row_digest(list(columns)).alias("_d"))
    parts = [F.sum(F.conv(F.substring("_d", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
             .cast("decimal(38,0)").cast("string").alias(f"_p{i}") for i in range(4)]
    sums = digest.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *parts)
    seal = F.sha2(F.concat_ws("|", F.lit(",".join(columns)), *[F.col(b).cast("string") for b in by],
                              F.col("rows").cast("string"), *[F.col(f"_p{i}") for i in range(4)]), 256)
    return sums.select(*by, "rows", seal.alias("fingerprint"))
