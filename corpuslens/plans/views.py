"""Logical tables of the library, derived from the driver's tables.

Differences between publishers are planted by changing values on a hash of the
id, never by leaving rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuslens.functions import dsp, keys, signal
from corpuslens.operators import effects
from corpuslens.profiles import Profile

# The profile of the derived tables.
FIELD = Profile(
    language="en", splits=("train", "dev", "eval"),
    prefixes={"train": "T", "dev": "D", "eval": "E"},
    generated_dataset="SYNTH", pristine_dataset="FIELD",
    expected_counts={("train", "pristine"): 500, ("train", "generated"): 200,
                     ("dev", "pristine"): 150, ("dev", "generated"): 60,
                     ("eval", "pristine"): 70, ("eval", "generated"): 30},
    sparse_fields={"native": "yes", "codec": "-"},
    archive_prefixes={"flac_T_": "train", "flac_D_": "dev", "flac_E_": "eval"})

# Band grid of the 64-sample signals: mel-spaced edges between 1 and 31 Hz.
SIGNAL_RATE = 64
BAND_COUNT = 4
BAND_EDGES = signal.mel_edges(BAND_COUNT, 1.0, 31.0)
FRAME, HOP = 16, 8
DETECTORS = ("zs", "ad")
RUNS = ("enc_a", "enc_b", "enc_c")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def draw(tag: str, key: str, modulus: int) -> Column:
    """A hash of ``tag:key`` reduced to ``[0, modulus)``."""
    return keys.key_number(keys.md5_key(F.lit(tag), key)) % modulus


def _labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").join(labels, "doc_id", "left")
    s = draw("s", "doc_id", 10)
    return (docs
            .withColumn("split", F.when(s < 7, "train").when(s < 9, "dev").otherwise("eval"))
            .withColumn("label", F.when(F.col("quality") == 1, "pristine")
                        .when(F.col("quality") == 0, "generated")
                        .when(draw("q", "doc_id", 2) == 0, "pristine").otherwise("generated"))
            .withColumn("utt_id", F.concat(
                F.when(F.col("split") == "train", "T").when(F.col("split") == "dev", "D")
                .otherwise("E"), F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 10, "0"))))


def protocol(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """Left publisher: nine string columns plus the split."""
    d = _labelled_documents(spark, sf)
    return d.select(
        F.col("source").alias("spk_id"), "utt_id",
        F.when(draw("g", "source", 2) == 0, "F").otherwise("M").alias("gender"),
        F.lit("-").alias("codec"),
        F.when(F.col("label") == "pristine", "pristine").otherwise(F.concat(
            F.lit("A"), F.lpad((draw("a", "doc_id", 16) + 1).cast("string"), 2, "0"))).alias("attack_id"),
        "label", F.lit("yes").alias("native"), F.col("lang").alias("language"),
        F.when(draw("d", "doc_id", 50) == 0, "OTHER")
        .when(F.col("label") == "generated", "SYNTH").otherwise("FIELD").alias("dataset"),
        "split", *extra)


def counterpart(spark: SparkSession, sf: str) -> DataFrame:
    """Right publisher: the same rows with planted disagreements."""
    p = protocol(spark, sf, "doc_id")
    flip = draw("f", "doc_id", 29) == 0
    spoof = (F.col("label") == "generated") != flip
    return p.select(
        F.when(draw("k", "doc_id", 33) == 0, "unk").otherwise(F.col("spk_id")).alias("spk_id"),
        F.when(draw("m", "doc_id", 40) == 0,
               F.concat(F.substring("utt_id", 1, 2), F.lit("9"), F.substring("utt_id", 4, 9)))
        .otherwise(F.col("utt_id")).alias("utt_id"),
        F.when(draw("n", "doc_id", 37) == 0, "unk").otherwise(F.col("gender")).alias("gender"),
        F.when(draw("c", "doc_id", 3) == 0, "-")
        .otherwise(F.concat(F.lit("C-"), draw("c", "doc_id", 3).cast("string"))).alias("codec"),
        F.lit("-").alias("codec_q"), F.lit("-").alias("codec_seed"),
        F.lit("-").alias("attack_tag"), "attack_id",
        F.when(spoof, "spoof").otherwise("bonafide").alias("key"),
        F.when(draw("t", "doc_id", 4) == 0, "-")
        .otherwise(F.concat(F.lit("G-"), F.floor(F.col("doc_id") / 3).cast("string"))).alias("tmp"),
        "split")


def manifest(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """Canonical manifest, fifteen string columns."""
    p = protocol(spark, sf, "doc_id", "text", *extra)
    codec, group = F.col("_codec"), F.col("_group")
    ext = F.when(F.col("label") == "pristine", ".flac").otherwise(".wav")
    root = F.when(F.col("label") == "pristine", FIELD.pristine_root).otherwise(FIELD.generated_root)
    return (p
            .withColumn("_codec", F.when(draw("c", "doc_id", 3) == 0, "-").otherwise(
                F.concat(F.lit("C-"), draw("c", "doc_id", 3).cast("string"))))
            .withColumn("_group", F.when(draw("t", "doc_id", 4) == 0, "-").otherwise(
                F.concat(F.lit("G-"), F.floor(F.col("doc_id") / 3).cast("string"))))
            .select(
                "utt_id", "spk_id", "gender", "language", "dataset", "split", "label", "attack_id",
                keys_strip(codec).alias("protocol_codec"), keys_strip(group).alias("source_group_id"),
                F.concat_ws("/", root, F.col("split"), F.concat(F.col("utt_id"), ext)).alias("source_path"),
                F.lit("").alias("processed_path"), F.sha2("text", 256).alias("sha256_source"),
                F.lit("").alias("sha256_processed"),
                F.lit(FIELD.metadata_source).alias("metadata_source"), *extra))


def keys_strip(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(""))


def _only(text: str, chars: str) -> Column:
    """How many characters of the class ``chars`` the whole text holds."""
    return F.length(F.regexp_replace(F.col(text), f"[^{chars}]+", ""))


MEASURES = ["source_sample_rate", "source_channels", "source_frames", "source_duration_seconds",
            "source_peak", "source_rms", "source_silence_ratio", "source_rms_dbfs",
            "source_estimated_snr_db"]


# Measures of the processed side as expressions of those of the source, in the SQL that both engines read.
PROCESSED_MEASURES = {
    "processed_sample_rate": "CAST(16000 AS BIGINT)", "processed_channels": "CAST(1 AS BIGINT)",
    "processed_duration_seconds": "source_duration_seconds", "processed_peak": "round(source_peak * 0.5, 9)",
    "processed_rms": "round(source_rms * 0.5, 9)", "processed_silence_ratio": "source_silence_ratio",
    "processed_rms_dbfs": "round(source_rms_dbfs - 6, 9)", "processed_estimated_snr_db": "round(source_estimated_snr_db + 1, 9)"}


def measured(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest with measures of the whole text standing in for signal measures."""
    m = manifest(spark, sf, "doc_id", "text")
    n = F.length("text")
    lines = F.size(F.split("text", "\n")) - 1
    words = F.size(F.split(F.trim(F.col("text")), " "))
    return (m
            .withColumn("source_sample_rate", F.when(F.col("label") == "generated", 22050)
                        .otherwise(8000).cast("bigint"))
            .withColumn("source_channels", F.when(F.col("label") == "generated", 2)
                        .otherwise(1).cast("bigint"))
            .withColumn("source_frames", n.cast("bigint"))
            .withColumn("source_duration_seconds",
                        F.round(F.col("source_frames") / F.col("source_sample_rate"), 9))
            .withColumn("source_peak", F.round(_only("text", "A-Z") / n, 9))
            .withColumn("source_rms", F.round(_only("text", "0-9") / n, 9))
            .withColumn("source_silence_ratio", F.round(_only("text", " \n") / n, 9))
            .withColumn("source_rms_dbfs", F.round(F.lit(20.0) * F.log10(F.nullif("source_rms", F.lit(0.0))), 9))
            .withColumn("source_estimated_snr_db",
                        F.round(F.lit(10.0) * F.log10(words / F.nullif(lines, F.lit(0))), 9))
            .drop("text"))


def crowd(spark: SparkSession, sf: str) -> DataFrame:
    """Crowd metadata: file paths and vote columns derived from the event stream."""
    e = table(spark, sf, "events")
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    split = F.when(draw("s", "event_id", 10) < 7, "train").when(
        draw("s", "event_id", 10) < 9, "dev").otherwise("test")
    bad = draw("p", "event_id", 97)
    path = F.concat(F.col("split"), F.lit("/"), F.col("user_id").cast("string"), F.lit("/"),
                    F.col("event_id").cast("string"), F.lit(".wav"))
    return (e.withColumn("split", split).select(
        "event_id",
        F.when(bad == 1, "").when(bad == 2, F.concat(F.lit("/"), path))
        .when(bad == 3, F.replace(path, F.lit("/"), F.lit("\\")))
        .when(bad == 4, F.concat(F.col("split"), F.lit("/../"), F.col("event_id").cast("string")))
        .when(bad == 5, F.concat(F.lit("other/"), path)).otherwise(path).alias("file_path"),
        F.lit("spoken").alias("task"), F.col("event_type").alias("variety"),
        F.concat(F.lit("set"), (F.col("user_id") % 5).cast("string")).alias("dataset"),
        F.when(draw("x", "event_id", 6) == 0, "").otherwise(F.col("event_type")).alias("accent"),
        F.when(draw("v", "event_id", 9) == 0, "").when(draw("v", "event_id", 61) == 7, "n/a")
        .otherwise(k).alias("up_votes"),
        F.when(draw("w", "event_id", 4) == 0, "").otherwise(
            F.floor(F.col("value")).cast("bigint").cast("string")).alias("down_votes"),
        F.col("props").alias("text"), "split"))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of 64 samples at 64 Hz."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("label").alias("class_id"),
        F.when(F.col("label") >= 5, 1).otherwise(0).alias("ground_truth"),
        F.lit(SIGNAL_RATE).alias("sample_rate"),
        F.transform("embedding", lambda v: v.cast("double")).alias("samples"))


def weight_values(salt: int) -> list[float]:
    """Fixed linear scorer: exact binary fractions, so every engine agrees on them."""
    return [(((i * 37 + 11 * salt) % 64) - 32) / 32.0 for i in range(64)]


def linear_logit(samples: Column, salt: int) -> Column:
    w = F.array(*[F.lit(x) for x in weight_values(salt)])
    return F.aggregate(F.zip_with(samples, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def scorer(salt: int, gain: float = 1.0) -> effects.LinearScorer:
    """A detector as a column function: samples to probability of the positive class."""
    return effects.LinearScorer(tuple(w * gain for w in weight_values(salt)),
                                lambda z: F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 9))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Two detectors' scores; the second one knows more about the class."""
    s = signals(spark, sf)
    side = F.col("ground_truth") * 2 - 1
    for tag, salt, lift in (("zs", 1, 0.3), ("ad", 2, 0.8)):
        z = linear_logit(F.col("samples"), salt) + side * F.lit(lift)
        s = s.withColumn(f"p_spoof_{tag}", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 9))
    return s


def run_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The same clips scored in three runs, long form (run, sample_id, p_spoof)."""
    s = signals(spark, sf)
    side = F.col("ground_truth") * 2 - 1
    pairs = F.array(*[
        F.struct(F.lit(run).alias("run"),
                 F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-(
                     linear_logit(F.col("samples"), 3 + i) + side * F.lit(0.2 * (i + 1))))), 9)
                 .alias("p_spoof"))
        for i, run in enumerate(RUNS)])
    return s.select("sample_id", "ground_truth", F.explode(pairs).alias("r")).select(
        F.col("r.run").alias("run"), "sample_id", "ground_truth", F.col("r.p_spoof").alias("p_spoof"))


def featured(spark: SparkSession, sf: str) -> DataFrame:
    """Scores plus log band energies: everything of the master table but the decisions."""
    s = scored(spark, sf)
    bands = dsp.log_band_energy(F.col("samples"), SIGNAL_RATE, BAND_EDGES, FRAME, HOP)
    s = s.withColumn("_f", bands)
    cols = [F.round(F.col("_f")[i], 8).alias(name)
            for i, name in enumerate(signal.band_columns(BAND_COUNT))]
    return s.select("sample_id", "ground_truth",
                    *[f"p_spoof_{t}" for t in DETECTORS], "samples", *cols)


BAND_COLUMNS = signal.band_columns(BAND_COUNT)


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Extraction ledger: one row per (order, line), duplicates kept apart by a window-free key."""
    li = table(spark, sf, "lineitem")
    name = F.concat(F.lit("flac_"), F.when(F.col("l_returnflag") == "N", "T")
                    .when(F.col("l_returnflag") == "A", "D").otherwise("E"),
                    F.lit("_a"), (F.col("l_orderkey") % 7).cast("string"), F.lit(".tar"))
    one = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.struct("l_returnflag", "l_partkey", "l_extendedprice")).alias("r")).select(
        "l_orderkey", "l_linenumber", "r.*")
    return one.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("utt_id"),
        F.when(F.col("l_returnflag") == "N", "train").when(F.col("l_returnflag") == "A", "dev")
        .otherwise("eval").alias("split"),
        name.alias("archive_name"),
        F.when(draw("u", "l_orderkey", 3000) == 0, F.md5(F.lit("stale")))
        .when(F.col("l_linenumber") % 2 == 0, F.upper(F.md5(name))).otherwise(F.md5(name)).alias("archive_md5"),
        F.concat(F.lit("m/"), F.col("l_partkey").cast("string"), F.lit(".flac")).alias("member_name"),
        F.floor(F.col("l_extendedprice")).cast("bigint").alias("member_size"),
        F.sha2(F.concat_ws("-", F.col("l_orderkey").cast("string"),
                           F.col("l_linenumber").cast("string")), 256).alias("sha256_extracted"))


def archives(spark: SparkSession, sf: str) -> DataFrame:
    """Published archives with their official checksum and size, one per archive name."""
    o = ledger(spark, sf).groupBy("archive_name").agg(F.sum("member_size").alias("size"))
    return o.select("archive_name", F.md5("archive_name").alias("checksum"), "size")


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Archive members: url paths with planted unsafe names and irregular entries."""
    p = table(spark, sf, "pages")
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    base = F.concat(path, F.lit(".flac"))
    bad = draw("z", "page_id", 23)
    return p.select(
        "page_id",
        F.when(bad == 1, F.concat(F.lit("/"), base))
        .when(bad == 2, F.concat(F.lit("../"), base))
        .when(bad == 3, F.replace(base, F.lit("/"), F.lit("\\")))
        .when(bad == 4, F.concat(F.lit("C:/"), base)).otherwise(base).alias("name"),
        F.length("html").cast("bigint").alias("size"),
        (draw("r", "page_id", 31) != 0).alias("is_regular"))


def master(spark: SparkSession, sf: str) -> DataFrame:
    """Master table: scores, decisions at the EER threshold, quadrants, band features (H9).

    It is written to the shared folder once: every statistic reads it several times.
    """
    from corpuslens.operators.metrics import with_decisions
    from corpuslens.session import freeze
    return freeze(with_decisions(featured(spark, sf), DETECTORS).drop("samples"))


def scored_long(spark: SparkSession, sf: str) -> DataFrame:
    from corpuslens.operators.metrics import scores_long
    return scores_long(scored(spark, sf), DETECTORS, "ground_truth", "sample_id")


def relevance(spark: SparkSession, sf: str, salt: int = 2) -> DataFrame:
    """Signals with input-times-weight relevance of the linear scorer and its logit."""
    w = F.array(*[F.lit(x) for x in weight_values(salt)])
    return signals(spark, sf).select(
        "sample_id", "ground_truth", "samples",
        F.zip_with("samples", w, lambda a, b: a * b).alias("relevance"),
        linear_logit(F.col("samples"), salt).alias("logit"))
