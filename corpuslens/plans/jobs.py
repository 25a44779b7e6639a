"""Jobs composed of the operators (I)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpuslens.functions import dsp, signal
from corpuslens.operators import (audit, compare, effects, metrics, models, profiling, reconcile, rules, sampling,
                                  stats)
from corpuslens.operators.order import attach_row
from corpuslens.profiles import Profile
from corpuslens.schemas import MANIFEST_COLUMNS
from corpuslens.session import freeze, stored
from corpuslens.sources import sinks


# --- corpus preparation -----------------------------------------------------------------------

def validate_protocols(left: DataFrame, right: DataFrame, profile: Profile) -> dict[str, DataFrame]:
    """Correspondence report with fingerprints, its problems, expected counts, and what either side breaks.

    Copies of an id are compared once; that they exist is among the violations.
    """
    reduced = reconcile.reduce_to(right, left)
    pairs = reconcile.paired(left, reduced, profile)
    report = reconcile.correspondence(pairs)
    for side, df in (("left", left), ("right", reduced), ("left_full", left), ("right_full", right)):
        prints = reconcile.table_fingerprint(df, ["split"], [c for c in df.columns if c != "split"]).select(
            "split", F.col("fingerprint").alias(f"{side}_fingerprint"))
        report = report.join(prints, "split", "left")
    matched = pairs.filter("label_matched").select("split", F.col("left_label").alias("label"))
    counts = rules.count_differences(matched, profile.expected(left.sparkSession), ["split", "label"])
    return {"report": report, "problems": reconcile.correspondence_problems(pairs), "counts": counts,
            "violations": rules.protocol_rules(left, right, profile)}


def build_manifest(left: DataFrame, right: DataFrame, files: DataFrame, profile: Profile) -> dict[str, DataFrame]:
    """Raw manifest with evidence, paths and file hashes, and its violations and those of its inputs.

    ``files`` holds ``path`` and ``sha256``; a source without a file is a violation.
    """
    rows = reconcile.with_evidence(left.drop("codec"), right)
    pristine = F.col("label") == "pristine"
    root = F.when(pristine, profile.pristine_root).otherwise(profile.generated_root)
    path = F.concat_ws("/", root, F.col("split"), F.concat(F.col("utt_id"), F.when(pristine, ".flac").otherwise(".wav")))
    hashed = rows.withColumn("source_path", path).join(
        files.select(F.col("path").alias("source_path"), F.col("sha256").alias("sha256_source")), "source_path", "left")
    out = hashed.withColumn("sha256_source", F.coalesce("sha256_source", F.lit(""))).withColumn(
        "processed_path", F.lit("")).withColumn("sha256_processed", F.lit("")).withColumn(
        "metadata_source", F.lit(profile.metadata_source)).select(*MANIFEST_COLUMNS)
    problems = rules.union_all([rules.manifest_rules(out, profile), rules.protocol_rules(left, right, profile)])
    return {"manifest": out, "problems": problems}


def enrich(manifest: DataFrame, signals: DataFrame, key: str, target_rate: int) -> DataFrame:
    """Source and processed measures of every signal.

    ``signals`` has the key, ``sample_rate`` and ``samples`` (frames x channels).
    """
    s = signals.withColumn("_out", dsp.standardise(F.col("samples"), F.col("sample_rate"), target_rate))
    flat = F.flatten("samples")
    measures = s.select(
        key, F.col("sample_rate").cast("bigint").alias("source_sample_rate"),
        F.size(F.get("samples", F.lit(0))).cast("bigint").alias("source_channels"),
        F.size("samples").cast("bigint").alias("source_frames"),
        (F.size("samples") / F.col("sample_rate")).alias("source_duration_seconds"),
        signal.peak(flat).alias("source_peak"), signal.rms(flat).alias("source_rms"),
        F.lit(target_rate).cast("bigint").alias("processed_sample_rate"),
        F.lit(1).cast("bigint").alias("processed_channels"),
        F.size("_out").cast("bigint").alias("processed_frames"),
        (F.size("_out") / F.lit(float(target_rate))).alias("processed_duration_seconds"),
        signal.peak(F.col("_out")).alias("processed_peak"), signal.rms(F.col("_out")).alias("processed_rms"))
    return manifest.join(measures, key)


def verify_processed(declared: DataFrame, measured: DataFrame, key: str = "utt_id") -> DataFrame:
    """Differences between declared and recomputed measures, nothing written (I4)."""
    integers = [f"{p}_{n}" for p in ("source", "processed") for n in ("sample_rate", "channels", "frames")]
    floats = [f"{p}_{n}" for p in ("source", "processed") for n in ("duration_seconds", "peak", "rms")]
    return rules.measure_differences(declared, measured, key, integers, floats)


def audited(df: DataFrame, samples: str = "samples", rate: str = "sample_rate", prefix: str = "source") -> DataFrame:
    """Silence ratio, level, noise proxy and their unavailable reasons.

    ``samples`` is one signal or frames of channel values: peak, level and silence then count every
    channel's samples, and the noise proxy hears the average of the channels.
    """
    x = F.col(samples)
    heard = x
    if isinstance(df.schema[samples].dataType.elementType, T.ArrayType):
        x, heard = F.flatten(x), signal.mono(x)
    level = signal.rms(x)
    snr, reason = signal.snr_parts(heard, F.col(rate))
    return df.withColumn(f"{prefix}_peak", signal.peak(x)).withColumn(f"{prefix}_rms", level).withColumn(
        f"{prefix}_silence_ratio", signal.silence_ratio(x)).withColumn(
        f"{prefix}_rms_dbfs", signal.dbfs(F.col(f"{prefix}_rms"))).withColumn(
        f"{prefix}_rms_dbfs_unavailable_reason", signal.dbfs_reason(F.col(f"{prefix}_rms"))).withColumn(
        f"{prefix}_estimated_snr_db", snr).withColumn(f"{prefix}_estimated_snr_db_unavailable_reason", reason)


# The dimension tuples that an audit counts besides the cube.
STRUCTURED = (("split", "label", "protocol_codec"), ("split", "label", "source_format", "source_subtype"),
              ("split", "label", "output_format", "output_subtype"))


def audit_and_publish(df: DataFrame, measures: Sequence[str], profile: Profile, root: str) -> dict[str, str]:
    """Audit tables of one enriched frame, computed from one copy of it and published as one set."""
    frame = stored(df, "audited")
    tables = {"audit_rows": frame, "counts": audit.grouping_counts(frame),
              "structured_counts": audit.structured_counts(frame, STRUCTURED),
              "source_groups": audit.group_counts(frame),
              "duplicate_processed_hashes": audit.members_of_repeated(
                  frame.filter(F.coalesce(F.col("sha256_processed"), F.lit("")) != ""), "sha256_processed", "utt_id", "split"),
              "cross_split_speakers": audit.cross_split_speakers(frame, profile),
              "duplicate_hashes": audit.members_of_repeated(frame, "sha256_source", "utt_id", "split"),
              "missing_values": audit.missing_values(frame),
              "distributions": audit.distributions(frame, measures),
              "cross_split_groups": audit.cross_split_groups(frame, profile),
              "duplicate_groups": audit.duplicate_groups(frame, "utt_id", "split")}
    return sinks.publish_set(tables, root)


def two_source_metadata(pristine: DataFrame, generated: DataFrame, names: Mapping[str, str],
                        pristine_fields: Mapping[str, Sequence[str]],
                        generated_fields: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Profiles and summary of a pristine and a generated source.

    The field maps have the classes ``categorical``, ``length`` and ``votes``.
    """
    out = {}
    parts = []
    for role, df, fields in (("pristine", pristine, pristine_fields), ("generated", generated, generated_fields)):
        out[f"{role}_manifest"] = df
        out[f"{role}_profile"] = profiling.field_profiles(
            df, sorted(df.columns), length_fields=fields.get("length", ()), vote_fields=fields.get("votes", ()))
        path = "audio_path" if "audio_path" in df.columns else None
        parts.append(profiling.source_profile(df, names[role], fields.get("categorical", ()),
                                              fields.get("votes", ()), path).withColumn("role", F.lit(role)))
    out["summary"] = rules.union_all(parts)
    return out


def provenance(evidence: DataFrame, schemas: Mapping[str, Sequence[str]], origins: Mapping[str, str],
               exclusions: Mapping[str, str]) -> DataFrame:
    """Inputs, schema positions, field origins and exclusions as one long table."""
    spark = evidence.sparkSession
    rows = [("schema", table, str(i), column) for table, cols in schemas.items() for i, column in enumerate(cols)]
    rows += [("origin", field, "", words) for field, words in origins.items()]
    rows += [("exclusion", name, "", why) for name, why in exclusions.items()]
    fixed = spark.createDataFrame(rows, "block string, name string, detail string, value string")
    inputs = evidence.select(F.lit("input").alias("block"), F.col("key").alias("name"),
                             F.col("size_bytes").cast("string").alias("detail"), F.col("sha256").alias("value"))
    return fixed.unionByName(inputs)


# --- detector analysis ------------------------------------------------------------------------

def performance(master: DataFrame, tags: Sequence[str], label: str = "ground_truth") -> DataFrame:
    """EER, MCC and accuracy per detector from the stored decisions."""
    long = metrics.scores_long(master, tags, label)
    eer = metrics.equal_error_rate(long, ["detector"], "score", label).select("detector", "eer")
    cells = F.array(*[F.struct(F.lit(t).alias("detector"), F.col(f"pred_{t}").alias("pred")) for t in tags])
    rows = master.select(label, F.explode(cells).alias("d")).select(label, "d.*")
    c = metrics.confusion(rows, ["detector"], label, F.col("pred") == 1)
    four = [F.col(x) for x in ("tp", "tn", "fp", "fn")]
    scores = c.select("detector", metrics.matthews(*four).alias("mcc"),
                      ((F.col("tp") + F.col("tn")) / sum(four[1:], four[0])).alias("accuracy"))
    return eer.join(scores, "detector")


def collect_samples(df: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Balanced sample with its shuffled position and provenance columns kept (I16)."""
    return sampling.balanced(df, label, [key], n, seed)


def association_stage(master: DataFrame, features: Sequence[str]) -> DataFrame:
    """Correlations with p and q for the detectors that are present."""
    return stats.association(master, rules.present_detectors(master.columns), features)


def confirmatory_stage(master: DataFrame, correlations: DataFrame, features: Sequence[str], top_n: int) -> DataFrame:
    """Group tests on the most associated features only."""
    tags = rules.present_detectors(master.columns)
    top = F.broadcast(stats.top_features(correlations, top_n).select("feature"))
    values = stats.quadrant_values(master, tags, features).join(top, "feature", "left_semi")
    return stats.confirmatory(values)


def _drawn(rows: DataFrame, quad: str, per_quadrant: int | None, seed: int) -> DataFrame:
    rows = rows.filter(F.col(quad).isNotNull())
    return rows if per_quadrant is None else sampling.up_to(rows, [quad], ["sample_id"], per_quadrant, seed)


def occlusion_stage(master: DataFrame, signals: DataFrame, scorers: Mapping[str, effects.Scorer],
                    features: Sequence[str], rate: int, edges: Sequence[float], win: int, hop: int, *,
                    per_quadrant: int | None = None, n_boot: int = 1000, k: int | None = None,
                    seed: int = 42) -> dict[str, DataFrame]:
    """Occlusion table, agreement of the two profiles and the convergence test.

    ``master`` has no samples; ``signals`` has ``sample_id`` and ``samples``.  All clips are measured;
    ``per_quadrant`` draws a sample instead.
    """
    n = len(edges) - 1
    tags = list(scorers)
    # A small table that several branches read: the ranking behind it runs once.
    whole = freeze(stats.band_strength(stats.within_class_correlation(master, tags, features), tags, n))
    tables = []
    for tag, scorer in scorers.items():
        picked = _drawn(master, f"quadrant_{tag}", per_quadrant, seed).select("sample_id")
        clips = signals.join(picked, "sample_id").select("sample_id", "samples")
        drops = freeze(effects.band_drops(clips, scorer, rate, edges, win, hop).drop("samples"))
        tables.append(effects.occlusion_table(drops, tag, edges, ["sample_id"], n_boot=n_boot, seed=seed))
    occlusion = rules.union_all(tables)
    return {"occlusion": occlusion, "agreement": effects.profile_agreement(occlusion, whole),
            "convergence": convergence_test(master, signals, scorers, features, rate, edges, win, hop, per_quadrant=per_quadrant,
                                            n_boot=n_boot, k=k, seed=seed)}


def convergence_test(master: DataFrame, signals: DataFrame, scorers: Mapping[str, effects.Scorer],
                     features: Sequence[str], rate: int, edges: Sequence[float], win: int, hop: int, *,
                     per_quadrant: int | None = None, n_boot: int = 1000, k: int | None = None,
                     seed: int = 42) -> DataFrame:
    """Bands ranked on one half of the clips, their effects tested on the other half.

    The clips of the other half meet their samples once, for all detectors.
    """
    n, tags = len(edges) - 1, list(scorers)
    k = k or max(1, n // 3)
    narrow = master.select("sample_id", "ground_truth", *[f"p_spoof_{t}" for t in tags], *features, *[f"quadrant_{t}" for t in tags])
    split = freeze(sampling.halves(narrow, ["sample_id"], seed))
    half = freeze(stats.band_strength(stats.within_class_correlation(split.filter(F.col("half") == 0), tags, features), tags, n))
    held = split.filter(F.col("half") == 1)
    ids = held.select("sample_id", *[F.col(f"quadrant_{t}").isNotNull().alias(f"_has_{t}") for t in tags])
    if per_quadrant is not None:
        marked = [_drawn(held, f"quadrant_{t}", per_quadrant, seed).select(
            "sample_id", *[F.lit(o == t).alias(f"_has_{o}") for o in tags]) for t in tags]
        ids = rules.union_all(marked).groupBy("sample_id").agg(*[F.max(f"_has_{t}").alias(f"_has_{t}") for t in tags])
    rows = signals.join(ids, "sample_id").select("sample_id", "samples", *[f"_has_{t}" for t in tags])
    cells = []
    for tag, scorer in scorers.items():
        drops = effects.band_drops(rows, scorer, rate, edges, win, hop)
        rows = drops.select(*rows.columns, F.struct(*[f"drop_{b}" for b in range(n)]).alias(f"_drops_{tag}"))
        cells.append(F.when(F.col(f"_has_{tag}"), F.struct(F.lit(tag).alias("detector"), F.col(f"_drops_{tag}").alias("d"))))
    long = rows.select("sample_id", F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.detector", "sample_id", "c.d.*")
    long = freeze(long)
    found = [effects.oriented_effects(long.filter(F.col("detector") == tag), half, tag, k, n).select(
        "detector", "sample_id", "top_effect", "bottom_effect") for tag in tags]
    tested = stats.paired_test(freeze(rules.union_all(found)), ["detector"], "top_effect", "bottom_effect",
                               ["sample_id"], n_boot=n_boot, seed=seed)
    named = sampling.top_and_bottom(half, k)

    def listed(rank: str) -> Column:
        hit = F.when(F.col(rank) <= k, F.struct(F.col(rank).alias("r"), F.col("band").cast("string").alias("b")))
        return F.array_join(F.transform(F.array_sort(F.array_compact(F.collect_list(hit))), lambda s: s["b"]), ";")

    bands = named.groupBy("detector").agg(listed("top_rank").alias("top_bands"), listed("bottom_rank").alias("bottom_bands"))
    return tested.join(bands, "detector").withColumn("k_bands", F.lit(k))


def faithfulness_rows(clips: DataFrame, scorer: effects.Scorer, rate: int, edges: Sequence[float], win: int,
                      hop: int, ks: Sequence[int], draws: int, seed: int = 0) -> DataFrame:
    """Rows (clip, class, condition, k, p_pred, p_orig) of the keep/delete study.

    ``clips`` has sample_id, ground_truth, samples, relevance and logit.
    """
    n = len(edges) - 1
    freqs = _rfft(win, rate)
    heard = F.col("samples")
    # Kernels of one projection share a Python worker; only sums over time come back from it.
    made = [dsp.bin_relevance(heard, F.col("relevance"), win, hop).alias("_bins")]
    if isinstance(scorer, effects.LinearScorer):
        made.append(scorer.shares(heard, rate, edges, win, hop).alias("shares"))
        heard = F.col("shares")
    c = clips.select("sample_id", "ground_truth", "samples", "logit", *made)
    c = c.withColumn("predicted", F.col("logit") > 0).withColumn(
        "ranking", sampling.ranked_bands(effects.band_sums(F.col("_bins"), freqs, edges, "last_closed"), F.col("logit") > 0))
    p = scorer(F.col("samples"))
    c = c.withColumn("p_orig", F.when(F.col("predicted"), p).otherwise(1.0 - p)).withColumn(
        "true_class", stats.class_name(F.col("ground_truth"))).select(
        "sample_id", "true_class", heard, "predicted", "ranking", "p_orig")
    grid = effects.intervention_grid(c, ks, draws, n, "sample_id", seed=seed)
    return effects.intervention_scores(grid, scorer, rate, edges, win, hop,
                                       ["sample_id", "true_class", "p_orig"])


def _rfft(win: int, rate: int) -> list[float]:
    return [i * rate / win for i in range(win // 2 + 1)]


def clip_export(clips: DataFrame, scorer: effects.Scorer, rate: int, edges: Sequence[float], win: int, hop: int,
                k: int, seed: int = 0) -> DataFrame:
    """Variant x kept bands x probability of chosen clips.

    ``clips`` has sample_id, true_class, samples, predicted and ranking.
    """
    n = len(edges) - 1
    every = F.array(*[F.lit(i) for i in range(n)])
    top = F.slice("ranking", 1, k)
    rand = sampling.random_bands(n, F.lit(k), F.lit(str(seed)), "sample_id")
    variants = F.array(*[F.struct(F.lit(name).alias("variant"), bands.alias("kept")) for name, bands in (
        ("original", every), (f"keep_top{k}", top), (f"delete_top{k}", sampling.complement(n, top)),
        (f"keep_rand{k}", rand), (f"delete_rand{k}", sampling.complement(n, rand)))])
    rows = clips.withColumn("_v", F.explode(variants)).select("*", "_v.*")
    y = rows.withColumn("_y", dsp.keep_bands(F.col("samples"), F.col("kept"), rate, edges, win, hop))
    heard = F.when(F.col("variant") == "original", F.col("samples")).otherwise(F.col("_y"))
    p = scorer(heard)
    label = F.when(F.col("variant") == "original", "all").otherwise(signal.kept_bands_label(F.col("kept"), list(edges)))
    return y.select("sample_id", "true_class", stats.class_name(F.col("predicted").cast("int")).alias("pred"), "variant",
                    F.round(F.when(F.col("predicted"), p).otherwise(1.0 - p), 4).alias("p_pred"),
                    label.alias("kept_bands_khz"))


def population_relevance(clips: DataFrame, by: Sequence[str], rate: int, win: int, hop: int,
                         excluded: Sequence[str] = ()) -> DataFrame:
    """Population time-frequency table of several models, some left out."""
    kept = clips.filter(~F.col(by[0]).isin(*excluded)) if excluded else clips
    tf = dsp.time_frequency_relevance(F.col("samples"), F.col("relevance"), rate, win, hop)
    return effects.population_map(kept.select(*by, tf.alias("_tf")).select(*by, F.col("_tf.r_tf").alias("r_tf")), by)


def compare_runs(performance_rows: DataFrame, relevance: DataFrame, scores: DataFrame, runs: Sequence[str], *,
                 excluded: Sequence[str] = (), k: int = 5) -> dict[str, DataFrame]:
    """Comparison table, band and clip agreement, top bands across runs."""
    kept = [r for r in runs if r not in excluded]
    rel = relevance.filter(F.col("run").isin(*kept))
    return {"comparison": compare.comparison_table(performance_rows.filter(F.col("run").isin(*kept)), "run"),
            "band_agreement": compare.rank_agreement(rel, kept, "run", "band", "relevance", 3),
            "clip_agreement": compare.rank_agreement(scores, kept, "run", "sample_id", "p_spoof", 50),
            "top_bands": compare.top_bands(rel, "run", "band_center_hz", "relevance", k)}


def same_clips(chosen: DataFrame, scores: DataFrame, runs: Sequence[str], label: str = "ground_truth") -> DataFrame:
    """Clip x run: score, decision and hit or miss."""
    rows = scores.join(chosen.select("sample_id"), "sample_id", "left_semi").filter(F.col("run").isin(*runs))
    pred = (F.col("p_spoof") > 0.5).cast("int")
    return rows.select("sample_id", "run", F.col(label), "p_spoof", pred.alias("pred"),
                       F.when(pred == F.col(label), "hit").otherwise("miss").alias("outcome"))
