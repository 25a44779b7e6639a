"""Ordered schemas.  Column order is part of the contract."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Column names and order of the published tables.
PROTOCOL_COLUMNS = ["spk_id", "utt_id", "gender", "codec", "attack_id", "label", "native",
                    "language", "dataset"]
COUNTERPART_COLUMNS = ["spk_id", "utt_id", "gender", "codec", "codec_q", "codec_seed",
                       "attack_tag", "attack_id", "key", "tmp"]
VOTE_COLUMNS = ["up_votes", "down_votes", "votes_for_hesitation", "votes_for_filled_pause",
                "votes_for_noise_or_low_voice", "votes_for_second_voice",
                "votes_for_no_identified_problem"]
CROWD_COLUMNS = ["file_path", "task", "variety", "dataset", "accent", "speech_genre",
                 "speech_style", *VOTE_COLUMNS, "text"]
TRACE_COLUMNS = ["split", "metadata_source_file", "metadata_source_row"]
MANIFEST_COLUMNS = ["utt_id", "spk_id", "gender", "language", "dataset", "split", "label",
                    "attack_id", "protocol_codec", "source_group_id", "source_path",
                    "processed_path", "sha256_source", "sha256_processed", "metadata_source"]
MEASURE_INTEGERS = ["sample_rate", "channels", "frames"]
MEASURE_FLOATS = ["duration_seconds", "peak", "rms"]
LEDGER_COLUMNS = ["utt_id", "split", "archive_name", "archive_md5", "member_name",
                  "member_size", "sha256_extracted"]
ARCHIVE_MANIFEST_COLUMNS = ["utt_id", "split", "archive_member_path", "speaker_id", "gender",
                            "age", "accent", "transcription", "pinyin", "prosody_available",
                            "metadata_source_file", "metadata_source_row"]

PROTOCOL = _strings(PROTOCOL_COLUMNS)
COUNTERPART = _strings(COUNTERPART_COLUMNS)
CROWD = _strings(CROWD_COLUMNS)
MANIFEST = _strings(MANIFEST_COLUMNS)
LEDGER = T.StructType([
    T.StructField(n, T.LongType() if n == "member_size" else T.StringType())
    for n in LEDGER_COLUMNS])
PROCESSED = T.StructType(list(MANIFEST.fields) + [
    T.StructField(f"{prefix}_{name}",
                  T.LongType() if name in MEASURE_INTEGERS else T.DoubleType())
    for prefix in ("source", "processed") for name in MEASURE_INTEGERS + MEASURE_FLOATS])
PROCESSED_COLUMNS = [f.name for f in PROCESSED.fields]
SIGNAL = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("sample_rate", T.LongType()),
    T.StructField("channels", T.LongType()), T.StructField("frames", T.LongType()),
    T.StructField("samples", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("reject_reason", T.StringType())])
