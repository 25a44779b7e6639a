import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens import schemas
from corpuslens.operators import rules
from corpuslens.profiles import ENGLISH, MANDARIN, PORTUGUESE, Profile
from corpuslens.sources import byte_files, files, protocols, sinks
from corpuslens.sources.text_lines import numbered_lines

HEADER = ",".join(schemas.PROTOCOL_COLUMNS)


def kinds(df):
    return sorted({r["rule"] for r in df.collect()})


def test_protocol_reader(spark, tmp_path):
    p = tmp_path / "train.csv"
    p.write_text(HEADER + '\nT_0001,T_0000000001,F,-,A01,generated,yes,eng,"a ""quoted""\nname"\n'
                 "x,T_1,M,,pristine,odd,yes,eng,D\nx,P_1,M,-,x,y,yes,por,D\n", encoding="utf-8")
    df, bad = protocols.read_protocol(spark, str(p), "train", ENGLISH, language="eng")
    rows = df.orderBy("utt_id").collect()
    assert len(rows) == 2 and rows[0]["dataset"] == 'a "quoted"\nname' and rows[1]["codec"] == ""
    assert kinds(bad) == ["malformed_id", "unsupported_label"]


@pytest.mark.parametrize("header,words", [
    ("spk_id,utt_id", "missing columns"), (HEADER + ",more", "extra columns"),
    (",".join(reversed(schemas.PROTOCOL_COLUMNS)), "required order")])
def test_protocol_header_errors(spark, tmp_path, header, words):
    p = tmp_path / "x.csv"
    p.write_text(header + "\n")
    with pytest.raises(rules.RuleViolation, match=words):
        protocols.read_protocol(spark, str(p), "train", ENGLISH)


def test_counterpart_reader_counts_fields(spark, tmp_path):
    p = tmp_path / "x.tsv"
    p.write_text("T_0001 T_0000000001 F - - - AC1 A01 spoof -\nshort line\n  T_2\tT_0000000002 M - - - - - odd -  \n")
    df, bad = protocols.read_counterpart(spark, str(p), "train", ENGLISH)
    assert [r["key"] for r in df.orderBy("utt_id").collect()] == ["spoof", "odd"]
    assert kinds(bad) == ["field_count", "unsupported_key"]


def test_crowd_rows_keep_their_number(spark, tmp_path):
    p = tmp_path / "train.csv"
    line = ["train/a.wav", "t", "v", "d", "", "g", "s", "1", "", "", "", "", "", "", "text"]
    p.write_text(",".join(schemas.CROWD_COLUMNS) + "\n" + ",".join(line) + "\n" + ",".join(["dev/b.wav", *line[1:7], "x", *line[8:]]) + "\n")
    df, bad = protocols.read_crowd(spark, {"train": str(p)})
    rows = df.orderBy("metadata_source_row").collect()
    assert [(r["metadata_source_row"], r["metadata_source_file"], r["down_votes"]) for r in rows] == [("2", "train.csv", ""), ("3", "train.csv", "")]
    assert kinds(bad) == ["invalid_up_votes", "wrong_split_prefix"]


def test_generated_subset_row_number_is_before_the_filter(spark, tmp_path):
    p = tmp_path / "train.csv"
    p.write_text(HEADER + "\nunk,T_0000000001,unk,-,unk,pristine,yes,zho,AISHELL3\nunk,T_0000000002,unk,-,unk,generated,yes,zho,ADD\n"
                 "unk,T_0000000003,unk,-,A01,generated,yes,zho,ADD\n")
    inv = spark.createDataFrame([("r/dataset/Chinese_ADD_Generated/train/wav/T_0000000002.wav",)], "path string")
    df, bad = protocols.read_generated(spark, str(p), "train", MANDARIN, root="r", inventory=inv)
    assert [(r["utt_id"], r["metadata_source_row"]) for r in df.orderBy("utt_id").collect()] == [("T_0000000002", "3"), ("T_0000000003", "4")]
    assert kinds(bad) == ["expected_count", "missing_file", "unexpected_attack_id"]


def test_archive_manifest(spark):
    prof = [f"{s}/wav/SSB0001/SSB0001000{i}.wav" for s, ids in (("train", (1, 2)), ("test", (3, 4, 5))) for i in ids]
    members = spark.createDataFrame([(n, 10, True) for n in prof], "name string, size long, is_regular boolean")
    content = spark.createDataFrame(
        [("train", 1, "SSB00010001.wav\ttext one"), ("train", 2, ""), ("train", 3, "SSB00010002.wav\ttwo"), ("train", 4, "SSB00010009.wav\tlost"),
         ("test", 1, "SSB00010003.wav\tthree"), ("test", 2, "SSB00010004\tfour"), ("test", 3, "SSB00010008.wav\tlost")], "split string, line_no long, value string")
    speakers = spark.createDataFrame([("# comment",), ("SSB0001\tB\tfemale\tnorth",)], "value string")
    labels = spark.createDataFrame([("SSB00010001|a|b",), ("# x",)], "value string")
    out = protocols.read_archive_manifest(members, content, speakers, labels)
    counts = {r["split"]: tuple(r)[1:] for r in out["reconciliation"].collect()}
    assert counts == {"train": (3, 2, 2, 1, 0), "test": (3, 3, 2, 1, 1)}
    rows = {r["utt_id"]: r for r in out["manifest"].collect()}
    assert list(out["manifest"].columns) == schemas.ARCHIVE_MANIFEST_COLUMNS
    assert rows["SSB00010001"]["pinyin"] == "a|b" and rows["SSB00010002"]["metadata_source_row"] == "3"
    assert rows["SSB00010003"]["prosody_available"] == "no" and out["problems"].count() == 0


def test_line_numbers_count_blank_lines_across_splits(spark, tmp_path):
    p = tmp_path / "lines.txt"
    p.write_text("".join(f"line {i}\n" if i % 7 else "\n" for i in range(1, 2001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        df = numbered_lines(spark, str(p))
        rows = df.collect()
        assert df.select("file").distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r["line_no"] for r in rows) == list(range(1, 2001))
    assert all(r["value"] == (f"line {r['line_no']}" if r["line_no"] % 7 else "") for r in rows)


def write_wav(path, x, rate=8000, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(x, dtype="<i2").tobytes())


def test_signals_headers_inventory_and_hashes(spark, tmp_path):
    write_wav(tmp_path / "a.wav", [0, 16384, -32768, 0], 8000)
    write_wav(tmp_path / "b.wav", [1, 2, 3, 4], 22050, channels=2)
    (tmp_path / "c.wav").write_bytes(b"not audio")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_signals(spark, str(tmp_path)).collect()}
    assert [s[0] for s in got["a.wav"]["samples"]] == [0.0, 0.5, -1.0, 0.0] and got["b.wav"]["channels"] == 2
    assert got["b.wav"]["frames"] == 2 and got["c.wav"]["reject_reason"] == byte_files.NOT_WAVE
    heads = {r["path"].rsplit("/", 1)[1]: r for r in files.wav_headers(spark, str(tmp_path)).collect()}
    assert (heads["a.wav"]["frames"], heads["a.wav"]["sample_rate"]) == (4, 8000)
    assert (heads["b.wav"]["frames"], heads["b.wav"]["channels"]) == (2, 2) and heads["c.wav"]["frames"] is None
    import hashlib
    h = {r["name"]: r for r in files.file_hashes(spark, str(tmp_path)).collect()}
    assert h["a.wav"]["sha256"] == hashlib.sha256((tmp_path / "a.wav").read_bytes()).hexdigest()
    assert [r["key"] for r in files.input_evidence(spark, str(tmp_path)).collect()] == ["a.wav", "b.wav", "c.wav"]
    assert files.inventory(spark, str(tmp_path), "*.wav").count() == 3


def test_tables_and_shards(spark, tmp_path):
    df = spark.createDataFrame([(1, "x,\"y\""), (2, "z")], "a int, b string")
    for suffix in ("csv", "parquet"):
        sinks.save_table(df, str(tmp_path / f"t.{suffix}"))
        assert sorted(map(tuple, sinks.load_table(spark, str(tmp_path / f"t.{suffix}")).collect())) == [(1, 'x,"y"'), (2, "z")]
    assert files.shard_column(spark, str(tmp_path / "t.parquet"), "a", 1).count() == 1
    sinks.write_small_csv(df, str(tmp_path / "small.csv"), ["a"])
    part = next((tmp_path / "small.csv").glob("part-*"))
    assert part.read_bytes().startswith(b"a,b\n1,") and b"\r" not in part.read_bytes()


def test_report_is_json_without_non_finite(spark, tmp_path):
    df = spark.createDataFrame([("x", float("nan"), 1.5)], "b string, a double, c double")
    sinks.write_report(df, str(tmp_path / "r"), once=True)
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '{"a":null,"b":"x","c":1.5}'
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_report(df, str(tmp_path / "r"), once=True)


def test_publication_accepts_completes_and_refuses(spark, tmp_path):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    b = spark.createDataFrame([(3,)], "x int")
    root = str(tmp_path / "out")
    assert sinks.publish_set({"a": a}, root) == {"a": "written"}
    assert sinks.publish_set({"a": a.orderBy("x", ascending=False), "b": b}, root) == {"a": "kept", "b": "written"}
    with pytest.raises(sinks.PublicationConflict, match="a"):
        sinks.publish_set({"a": b, "c": b}, root)
    assert not (tmp_path / "out" / "c").exists()


def test_ledger_and_stages(spark, tmp_path):
    df, bad = sinks.read_ledger(spark, str(tmp_path / "none"))
    assert df.count() == 0 and bad.count() == 0 and df.columns == schemas.LEDGER_COLUMNS
    runs = []
    stages = {"one": lambda read: (runs.append(1), spark.range(3))[1], "two": lambda read: read("one").agg(F.sum("id").alias("s"))}
    root = str(tmp_path / "stages")
    assert sinks.run_stages(spark, root, {"k": 1}, stages) == {"one": "done", "two": "done"}
    assert sinks.run_stages(spark, root, {"k": 1}, stages) == {"one": "skipped", "two": "skipped"} and runs == [1]
    assert sinks.run_stages(spark, root, {"k": 2}, stages, only="one") == {"one": "done"}
    assert sinks.run_stages(spark, root, {"k": 1}, stages, start="two", force=True) == {"two": "done"}
    with pytest.raises(ValueError, match="unknown stage"):
        sinks.run_stages(spark, root, {"k": 1}, stages, start="three")


def test_profiles_are_frozen():
    with pytest.raises(TypeError):
        ENGLISH.prefixes["train"] = "X"
    assert isinstance(PORTUGUESE, Profile) and MANDARIN.expected_counts[("dev", "generated")] == 7497


def test_processed_manifest_types_and_present_detectors(spark, tmp_path):
    row = {f.name: (1 if f.dataType.typeName() == "long" else 0.5 if f.dataType.typeName() == "double" else "x") for f in schemas.PROCESSED.fields}
    row["protocol_codec"] = ""
    df = spark.createDataFrame([tuple(row.values())], schemas.PROCESSED)
    sinks.write_manifest(df, str(tmp_path / "m"))
    back = protocols.read_manifest(spark, str(tmp_path / "m"), processed=True)
    assert back.schema.simpleString() == schemas.PROCESSED.simpleString() and back.first()["protocol_codec"] == ""
    assert rules.present_detectors(["p_spoof_ad", "x"]) == ["ad"]


def test_a_file_over_two_gib_is_hashed_in_chunks(spark, tmp_path):
    import hashlib
    import subprocess
    import sys
    size = 2**31 + 12345
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size - 3)
        f.seek(size - 3)
        f.write(b"end")
    (tmp_path / "small.bin").write_bytes(b"abc")
    want = hashlib.sha256()
    block = bytes(1 << 24)
    for start in range(0, size - 3, len(block)):
        want.update(block[:min(len(block), size - 3 - start)])
    want.update(b"end")
    got = {r["name"]: r for r in files.file_hashes(spark, str(tmp_path), "*.bin").collect()}
    assert got["large.bin"]["sha256"] == want.hexdigest() and got["large.bin"]["length"] == size
    assert got["small.bin"]["md5"] == hashlib.md5(b"abc").hexdigest()
    code = f"""
import resource
from corpuslens.sources.byte_files import FileDigests
reader = FileDigests({{"path": {str(tmp_path)!r}}}).reader(None)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert sum(len(list(reader.read(p))) for p in reader.partitions()) == 2 and len(reader.partitions()) == 2
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_wave_chunks_widths_and_rejects(spark, tmp_path):
    x = np.array([[0.5, -0.5], [-1.0, 0.25], [0.125, 0.0]])
    for bits in (8, 16, 24, 32, -32):
        (tmp_path / f"w{bits}.wav").write_bytes(byte_files.wave_bytes(x, 16000, bits, b"odd" if bits != 16 else b""))
    whole = byte_files.wave_bytes(x, 16000, 16)
    (tmp_path / "cut.wav").write_bytes(whole[:-2])
    (tmp_path / "none.wav").write_bytes(byte_files.wave_bytes(np.zeros((0, 1)), 8000, 16))
    (tmp_path / "nan.wav").write_bytes(byte_files.wave_bytes(np.array([[np.nan]]), 8000, -32))
    (tmp_path / "rate.wav").write_bytes(byte_files.wave_bytes(x, 0, 16))
    (tmp_path / "short.wav").write_bytes(b"RIFF")
    (tmp_path / "law.wav").write_bytes(whole[:20] + struct.pack("<H", 7) + whole[22:])
    heads = {r["path"].rsplit("/", 1)[1]: r for r in files.wav_headers(spark, str(tmp_path)).collect()}
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_signals(spark, str(tmp_path)).collect()}
    for bits in (8, 16, 24, 32, -32):
        r = heads[f"w{bits}.wav"]
        assert (r["form"], r["channels"], r["sample_rate"], r["bits"], r["frames"]) == ("float" if bits < 0 else "pcm", 2, 16000, abs(bits), 3)
        assert got[f"w{bits}.wav"]["samples"] == x.tolist()
    why = {n: r["reject_reason"] for n, r in got.items() if r["reject_reason"]}
    assert why == {"cut.wav": byte_files.TRUNCATED, "none.wav": byte_files.EMPTY, "nan.wav": byte_files.NOT_FINITE, "rate.wav": byte_files.BAD_RATE,
                   "short.wav": byte_files.NOT_WAVE, "law.wav": "format 7 of 2 bytes a sample is not supported"}
    assert {n: r["reject_reason"] for n, r in heads.items() if r["reject_reason"]} == {n: w for n, w in why.items() if n != "nan.wav"}
    # Headers are found by seeking: bytes of other chunks and of samples are not read.
    class Counted:
        def __init__(self, data):
            import io
            self.f, self.n = io.BytesIO(data), 0

        def read(self, k):
            out = self.f.read(k)
            self.n += len(out)
            return out

        def seek(self, at):
            self.f.seek(at)
    data = byte_files.wave_bytes(np.zeros((100_000, 1)), 8000, 16, b"x" * 50_000)
    f = Counted(data)
    assert byte_files.find_chunks(f, len(data)).frames == 100_000 and f.n == 12 + 3 * 8 + 16


def test_parts_of_files_follow_their_bytes():
    parts = byte_files.dealt([("a", 10), ("big", 10**9), ("c", 5), ("d", 0)], part_bytes=4 << 20)
    assert sorted(f for p in parts for f in p.files) == [("a", 10), ("big", 10**9), ("c", 5), ("d", 0)]
    assert [p.files for p in parts if len(p.files) == 1 and p.files[0][0] == "big"]
