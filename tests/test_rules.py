import pytest

from corpuslens import schemas
from corpuslens.operators import reconcile, rules, storage
from corpuslens.profiles import ENGLISH, MANDARIN, PORTUGUESE


def found(df):
    return sorted((r["rule"], r["key"]) for r in df.collect())


def test_schema_problems_are_three_kinds():
    want = ["a", "b"]
    assert rules.schema_problems(["a", "b"], want) == []
    assert rules.schema_problems(["a"], want) == ["missing columns: b"]
    assert rules.schema_problems(["a", "b", "c"], want) == ["extra columns: c"]
    assert rules.schema_problems(["b", "a"], want) == ["columns are not in the required order"]


def test_ids_paths_and_votes(spark):
    ids = spark.createDataFrame([("T_0000000001", "train"), ("D_0000000001", "train"), ("T_1", "train")], "utt_id string, split string")
    assert found(rules.malformed_ids(ids, ENGLISH)) == [("malformed_id", "D_0000000001"), ("malformed_id", "T_1")]
    paths = spark.createDataFrame([("train/a.wav", "train"), ("", "train"), ("/x", "train"), ("train/../x", "train"), ("dev/a", "train")],
                                  "file_path string, split string")
    rows = found(rules.path_rules(paths))
    assert ("empty_path", "") in rows and ("absolute_path", "/x") in rows
    assert ("parent_reference", "train/../x") in rows and ("wrong_split_prefix", "dev/a") in rows
    votes = spark.createDataFrame([("a", "3"), ("b", ""), ("c", "-1")], "k string, v string")
    assert found(rules.non_digit_votes(votes, "k", ["v"])) == [("invalid_v", "c")]


def test_combination_kinds(spark):
    rows = [("por", "generated", "MLAAD"), ("por", "pristine", "CORAA"), ("eng", "generated", "X"),
            ("por", "generated", "OTHER"), ("por", "pristine", "MLAAD"), ("por", "pristine", "OTHER")]
    df = spark.createDataFrame(rows, "language string, label string, dataset string")
    assert found(rules.bad_combinations(df, PORTUGUESE)) == [
        ("unexpected_combination", "pristine"), ("unexpected_dataset", "OTHER"), ("unexpected_label", "pristine")]


def test_sparse_fields(spark):
    df = spark.createDataFrame([("unk", "unk", "unk", "-", "yes"), ("A01", "unk", "unk", "-", "no")],
                               "attack_id string, gender string, spk_id string, codec string, native string")
    assert found(rules.sparse_field_values(df, MANDARIN.sparse_fields)) == [("unexpected_attack_id", "A01"), ("unexpected_native", "no")]


def test_assert_clean(spark):
    clean = spark.createDataFrame([], rules.VIOLATION)
    rules.assert_clean(clean)
    with pytest.raises(rules.RuleViolation, match="duplicate_key"):
        rules.assert_clean(spark.createDataFrame([("duplicate_key", "a", "2")], rules.VIOLATION))


def test_members(spark):
    rows = [("train/wav/SSB0001/SSB00010001.wav", 1, True), ("test/wav/SSB0002/SSB00010002.wav", 1, True),
            ("../x", 1, True), ("a\\b", 1, True), ("C:/x", 1, True), ("dev/..x", 1, True),
            ("train/wav/SSB0001/SSB00010009.wav", 1, False)]
    df = spark.createDataFrame(rows, "name string, size long, is_regular boolean")
    assert found(rules.member_rules(df)) == sorted([
        ("speaker_mismatch", "test/wav/SSB0002/SSB00010002.wav"), ("unsafe_member", "../x"), ("unsafe_member", "a\\b"),
        ("unsafe_member", "C:/x"), ("irregular_member", "train/wav/SSB0001/SSB00010009.wav")])


def test_measure_tolerance(spark):
    declared = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.5), ("c", 1, None)], "utt_id string, n long, x double")
    actual = spark.createDataFrame([("a", 1, 0.5 + 1e-13), ("b", 1, 0.5 + 1e-9), ("c", 1, 0.1)], "utt_id string, n long, x double")
    assert found(rules.measure_differences(declared, actual, "utt_id", ["n"], ["x"])) == [
        ("n_differs", "b"), ("x_differs", "b"), ("x_differs", "c")]


def test_correspondence_counts_label_even_if_speaker_differs(spark):
    left = spark.createDataFrame([("s1", "T_1", "F", "pristine", "train"), ("s2", "T_2", "M", "generated", "train"),
                                  ("s3", "T_3", "M", "generated", "train")], "spk_id string, utt_id string, gender string, label string, split string")
    right = spark.createDataFrame([("other", "T_1", "F", "bonafide", "train"), ("s2", "T_2", "M", "bonafide", "train"),
                                   ("s9", "T_9", "M", "spoof", "train")], "spk_id string, utt_id string, gender string, key string, split string")
    pairs = reconcile.paired(left, right, ENGLISH)
    r = reconcile.correspondence(pairs).first()
    assert (r["pristine_matched"], r["generated_matched"], r["missing_ids"], r["extra_ids"], r["mismatched"]) == (1, 0, 1, 1, 2)
    rows = {(p["kind"], p["utt_id"], p["field"]) for p in reconcile.correspondence_problems(pairs).collect()}
    assert rows == {("mismatch", "T_1", "spk_id"), ("mismatch", "T_2", "label"), ("missing", "T_3", ""), ("extra", "T_9", "")}


def test_fingerprint_sees_columns_copies_and_split_but_not_order(spark):
    df = spark.createDataFrame([("a", "b", "train"), ("c", "d", "train")], "x string, y string, split string")
    def fp(d, cols=("x", "y")):
        return reconcile.table_fingerprint(d, ["split"], list(cols)).first()["fingerprint"]
    base = fp(df)
    assert fp(df.orderBy("x", ascending=False)) == base
    assert fp(df, ("y", "x")) != base
    assert fp(df.union(df.limit(1))) != base
    from pyspark.sql import functions as F
    assert fp(df.withColumn("split", F.lit("dev"))) != base


def test_upsert_replaces_by_key(spark):
    a = spark.createDataFrame([("1", "old"), ("2", "old")], "utt_id string, v string")
    b = spark.createDataFrame([("2", "new"), ("3", "new")], "utt_id string, v string")
    assert sorted(map(tuple, reconcile.upsert(a, b).collect())) == [("1", "old"), ("2", "new"), ("3", "new")]


def test_ceil_div_and_space(spark):
    df = spark.createDataFrame([(10, True), (4097, False)], "size long, present boolean")
    r = storage.space_estimate(df).first()
    assert r["missing_output_allocated_bytes"] == 8192 and r["largest_temporary_bytes"] == 8192
    assert r["manifest_reserve_bytes"] == 2 << 20 and r["safety_reserve_bytes"] == 1 << 30


def test_processed_schema_order():
    assert schemas.PROCESSED_COLUMNS[:15] == schemas.MANIFEST_COLUMNS
    assert rules.manifest_stage(schemas.MANIFEST_COLUMNS) == "raw"
    with pytest.raises(rules.RuleViolation):
        rules.manifest_stage(["utt_id"])
