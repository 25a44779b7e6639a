"""Cases of the third round of findings."""

import ast
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpuslens.plans
from corpuslens.functions import dsp
from corpuslens.operators import reconcile, rules, storage
from corpuslens.plans import jobs, load_queries, views
from corpuslens.schemas import LEDGER
from corpuslens.streaming import ledger_stream

PLANS = sorted(Path(corpuslens.plans.__file__).parent.glob("*.py"))


@pytest.mark.parametrize("path", PLANS, ids=lambda p: p.stem)
def test_no_constant_is_named_twice(path):
    # A query reads its module's names when it runs, so a second value would replace the first one's.
    names = Counter(t.id for n in ast.parse(path.read_text()).body if isinstance(n, ast.Assign)
                    for t in n.targets if isinstance(t, ast.Name) and t.id != "_")
    assert not [n for n, count in names.items() if count > 1]


def test_inventory_takes_the_first_member_of_a_name(spark):
    # Equal names: the member that stands first in the archive tells the size, not the smallest one.
    members = spark.createDataFrame([(3, "a/x.flac", 5, True), (1, "a/x.flac", 9, True), (2, "b/x.flac", 1, True), (0, "a/x.flac", None, True)],
                                    "place int, name string, size long, is_regular boolean")
    assert storage.inventory_summary(storage.inventory(members), "place").collect() == [("x", 4, "a/x.flac", 9)]


def test_misplaced_members_leave_repeats_to_their_own_rule(spark):
    name = "train/wav/SSB0001/SSB00010009.wav"
    members = spark.createDataFrame([(name, True), (name, False)], "name string, is_regular boolean")
    assert rules.misplaced_members(members).collect() == [("irregular_member", name, name)]
    assert rules.member_rules(members).count() == 2


def test_misfiled_members_of_pages_past_ten_thousand(spark, tmp_path):
    # Four places hold only the first digits of 10800, which gives it the name of 1080.
    spark.createDataFrame([(1080,), (10800,)], "page_id long").write.parquet(f"{tmp_path}/pages.parquet")
    name = "test/wav/SSB0000/SSB00001080.wav"
    assert load_queries()[0]["rule_misfiled_members"](spark, str(tmp_path)).collect() == [("irregular_member", name, name)]


def test_quota_of_a_table_in_a_folder(spark, tmp_path):
    rows = spark.range(60).selectExpr("id as vec_id", "array(cast(1 as float)) as embedding", "if(id < 53, 0, 1) as label")
    rows.repartition(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = load_queries()[0]["stream_class_quota"](spark, str(tmp_path)).collect()
    assert sorted(found) == [(0, 40), (1, 7)]


def test_kernels_of_a_batch_work_on_buffers():
    # 10,000 signals as Spark hands them over: no object for each number, and only a chunk in a kernel at once.
    signals = pa.ListArray.from_arrays(pa.array(np.arange(10_001, dtype=np.int32) * 64), pa.array(np.random.default_rng(1).normal(size=640_000)))
    seen = []

    def kernel(m):
        seen.append(m.size)
        return dsp._framed_power(m, 16, 8)

    tracemalloc.start()
    out = dsp.in_order(dsp.by_length([signals], kernel), len(signals), 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(seen) <= dsp.CHUNK_VALUES and sum(seen) == 640_000
    assert out.type == pa.list_(pa.list_(pa.float64())) and len(out) == 10_000 and peak < 64e6


def test_rows_of_a_batch_keep_their_order():
    x = pa.array([[1.0, 2.0], None, [3.0], [4.0, None], []], pa.list_(pa.float64())).slice(0, 5)
    y = pa.array([[1.0, 1.0], [1.0], [1.0, 5.0], [2.0, 2.0], []], pa.list_(pa.float64()))
    doubled = dsp.in_order(dsp.by_length([x], lambda m: m * 2), 5).to_pylist()
    assert doubled[:3] == [[2.0, 4.0], None, [6.0]] and doubled[3][0] == 8.0 and np.isnan(doubled[3][1]) and doubled[4] == []
    sums = dsp.in_order(dsp.by_length([x.slice(1), y.slice(1)], lambda a, b: a + b, usable=np.array([True, True, True, False])), 4).to_pylist()
    assert sums[:2] == [None, None] and sums[2][0] == 6.0 and sums[3] is None
    assert dsp.in_order([], 2, 2).to_pylist() == [None, None]


def test_one_update_of_the_ledger_is_read_without_a_shuffle(spark, tmp_path):
    row = ("u1", "train", "a.tar", "m", "f", 1, "s")
    make = lambda rows: spark.createDataFrame(rows, LEDGER).select(*LEDGER.names)
    ledger_stream.apply_batch(make([row, ("u2", *row[1:])]), 0, str(tmp_path), "run")
    alone = ledger_stream.read_ledger(spark, str(tmp_path))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString() and alone.count() == 2
    ledger_stream.apply_batch(make([("u1", "dev", *row[2:])]), 1, str(tmp_path), "run")
    assert sorted((r.utt_id, r.split) for r in ledger_stream.read_ledger(spark, str(tmp_path)).collect()) == [("u1", "dev"), ("u2", "train")]


def test_missing_keys_meet_the_inventory_once(spark):
    targets = spark.createDataFrame([(f"u{i:02d}", "train") for i in range(30)], "utt_id string, split string")
    found = reconcile.missing_preview(targets, spark.createDataFrame([("u00",), ("u00",), ("u02",)], "utt_id string"), 2)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.collect() == [(28, "train:u01, train:u03", 26)]


def test_held_extractions_collect_no_sets(spark):
    # Sets would be collected by an aggregate that sorts both tables before and after the shuffle.
    ledger = spark.createDataFrame([("u1", "train", "a", "M", "s"), ("u1", "dev", "a", "m", "s"), ("u2", "train", "a", "m", "t"), ("u3", "train", "a", "x", "s"),
                                    ("u1", "eval", "a", "m", None)], "utt_id string, split string, archive_name string, archive_md5 string, sha256_extracted string")
    archives = spark.createDataFrame([("a", "m")], "archive_name string, checksum string")
    inventory = spark.createDataFrame([("u1", "s"), ("u1", "s"), ("u2", "s"), ("u3", "s"), ("u1", None)], "utt_id string, sha256 string")
    held = reconcile.held_extractions(ledger, archives, inventory)
    assert "collect_set" not in held._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(held.distinct().collect()) == [("u1", "dev"), ("u1", "train")]


def test_faithfulness_rows_run_their_kernels_in_one_worker(spark):
    # Both kernels in one Python step, which returns sums over time and no maps.
    clips = views.relevance(spark, "/root/testdata/sf0.001")
    make = lambda df: jobs.faithfulness_rows(df, views.scorer(2), views.SIGNAL_RATE, views.BAND_EDGES, views.FRAME, views.HOP, (1, 2), 2)
    plan = make(clips)._jdf.queryExecution().executedPlan().toString().split("\n\n")[0]
    assert plan.count("ArrowEvalPython") == 1 and "r_tf" not in plan
    # Clips shorter than a window have no probability.
    short = make(clips.withColumn("samples", F.slice("samples", 1, 8)).withColumn("relevance", F.slice("relevance", 1, 8)))
    assert short.count() > 0 and short.filter("p_pred is not null").count() == 0


def test_bins_are_the_map_summed_over_time(spark):
    clips = views.relevance(spark, "/root/testdata/sf0.001").limit(50)
    rows = clips.select(dsp.bin_relevance(F.col("samples"), F.col("relevance"), 16, 8).alias("bins"),
                        dsp.time_frequency_relevance(F.col("samples"), F.col("relevance"), 64, 16, 8).alias("tf")).collect()
    for r in rows:
        assert r["bins"] == pytest.approx(np.sum(r["tf"]["r_tf"], axis=0), abs=1e-12)


def test_area_comparison_draws_no_replicates(spark):
    plan = load_queries()[0]["faithfulness_comparison"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan
