"""Registered queries against their SQL.  Set ALL_QUERIES=1 to run every one of them."""

import os
import re
from importlib.util import find_spec

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle_check import compare, duck

# One or more of each family, chosen for speed.
QUICK = """audit_grouping_set_counts audit_duplicate_hashes audit_missing_values audit_summary cross_split_speakers
rule_unique_key rule_relative_paths rule_digit_votes rule_label_dataset_pairs rule_manifest_rows rule_archive_members
correspondence_report correspondence_problems table_fingerprints field_profiles source_profile archive_reconciliation
ledger_upsert storage_state space_estimate outstanding_work acquisition_plan receipt_problems roc_points equal_error_rate
detector_evaluation confusion_grid classification_metrics confirmatory_tests paired_test stratified_sample random_halves
run_rank_agreement signal_layer_norm signal_noise frequency_relevance time_frequency_relevance clip_band_drops
population_relevance clip_band_ranking protocol_csv_scan counterpart_line_scan clip_file_digests clip_file_headers
clip_file_signals small_csv_artifact receipt_fields protocol_rules det_deviates stereo_signal_statistics
manifest_canonical_order""".split()


@pytest.fixture(scope="session")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(oracle_sql()) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_equals_sql(spark, con, sf, name):
    ok, _, why = compare(spark, con, sf, queries()[name], oracle_sql()[name])
    assert ok, why


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    corpus_part = {n for n in queries() if re.match(r"op[0-9]|pipeline", n)}
    part = find_spec("corpuslens.llm")
    assert bool(corpus_part) == (part is not None and part.origin is not None and find_spec("corpus_pipeline") is not None)
    df = entry(spark)
    assert df.columns == ["counted", "split", "label", "speaker", "attack", "count"] and df.count() > 0
