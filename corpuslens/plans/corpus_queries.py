"""Registered queries: audits, rules, reconciliation, ledgers and set operations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from corpuslens.operators import audit, reconcile, rules
from corpuslens.plans import views as V
from corpuslens.plans.oracle_views import h
from corpuslens.plans.registry import query
from corpuslens.session import freeze, stored

P = V.FIELD

# --- audit ------------------------------------------------------------------------------------

_DIMS = [("split", "split"), ("label", "label"), ("spk_id", "speaker"), ("attack_id", "attack")]


@query("audit_grouping_set_counts", """
SELECT concat_ws('_', CASE WHEN grouping(split)=0 THEN 'split' END, CASE WHEN grouping(label)=0 THEN 'label' END,
    CASE WHEN grouping(spk_id)=0 THEN 'speaker' END, CASE WHEN grouping(attack_id)=0 THEN 'attack' END) AS counted,
  split, label, spk_id AS speaker, attack_id AS attack, count(*) AS count
FROM manifest GROUP BY CUBE (split, label, spk_id, attack_id)
HAVING grouping(split)+grouping(label)+grouping(spk_id)+grouping(attack_id) < 4""", "manifest")
def _(spark, sf):
    return audit.grouping_counts(V.manifest(spark, sf))


@query("audit_structured_counts", """
SELECT 'split_label_protocol_codec' AS counted, split||'|'||label||'|'||protocol_codec AS value, count(*) AS count FROM manifest GROUP BY ALL
UNION ALL SELECT 'split_label_language_dataset', split||'|'||label||'|'||language||'|'||dataset, count(*) FROM manifest GROUP BY ALL""",
       "manifest")
def _(spark, sf):
    return audit.structured_counts(V.manifest(spark, sf), [
        ("split", "label", "protocol_codec"), ("split", "label", "language", "dataset"),
        ("split", "label", "output_format")])


@query("audit_source_group_counts", """
SELECT source_group_id, count(*) AS count FROM manifest WHERE source_group_id <> '' GROUP BY ALL""", "manifest")
def _(spark, sf):
    return audit.group_counts(V.manifest(spark, sf))


@query("audit_duplicate_hashes", """
SELECT sha256_source, utt_id, split, n AS copies FROM (
  SELECT sha256_source, utt_id, split, count(*) OVER (PARTITION BY sha256_source) AS n FROM manifest) WHERE n > 1""", "manifest")
def _(spark, sf):
    return audit.members_of_repeated(V.manifest(spark, sf), "sha256_source", "utt_id", "split")


@query("audit_cross_split_groups", """
SELECT source_group_id, concat_ws(',', CASE WHEN bool_or(split='train') THEN 'train' END,
    CASE WHEN bool_or(split='dev') THEN 'dev' END, CASE WHEN bool_or(split='eval') THEN 'eval' END) AS splits
FROM manifest WHERE source_group_id <> '' GROUP BY ALL HAVING count(DISTINCT split) > 1""", "manifest")
def _(spark, sf):
    return audit.cross_split_groups(V.manifest(spark, sf), P)


@query("audit_duplicate_groups", """
SELECT source_group_id, utt_id, split, n AS copies FROM (
  SELECT source_group_id, utt_id, split, count(*) OVER (PARTITION BY source_group_id) AS n
  FROM manifest WHERE source_group_id <> '') WHERE n > 1""", "manifest")
def _(spark, sf):
    return audit.duplicate_groups(V.manifest(spark, sf), "utt_id", "split")


@query("audit_missing_values", """
SELECT 'source_rms_dbfs' AS "column", utt_id, split FROM measured WHERE source_rms_dbfs IS NULL
UNION ALL SELECT 'source_estimated_snr_db', utt_id, split FROM measured WHERE source_estimated_snr_db IS NULL""", "measured")
def _(spark, sf):
    return audit.missing_values(V.measured(spark, sf))


def _distribution_sql(measures=V.MEASURES, source: str = "measured") -> str:
    parts = []
    for m in measures:
        v = f"({m})::DOUBLE"
        parts.append(
            f"SELECT '{m}' AS measure, split, label, count({m}) AS count, count(*)-count({m}) AS missing_or_nonfinite, "
            f"round(avg({v}),6)+0.0 AS mean, round(stddev_pop({v}),6)+0.0 AS std, round(min({v}),11)+0.0 AS min, "
            f"round(quantile_cont({v},0.25),11)+0.0 AS p25, round(quantile_cont({v},0.5),11)+0.0 AS median, "
            f"round(quantile_cont({v},0.75),11)+0.0 AS p75, round(max({v}),11)+0.0 AS max FROM {source} GROUP BY ALL")
    return " UNION ALL ".join(parts)


def rounded(df, *columns, digits=6):
    """Round for value comparison; adding zero turns minus zero into zero."""
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c), digits) + F.lit(0.0))
    return df


@query("audit_distributions", _distribution_sql(), "measured")
def _(spark, sf):
    # Written once: moments, cut points and order statistics all read it.
    m = freeze(V.measured(spark, sf).select("split", "label", *V.MEASURES))
    d = audit.distributions(m, V.MEASURES)
    return rounded(rounded(d, "mean", "std"), "min", "p25", "median", "p75", "max", digits=11)


_PROCESSED = ", ".join(f"{v} AS {k}" for k, v in V.PROCESSED_MEASURES.items())


@query("audit_distributions_processed", _distribution_sql(list(V.PROCESSED_MEASURES), f"(SELECT split, label, {_PROCESSED} FROM measured)"), "measured")
def _(spark, sf):
    m = stored(V.measured(spark, sf).select("split", "label", *[F.expr(v).alias(k) for k, v in V.PROCESSED_MEASURES.items()]), "processed")
    d = audit.distributions(m, list(V.PROCESSED_MEASURES))
    return rounded(rounded(d, "mean", "std"), "min", "p25", "median", "p75", "max", digits=11)


_SUMMARY_SQL = """
SELECT 'samples' AS report, count(*) AS n FROM measured
UNION ALL SELECT 'cross_split_speakers', count(*) FROM (SELECT DISTINCT a.spk_id, a.split, b.split FROM measured a JOIN measured b
   ON a.spk_id = b.spk_id AND ((a.split='train' AND b.split IN ('dev','eval')) OR (a.split='dev' AND b.split='eval')))
UNION ALL SELECT 'duplicate_hash_members', sum(n)::BIGINT FROM (SELECT count(*) n FROM measured GROUP BY sha256_source HAVING count(*)>1)
UNION ALL SELECT 'missing_values', count(*) FILTER (WHERE source_rms_dbfs IS NULL) + count(*) FILTER (WHERE source_estimated_snr_db IS NULL) FROM measured
UNION ALL SELECT 'cross_split_source_groups', count(*) FROM (SELECT source_group_id FROM measured WHERE source_group_id<>'' GROUP BY 1 HAVING count(DISTINCT split)>1)
UNION ALL SELECT 'duplicate_source_group_members', sum(n)::BIGINT FROM (SELECT count(*) n FROM measured WHERE source_group_id<>'' GROUP BY source_group_id HAVING count(*)>1)"""


@query("audit_summary", _SUMMARY_SQL, "measured")
def _(spark, sf):
    return audit.audit_summary(V.measured(spark, sf), P)


@query("cross_split_speakers", """
SELECT DISTINCT a.split AS left_split, b.split AS right_split, a.spk_id FROM manifest a JOIN manifest b ON a.spk_id = b.spk_id
WHERE (a.split='train' AND b.split IN ('dev','eval')) OR (a.split='dev' AND b.split='eval')""", "manifest")
def _(spark, sf):
    return audit.cross_split_speakers(V.manifest(spark, sf), P)


@query("leaking_speakers", """
SELECT spk_id FROM manifest WHERE split='train' INTERSECT SELECT spk_id FROM manifest WHERE split='dev'""", "manifest")
def _(spark, sf):
    return rules.shared_between_splits(V.manifest(spark, sf), "spk_id", "train", "dev")


@query("class_counts", """
SELECT s.split, l.label, count(m.utt_id) AS count FROM (VALUES ('train'),('dev')) s(split), (VALUES ('generated'),('pristine')) l(label)
LEFT JOIN manifest m ON m.split = s.split AND m.label = l.label GROUP BY ALL""", "manifest")
def _(spark, sf):
    return audit.class_counts(V.manifest(spark, sf))


@query("manifest_canonical_order", """
SELECT row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'dev' THEN 1 ELSE 2 END, label, utt_id) AS position,
  utt_id, split, label FROM manifest""", "manifest")
def _(spark, sf):
    # Written in order, the files are ranges of the order: a row's place is its index and the rows of the files before.
    rows = stored(audit.canonical_order(V.manifest(spark, sf), P).select("utt_id", "split", "label"), "ordered").select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("_file", before.alias("_o")), "_file").select(
        (F.col("_o") + F.col("_at") + 1).alias("position"), "utt_id", "split", "label")


# --- rules ------------------------------------------------------------------------------------

@query("rule_split_domain", """
SELECT 'unsupported_split' AS rule, split AS key, count(*)::VARCHAR AS detail FROM manifest WHERE split NOT IN ('train','dev') GROUP BY split""", "manifest")
def _(spark, sf):
    return rules.unsupported_splits(V.manifest(spark, sf), ("train", "dev"))


@query("rule_unique_key", """
SELECT 'duplicate_key' AS rule, l_orderkey||'|'||l_linenumber AS key, count(*)::VARCHAR AS detail
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def _(spark, sf):
    return rules.duplicate_keys(V.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("rule_id_pattern", """
SELECT 'malformed_id' AS rule, utt_id AS key, split AS detail FROM (
  SELECT CASE WHEN """ + h('i', 'doc_id') + """%30=0 THEN lower(utt_id) WHEN """ + h('i', 'doc_id') + """%30=1 THEN utt_id||'0' ELSE utt_id END AS utt_id, split FROM protocol)
WHERE NOT regexp_full_match(utt_id, CASE split WHEN 'train' THEN 'T' WHEN 'dev' THEN 'D' ELSE 'E' END||'_[0-9]{10}')""", "protocol")
def _(spark, sf):
    p = V.protocol(spark, sf, "doc_id")
    d = V.draw("i", "doc_id", 30)
    spoiled = p.withColumn("utt_id", F.when(d == 0, F.lower("utt_id")).when(
        d == 1, F.concat("utt_id", F.lit("0"))).otherwise(F.col("utt_id")))
    return rules.malformed_ids(spoiled, P)


@query("rule_relative_paths", """
SELECT 'empty_path' AS rule, file_path AS key, split AS detail FROM crowd WHERE file_path=''
UNION ALL SELECT 'absolute_path', file_path, file_path FROM crowd WHERE starts_with(file_path,'/')
UNION ALL SELECT 'backslash_in_path', file_path, file_path FROM crowd WHERE contains(file_path, chr(92))
UNION ALL SELECT 'parent_reference', file_path, file_path FROM crowd WHERE contains(file_path,'..')
UNION ALL SELECT 'wrong_split_prefix', file_path, file_path FROM crowd WHERE NOT starts_with(file_path, split||'/')""", "crowd")
def _(spark, sf):
    return rules.path_rules(V.crowd(spark, sf))


@query("rule_digit_votes", """
SELECT 'invalid_up_votes' AS rule, event_id::VARCHAR AS key, up_votes AS detail FROM crowd WHERE up_votes<>'' AND NOT regexp_full_match(up_votes,'[0-9]+')
UNION ALL SELECT 'invalid_down_votes', event_id::VARCHAR, down_votes FROM crowd WHERE down_votes<>'' AND NOT regexp_full_match(down_votes,'[0-9]+')""", "crowd")
def _(spark, sf):
    return rules.non_digit_votes(V.crowd(spark, sf), "event_id", ["up_votes", "down_votes"])


@query("rule_label_domain", """
SELECT 'unsupported_role' AS rule, role AS key, count(*)::VARCHAR AS detail FROM conversations WHERE role NOT IN ('user','assistant') GROUP BY role""")
def _(spark, sf):
    return rules.outside_domain(V.table(spark, sf, "conversations"), "role", ["user", "assistant"], "unsupported_role")


_COMBO = """
SELECT CASE WHEN label='generated' THEN 'unexpected_dataset' WHEN dataset='SYNTH' THEN 'unexpected_label' ELSE 'unexpected_combination' END AS rule,
  CASE WHEN label='generated' THEN dataset ELSE label END AS key, count(*)::VARCHAR AS detail FROM protocol
WHERE language='en' AND NOT ((label='generated' AND dataset='SYNTH') OR (label='pristine' AND dataset='FIELD')) GROUP BY ALL"""


@query("rule_label_dataset_pairs", _COMBO, "protocol")
def _(spark, sf):
    return rules.bad_combinations(V.protocol(spark, sf), P)


@query("generated_subset_filter", """
SELECT utt_id, spk_id, attack_id, split FROM protocol WHERE language='en' AND label='generated' AND dataset='SYNTH'""", "protocol")
def _(spark, sf):
    return rules.generated_subset(V.protocol(spark, sf), P).select("utt_id", "spk_id", "attack_id", "split")


@query("rule_constant_fields", """
SELECT 'unexpected_gender' AS rule, gender AS key, count(*)::VARCHAR AS detail FROM protocol WHERE gender<>'F' GROUP BY ALL
UNION ALL SELECT 'unexpected_dataset', dataset, count(*)::VARCHAR FROM protocol WHERE dataset<>'FIELD' GROUP BY ALL""", "protocol")
def _(spark, sf):
    return rules.sparse_field_values(V.protocol(spark, sf), {
        "gender": "F", "dataset": "FIELD", "native": "yes", "codec": "-"})


@query("rule_expected_counts", """
SELECT coalesce(a.split,e.split) AS split, coalesce(a.label,e.label) AS label, coalesce(actual,0) AS actual,
  coalesce(expected,0) AS expected, coalesce(actual,0)-coalesce(expected,0) AS difference
FROM (SELECT split, label, count(*) AS actual FROM protocol GROUP BY ALL) a FULL JOIN (SELECT * FROM (VALUES """
       + ",".join(f"('{s}','{l}',{n}::BIGINT)" for (s, l), n in P.expected_counts.items())
       + """) v(split,label,expected)) e ON a.split=e.split AND a.label=e.label""", "protocol")
def _(spark, sf):
    return rules.count_differences(V.protocol(spark, sf), P.expected(spark), ["split", "label"])


@query("rule_resolved_paths", """
WITH inv AS (SELECT CASE WHEN """ + h('j', 'doc_id') + """%45=0 THEN source_path||'.lost' ELSE source_path END AS path FROM manifest),
 m AS (SELECT utt_id, CASE WHEN """ + h('o', 'doc_id') + """%60=0 THEN 'elsewhere/'||utt_id WHEN """ + h('o', 'doc_id') + """%60=1 THEN 'raw/pristine/../x' ELSE source_path END AS source_path, label FROM manifest)
SELECT 'missing_file' AS rule, utt_id AS key, source_path AS detail FROM m WHERE source_path NOT IN (SELECT path FROM inv)
UNION ALL SELECT 'outside_root', utt_id, source_path FROM m WHERE NOT starts_with(source_path, CASE WHEN label='pristine' THEN 'raw/pristine/' ELSE 'dataset/generated/' END) OR contains('/'||source_path||'/', '/../')
UNION ALL SELECT 'duplicate_path', source_path, count(*)::VARCHAR FROM m GROUP BY source_path HAVING count(*)>1""", "manifest")
def _(spark, sf):
    m = V.manifest(spark, sf, "doc_id")
    inv = m.select(F.when(V.draw("j", "doc_id", 45) == 0, F.concat("source_path", F.lit(".lost")))
                   .otherwise(F.col("source_path")).alias("path"))
    o = V.draw("o", "doc_id", 60)
    moved = m.withColumn("source_path", F.when(o == 0, F.concat(F.lit("elsewhere/"), "utt_id"))
                         .when(o == 1, "raw/pristine/../x").otherwise(F.col("source_path")))
    root = F.when(F.col("label") == "pristine", P.pristine_root).otherwise(P.generated_root)
    return rules.resolved_path_rules(moved, inv, root)


def _spoiled_manifest(spark, sf):
    m = V.manifest(spark, sf, "doc_id")
    d = V.draw("b", "doc_id", 40)
    return (m.withColumn("gender", F.when(d == 0, "unk").when(d == 1, "").otherwise(F.col("gender")))
            .withColumn("attack_id", F.when(d == 2, "pristine").when(d == 3, "A01").otherwise(F.col("attack_id")))
            .withColumn("processed_path", F.when(d == 4, "out.wav").otherwise(F.col("processed_path")))
            .withColumn("utt_id", F.when(d == 5, "T_0000000000").otherwise(F.col("utt_id"))).drop("doc_id"))


_SPOILED = ("SELECT * EXCLUDE (gender, attack_id, processed_path, utt_id, text), d, "
            "CASE d WHEN 0 THEN 'unk' WHEN 1 THEN '' ELSE gender END AS gender, "
            "CASE d WHEN 2 THEN 'pristine' WHEN 3 THEN 'A01' ELSE attack_id END AS attack_id, "
            "CASE d WHEN 4 THEN 'out.wav' ELSE processed_path END AS processed_path, "
            "CASE d WHEN 5 THEN 'T_0000000000' ELSE utt_id END AS utt_id "
            f"FROM (SELECT *, {h('b', 'doc_id')}%40 AS d FROM manifest)")


@query("rule_manifest_rows", f"""
WITH s AS ({_SPOILED})
SELECT 'empty_gender' AS rule, utt_id AS key, '' AS detail FROM s WHERE gender=''
UNION ALL SELECT 'invalid_gender', utt_id, gender FROM s WHERE gender NOT IN ('F','M')
UNION ALL SELECT 'invalid_language', utt_id, language FROM s WHERE language<>'en'
UNION ALL SELECT 'invalid_dataset', utt_id, dataset FROM s WHERE dataset NOT IN ('SYNTH','FIELD')
UNION ALL SELECT 'pristine_with_attack', utt_id, attack_id FROM s WHERE label='pristine' AND attack_id<>'pristine'
UNION ALL SELECT 'generated_without_attack', utt_id, attack_id FROM s WHERE label='generated' AND attack_id='pristine'
UNION ALL SELECT 'half_processed', utt_id, processed_path FROM s WHERE (processed_path='')<>(sha256_processed='')
UNION ALL SELECT 'duplicate_key', utt_id, count(*)::VARCHAR FROM s GROUP BY utt_id HAVING count(*)>1
UNION ALL SELECT 'duplicate_path', source_path, count(*)::VARCHAR FROM s GROUP BY source_path HAVING count(*)>1""", "manifest")
def _(spark, sf):
    return rules.manifest_rules(_spoiled_manifest(spark, sf), P)


@query("rule_raw_fields_empty", f"""
WITH s AS ({_SPOILED}) SELECT 'raw_with_processed_fields' AS rule, utt_id AS key, processed_path AS detail
FROM s WHERE processed_path<>'' OR sha256_processed<>''""", "manifest")
def _(spark, sf):
    return rules.raw_fields_filled(_spoiled_manifest(spark, sf))


@query("rule_output_plan", """
WITH p AS (SELECT utt_id, source_path, 'out/'||split||'/'||label AS root,
   CASE WHEN """ + h('y', 'doc_id') + """%50=0 THEN 'out/'||split||'/'||label||'/same.wav' WHEN """ + h('y', 'doc_id') + """%50=1 THEN 'tmp/'||utt_id
     WHEN """ + h('y', 'doc_id') + """%50=2 THEN 'out/manifest.csv/'||utt_id ELSE 'out/'||split||'/'||label||'/'||utt_id||'.wav' END AS output FROM manifest)
SELECT 'escapes_root' AS rule, utt_id AS key, output AS detail FROM p WHERE NOT starts_with(output, root||'/')
UNION ALL SELECT 'manifest_is_ancestor', utt_id, output FROM p WHERE starts_with(output, 'out/manifest.csv/')
UNION ALL SELECT 'duplicate_destination', output, count(*)::VARCHAR FROM p GROUP BY output HAVING count(*)>1""", "manifest")
def _(spark, sf):
    m = V.manifest(spark, sf, "doc_id")
    y = V.draw("y", "doc_id", 50)
    m = m.withColumn("output_root", F.concat_ws("/", F.lit("out"), "split", "label"))
    m = m.withColumn("output_path", F.when(y == 0, F.concat("output_root", F.lit("/same.wav")))
                     .when(y == 1, F.concat(F.lit("tmp/"), "utt_id"))
                     .when(y == 2, F.concat(F.lit("out/manifest.csv/"), "utt_id"))
                     .otherwise(F.concat("output_root", F.lit("/"), "utt_id", F.lit(".wav"))))
    return rules.output_plan_rules(m, "out/manifest.csv")


@query("rule_measures_recomputed", """
SELECT 'source_frames_differs' AS rule, utt_id AS key, source_frames::VARCHAR AS detail FROM measured WHERE """ + h('e', 'doc_id') + """%70=0
UNION ALL SELECT 'source_peak_differs', utt_id, NULL FROM measured WHERE """ + h('e', 'doc_id') + """%70=1""", "measured")
def _(spark, sf):
    m = V.measured(spark, sf)
    e = V.draw("e", "doc_id", 70)
    declared = (m.withColumn("source_frames", F.when(e == 0, F.col("source_frames") + 1).otherwise(F.col("source_frames")))
                .withColumn("source_peak", F.when(e == 1, F.col("source_peak") + 1e-9).otherwise(F.col("source_peak"))))
    found = rules.measure_differences(declared, m, "utt_id", ["source_frames", "source_channels"],
                                      ["source_peak", "source_rms"])
    return found.withColumn("detail", F.when(F.col("rule") == "source_frames_differs", F.col("detail")))


@query("rule_partition_gate", """
SELECT 'speaker_leak' AS rule, spk_id AS key, 'train,dev' AS detail FROM (
  SELECT spk_id FROM manifest WHERE split='train' INTERSECT SELECT spk_id FROM manifest WHERE split='dev')""", "manifest")
def _(spark, sf):
    return rules.partition_gate(V.manifest(spark, sf))


@query("rule_finite_features", """
SELECT 'non_finite_source_rms_dbfs' AS rule, utt_id AS key FROM measured WHERE source_rms_dbfs IS NULL
UNION ALL SELECT 'non_finite_source_estimated_snr_db', utt_id FROM measured WHERE source_estimated_snr_db IS NULL""", "measured")
def _(spark, sf):
    return rules.non_finite(V.measured(spark, sf), "utt_id", V.MEASURES).select("rule", "key")


@query("rule_archive_members", """
SELECT 'unsafe_member' AS rule, name AS key, name AS detail FROM members WHERE contains(name,chr(92)) OR starts_with(name,'/') OR starts_with(name,'../') OR contains(name,'/../') OR regexp_matches(name,'^[A-Za-z]:')
UNION ALL SELECT 'duplicate_member', name, count(*)::VARCHAR FROM members GROUP BY name HAVING count(*)>1""", "members")
def _(spark, sf):
    return rules.member_rules(V.members(spark, sf).drop("page_id"))


@query("rule_exact_member_set", """
WITH e AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), o AS (SELECT DISTINCT o_orderkey AS k FROM orders)
SELECT CASE WHEN e.k IS NULL THEN 'missing' ELSE 'unexpected' END AS rule, coalesce(e.k,o.k)::VARCHAR AS key, '' AS detail
FROM o FULL JOIN e ON o.k=e.k WHERE o.k IS NULL OR e.k IS NULL""")
def _(spark, sf):
    return rules.set_difference_rules(V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")),
                                      V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("rule_required_inputs", """
SELECT 'missing_input' AS rule, n AS key, '' AS detail FROM (VALUES ('flac_T_a0.tar'),('flac_T_a9.tar'),('flac_X.tar')) v(n)
WHERE n NOT IN (SELECT archive_name FROM archives)""", "archives")
def _(spark, sf):
    return rules.missing_names(V.archives(spark, sf), ["flac_T_a0.tar", "flac_T_a9.tar", "flac_X.tar"], "archive_name").select("rule", F.col("key"), "detail")


@query("rule_standard_signals", """
SELECT 'sample_rate' AS rule, sample_id::VARCHAR AS key, '64' AS detail FROM signals
UNION ALL SELECT 'frames', sample_id::VARCHAR, '64' FROM signals WHERE """ + h('l', 'sample_id') + """%20=0""", "signals")
def _(spark, sf):
    s = V.signals(spark, sf).withColumn("channels", F.lit(1)).withColumn(
        "expected", F.when(V.draw("l", "sample_id", 20) == 0, 65).otherwise(64))
    return rules.standard_signal_rules(s, 16000, "sample_id", "expected")


@query("label_equivalence", """
SELECT label, CASE label WHEN 'pristine' THEN 'bonafide' ELSE 'spoof' END AS equivalent, count(*) AS n FROM protocol GROUP BY ALL""", "protocol")
def _(spark, sf):
    p = V.protocol(spark, sf)
    return p.groupBy("label", P.equivalent_label(F.col("label")).alias("equivalent")).agg(F.count(F.lit(1)).alias("n"))


@query("archive_splits", """
SELECT archive_name, CASE WHEN starts_with(archive_name,'flac_T_') THEN 'train' WHEN starts_with(archive_name,'flac_D_') THEN 'dev'
  WHEN starts_with(archive_name,'flac_E_') THEN 'eval' END AS split FROM archives""", "archives")
def _(spark, sf):
    return V.archives(spark, sf).select("archive_name", P.split_of_archive(F.col("archive_name")).alias("split"))


# --- reconciliation ---------------------------------------------------------------------------

_PAIRS = """pairs AS (SELECT coalesce(l.split,r.split) AS split, coalesce(l.utt_id,r.utt_id) AS utt_id, l.utt_id AS lid, r.utt_id AS rid,
  l.label, r.key, l.spk_id AS ls, r.spk_id AS rs, l.gender AS lg, r.gender AS rg,
  (l.label='pristine' AND r.key='bonafide') OR (l.label='generated' AND r.key='spoof') AS ok
  FROM protocol l FULL JOIN counterpart r ON l.utt_id=r.utt_id AND l.split=r.split)"""


def _pairs(spark, sf):
    return reconcile.paired(V.protocol(spark, sf), V.counterpart(spark, sf), P)


@query("correspondence_report", f"""
WITH {_PAIRS} SELECT split, count(*) FILTER (WHERE label='pristine') AS pristine_expected, count(*) FILTER (WHERE label='generated') AS generated_expected,
 count(*) FILTER (WHERE ok AND label='pristine') AS pristine_matched, count(*) FILTER (WHERE ok AND label='generated') AS generated_matched,
 count(*) FILTER (WHERE rid IS NULL) AS missing_ids, count(*) FILTER (WHERE lid IS NULL) AS extra_ids,
 count(*) FILTER (WHERE lid IS NOT NULL AND rid IS NOT NULL AND (ls<>rs OR lg<>rg OR NOT ok)) AS mismatched FROM pairs GROUP BY split""",
       "protocol", "counterpart")
def _(spark, sf):
    return reconcile.correspondence(_pairs(spark, sf))


@query("correspondence_problems", f"""
WITH {_PAIRS} SELECT split, CASE WHEN rid IS NULL THEN 'missing' ELSE 'extra' END AS kind, utt_id, '' AS field, '' AS "left", '' AS "right" FROM pairs WHERE rid IS NULL OR lid IS NULL
UNION ALL SELECT split, 'mismatch', utt_id, 'spk_id', ls, rs FROM pairs WHERE ls<>rs
UNION ALL SELECT split, 'mismatch', utt_id, 'gender', lg, rg FROM pairs WHERE lg<>rg
UNION ALL SELECT split, 'mismatch', utt_id, 'label', label, key FROM pairs WHERE lid IS NOT NULL AND rid IS NOT NULL AND NOT ok""",
       "protocol", "counterpart")
def _(spark, sf):
    return reconcile.correspondence_problems(_pairs(spark, sf))


@query("overlap_evidence", f"""
WITH {_PAIRS} SELECT split, count(*) FILTER (WHERE label='pristine') AS left_pristine, count(*) FILTER (WHERE key='bonafide') AS right_bonafide,
 count(*) FILTER (WHERE label='pristine' AND key='bonafide') AS overlap_pristine_bonafide, count(*) FILTER (WHERE label='generated') AS left_generated,
 count(*) FILTER (WHERE key='spoof') AS right_spoof, count(*) FILTER (WHERE label='generated' AND key='spoof') AS overlap_generated_spoof,
 count(*) FILTER (WHERE lid IS NOT NULL AND rid IS NOT NULL) AS id_overlap, count(*) FILTER (WHERE rid IS NULL) AS left_only,
 count(*) FILTER (WHERE lid IS NULL) AS right_only, bool_and(coalesce(ok,false)) AS now_corresponds FROM pairs GROUP BY split""",
       "protocol", "counterpart")
def _(spark, sf):
    return reconcile.overlap_evidence(_pairs(spark, sf), P)


@query("counterpart_semi_join", "SELECT * FROM counterpart WHERE (split, utt_id) IN (SELECT (split, utt_id) FROM protocol)", "protocol", "counterpart")
def _(spark, sf):
    return reconcile.reduce_to(V.counterpart(spark, sf), V.protocol(spark, sf))


@query("optional_evidence", """
SELECT p.utt_id, p.split, coalesce(replace(c.codec,'-',''),'') AS protocol_codec, coalesce(replace(c.tmp,'-',''),'') AS source_group_id
FROM protocol p LEFT JOIN counterpart c ON p.utt_id=c.utt_id""", "protocol", "counterpart")
def _(spark, sf):
    return reconcile.with_evidence(V.protocol(spark, sf).drop("codec"), V.counterpart(spark, sf)).select(
        "utt_id", "split", "protocol_codec", "source_group_id")


@query("key_set_overlap", """
SELECT coalesce(l.split,r.split) AS split, count(*) FILTER (WHERE r.utt_id IS NULL) AS left_only, count(*) FILTER (WHERE l.utt_id IS NULL) AS right_only,
 count(*) FILTER (WHERE l.utt_id IS NOT NULL AND r.utt_id IS NOT NULL) AS shared, bool_and(l.utt_id IS NOT NULL AND r.utt_id IS NOT NULL) AS equal
FROM (SELECT DISTINCT split, utt_id FROM protocol) l FULL JOIN (SELECT DISTINCT split, utt_id FROM counterpart) r
 ON l.split=r.split AND l.utt_id=r.utt_id GROUP BY 1""", "protocol", "counterpart")
def _(spark, sf):
    return reconcile.key_overlap(V.protocol(spark, sf), V.counterpart(spark, sf), "utt_id", "split")


_FP = """
WITH d AS (SELECT split, sha256(concat_ws('|', """ + ", ".join(
    f"length({c})::VARCHAR||':'||{c}" for c in ("spk_id", "utt_id", "gender", "label", "attack_id")) + """)) AS d FROM protocol),
 s AS (SELECT split, count(*) AS rows, """ + ", ".join(
    f"sum(('0x'||substr(d,{1 + 15 * i},15))::BIGINT)::HUGEINT::VARCHAR AS p{i}" for i in range(4)) + """ FROM d GROUP BY split)
SELECT split, rows, sha256(concat_ws('|','spk_id,utt_id,gender,label,attack_id',split,rows::VARCHAR,p0,p1,p2,p3)) AS fingerprint FROM s"""


@query("table_fingerprints", _FP, "protocol")
def _(spark, sf):
    return reconcile.table_fingerprint(V.protocol(spark, sf), ["split"],
                                       ["spk_id", "utt_id", "gender", "label", "attack_id"])
