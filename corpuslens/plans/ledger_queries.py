"""Registered queries: profiles, ledgers, archives, storage, stored reports, files and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens import schemas
from corpuslens.operators import compare, models, profiling, reconcile, rules, sampling, stats, storage
from corpuslens.plans import detector_sql as S, jobs, views as V
from corpuslens.plans.corpus_queries import _SPOILED, rounded
from corpuslens.plans.detector_queries import _LEVENE, _WELCH, _r
from corpuslens.plans.oracle_views import VIEWS, h
from corpuslens.plans.registry import query
from corpuslens.session import freeze, scratch_path, stored
from corpuslens.sources import files, protocols, sinks

P = V.FIELD

# --- profiles ---------------------------------------------------------------------------------


@query("counts_by_split", "SELECT split, count(*) AS count FROM crowd GROUP BY ALL", "crowd")
def _(spark, sf):
    return profiling.counts_by_split(V.crowd(spark, sf))


@query("length_statistics", f"""
SELECT 'role' AS field, count(*) AS count, min(length(role))::INTEGER AS min_length, {_r('avg(length(role))','mean_length')}, max(length(role))::INTEGER AS max_length FROM conversations
UNION ALL SELECT 'text', count(*), min(length(text))::INTEGER, {_r('avg(length(text))','m')}, max(length(text))::INTEGER FROM conversations""")
def _(spark, sf):
    return rounded(profiling.length_statistics(V.table(spark, sf, "conversations"), ["role", "text"]), "mean_length")


_NUM = "TRY_CAST(nullif({c},'') AS BIGINT)"


@query("numeric_statistics", " UNION ALL ".join(
    f"SELECT '{c}' AS field, count({_NUM.format(c=c)}) AS non_missing_count, min({_NUM.format(c=c)}) AS min, {_r(f'avg({_NUM.format(c=c)})','mean')}, max({_NUM.format(c=c)}) AS max FROM crowd"
    for c in ("up_votes", "down_votes")), "crowd")
def _(spark, sf):
    return rounded(profiling.numeric_statistics(V.crowd(spark, sf), ["up_votes", "down_votes"]), "mean")


@query("value_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS field, {c} AS value, count(*) AS count FROM crowd GROUP BY ALL" for c in ("variety", "dataset", "accent", "task")), "crowd")
def _(spark, sf):
    return profiling.value_counts(V.crowd(spark, sf), ["variety", "dataset", "accent", "task"])


_PROFILED = {"file_path": "length", "text": "length", "up_votes": "numeric", "down_votes": "numeric", "accent": "categorical", "variety": "categorical"}


def _profile_sql() -> str:
    parts = []
    for f, k in _PROFILED.items():
        ln = (f"min(length({f}))::INTEGER", f"max(length({f}))::INTEGER", _r(f"avg(length({f}))", "mean_length")) if k == "length" else (
            "NULL::INTEGER", "NULL::INTEGER", "NULL::DOUBLE AS mean_length")
        v = _NUM.format(c=f)
        nm = (f"min({v})", f"max({v})", _r(f"avg({v})", "mean"), f"count({v})") if k == "numeric" else (
            "NULL::BIGINT", "NULL::BIGINT", "NULL::DOUBLE AS mean", "NULL::BIGINT")
        parts.append(f"SELECT '{f}' AS field, count(*) FILTER (WHERE {f}='') AS missing_count, {ln[0]} AS min_length, {ln[1]} AS max_length, {ln[2]}, "
                     f"{nm[0]} AS min, {nm[1]} AS max, {nm[2]}, {nm[3]} AS non_missing_count, count(DISTINCT {f}) AS distinct_count, "
                     f"count(*) FILTER (WHERE {f}='')>0 AS nullable, '{k}' AS block FROM crowd")
    return " UNION ALL ".join(parts)


@query("field_profiles", _profile_sql(), "crowd")
def _(spark, sf):
    d = profiling.field_profiles(V.crowd(spark, sf), list(_PROFILED),
                                 length_fields=[f for f, k in _PROFILED.items() if k == "length"],
                                 vote_fields=[f for f, k in _PROFILED.items() if k == "numeric"])
    return rounded(d, "mean_length", "mean")


_PROFILE_ROWS = """
SELECT 'crowd' AS source, 'sample_count' AS block, '' AS field, '' AS value, count(*) AS n FROM crowd
UNION ALL SELECT 'crowd','split','split',split,count(*) FROM crowd GROUP BY split
UNION ALL SELECT 'crowd','distribution','accent',accent,count(*) FROM crowd GROUP BY accent
UNION ALL SELECT 'crowd','distribution','variety',variety,count(*) FROM crowd GROUP BY variety
UNION ALL SELECT 'crowd','quality','up_votes',CASE WHEN up_votes='' THEN 'missing' ELSE 'non_missing' END,count(*) FROM crowd GROUP BY 4
UNION ALL SELECT 'crowd','availability','file_path',CASE WHEN file_path='' THEN 'missing' ELSE 'resolved' END,count(*) FROM crowd GROUP BY 4"""


@query("source_profile", _PROFILE_ROWS, "crowd")
def _(spark, sf):
    return profiling.source_profile(V.crowd(spark, sf), "crowd", ["accent", "variety"], ["up_votes"], "file_path")


@query("two_source_summary", """
SELECT 'crowd' AS source, 'sample_count' AS block, '' AS field, '' AS value, count(*) AS n, 'pristine' AS role FROM crowd
UNION ALL SELECT 'crowd','split','split',split,count(*),'pristine' FROM crowd GROUP BY split
UNION ALL SELECT 'crowd','distribution','accent',accent,count(*),'pristine' FROM crowd GROUP BY accent
UNION ALL SELECT 'crowd','quality','up_votes',CASE WHEN up_votes='' THEN 'missing' ELSE 'non_missing' END,count(*),'pristine' FROM crowd GROUP BY 4
UNION ALL SELECT 'protocol','sample_count','','',count(*),'generated' FROM g
UNION ALL SELECT 'protocol','split','split',split,count(*),'generated' FROM g GROUP BY split
UNION ALL SELECT 'protocol','distribution','attack_id',attack_id,count(*),'generated' FROM g GROUP BY attack_id
UNION ALL SELECT 'protocol','distribution','gender',gender,count(*),'generated' FROM g GROUP BY gender
""".join(["WITH g AS (SELECT * FROM protocol WHERE language='en' AND label='generated' AND dataset='SYNTH') ", ""]), "crowd", "protocol")
def _(spark, sf):
    g = rules.generated_subset(V.protocol(spark, sf), P)
    return jobs.two_source_metadata(V.crowd(spark, sf), g, {"pristine": "crowd", "generated": "protocol"},
                                    {"categorical": ["accent"], "votes": ["up_votes"]},
                                    {"categorical": ["attack_id", "gender"]})["summary"]


# --- archive with text members ----------------------------------------------------------------

def _utt(conv="conv_id", turn="turn"):
    return F.concat(F.lit("S"), F.lpad(F.col(conv).cast("string"), 6, "0"), F.lpad(F.col(turn).cast("string"), 4, "0"))


def _archive(spark, sf):
    c = V.table(spark, sf, "conversations").withColumn("utt", _utt()).withColumn("speaker", F.substring("utt", 1, 7)).withColumn(
        "split", F.when(V.draw("cs", "conv_id", 10) < 7, "train").otherwise("test"))
    content = c.select("split", (F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"),
                       F.concat(F.col("utt"), F.lit(".wav\t"), F.replace("text", F.lit("\n"), F.lit(" "))).alias("value"))
    name = F.when(V.draw("aw", "utt", 25) == 0, F.concat("utt", F.lit("x"))).otherwise(F.col("utt"))
    members = c.select(F.concat_ws("/", "split", F.lit("wav"), "speaker", F.concat(name, F.lit(".wav"))).alias("name"),
                       F.length("text").cast("bigint").alias("size"), F.lit(True).alias("is_regular"))
    speakers = c.select("speaker", "conv_id").distinct().select(F.concat(
        F.when(V.draw("sp", "conv_id", 10) == 0, F.concat("speaker", F.lit("?"))).otherwise(F.col("speaker")),
        F.lit("\tB\tfemale\tnorth")).alias("value"))
    labels = c.select(F.when(V.draw("lb", "utt", 5) == 0, F.concat(F.lit("# "), F.col("utt")))
                      .otherwise(F.concat(F.col("utt"), F.lit("|p"), F.col("turn").cast("string"))).alias("value"))
    return members, content, speakers, labels


VIEWS["arch"] = ((), f"""
  SELECT *, substr(utt,1,7) AS speaker, CASE WHEN {h('cs','conv_id')}%10<7 THEN 'train' ELSE 'test' END AS split,
    CASE WHEN {h('aw','utt')}%25=0 THEN utt||'x' ELSE utt END AS wav FROM (
    SELECT *, 'S'||lpad(conv_id::VARCHAR,6,'0')||lpad(turn::VARCHAR,4,'0') AS utt FROM conversations)""")
VIEWS["arch_pairs"] = (("arch",), """
  SELECT coalesce(c.split,m.split) AS split, c.utt AS cu, m.wav AS mu, c.conv_id, c.turn, c.text FROM arch c FULL JOIN arch m ON c.split=m.split AND c.utt=m.wav""")


@query("archive_reconciliation", """
SELECT split, count(cu) AS content_lines, count(mu) AS members, count(*) FILTER (WHERE cu IS NOT NULL AND mu IS NOT NULL) AS matched,
 count(*) FILTER (WHERE mu IS NULL) AS content_without_member, count(*) FILTER (WHERE cu IS NULL) AS member_without_content FROM arch_pairs GROUP BY split""", "arch_pairs")
def _(spark, sf):
    return protocols.read_archive_manifest(*_archive(spark, sf))["reconciliation"]


@query("archive_manifest", f"""
SELECT cu AS utt_id, split, split||'/wav/'||substr(cu,1,7)||'/'||cu||'.wav' AS archive_member_path, substr(cu,1,7) AS speaker_id, 'female' AS gender, 'B' AS age, 'north' AS accent,
 rtrim(replace(text,chr(10),' '),' ') AS transcription, CASE WHEN {h('lb','cu')}%5=0 THEN '' ELSE 'p'||turn END AS pinyin, CASE WHEN {h('lb','cu')}%5=0 THEN 'no' ELSE 'yes' END AS prosody_available,
 'content.txt' AS metadata_source_file, (conv_id*1000+turn)::VARCHAR AS metadata_source_row FROM arch_pairs WHERE cu IS NOT NULL AND mu IS NOT NULL AND {h('sp','conv_id')}%10<>0""", "arch_pairs")
def _(spark, sf):
    return protocols.read_archive_manifest(*_archive(spark, sf))["manifest"]


@query("archive_problems", f"""
SELECT 'unknown_speaker' AS rule, cu AS key, substr(cu,1,7) AS detail FROM arch_pairs WHERE cu IS NOT NULL AND mu IS NOT NULL AND {h('sp','conv_id')}%10=0""", "arch_pairs")
def _(spark, sf):
    return protocols.read_archive_manifest(*_archive(spark, sf))["problems"]


@query("reconciliation_note", """
SELECT 'observed test content lines: '||format('{:,}', count(cu))||'; published: 23,262' AS note FROM arch_pairs WHERE split='test'""", "arch_pairs")
def _(spark, sf):
    counts = protocols.read_archive_manifest(*_archive(spark, sf))["reconciliation"]
    return reconcile.divergence_note(counts, 23262)


# --- ledger and storage -----------------------------------------------------------------------

def _updates(ledger):
    d = V.draw("up", "utt_id", 20)
    return ledger.select(
        F.when(d == 0, F.concat(F.col("utt_id"), F.lit("-new"))).otherwise(F.col("utt_id")).alias("utt_id"),
        "split", "archive_name", "archive_md5", "member_name", (F.col("member_size") + 1).alias("member_size"), "sha256_extracted")


@query("ledger_upsert", f"""
WITH u AS (SELECT CASE WHEN {h('up','utt_id')}%20=0 THEN utt_id||'-new' ELSE utt_id END AS utt_id, split, archive_name, member_size+1 AS member_size FROM ledger)
SELECT utt_id, split, archive_name, member_size FROM u UNION ALL SELECT utt_id, split, archive_name, member_size FROM ledger WHERE utt_id NOT IN (SELECT utt_id FROM u)""", "ledger")
def _(spark, sf):
    l = V.ledger(spark, sf)
    return reconcile.upsert(l, _updates(l)).select("utt_id", "split", "archive_name", "member_size")


@query("ledger_roundtrip", "SELECT utt_id, split, archive_name, archive_md5, member_name, member_size, sha256_extracted FROM ledger", "ledger")
def _(spark, sf):
    path = scratch_path(spark, "ledger")
    reconcile.ledger_order(V.ledger(spark, sf)).write.parquet(path)
    return sinks.read_ledger(spark, path)[0]


@query("completed_archives", "SELECT l.archive_name FROM ledger l JOIN archives a ON l.archive_name=a.archive_name GROUP BY l.archive_name HAVING bool_and(lower(archive_md5)=lower(checksum))", "ledger", "archives")
def _(spark, sf):
    return storage.completed_archives(V.ledger(spark, sf), V.archives(spark, sf))


@query("storage_state", """
WITH done AS (SELECT l.archive_name FROM ledger l JOIN archives a ON l.archive_name=a.archive_name GROUP BY l.archive_name HAVING bool_and(lower(archive_md5)=lower(checksum))),
 r AS (SELECT coalesce(sum(size),0)::BIGINT AS rem, coalesce(max(size),0) AS big FROM archives WHERE archive_name NOT IN (SELECT * FROM done)),
 e AS (SELECT sum(member_size)::BIGINT AS ex FROM ledger), c AS (SELECT sum(length(html))::BIGINT AS cur FROM pages)
SELECT ex AS extracted_bytes, cur AS current_archive_bytes, rem AS remaining_bytes, big AS largest_active_bytes, cur+big AS active_working_set_bytes, ex+cur+rem+big AS peak_bytes FROM r,e,c""", "ledger", "archives")
def _(spark, sf):
    current = V.table(spark, sf, "pages").select(F.length("html").cast("bigint").alias("size"))
    return storage.storage_state(V.archives(spark, sf), V.ledger(spark, sf), current)


@query("output_size_estimate", f"""
WITH b AS (SELECT label, CASE WHEN {h('pe','doc_id')}%15=0 THEN NULL ELSE source_frames END AS f, source_sample_rate AS r FROM measured),
 s AS (SELECT label, f, ((f*16000 + r - 1)//r)*2 AS bytes FROM b)
SELECT label, count(f) AS files_measured, count(*)-count(f) AS files_pending, coalesce(sum(bytes),0)::BIGINT AS processed_bytes, max(bytes)::BIGINT AS maximum_single_output,
 CASE WHEN count(*)>count(f) THEN 'pending until extraction' ELSE 'complete from current headers' END AS status FROM s GROUP BY label""", "measured")
def _(spark, sf):
    m = V.measured(spark, sf)
    return storage.output_estimate(m.select("label", F.col("source_sample_rate").alias("sample_rate"), F.when(
        V.draw("pe", "doc_id", 15) != 0, F.col("source_frames")).alias("frames")), 16000)


@query("bulk_size_estimate", "SELECT lang AS label, count(*) AS files_measured, sum(length(text)-44)::BIGINT AS processed_bytes, max(length(text)-44) AS maximum_single_output FROM documents GROUP BY lang")
def _(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("lang").alias("label"), F.length("text").cast("bigint").alias("length"))
    return storage.bulk_estimate(d)


@query("space_estimate", f"""
WITH p AS (SELECT source_frames*2+44 AS size, {h('px','doc_id')}%3=0 AS present FROM measured),
 a AS (SELECT count(*) AS rows, count(*) FILTER (WHERE NOT present) AS missing_outputs, sum(size) FILTER (WHERE NOT present)::BIGINT AS missing_output_bytes,
  (sum((size+4095)//4096*4096) FILTER (WHERE NOT present))::BIGINT AS missing_output_allocated_bytes, max((size+4095)//4096*4096)::BIGINT AS largest_temporary_bytes FROM p),
 m AS (SELECT *, 2*greatest(1048576, rows*2048) AS manifest_reserve_bytes FROM a),
 s AS (SELECT *, missing_output_allocated_bytes+largest_temporary_bytes+manifest_reserve_bytes AS subtotal_bytes FROM m),
 f AS (SELECT *, greatest(1073741824, (subtotal_bytes+99)//100) AS safety_reserve_bytes FROM s)
SELECT *, subtotal_bytes+safety_reserve_bytes AS required_bytes FROM f""", "measured")
def _(spark, sf):
    m = V.measured(spark, sf).select((F.col("source_frames") * 2 + 44).alias("size"), (V.draw("px", "doc_id", 3) == 0).alias("present"))
    return storage.space_estimate(m)


VIEWS["targets"] = (("ledger",), f"SELECT CASE WHEN {h('tg','utt_id')}%40=0 THEN utt_id||'-t' ELSE utt_id END AS utt_id, split FROM ledger")
VIEWS["stored"] = (("ledger",), f"SELECT utt_id, CASE WHEN {h('sf','utt_id')}%30=0 THEN sha256('broken') ELSE sha256_extracted END AS sha256 FROM ledger")
VIEWS["valid"] = (("targets", "stored", "archives"), """
  SELECT t.utt_id, t.split FROM targets t JOIN ledger l ON t.utt_id=l.utt_id AND t.split=l.split JOIN archives a ON a.archive_name=l.archive_name AND lower(a.checksum)=lower(l.archive_md5)
  JOIN stored s ON s.utt_id=l.utt_id AND s.sha256=l.sha256_extracted""")


def _targets(ledger):
    return ledger.select(F.when(V.draw("tg", "utt_id", 40) == 0, F.concat("utt_id", F.lit("-t"))).otherwise(F.col("utt_id")).alias("utt_id"), "split")


def _work(spark, sf):
    # The ledger's columns that four branches read, computed once.
    l = stored(V.ledger(spark, sf).select("utt_id", "split", "archive_name", "archive_md5", "sha256_extracted", "member_size"), "ledger")
    targets = _targets(l)
    inventory = l.select("utt_id", F.when(V.draw("sf", "utt_id", 30) == 0, F.sha2(F.lit("broken"), 256)).otherwise(
        F.col("sha256_extracted")).alias("sha256"))
    archives = l.groupBy("archive_name").agg(F.sum("member_size").alias("size")).withColumn("checksum", F.md5("archive_name"))
    return targets, inventory, reconcile.valid_extractions(targets, l, archives, inventory)


@query("valid_extractions", "SELECT utt_id, split FROM valid", "valid")
def _(spark, sf):
    return _work(spark, sf)[2]


@query("outstanding_work", """
SELECT t.split, count(*) AS targets, count(v.utt_id) AS valid, count(*)-count(v.utt_id) AS outstanding, count(*) FILTER (WHERE s.utt_id IS NULL) AS never_inventoried
FROM targets t LEFT JOIN valid v ON t.utt_id=v.utt_id LEFT JOIN stored s ON s.utt_id=t.utt_id GROUP BY t.split""", "valid")
def _(spark, sf):
    targets, stored, valid = _work(spark, sf)
    return reconcile.outstanding(targets, valid, stored)


@query("missing_key_preview", """
WITH m AS (SELECT split||':'||utt_id AS item FROM targets WHERE utt_id NOT IN (SELECT utt_id FROM stored))
SELECT count(*) AS n, (SELECT string_agg(item, ', ' ORDER BY item) FROM (SELECT item FROM m ORDER BY item LIMIT 10)) AS preview, count(*)-least(count(*),10) AS remainder FROM m""", "targets", "stored")
def _(spark, sf):
    # Ids and splits alone: hashes and archives play no part here.
    l = stored(V.ledger(spark, sf).select("utt_id", "split"), "ledger")
    return reconcile.missing_preview(_targets(l), l.select("utt_id"))


_INV = """inv AS (SELECT name, size, contains(name,chr(92)) OR starts_with(name,'/') OR starts_with(name,'../') OR contains(name,'/../') OR regexp_matches(name,'^[A-Za-z]:') AS unsafe,
  regexp_replace(regexp_extract(name,'([^/]*)$',1),'[.][^.]*$','') AS utt_id FROM members WHERE is_regular)"""


@query("archive_inventory", f"WITH {_INV} SELECT utt_id, count(*) AS copies, min(name) AS member_name, arg_min(size, name) AS member_size FROM inv WHERE NOT unsafe GROUP BY utt_id", "members")
def _(spark, sf):
    return storage.inventory_summary(storage.inventory(V.members(spark, sf)), "page_id")


@query("archive_selection", f"""
WITH {_INV}, w AS (SELECT DISTINCT regexp_replace(regexp_extract(regexp_replace(url,'[?#].*$',''),'([^/]*)$',1),'[.][^.]*$','') AS utt_id FROM pages),
 s AS (SELECT utt_id, count(*) AS c, arg_min(size,name) AS size FROM inv WHERE NOT unsafe GROUP BY utt_id)
SELECT w.utt_id, CASE WHEN c IS NULL THEN 'missing' WHEN c>1 THEN 'duplicate' ELSE 'extracted' END AS state, CASE WHEN c=1 THEN size END AS member_size FROM w LEFT JOIN s ON w.utt_id=s.utt_id""", "members")
def _(spark, sf):
    url = F.regexp_replace("url", "[?#].*$", "")
    wanted = V.table(spark, sf, "pages").select(F.regexp_replace(F.substring_index(url, "/", -1), "[.][^.]*$", "").alias("utt_id")).distinct()
    return storage.selection_report(storage.inventory_summary(storage.inventory(V.members(spark, sf).drop("page_id"))), wanted)


# --- catalog, receipts, reports ---------------------------------------------------------------

def _catalog(spark, sf):
    o = V.table(spark, sf, "orders")
    c = o.select(F.concat(F.lit("a"), F.col("o_orderkey").cast("string"), F.lit(".tar")).alias("artifact"), "o_orderkey",
                 F.floor("o_totalprice").cast("bigint").alias("size"))
    st = V.draw("st", "o_orderkey", 7)
    # An absent file or receipt is one that lies under another name; every row stays.
    name = (F.when(st.isin(2, 3, 4), F.concat("artifact", F.lit(".partial")))
            .when(st == 6, F.concat(F.lit("elsewhere-"), F.col("artifact"))).otherwise(F.col("artifact")))
    have = c.select(name.alias("name"), F.when(st == 5, F.lit(0)).when(st.isin(1, 2), F.col("size") - 1)
                    .when(st == 4, F.col("size") + 1).otherwise(F.col("size")).cast("bigint").alias("length"))
    receipts = c.select(F.when(V.draw("rc", "o_orderkey", 2) == 0, F.col("artifact")).otherwise(
        F.concat(F.lit("elsewhere-"), F.col("artifact"))).alias("artifact"))
    return c.drop("o_orderkey"), have, receipts


@query("acquisition_plan", f"""
WITH c AS (SELECT 'a'||o_orderkey||'.tar' AS artifact, floor(o_totalprice)::BIGINT AS size, {h('st','o_orderkey')}%7 AS st, {h('rc','o_orderkey')}%2=0 AS rc FROM orders),
 s AS (SELECT *, CASE WHEN st=0 AND rc THEN 'final with receipt' WHEN st=0 THEN 'final without receipt' WHEN st IN (1,5) THEN 'invalid final' WHEN st=2 THEN 'partial'
   WHEN st=3 THEN 'complete partial' WHEN st=4 THEN 'oversized partial' ELSE 'missing' END AS state FROM c)
SELECT artifact, size, state, CASE state WHEN 'final with receipt' THEN 0 WHEN 'partial' THEN 1 ELSE size END::BIGINT AS remaining_bytes FROM s""")
def _(spark, sf):
    return storage.acquisition_plan(*_catalog(spark, sf))


_RF = ("version", "name", "checksum")


@query("receipt_problems", f"""
WITH c AS (SELECT 'a'||o_orderkey||'.tar' AS artifact, {h('rp','o_orderkey')}%50 AS d FROM orders)
SELECT artifact, CASE d WHEN 0 THEN 'version' WHEN 1 THEN 'checksum,version' WHEN 2 THEN 'observed.sha256' ELSE 'name' END AS differing FROM c WHERE d<4""")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    d = V.draw("rp", "o_orderkey", 50)
    art = F.concat(F.lit("a"), F.col("o_orderkey").cast("string"), F.lit(".tar"))
    good = F.sha2(art, 256)
    catalog = o.select(art.alias("artifact"), F.lit("v1").alias("version"), art.alias("name"), F.lit("md5").alias("checksum_algorithm"), F.md5(art).alias("checksum"))
    receipts = o.select(art.alias("artifact"), F.when(d.isin(0, 1), "v2").otherwise("v1").alias("version"),
                        F.when(d == 3, "other").otherwise(art).alias("name"), F.when(d == 1, "bad").otherwise(F.md5(art)).alias("checksum"),
                        F.when(d == 2, "short").otherwise(good).alias("observed_sha256"))
    return storage.receipt_problems(catalog, receipts, fields=_RF)


def _reports(spark, sf):
    return jobs.validate_protocols(V.protocol(spark, sf), V.counterpart(spark, sf), P)["report"]


# Receipts of which each field differs once in a while; the number of a field is the draw that spoils it.
_TOLD = [*storage.RECEIPT_FIELDS, "origin", "observed.sha256"]
_ORIGINS = ("fetched", "resumed")


@query("receipt_fields", f"""
WITH c AS (SELECT 'a'||o_orderkey||'.tar' AS artifact, {h('rf','o_orderkey')}%40 AS d, {h('rg','o_orderkey')}%40 AS e FROM orders),
 f(field, k) AS (VALUES {", ".join(f"('{f}',{i})" for i, f in enumerate(_TOLD))})
SELECT artifact, string_agg(field, ',' ORDER BY field) AS differing FROM c JOIN f ON k=d OR k=e GROUP BY artifact""")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    art = F.concat(F.lit("a"), F.col("o_orderkey").cast("string"), F.lit(".tar"))
    spoiled = {f: (V.draw("rf", "o_orderkey", 40) == i) | (V.draw("rg", "o_orderkey", 40) == i) for i, f in enumerate(_TOLD)}
    text = {"dataset_id": F.lit("orders"), "version": F.lit("v1"), "revision": F.col("o_orderdate").cast("string"), "name": art,
            "remote_path": F.concat(F.lit("data/"), art), "url": F.concat(F.lit("https://example.org/"), art), "checksum_algorithm": F.lit("md5"),
            "checksum": F.md5(art), "license": F.col("o_orderstatus"), "usage_policy": F.lit(None).cast("string")}
    size = F.floor(F.col("o_totalprice")).cast("bigint")
    catalog = o.select(art.alias("artifact"), *[c.alias(n) for n, c in text.items()], size.alias("expected_size"), size.alias("observed_size"))
    told = o.select(
        art.alias("artifact"), *[F.when(spoiled[n], "other").otherwise(c).alias(n) for n, c in text.items()],
        *[F.when(spoiled[n], size + 1).otherwise(size).alias(n) for n in ("expected_size", "observed_size")],
        F.when(spoiled["origin"], "found").otherwise(F.when(F.col("o_orderkey") % 2 == 0, "fetched").otherwise("resumed")).alias("origin"),
        F.when(spoiled["observed.sha256"], F.upper(F.sha2(art, 256))).otherwise(F.sha2(art, 256)).alias("observed_sha256"))
    return storage.receipt_problems(catalog, told, origins=_ORIGINS)


@query("protocol_rules", f"""
WITH l AS (SELECT * REPLACE (CASE WHEN {h('lang','utt_id')}%40=0 THEN 'xx' ELSE language END AS language) FROM protocol
    UNION ALL SELECT * FROM protocol WHERE {h('twice','utt_id')}%25=0),
 r AS (SELECT split, utt_id, key FROM counterpart UNION ALL SELECT split, utt_id, key FROM counterpart WHERE {h('twice','utt_id')}%30=1),
 p(split, prefix) AS (VALUES {", ".join(f"('{s}','{x}')" for s, x in P.prefixes.items())})
SELECT 'duplicate_left_id' AS rule, split||'|'||utt_id AS key, count(*)::VARCHAR AS detail FROM l GROUP BY split, utt_id HAVING count(*)>1
UNION ALL SELECT 'duplicate_right_id', split||'|'||utt_id, count(*)::VARCHAR FROM r GROUP BY split, utt_id HAVING count(*)>1
UNION ALL SELECT 'malformed_left_id', utt_id, l.split FROM l LEFT JOIN p ON l.split=p.split WHERE NOT coalesce(regexp_full_match(utt_id, prefix||'_[0-9]{{10}}'), false)
UNION ALL SELECT 'malformed_right_id', utt_id, r.split FROM r LEFT JOIN p ON r.split=p.split WHERE NOT coalesce(regexp_full_match(utt_id, prefix||'_[0-9]{{10}}'), false)
UNION ALL SELECT 'unsupported_left_label', label, count(*)::VARCHAR FROM l WHERE label NOT IN ('pristine','generated') GROUP BY label
UNION ALL SELECT 'unsupported_right_label', key, count(*)::VARCHAR FROM r WHERE key NOT IN ('bonafide','spoof') GROUP BY key
UNION ALL SELECT 'other_language', language, count(*)::VARCHAR FROM l WHERE language<>'en' GROUP BY language""", "protocol", "counterpart")
def _(spark, sf):
    left, right = V.protocol(spark, sf), V.counterpart(spark, sf)
    other = F.when(V.draw("lang", "utt_id", 40) == 0, "xx").otherwise(F.col("language"))
    left = left.withColumn("language", other).unionByName(left.filter(V.draw("twice", "utt_id", 25) == 0))
    right = right.unionByName(right.filter(V.draw("twice", "utt_id", 30) == 1))
    return jobs.validate_protocols(left, right, P)["violations"]


@query("rule_report_gate", f"""
WITH l AS (SELECT * FROM protocol), p AS (SELECT l.split, l.label, r.key, l.spk_id<>r.spk_id OR l.gender<>r.gender AS d, r.utt_id IS NULL AS missing,
   coalesce((l.label='pristine' AND r.key='bonafide') OR (l.label='generated' AND r.key='spoof'), false) AS ok FROM l LEFT JOIN counterpart r ON l.utt_id=r.utt_id),
 s AS (SELECT split, count(*) FILTER (WHERE missing) + count(*) FILTER (WHERE NOT missing AND (d OR NOT ok)) AS errs, count(*) FILTER (WHERE ok) AS m FROM p GROUP BY split)
SELECT 'has_errors' AS rule, split AS key, errs::VARCHAR AS detail FROM s UNION ALL SELECT 'incomplete', split, m::VARCHAR FROM s
UNION ALL SELECT 'unsupported_split', split, split FROM s WHERE split NOT IN ('train','dev','test') UNION ALL SELECT 'missing_report','test',''""", "protocol", "counterpart")
def _(spark, sf):
    r = _reports(spark, sf).withColumnRenamed("left_fingerprint", "left_fingerprint")
    return rules.report_gate(r, ["train", "dev", "test"])


@query("rule_stale_reports", """
SELECT 'stale_rows' AS rule, split AS key, count(*)::VARCHAR AS detail FROM protocol WHERE split='dev' GROUP BY split
UNION ALL SELECT 'stale_fingerprint', 'dev', NULL""", "protocol")
def _(spark, sf):
    p = V.protocol(spark, sf)
    now = freeze(reconcile.table_fingerprint(p, ["split"], ["utt_id", "label"]))
    path = scratch_path(spark, "reports")
    # The stored report is written as JSON lines and read back, as a later command would.
    old = now.withColumn("rows", F.when(F.col("split") == "dev", F.col("rows") + 1).otherwise(F.col("rows"))).withColumn(
        "fingerprint", F.when(F.col("split") == "dev", F.sha2("fingerprint", 256)).otherwise(F.col("fingerprint")))
    sinks.write_report(old, path)
    stored = spark.read.text(path).select(F.from_json("value", "split string, rows long, fingerprint string").alias("j")).select("j.*")
    out = rules.stale_reports(stored, now, "split", ["rows", "fingerprint"])
    return out.withColumn("detail", F.when(F.col("rule") == "stale_rows", F.col("detail")))


@query("raw_manifest", """
SELECT p.utt_id, p.spk_id, p.gender, p.language, p.dataset, p.split, p.label, p.attack_id, coalesce(replace(c.codec,'-',''),'') AS protocol_codec, coalesce(replace(c.tmp,'-',''),'') AS source_group_id,
 m.source_path, '' AS processed_path, m.sha256_source, '' AS sha256_processed, 'two-source-verified' AS metadata_source
FROM protocol p JOIN manifest m ON p.utt_id=m.utt_id LEFT JOIN counterpart c ON p.utt_id=c.utt_id""", "manifest", "counterpart")
def _(spark, sf):
    stored = V.manifest(spark, sf).select(F.col("source_path").alias("path"), F.col("sha256_source").alias("sha256"))
    return jobs.build_manifest(V.protocol(spark, sf), V.counterpart(spark, sf), stored, P)["manifest"]


@query("protocol_union", "SELECT utt_id, spk_id, 'left' AS publisher FROM protocol UNION ALL SELECT utt_id, spk_id, 'right' FROM counterpart", "protocol", "counterpart")
def _(spark, sf):
    return V.protocol(spark, sf).select("utt_id", "spk_id", F.lit("left").alias("publisher")).unionByName(
        V.counterpart(spark, sf).select("utt_id", "spk_id", F.lit("right").alias("publisher")))


# --- files written by one job and read by the next --------------------------------------------

_PROTO = "SELECT spk_id, utt_id, gender, codec, attack_id, label, native, language, dataset, 'train' AS split FROM protocol"


@query("protocol_csv_scan", _PROTO.replace("'train' AS split", "'train' AS split") + " WHERE language='en'", "protocol")
def _(spark, sf):
    path = scratch_path(spark, "protocol")
    sinks.write_manifest(V.protocol(spark, sf).select(*schemas.PROTOCOL_COLUMNS), path)
    return protocols.read_protocol(spark, path, "train", P, language="en", multiline=False)[0]


@query("counterpart_line_scan", "SELECT * EXCLUDE (split), 'train' AS split FROM counterpart", "counterpart")
def _(spark, sf):
    path = scratch_path(spark, "counterpart")
    V.counterpart(spark, sf).select(F.concat_ws(" ", *schemas.COUNTERPART_COLUMNS).alias("value")).write.text(path)
    return protocols.read_counterpart(spark, path, "train", P)[0]


@query("crowd_csv_scan", "SELECT file_path, task, variety, dataset, accent, up_votes, down_votes, text, 'train' AS split FROM crowd", "crowd")
def _(spark, sf):
    path = scratch_path(spark, "crowd")
    c = V.crowd(spark, sf)
    blank = [F.lit("").alias(n) for n in schemas.CROWD_COLUMNS if n not in c.columns]
    sinks.write_manifest(c.select("*", *blank).select(*schemas.CROWD_COLUMNS), path)
    return protocols.read_crowd(spark, {"train": path})[0].select(
        "file_path", "task", "variety", "dataset", "accent", "up_votes", "down_votes", "text", "split")


@query("generated_csv_scan", """
SELECT utt_id, attack_id, 'corpus/dataset/generated/train/wav/'||utt_id||'.wav' AS audio_path, 'train' AS split FROM protocol WHERE language='en' AND label='generated' AND dataset='SYNTH'""", "protocol")
def _(spark, sf):
    path = scratch_path(spark, "generated")
    sinks.write_manifest(V.protocol(spark, sf).select(*schemas.PROTOCOL_COLUMNS), path)
    return protocols.read_generated(spark, path, "train", P, root="corpus")[0].select("utt_id", "attack_id", "audio_path", "split")


@query("manifest_csv_roundtrip", "SELECT * EXCLUDE (doc_id, text) FROM manifest", "manifest")
def _(spark, sf):
    path = scratch_path(spark, "manifest")
    sinks.write_manifest(V.manifest(spark, sf), path)
    return protocols.read_manifest(spark, path)


@query("numbered_lines", "SELECT count(*) AS lines, true AS contiguous FROM documents")
def _(spark, sf):
    from corpuslens.sources.text_lines import numbered_lines
    path = scratch_path(spark, "lines")
    V.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("value")).write.text(path)
    n = F.count(F.lit(1))
    per_file = numbered_lines(spark, path).groupBy("file").agg(
        n.alias("n"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"), F.sum("line_no").alias("s"))
    whole = (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("s") * 2 == F.col("n") * (F.col("n") + 1))
    return per_file.agg(F.sum("n").alias("lines"), F.bool_and(whole).alias("contiguous"))


@query("file_inventory_and_hashes")
def _(spark, sf):
    return files.file_hashes(spark, sf, "*.parquet").select("name", "length", "sha256", "md5")


@query("input_evidence")
def _(spark, sf):
    return files.input_evidence(spark, sf, "*.parquet").select("key", "sha256", "size_bytes")


@query("provenance_table")
def _(spark, sf):
    return jobs.provenance(files.input_evidence(spark, sf, "*.parquet"), {"protocol": schemas.PROTOCOL_COLUMNS},
                           {"split": "hash of the id"}, {"eval": "ids of the two publishers differ"})


@query("published_set", "SELECT spk_id, utt_id, gender, codec, attack_id, label, native, language, dataset, split, 'kept' AS second_publication FROM protocol", "protocol")
def _(spark, sf):
    root = scratch_path(spark, "published")
    p = V.protocol(spark, sf)
    tables = {"protocol": p, "overlap": reconcile.key_overlap(p, V.counterpart(spark, sf), "utt_id", "split")}
    sinks.publish_set(tables, root)
    again = sinks.publish_set(tables, root)
    return spark.read.parquet(f"{root}/protocol").withColumn("second_publication", F.lit(again["protocol"]))


@query("resumable_stages", "SELECT split, label, count(*) AS n FROM protocol GROUP BY ALL", "protocol")
def _(spark, sf):
    root = scratch_path(spark, "stages")
    stages = {"collect": lambda read: V.protocol(spark, sf),
              "count": lambda read: read("collect").groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))}
    sinks.run_stages(spark, root, {"a": 1}, stages)
    sinks.run_stages(spark, root, {"a": 1}, stages)
    return spark.read.parquet(f"{root}/{sinks.config_hash({'a': 1})}/count")


@query("latest_runs", f"""
WITH r AS (SELECT 'enc'||(o_custkey%7) AS encoder, CASE WHEN {h('sm','o_orderkey')}%3=0 THEN 'smoke_' ELSE '' END||strftime(o_orderdate,'%Y%m%d')||'_'||o_orderkey AS run FROM orders)
SELECT encoder, coalesce(max(run) FILTER (WHERE NOT starts_with(run,'smoke')), max(run)) AS run FROM r GROUP BY encoder""")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    run = F.concat(F.when(V.draw("sm", "o_orderkey", 3) == 0, "smoke_").otherwise(""), F.date_format("o_orderdate", "yyyyMMdd"),
                   F.lit("_"), F.col("o_orderkey").cast("string"))
    return compare.latest_runs(o.select(F.concat(F.lit("enc"), (F.col("o_custkey") % 7).cast("string")).alias("encoder"), run.alias("run")), "encoder", "run")


@query("same_clips_across_runs", """
WITH c AS (SELECT sample_id FROM (SELECT *, row_number() OVER (PARTITION BY quadrant ORDER BY CASE WHEN p_spoof_ad>0.5 THEN -p_spoof_ad ELSE p_spoof_ad END, sample_id) AS rn
 FROM (SELECT *, """ + S.quadrant("p_spoof_ad > 0.5") + """ AS quadrant FROM scored)) WHERE rn<=3)
SELECT sample_id, run, ground_truth, p_spoof, (p_spoof>0.5)::INTEGER AS pred, CASE WHEN (p_spoof>0.5)::INTEGER=ground_truth THEN 'hit' ELSE 'miss' END AS outcome FROM run_scores WHERE sample_id IN (SELECT sample_id FROM c)""", "scored", "run_scores")
def _(spark, sf):
    from corpuslens.operators import sampling
    chosen = sampling.confident_per_quadrant(V.scored(spark, sf), "ground_truth", "p_spoof_ad", "sample_id", 3)
    return jobs.same_clips(chosen, V.run_scores(spark, sf), V.RUNS)


# --- models -----------------------------------------------------------------------------------

def _technical(spark, sf):
    return freeze(V.measured(spark, sf).select("utt_id", "spk_id", "split", "label", *models.TECHNICAL_FEATURES))


@query("technical_baseline_metrics")
def _(spark, sf):
    # The derived speakers leak between splits on purpose, so the gate is checked by its own query.
    return models.technical_baseline(_technical(spark, sf), check=False)["metrics"]


@query("technical_baseline_coefficients")
def _(spark, sf):
    return models.technical_baseline(_technical(spark, sf), check=False)["coefficients"]


def _embeddings(spark, sf):
    return freeze(V.scored(spark, sf).select("sample_id", "ground_truth", "p_spoof_zs", F.col("samples").alias("embedding")))


@query("out_of_fold_scores")
def _(spark, sf):
    return models.out_of_fold(_embeddings(spark, sf), "embedding", "ground_truth", "sample_id")


@query("adaptation_check")
def _(spark, sf):
    return models.adapt(_embeddings(spark, sf), None, "embedding", "ground_truth", "sample_id", zero_shot="p_spoof_zs")[1]


@query("head_comparison")
def _(spark, sf):
    return models.compare_heads(_embeddings(spark, sf), "embedding", "ground_truth", "sample_id")


@query("out_of_fold_optimum", """
WITH f AS (SELECT ((row_number() OVER (PARTITION BY ground_truth ORDER BY md5('42:'||sample_id)) - 1) % 5)::INTEGER AS fold FROM signals)
SELECT h.fold::INTEGER AS fold, c.place::INTEGER AS place, (SELECT count(*) FROM f WHERE f.fold <> h.fold) AS n_train, 0.0 AS gradient FROM range(0,5) h(fold), range(0,65) c(place)""", "signals")
def _(spark, sf):
    """The slope of each fold's objective at its solution, by plain aggregates over the rows: zero everywhere."""
    folds = freeze(sampling.stratified_folds(_embeddings(spark, sf), "ground_truth", ["sample_id"], 5))
    parts = []
    for fold, head in models.fit_logistic(folds, "embedding", "ground_truth", "fold", 5).items():
        rows = head.score(folds.filter(F.col("fold") != fold), "embedding").withColumn("_e", F.col("p_spoof") - F.col("ground_truth"))
        cells = [(F.get("embedding", F.lit(i)) - float(m)) / float(s) for i, (m, s) in enumerate(zip(head.mean, head.spread, strict=True))]
        sums = rows.agg(F.count(F.lit(1)).alias("n_train"), *[F.sum(F.col("_e") * c).alias(f"g{i}") for i, c in enumerate([*cells, F.lit(1.0)])])
        own = [*(head.weights * head.spread), 0.0]
        places = F.array(*[F.struct(F.lit(i).alias("place"), (F.col(f"g{i}") + float(w)).alias("gradient")) for i, w in enumerate(own)])
        parts.append(sums.select(F.lit(fold).alias("fold"), "n_train", F.explode(places).alias("c")).select("fold", "c.place", "n_train", "c.gradient"))
    return rounded(rules.union_all(parts), "gradient")


@query("folded_head_scores")
def _(spark, sf):
    e = _embeddings(spark, sf)
    head = models.fit_logistic(e, "embedding", "ground_truth")[0]
    centred = F.zip_with("embedding", F.array(*[F.lit(float(v)) for v in head.mean]), lambda x, m: x - m)
    unit = F.zip_with(centred, F.array(*[F.lit(float(v)) for v in head.spread]), lambda x, s: x / s)
    bias = head.bias + float(head.weights @ head.mean)
    return head.score(e, "embedding", "p_folded").withColumn("_u", unit).select(
        "sample_id", models.linear_score(F.col("_u"), head.weights * head.spread, bias).alias("p_spoof"), "p_folded")


def _surrogate(spark, sf):
    f = freeze(V.featured(spark, sf).drop("samples"))
    return models.fit_surrogate(f, V.BAND_COLUMNS, "p_spoof_ad", "sample_id")


@query("surrogate_fit")
def _(spark, sf):
    return _surrogate(spark, sf)[2]


@query("surrogate_importance")
def _(spark, sf):
    model, held, _ = _surrogate(spark, sf)
    return models.permutation_importance(model, held, V.BAND_COLUMNS, "p_spoof_ad", "sample_id")


# --- whole stages -----------------------------------------------------------------------------

@query("protocol_validation", f"""
WITH c AS (SELECT p.*, CASE WHEN r.utt_id IS NULL THEN 0 ELSE 1 END AS seen, r.key FROM protocol p LEFT JOIN counterpart r ON p.utt_id=r.utt_id),
 m AS (SELECT split, label, count(*) AS actual FROM c WHERE (label='pristine' AND key='bonafide') OR (label='generated' AND key='spoof') GROUP BY ALL)
SELECT coalesce(m.split,e.split) AS split, coalesce(m.label,e.label) AS label, coalesce(actual,0) AS actual, coalesce(expected,0) AS expected, coalesce(actual,0)-coalesce(expected,0) AS difference
FROM m FULL JOIN (SELECT * FROM (VALUES """ + ",".join(f"('{s}','{l}',{n}::BIGINT)" for (s, l), n in P.expected_counts.items()) + """) v(split,label,expected)) e ON m.split=e.split AND m.label=e.label""",
       "protocol", "counterpart")
def _(spark, sf):
    return jobs.validate_protocols(V.protocol(spark, sf), V.counterpart(spark, sf), P)["counts"]


@query("published_audit_counts", """
SELECT concat_ws('_', CASE WHEN grouping(split)=0 THEN 'split' END, CASE WHEN grouping(label)=0 THEN 'label' END,
    CASE WHEN grouping(spk_id)=0 THEN 'speaker' END, CASE WHEN grouping(attack_id)=0 THEN 'attack' END) AS counted, count(*) AS count
FROM manifest GROUP BY CUBE (split, label, spk_id, attack_id) HAVING grouping(split)+grouping(label)+grouping(spk_id)+grouping(attack_id) < 4""", "manifest")
def _(spark, sf):
    root = scratch_path(spark, "audit")
    jobs.audit_and_publish(V.measured(spark, sf), V.MEASURES, P, root)
    return spark.read.parquet(f"{root}/counts").select("counted", "count")


@query("confirmatory_stage", f"""
WITH top AS (SELECT feature FROM (SELECT feature, max(abs(rho)) AS s FROM correlations GROUP BY feature) ORDER BY s DESC, feature LIMIT 3),
 q AS (SELECT r.* FROM quadrant_rows r JOIN top USING (feature))
SELECT detector, feature, 'welch_TN_vs_FP' AS test, {_r('statistic','statistic')} FROM ({_WELCH.replace('quadrant_rows', 'q')})
UNION ALL SELECT detector, feature, 'levene_TP_vs_FN', {_r('statistic','statistic')} FROM ({_LEVENE.replace('quadrant_rows', 'q')})""",
       "correlations", "quadrant_rows")
def _(spark, sf):
    m = V.master(spark, sf)
    c = stats.within_class_correlation(m, rules.present_detectors(m.columns), V.BAND_COLUMNS)
    return rounded(jobs.confirmatory_stage(m, c, V.BAND_COLUMNS, 3).select("detector", "feature", "test", "statistic"), "statistic")


@query("collected_samples", """
SELECT sample_id, ground_truth FROM (SELECT *, row_number() OVER (PARTITION BY ground_truth ORDER BY md5('42:'||sample_id)) AS rn FROM signals) WHERE rn<=150""", "signals")
def _(spark, sf):
    return jobs.collect_samples(V.signals(spark, sf), "ground_truth", "sample_id", 150).select("sample_id", "ground_truth")


@query("telephony_scores")
def _(spark, sf):
    from corpuslens.functions import dsp
    s = V.signals(spark, sf).withColumn("y", dsp.telephony(F.col("samples"), V.SIGNAL_RATE, 32))
    return s.select("sample_id", V.scorer(2)(F.col("y")).alias("score"))


@query("run_comparison_tables", f"""
WITH r AS (SELECT run, sample_id, row_number() OVER (PARTITION BY run ORDER BY p_spoof, md5(sample_id::VARCHAR)) AS rk FROM run_scores),
 b AS (SELECT run, band, row_number() OVER (PARTITION BY run ORDER BY relevance) AS rk FROM run_relevance)
SELECT x.run AS run_a, y.run AS run_b, {_r('corr(x.rk,y.rk)','spearman')}, count(*) AS n, 'clips' AS kind FROM r x JOIN r y ON x.sample_id=y.sample_id AND x.run='enc_a' AND y.run='enc_b' GROUP BY ALL
UNION ALL SELECT x.run, y.run, {_r('corr(x.rk,y.rk)','spearman')}, count(*), 'bands' FROM b x JOIN b y ON x.band=y.band AND x.run='enc_a' AND y.run='enc_b' GROUP BY ALL""", "run_scores", "run_relevance")
def _(spark, sf):
    from corpuslens.operators import metrics
    from corpuslens.plans.signal_queries import _run_relevance
    scores = freeze(V.run_scores(spark, sf))
    e = metrics.evaluate(scores, ["run"], "p_spoof", "ground_truth").select(
        "run", F.lit("ad").alias("detector"), (F.col("eer") / 100).alias("eer"), F.col("mcc_eer").alias("mcc"), F.col("acc_eer").alias("accuracy"))
    out = jobs.compare_runs(e, _run_relevance(spark, sf), scores, V.RUNS, excluded=["enc_c"])
    both = out["clip_agreement"].withColumn("kind", F.lit("clips")).unionByName(out["band_agreement"].withColumn("kind", F.lit("bands")))
    return rounded(both, "spearman")


# --- streams ----------------------------------------------------------------------------------

QUOTA = 40


@query("stream_class_quota", f"SELECT label, least(count(*), {QUOTA}) AS n FROM embeddings GROUP BY label")
def _(spark, sf):
    from corpuslens.streaming.quota import first_per_class
    still = V.table(spark, sf, "embeddings").select("vec_id", "label")
    # A pattern, as a stream takes no single file by its plain name; the table may be a file or a folder of files.
    stream = spark.readStream.schema(V.table(spark, sf, "embeddings").schema).parquet(
        f"{sf.rstrip('/')}/embeddings.parque[t]").select(*still.columns)
    out = scratch_path(spark, "quota")
    done = (first_per_class(stream, "label", QUOTA).writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", scratch_path(spark, "quota-state")).trigger(availableNow=True).start())
    done.awaitTermination()
    return spark.read.schema(still.schema).parquet(out).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("stream_ledger_upsert", "SELECT utt_id, split, archive_name, member_size FROM ledger", "ledger")
def _(spark, sf):
    from corpuslens.streaming.ledger_stream import read_ledger, upsert_stream
    source, root = scratch_path(spark, "ledger-in"), scratch_path(spark, "ledger-out")
    V.ledger(spark, sf).write.parquet(source)
    stream = spark.readStream.schema(schemas.LEDGER).parquet(source)
    upsert_stream(stream, root, scratch_path(spark, "ledger-state")).awaitTermination()
    return read_ledger(spark, root).select("utt_id", "split", "archive_name", "member_size")
