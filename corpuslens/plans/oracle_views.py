"""The logical tables once more, in DuckDB SQL, for checking."""

from __future__ import annotations

from corpuslens.functions.keys import poisson_cdf
from corpuslens.plans import views as V


def h(tag: str, key: str) -> str:
    """SQL of the hash draw of ``tag:key``."""
    return f"(('0x'||substr(md5('{tag}:'||{key}),1,8))::BIGINT)"


def poisson(u: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {u} >= {p!r} THEN 1 ELSE 0 END" for p in poisson_cdf()) + ")"


def weights(salt: int) -> str:
    return "[" + ",".join(repr(x) for x in V.weight_values(salt)) + "]::DOUBLE[]"


def dot(samples: str, salt: int) -> str:
    return (f"list_sum(list_transform(range(1,65), lambda i: {samples}[i] * ({weights(salt)})[i]))")


def sigmoid(z: str) -> str:
    return f"round(1.0/(1.0+exp(-({z}))), 9)"


_EDGES = "[" + ",".join(repr(e) for e in V.BAND_EDGES) + "]::DOUBLE[]"
_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def dropped(chars: str) -> str:
    return f"(length(text) - length(translate(text, {chars}, '')))"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "base": ((), f"""
        SELECT d.doc_id, d.text, d.lang, d.source, l.quality,
          CASE WHEN {h('s','d.doc_id')}%10 < 7 THEN 'train' WHEN {h('s','d.doc_id')}%10 < 9 THEN 'dev' ELSE 'eval' END AS split,
          CASE WHEN l.quality = 1 THEN 'pristine' WHEN l.quality = 0 THEN 'generated'
               WHEN {h('q','d.doc_id')}%2 = 0 THEN 'pristine' ELSE 'generated' END AS label
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "protocol": (("base",), f"""
        SELECT doc_id, text, source AS spk_id,
          CASE split WHEN 'train' THEN 'T' WHEN 'dev' THEN 'D' ELSE 'E' END || '_' || lpad(doc_id::VARCHAR, 10, '0') AS utt_id,
          CASE WHEN {h('g','source')}%2 = 0 THEN 'F' ELSE 'M' END AS gender, '-' AS codec,
          CASE WHEN label = 'pristine' THEN 'pristine' ELSE 'A' || lpad(({h('a','doc_id')}%16 + 1)::VARCHAR, 2, '0') END AS attack_id,
          label, 'yes' AS native, lang AS language,
          CASE WHEN {h('d','doc_id')}%50 = 0 THEN 'OTHER' WHEN label = 'generated' THEN 'SYNTH' ELSE 'FIELD' END AS dataset,
          split FROM base"""),
    "counterpart": (("protocol",), f"""
        SELECT CASE WHEN {h('k','doc_id')}%33 = 0 THEN 'unk' ELSE spk_id END AS spk_id,
          CASE WHEN {h('m','doc_id')}%40 = 0 THEN substr(utt_id,1,2)||'9'||substr(utt_id,4,9) ELSE utt_id END AS utt_id,
          CASE WHEN {h('n','doc_id')}%37 = 0 THEN 'unk' ELSE gender END AS gender,
          CASE WHEN {h('c','doc_id')}%3 = 0 THEN '-' ELSE 'C-'||({h('c','doc_id')}%3)::VARCHAR END AS codec,
          '-' AS codec_q, '-' AS codec_seed, '-' AS attack_tag, attack_id,
          CASE WHEN (label = 'generated') <> ({h('f','doc_id')}%29 = 0) THEN 'spoof' ELSE 'bonafide' END AS key,
          CASE WHEN {h('t','doc_id')}%4 = 0 THEN '-' ELSE 'G-'||(doc_id//3)::VARCHAR END AS tmp, split
        FROM protocol"""),
    "manifest": (("protocol",), f"""
        SELECT utt_id, spk_id, gender, language, dataset, split, label, attack_id,
          CASE WHEN {h('c','doc_id')}%3 = 0 THEN '' ELSE 'C'||({h('c','doc_id')}%3)::VARCHAR END AS protocol_codec,
          CASE WHEN {h('t','doc_id')}%4 = 0 THEN '' ELSE 'G'||(doc_id//3)::VARCHAR END AS source_group_id,
          CASE WHEN label = 'pristine' THEN 'raw/pristine/'||split||'/'||utt_id||'.flac'
               ELSE 'dataset/generated/'||split||'/'||utt_id||'.wav' END AS source_path,
          '' AS processed_path, sha256(text) AS sha256_source, '' AS sha256_processed,
          'two-source-verified' AS metadata_source, doc_id, text FROM protocol"""),
    "measured": (("manifest",), f"""
        SELECT * EXCLUDE (text, src_rms, n_lines, n_words, n_len),
          CASE WHEN src_rms > 0 THEN round(20.0*log10(src_rms), 9) END AS source_rms_dbfs,
          CASE WHEN n_lines > 0 THEN round(10.0*log10(n_words/n_lines), 9) END AS source_estimated_snr_db
        FROM (SELECT *, CASE WHEN label = 'generated' THEN 22050 ELSE 8000 END::BIGINT AS source_sample_rate,
          CASE WHEN label = 'generated' THEN 2 ELSE 1 END::BIGINT AS source_channels,
          length(text)::BIGINT AS source_frames, length(text) AS n_len,
          round(length(text) / CASE WHEN label = 'generated' THEN 22050 ELSE 8000 END, 9) AS source_duration_seconds,
          round({dropped(repr(_UP))} / length(text), 9) AS source_peak,
          round({dropped("'0123456789'")} / length(text), 9) AS source_rms,
          round({dropped("'0123456789'")} / length(text), 9) AS src_rms,
          round({dropped("' '||chr(10)")} / length(text), 9) AS source_silence_ratio,
          {dropped("chr(10)")} AS n_lines,
          length(trim(text, ' ')) - length(replace(trim(text, ' '), ' ', '')) + 1 AS n_words
          FROM manifest)"""),
    "crowd": ((), f"""
        WITH e AS (SELECT *, CASE WHEN {h('s','event_id')}%10 < 7 THEN 'train' WHEN {h('s','event_id')}%10 < 9 THEN 'dev' ELSE 'test' END AS split,
            {h('p','event_id')}%97 AS bad, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events),
          f AS (SELECT *, split||'/'||user_id||'/'||event_id||'.wav' AS path FROM e)
        SELECT event_id, CASE bad WHEN 1 THEN '' WHEN 2 THEN '/'||path WHEN 3 THEN replace(path, '/', chr(92))
            WHEN 4 THEN split||'/../'||event_id WHEN 5 THEN 'other/'||path ELSE path END AS file_path,
          'spoken' AS task, event_type AS variety, 'set'||(user_id%5)::VARCHAR AS dataset,
          CASE WHEN {h('x','event_id')}%6 = 0 THEN '' ELSE event_type END AS accent,
          CASE WHEN {h('v','event_id')}%9 = 0 THEN '' WHEN {h('v','event_id')}%61 = 7 THEN 'n/a' ELSE k END AS up_votes,
          CASE WHEN {h('w','event_id')}%4 = 0 THEN '' ELSE floor(value)::BIGINT::VARCHAR END AS down_votes,
          props AS text, split FROM f"""),
    "signals": ((), """
        SELECT vec_id AS sample_id, label AS class_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS ground_truth,
          64 AS sample_rate, list_transform(embedding, lambda v: v::DOUBLE) AS samples FROM embeddings"""),
    "scored": (("signals",), f"""
        SELECT *, {sigmoid(dot('samples',1) + ' + (2*ground_truth-1)*0.3')} AS p_spoof_zs,
          {sigmoid(dot('samples',2) + ' + (2*ground_truth-1)*0.8')} AS p_spoof_ad FROM signals"""),
    "run_scores": (("signals",), " UNION ALL ".join(
        f"SELECT '{run}' AS run, sample_id, ground_truth, "
        + sigmoid(dot('samples', 3 + i) + f" + (2*ground_truth-1)*{0.2 * (i + 1)!r}")
        + " AS p_spoof FROM signals" for i, run in enumerate(V.RUNS))),
    # Centred frames with reflected ends: sample at padded position j of a 64-sample signal.
    "frame_power": (("signals",), f"""
        WITH t AS (SELECT sample_id, samples, m, k FROM signals, range(0,9) a(m), range(0,9) b(k)),
          c AS (SELECT sample_id, m, k,
            list_transform(range(0,16), lambda n: samples[
              CASE WHEN m*8+n-8 < 0 THEN -(m*8+n-8) WHEN m*8+n-8 > 63 THEN 126-(m*8+n-8) ELSE m*8+n-8 END + 1]
              * (0.5-0.5*cos(2*pi()*n/16.0))) AS x FROM t)
        SELECT sample_id, m, k, k*4.0 AS hz,
          pow(list_sum(list_transform(range(0,16), lambda n: x[n+1]*cos(2*pi()*k*n/16.0))), 2)
          + pow(list_sum(list_transform(range(0,16), lambda n: x[n+1]*sin(2*pi()*k*n/16.0))), 2) AS power FROM c"""),
    "edges": ((), f"SELECT (i-1)::INTEGER AS band, ({_EDGES})[i] AS lo, ({_EDGES})[i+1] AS hi "
                  f"FROM range(1,{V.BAND_COUNT + 1}) r(i)"),
    "band_frames": (("frame_power", "edges"), """
        SELECT p.sample_id, p.m, e.band, ln(sum(p.power) + 1e-10) AS energy
        FROM frame_power p JOIN edges e ON p.hz >= e.lo AND p.hz < e.hi GROUP BY ALL"""),
    "featured": (("scored", "band_frames"), "SELECT s.sample_id, s.ground_truth, s.p_spoof_zs, s.p_spoof_ad, s.samples, "
        + ", ".join(f"b.band{k}_{st}" for st in ("mean", "std") for k in range(1, V.BAND_COUNT + 1))
        + " FROM scored s JOIN (SELECT sample_id, "
        + ", ".join(f"round({fn}(energy) FILTER (WHERE band = {k - 1}), 8) AS band{k}_{st}"
                    for st, fn in (("mean", "avg"), ("std", "stddev_pop")) for k in range(1, V.BAND_COUNT + 1))
        + " FROM band_frames GROUP BY sample_id) b ON s.sample_id = b.sample_id"),
    "ledger": ((), f"""
        WITH one AS (SELECT l_orderkey, l_linenumber, min(struct_pack(a := l_returnflag, b := l_partkey, c := l_extendedprice)) AS r
            FROM lineitem GROUP BY ALL),
          n AS (SELECT l_orderkey, l_linenumber, r.a AS flag, r.b AS part, r.c AS price,
            'flac_'||CASE r.a WHEN 'N' THEN 'T' WHEN 'A' THEN 'D' ELSE 'E' END||'_a'||(l_orderkey%7)||'.tar' AS archive_name FROM one)
        SELECT l_orderkey||'-'||l_linenumber AS utt_id,
          CASE flag WHEN 'N' THEN 'train' WHEN 'A' THEN 'dev' ELSE 'eval' END AS split, archive_name,
          CASE WHEN {h('u','l_orderkey')}%3000 = 0 THEN md5('stale') WHEN l_linenumber%2 = 0 THEN upper(md5(archive_name))
            ELSE md5(archive_name) END AS archive_md5,
          'm/'||part||'.flac' AS member_name, floor(price)::BIGINT AS member_size,
          sha256(l_orderkey||'-'||l_linenumber) AS sha256_extracted FROM n"""),
    "archives": (("ledger",), """
        SELECT archive_name, md5(archive_name) AS checksum, sum(member_size)::BIGINT AS size FROM ledger GROUP BY archive_name"""),
    "members": ((), f"""
        WITH b AS (SELECT page_id, html, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')||'.flac' AS base,
            {h('z','page_id')}%23 AS bad FROM pages)
        SELECT page_id, CASE bad WHEN 1 THEN '/'||base WHEN 2 THEN '../'||base WHEN 3 THEN replace(base, '/', chr(92))
            WHEN 4 THEN 'C:/'||base ELSE base END AS name, length(html)::BIGINT AS size,
          {h('r','page_id')}%31 <> 0 AS is_regular FROM b"""),
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named views and all they depend on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in ordered)
    body = sql.strip()
    if body.startswith("WITH "):
        body = ", " + body[5:]
    return f"WITH {ctes} {body}"
