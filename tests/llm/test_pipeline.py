import numpy as np
from collections import Counter

import corpus_pipeline
from corpus import documents, labels, odd_texts, prose
from corpuslens.llm import mixing, packing
from test_pairs import brute_chunks, shingles
from test_quality import base_values


def rows():
    long_line = prose(500, 70)
    out = [(300 + i, prose(i, 40 + i % 60) + ("\n" + long_line if i % 7 == 0 else "")) for i in range(60)]
    near = [(400 + i, out[i][1].replace(" ", f" changed{i} ", 1)) for i in range(1, 6)]
    return out + near + [(500, out[3][1])] + odd_texts()


def brute(table):
    kept = [r for r in table if (v := base_values(r[1]))[0] >= 10 and 100 * v[4] <= 20 * v[0]]
    before = Counter(kept)
    kept = [(d, t) for (d, t) in brute_chunks(kept) if t.split() or (d, t) in before]
    classes = []
    for d, t in sorted(kept, key=lambda r: (r[0] is None, r[0])):
        s = shingles(t)
        hit = [c for c in classes if any(5 * len(s & o) >= 4 * len(s | o) for _, _, o in c)]
        merged = sum(hit, []) + [(d, t, s)]
        classes = [c for c in classes if c not in hit] + [merged]
    return [min(((d, t) for d, t, _ in c), key=lambda r: (r[0] is None, r[0])) for c in classes]


def test_pipeline_equals_brute_force(spark, tmp_path):
    documents(spark, rows()).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(301, 1, 0), (302, 0, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    got = pieces.collect()
    want = brute(rows())
    model = packing.TextEncoder(packing.tokenizer_path())
    tokens = {d: len(model.encode(t)) // 4 + 1 for d, t in want}
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
        assert r.doc_tokens == tokens[r.doc_id]
    assert total == tokens
    stream = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))])
    assert len(stream) == sum(tokens.values()) and (stream == packing.END_ID).sum() >= len(tokens)


def test_stages_keep_columns_and_order(spark, tmp_path):
    documents(spark, rows()).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == columns and docs.count()
    # The stored order is the order of the slots.
    placed = mixing.place(spark.read.parquet(f"{tmp_path}/2")).toPandas()
    slot = dict(zip(placed.text, placed["__cl_slot"]))
    stored = docs.select("text", docs.metadataColumn("_metadata")["file_path"].alias("f"),
                         docs.metadataColumn("_metadata")["row_index"].alias("r")).collect()
    slots = [slot[x.text] for x in sorted(stored, key=lambda x: (x.f, x.r))]
    assert slots == sorted(slots)


def test_empty_tables(spark, tmp_path):
    documents(spark, rows()).where("false").write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
