import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpus import documents, odd_texts, prose
from corpuslens.llm import packing


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.tokenizer_path())


ENCODER = packing.TextEncoder(packing.tokenizer_path())
PARTS = st.sampled_from([" ", "  ", "\n", "\t", "\x85", "\xa0", "　", "a", "Wörd", "don't", "'LL", "12", "½", "²", "ſ", "語", "!?",
                         "<|endoftext|>", "\x1c", "é", "́", "x\n\n"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=12))
def test_quick_encoder_equals_tokenizer(parts):
    text = "".join(parts)
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ENCODER.whole(text)


def test_pieces_tile_the_stream(spark, plain):
    docs = documents(spark, odd_texts() + [(i, prose(i, 300)) for i in range(10, 40)]).repartition(5)
    table = packing.pack(docs)
    pieces = table.toPandas()
    by_doc = table.where("doc_id is not null").toPandas().sort_values("start").groupby("doc_id")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for key, part in by_doc:
        if key == 6:
            continue
        want = plain.encode(texts[key], add_special_tokens=False).ids + [packing.END_ID]
        got = np.concatenate([np.frombuffer(b, "<u4") for b in part.ids]).tolist()
        assert got == want and (part.doc_tokens == len(want)).all()
        assert part.start.tolist() == np.r_[0, part.length.cumsum()[:-1]].tolist()
    rows = pieces.sort_values(["sequence_id", "offset"])
    for _, part in rows.groupby("sequence_id"):
        assert part.offset.tolist() == np.r_[0, part.length.cumsum()[:-1]].tolist() and part.length.sum() <= packing.WINDOW
    full = rows.groupby("sequence_id").length.sum()
    assert (full.iloc[:-1] == packing.WINDOW).all() and full.index.tolist() == list(range(len(full)))
    assert (pieces.doc_id == 6).sum() >= 2 and table.where(f"doc_id = {2**60 + 1}").count() == 1


def test_sequences_round_trip(spark):
    docs = documents(spark, [(i, prose(i, 700)) for i in range(6)])
    pieces = packing.pack(docs)
    total = pieces.agg(F.sum("length")).first()[0]
    whole = packing.sequences(pieces).orderBy("sequence_id").toPandas()
    assert sum(len(b) for b in whole.ids) == 4 * total and all(len(b) == 4 * packing.WINDOW for b in whole.ids[:-1])


def test_empty_table(spark):
    assert packing.pack(documents(spark, []).where("false")).count() == 0
