"""Packing: documents' token ids are concatenated in reading order and cut into fixed windows.

Two passes.  The first tokenises every whole text and keeps running token counts inside each
file split; the second adds the totals of the earlier splits, which gives every document its
place in one endless stream, and cuts it at multiples of the window.  A document over a border
gives one record on each side.  Only the last window of the corpus can be short, so padding is
less than one window in all.

Edge cases: a null or empty text has no ids but the end id and so one piece; repeated rows are
packed as often as they occur; a null ``doc_id`` stays null; extra columns are not used; an
empty table gives no pieces.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm import common

WINDOW = 1024
#: Ends each document.
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class TextEncoder:
    """Ids of a byte-level BPE tokenizer, by the faster of two equal encoders where that is certain.

    The second encoder holds the same vocabulary as ranks.  It takes Latin texts without added
    tokens, if the vocabulary's ids follow its merges; beyond Latin two libraries may know
    different versions of Unicode.  Where no two blanks meet, the splitting pattern needs no
    look-ahead.
    """

    _beyond_latin = re.compile("[^\x00-\u024f]")
    _blanks_meet = re.compile(r"\s\s")
    _no_lookahead = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.ranks = self._ranks(spec)

    def _ranks(self, spec: dict) -> dict[bytes, int] | None:
        """The vocabulary as ranks; None where ids do not follow the merges."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        vocab, merges = model["vocab"], [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
        plain = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                 and spec.get("normalizer") is None and not model.get("ignore_merges")
                 and all(vocab.get(m) == 256 + i for i, m in enumerate(merges)))
        if not plain:
            return None
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = sorted(set(range(256)) - set(shown))
        byte = {ord(chr(b)): b for b in shown} | {256 + i: b for i, b in enumerate(hidden)}
        as_bytes = {k: chr(b) for k, b in byte.items()}
        return {t.translate(as_bytes).encode("latin-1"): i for t, i in vocab.items() if t not in self.added}

    @functools.cached_property
    def whole(self):
        from tokenizers import Tokenizer
        model = Tokenizer.from_file(self.path)
        return lambda text: model.encode(text, add_special_tokens=False).ids

    def _by_rank(self, pattern: str):
        import tiktoken
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=self.ranks,
                                 special_tokens={}).encode_ordinary

    @functools.cached_property
    def by_rank(self):
        import public_tokenizers
        return self._by_rank(public_tokenizers.PATTERN)

    @functools.cached_property
    def by_rank_simply(self):
        return self._by_rank(self._no_lookahead)

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if self.ranks is None or self._beyond_latin.search(text) or any(t in text for t in self.added):
            ids = self.whole(text)
        else:
            ids = (self.by_rank if self._blanks_meet.search(text) else self.by_rank_simply)(text)
        return np.array(ids, "<u4").tobytes()


def _tokeniser(path: str, end: bytes):
    encode = TextEncoder(path).encode

    def tokenise(texts: list[str]) -> list[list]:
        ids = [encode(t) + end for t in texts]
        return [[len(x) // 4 for x in ids], ids]
    return tokenise


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: where each lies and its ids (little-endian unsigned 32-bit).

    Columns: doc_id, start, length, doc_tokens, sequence_id, offset, ids.  ``tokenizer`` is the
    path of the vocabulary file on every executor.
    """
    path = tokenizer or tokenizer_path()
    keyed = common.with_row_key(docs)
    narrow = keyed.select("doc_id", common.FILE, common.BLOCK, common.ROW, common.whole_text().alias("__cl_text"))
    tokens = common.with_python(narrow, "__cl_text", functools.partial(
        _tokeniser, path=path, end=end_id.to_bytes(4, "little")), "__cl_n long, __cl_ids binary", 1000)
    placed = common.with_offsets(tokens, "__cl_n", "__cl_at")
    at, n, w = F.col("__cl_at"), F.col("__cl_n"), F.lit(window)
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(
        F.floor(at / w), F.floor((at + n - 1) / w))))
    low = F.greatest(at, F.col("sequence_id") * w)
    high = F.least(at + n, (F.col("sequence_id") + 1) * w)
    return cut.select(
        "doc_id", (low - at).alias("start"), (high - low).alias("length"), n.alias("doc_tokens"),
        "sequence_id", (low - F.col("sequence_id") * w).alias("offset"),
        F.substring("__cl_ids", ((low - at) * 4 + 1).cast("int"), ((high - low) * 4).cast("int")).alias("ids"))


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences: the pieces' ids joined by offset; at most one window of ids a group."""
    return pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("parts")).select(
        "sequence_id", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"))
