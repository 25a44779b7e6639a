"""SimHash near-duplicates found by a hierarchical index in Gray order.

A fingerprint has a bit for each bit of 64-bit hashes of word shingles: 1 if set in more than half
of them.  Distinct fingerprints are sorted by Gray rank, in which neighbours tend to differ in few
bits, and cut into leaves of consecutive ones.  A node keeps what its members share: a mask of the
bits in which all agree and their pattern there; nodes of consecutive leaves form the nodes above,
level by level, with the shared bits factored upwards.  Two nodes whose patterns differ, within the
bits that both masks have, in more bits than allowed have no linked members below, so whole groups
are pruned.  The index is joined with itself from the top: pairs of nodes that survive open into pairs
of children, the pairs of leaves that are left compare groups of fingerprints the same way, and only
then fingerprints.  Each pair of leaves returns a spanning forest of its links, so many links between
the same fingerprints stay few rows; components join the forests.

Nothing is broadcast but keys of counted frequent fingerprints.  A level is a table with a row for
each node, a node has at most ``FAN`` children, a leaf at most about ``LEAF`` fingerprints, and the
levels grow with the logarithm of their number.

Edge cases: a null or empty text, or one of blanks only, has fingerprint zero, which links like any
other; a text of one or two words is one shingle; ties and repeated rows share a fingerprint and a
component; a null doc_id stays as a row and counts as larger than every id, so a component of such
rows alone has a null id; an empty table gives no rows; extra columns are not used.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm import common
from corpuslens.llm.components import components

SHINGLE, DIFFERENCE, SEED = 3, 2, 42
#: Fingerprints in a leaf, fingerprints that are compared as one group there, children of a node.
LEAF, GROUP, FAN = 2048, 32, 32
#: A fingerprint of more rows than this many is joined by a broadcast of such ones; see :func:`_placed`.
HOT_ROWS, MAX_HOT = 20_000, 100_000
_SLICE = 1 << 16


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n, width = b" ".join(words), max(1, len(words) - width + 1), min(width, len(words))
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts, ends, ones = [0, *ends[:n - 1]], [e - 1 for e in ends[width - 1:]], np.zeros(64, np.int64)
    for k in range(0, n, _SLICE):
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[i:j], seed) for i, j in zip(
            starts[k:k + _SLICE], ends[k:k + _SLICE], strict=True)), np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes())


def _fingerprints() -> Callable:
    def run(texts: list[bytes]) -> list[list]:
        return [[(f := fingerprint(t)) - (f >> 63 << 64) for t in texts]]
    return run


def gray_rank(code: Column) -> Column:
    """The place of a code in Gray order, as a long that sorts as the unsigned rank does."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-2**63))


def linked_groups(left: np.ndarray, right: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs (left, right) of codes at most ``most`` bits apart, by groups that share patterns."""
    def grouped(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(np.arange(-(-len(codes) // GROUP) * GROUP), len(codes) - 1).reshape(-1, GROUP)
        rows = codes.view(np.uint64)[at]
        either, both = np.bitwise_or.reduce(rows, axis=1), np.bitwise_and.reduce(rows, axis=1)
        return at, ~(either ^ both), both

    at_l, mask_l, pattern_l = grouped(left)
    at_r, mask_r, pattern_r = grouped(right)
    differ = np.bitwise_count((pattern_l[:, None] ^ pattern_r[None, :]) & mask_l[:, None] & mask_r[None, :])
    found_l, found_r = [], []
    i, j = np.nonzero(differ <= most)
    for start in range(0, len(i), 512):
        a, b = at_l[i[start:start + 512]], at_r[j[start:start + 512]]
        k, x, y = np.nonzero(np.bitwise_count(left.view(np.uint64)[a][:, :, None] ^ right.view(np.uint64)[b][:, None, :]) <= most)
        found_l.append(a[k, x])
        found_r.append(b[k, y])
    return (np.concatenate(found_l), np.concatenate(found_r)) if found_l else (np.zeros(0, int), np.zeros(0, int))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each node's component, for nodes 0 to n - 1 with links a, b."""
    label = np.arange(n)
    while True:
        old = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == old).all():
            return label


def _leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted codes to leaves: the codes with the mask and pattern that all of them share."""
    held = np.zeros(0, np.int64)

    def leaf(codes: np.ndarray) -> pd.DataFrame:
        either, both = np.bitwise_or.reduce(codes), np.bitwise_and.reduce(codes)
        return pd.DataFrame({"mask": [int(~(either ^ both))], "pattern": [int(both)], "codes": [codes.tobytes()]})

    for batch in batches:
        held = np.concatenate([held, batch["code"].to_numpy(np.int64)])
        while len(held) >= LEAF:
            yield leaf(held[:LEAF])
            held = held[LEAF:]
    if len(held):
        yield leaf(held)


def _links(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Spanning forests of the links between the codes of two leaves, or within one."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            left, right = np.frombuffer(row.codes, np.int64), np.frombuffer(row.other_codes, np.int64)
            i, j = linked_groups(left, right, most)
            codes, place = np.unique(np.concatenate([left, right]), return_inverse=True)
            label = forest(place[i], place[len(left) + j], len(codes))
            a = np.flatnonzero(label != np.arange(len(codes)))
            yield pd.DataFrame({"a": codes[a], "b": codes[label[a]]})


def levels(codes: DataFrame) -> list[DataFrame]:
    """The index over distinct codes, leaves first: (no, mask, pattern), leaves with their codes.

    Every table is written to the shared folder; ``no`` numbers the nodes of a level in Gray order, and
    the children of node k are those numbered k * FAN and on.
    """
    n = codes.count()
    ordered = codes.select("code", gray_rank(F.col("code")).alias("rank")).repartitionByRange(
        max(1, -(-n // (8 * LEAF))), "rank").sortWithinPartitions("rank").select("code")
    leaves = common.written(ordered.mapInPandas(_leaves, "mask long, pattern long, codes binary"), "leaves")
    numbered = common.with_offsets(common.with_row_key(leaves).withColumn("one", F.lit(1).cast("long")), "one", "no")
    out = [common.written(numbered.select("no", "mask", "pattern", "codes"), "leaves")]
    nodes = out[0].count()
    while nodes > FAN:
        below = out[-1].select(F.floor(F.col("no") / FAN).alias("no"), "mask", "pattern")
        # Bits in which all children agree, inside all of their masks.
        both = F.bit_and("pattern")
        same = F.bit_and("mask").bitwiseAND(F.bitwise_not(F.bit_or("pattern").bitwiseXOR(both)))
        out.append(common.written(below.groupBy("no").agg(same.alias("mask"), both.alias("pattern")), "nodes"))
        nodes = -(-nodes // FAN)
    return out


def _far(a: Column, b: Column) -> Column:
    """In how many bits two nodes differ for certain."""
    return F.bit_count(a["pattern"].bitwiseXOR(b["pattern"]).bitwiseAND(a["mask"]).bitwiseAND(b["mask"]))


def leaf_pairs(index: list[DataFrame], most: int = DIFFERENCE) -> DataFrame:
    """(a, b) with a <= b: numbers of the leaves that may hold linked codes, by descending the index from its top."""
    # Above the top there is one node; its children are all nodes of the top, at most FAN.
    pairs = index[-1].sparkSession.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in reversed(index):
        kids = level.groupBy(F.floor(F.col("no") / FAN).alias("up")).agg(
            F.collect_list(F.struct("no", "mask", "pattern")).alias("nodes"))
        met = pairs.join(kids.withColumnsRenamed({"up": "a", "nodes": "left"}), "a").join(
            kids.withColumnsRenamed({"up": "b", "nodes": "right"}), "b").select("right", F.explode("left").alias("l"))
        near = F.filter("right", lambda r: (F.col("l.no") <= r["no"]) & (_far(F.col("l"), r) <= most))
        pairs = common.written(met.select(F.col("l.no").alias("a"), F.explode(F.transform(near, lambda r: r["no"])).alias("b")), "pairs")
    return pairs


def links(codes: DataFrame, most: int = DIFFERENCE) -> DataFrame:
    """(a, b): links between distinct codes at most ``most`` bits apart, enough of them to connect what all connect."""
    index = levels(codes)
    leaves = index[0].select("no", "codes")
    pairs = leaf_pairs(index, most)
    width = max(1, min(8192, -(-pairs.count() // 64)))
    met = pairs.join(leaves.withColumnsRenamed({"no": "a"}), "a").join(
        leaves.select(F.col("no").alias("b"), F.col("codes").alias("other_codes")), "b")
    return met.repartition(width, F.xxhash64("a", "b")).mapInPandas(lambda batches: _links(batches, most), "a long, b long").distinct()


def _placed(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """Rows with ``least``, looked up by ``code``.  ``counted`` has one row for each code, with its number of rows.

    The rows of frequent codes stay where they are: these codes, at most ``MAX_HOT`` (no more can have that
    many rows, as the limit grows with all rows), are broadcast.  The others are shuffled.
    """
    total = counted.agg(F.sum("rows")).first()[0] or 0
    hot = F.col("rows") > max(HOT_ROWS, total // MAX_HOT)
    few = F.broadcast(counted.where(hot).select("code", F.col("least").alias("hot_least"), F.lit(True).alias("hot")))
    marked = rows.join(few, "code", "left")
    rest = marked.where("hot is null").drop("hot", "hot_least").join(counted.where(~hot).select("code", "least"), "code")
    return rest.unionByName(marked.where("hot").withColumnRenamed("hot_least", "least").drop("hot"))


def near_duplicates(docs: DataFrame, most: int = DIFFERENCE) -> DataFrame:
    """Every row's doc_id with ``fingerprint`` (16 hex digits) and ``component_id``, the least doc_id reachable by links."""
    texts = docs.select("doc_id", common.whole_text().cast("binary").alias("__cl_text"))
    rows = common.written(common.with_python(texts, "__cl_text", _fingerprints, "code bigint"), "fingerprints")
    codes = common.written(rows.groupBy("code").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "codes")
    roots = components(links(codes, most)).select(F.col("a").alias("code"), F.col("b").alias("root"))
    rooted = common.written(codes.join(roots, "code", "left").withColumn("root", F.coalesce("root", "code")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("least"))
    counted = common.written(rooted.drop("least").join(least, "root").select("code", "least", "rows"), "counted")
    return _placed(rows, counted).select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"),
                                         F.col("least").alias("component_id"))
