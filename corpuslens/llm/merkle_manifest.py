"""A Merkle manifest of documents as a content-addressed DAG, with proofs by descent from the root.

A leaf is the digest of a row's fields.  The leaves of a language, ordered by doc_id, are the bottom of
a tree in which every ``ARITY`` consecutive nodes (the last ones may be fewer, even one) have the digest
of their digests as parent; the tops of the languages, ordered by language, are the leaves of one
more tree, whose top is the root of the manifest.

The DAG is stored in pages: a page is addressed by the digest of its top node and holds the digests of
all nodes ``STRIDE`` levels down, level by level, so that the children of each of its nodes are known.
Equal digests mean equal content, so equal pages are stored once.  Requests for leaves descend from the
root: the digits of a leaf's rank pick a child at every level, the digests of the children not picked
are collected, a page at a time, and the path segments are reversed at the end, from leaf to root.
Requests below the same node descend as one, so a page near the root is read once for each of its
children and not for each leaf, and no digest gathers more than a page's width of requests.

Ranks come from a sort by ranges and running totals of its files; nodes of a page are grouped by rank,
at most ``ARITY ** STRIDE`` in a group.  Rounds grow with the logarithm of the leaves.

Edge cases: a null field is written as ``-``, an empty text as ``0:``, so they differ; null doc_ids
come first in their language; rows of equal doc_id follow their leaf digests, equal leaves are nodes
of their own; a null language is one of its own and comes first; one leaf alone is its subroot, one
subroot alone is the root, and its proof is the digest of nothing; an empty table gives no rows;
extra columns are not used.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm import common

ARITY, STRIDE = 2, 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as its length in bytes and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def node_digest(children: Sequence[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def fold_levels(bottom: list[str], steps: int, arity: int = ARITY) -> list[list[str]]:
    """The levels of digests above ``bottom``, which comes first."""
    out = [bottom]
    for _ in range(steps):
        below = out[-1]
        out.append([node_digest(below[i:i + arity]) for i in range(0, len(below), arity)])
    return out


def walk_down(levels: list[list[str]], place: int, arity: int = ARITY) -> list[list[str]]:
    """For each level of a page, from its bottom: the children not picked on the way down to ``place``."""
    segment, start = [], 0
    for k in range(len(levels) - 2, -1, -1):
        run = levels[k][start:start + arity]
        digit = place // arity**k % arity
        segment.append(run[:digit] + run[digit + 1:])
        start = (start + digit) * arity
    return segment[::-1]


def _height(n: Column, arity: int) -> Column:
    """Levels above ``n`` leaves until one node is left."""
    powers, k = [1], 0
    while powers[-1] < 2**63:
        powers.append(powers[-1] * arity)
    return F.size(F.filter(F.array(*[F.lit(p) for p in powers if p < 2**63]), lambda p: p < n))


def _build(batches: Iterator[pa.RecordBatch], arity: int, stride: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        levels = [fold_levels(nodes, min(stride, left), arity) for nodes, left in zip(
            batch["nodes"].to_pylist(), batch["left"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch["tree"], batch["no"], pa.array([x[-1][0] for x in levels], pa.string()),
             pa.array(levels, pa.list_(pa.list_(pa.string())))], names=["tree", "no", "digest", "levels"])


def _descend(batches: Iterator[pa.RecordBatch], arity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        segments = [[walk_down(levels, place, arity) for place in places] for levels, places in zip(
            batch["levels"].to_pylist(), batch["places"].to_pylist(), strict=True)]
        keep = [i for i, name in enumerate(batch.schema.names) if name not in ("levels", "places")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in keep], pa.array(segments, pa.list_(pa.list_(pa.list_(pa.string()))))],
            names=[*[batch.schema.names[i] for i in keep], "segments"])


def ranked(rows: DataFrame, order: Sequence[str], rank: str) -> DataFrame:
    """Add ``rank``: the place of a row among those of its ``tree`` in the order of some columns, from 0; written once."""
    table = common.written(rows, "unordered")
    parts = max(1, min(4096, -(-table.count() // 100_000)))
    sorted_rows = common.written(
        table.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order), "ordered")
    keyed = common.with_row_key(sorted_rows).withColumn("__cl_one", F.lit(1).cast("long"))
    placed = common.with_offsets(keyed, "__cl_one", rank, by=["tree"])
    return common.written(placed.select(*rows.columns, rank), "ranked")


@dataclass(frozen=True)
class Store:
    """Trees as pages: ``rounds[r]`` has (tree, no, digest) of the pages that begin ``r * stride`` levels up,
    ``pages`` (digest, levels) of all, ``tops`` (tree, n, digest)."""

    rounds: list[DataFrame]
    pages: DataFrame
    tops: DataFrame
    arity: int
    stride: int


def store(leaves: DataFrame, arity: int = ARITY, stride: int = STRIDE) -> Store:
    """Build the trees over ``leaves``: (tree, rank, digest), with ranks from 0 in every tree."""
    width = arity**stride
    sizes = common.written(leaves.groupBy("tree").agg(F.count("*").alias("n")).withColumn("height", _height(F.col("n"), arity)), "sizes")
    highest = sizes.agg(F.max("height")).first()[0] or 0
    nodes, rounds, pages = leaves, [], []
    for r in range(max(1, -(-highest // stride))):
        # A page for each group of consecutive nodes; trees that ended below are not among the nodes.
        groups = nodes.groupBy("tree", F.floor(F.col("rank") / width).alias("no")).agg(
            F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("nodes"))
        left = F.greatest(F.lit(0), F.col("height") - r * stride)
        groups = groups.join(common.shared_small(sizes.select("tree", left.alias("left"))), "tree").select(
            "tree", "no", F.col("nodes.digest").alias("nodes"), "left")
        made = common.written(groups.mapInArrow(functools.partial(_build, arity=arity, stride=stride),
                                                "tree string, no long, digest string, levels array<array<string>>"), "pages")
        rounds.append(made.select("tree", "no", "digest"))
        pages.append(made.select("digest", "levels"))
        ended = sizes.where(F.col("height") <= (r + 1) * stride).select("tree")
        nodes = made.select("tree", F.col("no").alias("rank"), "digest").join(ended, "tree", "left_anti")
    all_pages = functools.reduce(DataFrame.union, pages)
    tops = functools.reduce(DataFrame.union, [
        pages_of.join(sizes.where(F.greatest(F.lit(1), F.ceil(F.col("height") / stride)) == r + 1), "tree").select("tree", "n", "digest")
        for r, pages_of in enumerate(rounds)])
    return Store(rounds, common.written(all_pages.dropDuplicates(["digest"]), "store"), common.written(tops, "tops"), arity, stride)


def prove(held: Store, requests: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """``requests`` with ``digits`` and ``siblings``, level by level from the leaf to the top.

    ``requests`` has a row for each (tree, rank) that is asked for, with any other columns.  ``above`` may
    hold (tree, digits, siblings) of the tops themselves, which are appended.
    """
    arity, stride, width = held.arity, held.stride, held.arity**held.stride
    digits_type, path_type = "array<int>", "array<array<string>>"
    # (tree, no, digest, digits, siblings): where the descent stands; at first at the tops.
    now = held.tops.select("tree", F.lit(0).cast("long").alias("no"), "digest", F.ceil(
        F.greatest(_height(F.col("n"), arity), F.lit(1)) / stride).alias("pages"), _height(F.col("n"), arity).alias("height"))
    if above is None:
        now = now.withColumns({"digits": F.array().cast(digits_type), "siblings": F.array().cast(path_type)})
    else:
        now = now.join(above, "tree")
    now = common.written(now, "descent")
    for r in range(len(held.rounds) - 1, -1, -1):
        here = now.where(F.col("pages") == r + 1).drop("pages")
        # What is asked for below each page: places at its bottom, each once, at most its width of them.
        place = F.floor(F.col("rank") / width**r)
        no, spot = F.floor(place / width).alias("no"), F.pmod(place, F.lit(width)).cast("int").alias("place")
        if r:
            asked = requests.select("tree", no, spot).distinct().groupBy("tree", "no").agg(F.collect_list("place").alias("places"))
            asked = asked.withColumn("asked", F.transform("places", lambda p: F.struct(p.alias("place"))))
        else:
            asked = requests.select("tree", no, F.struct(spot, F.struct(*requests.columns).alias("row")).alias("asked")).groupBy(
                "tree", "no").agg(F.collect_list("asked").alias("asked")).withColumn("places", F.col("asked.place"))
        met = here.join(asked, ["tree", "no"]).join(held.pages, "digest")
        schema = met.drop("levels", "places").withColumn("segments", F.lit(None).cast("array<array<array<string>>>")).schema
        walked = met.mapInArrow(functools.partial(_descend, arity=arity), schema)
        one = walked.select("tree", "no", "height", "digits", "siblings", F.explode(F.arrays_zip("asked", "segments")).alias("x"))
        steps = F.size("x.segments")
        own = F.transform(F.sequence(F.lit(0), steps - 1), lambda k: F.pmod(F.floor(
            F.col("x.asked.place") / F.pow(F.lit(float(arity)), k)), F.lit(arity)).cast("int"))
        digits = F.concat(F.when(steps > 0, own).otherwise(F.array().cast(digits_type)), "digits").alias("digits")
        path = F.concat("x.segments", "siblings").alias("siblings")
        if not r:
            return one.select("x.asked.row.*", digits, path)
        below = one.select("tree", "height", (F.col("no") * width + F.col("x.asked.place")).alias("no"), digits, path)
        below = below.join(held.rounds[r - 1], ["tree", "no"]).withColumn("pages", F.lit(r).cast("long"))
        waiting = now.where(F.col("pages") <= r)
        now = common.written(below.unionByName(waiting.select(*below.columns)), "descent")
    raise AssertionError("a store has at least one round")


def folded(leaf: Column, digits: Column, siblings: Column) -> Column:
    """The top that a leaf and the siblings on its way give."""
    def up(node: Column, x: Column) -> Column:
        before, after = F.slice(x["siblings"], F.lit(1), x["digits"]), F.slice(x["siblings"], x["digits"] + 1, F.size(x["siblings"]))
        return F.sha2(F.concat(F.array_join(before, ""), node, F.array_join(after, "")), 256)
    return F.aggregate(F.arrays_zip(digits.alias("digits"), siblings.alias("siblings")), leaf, up)


def manifest(docs: DataFrame, claimed: Column | None = None, arity: int = ARITY, stride: int = STRIDE) -> DataFrame:
    """A row for each document: doc_id, leaf, subroot, root, ``digits`` and ``siblings`` from leaf to root, and
    ``claimed``, the digest of the row with n_chars as the column given claims."""
    keyed = common.with_row_key(docs)
    fields = [F.col(c) for c in FIELDS]
    other = fields if claimed is None else [claimed if c == "n_chars" else F.col(c) for c in FIELDS]
    # A prefix keeps the null language apart, and first.
    tree = F.coalesce(F.concat(F.lit("v"), F.col("lang")), F.lit("n"))
    # The last column spreads equal rows over ranges; their order does not matter.
    leaves = keyed.select("doc_id", tree.alias("tree"), leaf_digest(fields).alias("leaf"), leaf_digest(other).alias("claimed"),
                          F.xxhash64(*common.ROW_KEY).alias("own"))
    leaves = ranked(leaves, ["doc_id", "leaf", "own"], "rank")
    by_lang = store(leaves.select("tree", "rank", F.col("leaf").alias("digest")), arity, stride)
    tops = ranked(by_lang.tops.select(F.lit("root").alias("tree"), F.col("tree").alias("lang"), "digest"), ["lang"], "rank")
    over = store(tops.select("tree", "rank", "digest"), arity, stride)
    above = prove(over, tops).select(F.col("lang").alias("tree"), F.col("digest").alias("subroot"), "digits", "siblings")
    root = over.tops.select(F.col("digest").alias("root"))
    above = common.written(above.join(F.broadcast(root.limit(1))), "above")
    proofs = prove(by_lang, leaves.select("tree", "rank", "doc_id", "leaf", "claimed"), above.select("tree", "digits", "siblings"))
    return proofs.join(common.shared_small(above.select("tree", "subroot", "root")), "tree").select(
        "doc_id", "leaf", "claimed", "subroot", "root", "digits", "siblings")
