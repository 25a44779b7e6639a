"""N-gram Jaccard join by chosen paths.

Every text is the set of its five-word shingles.  Copies (equal sets) are collapsed to one class
with a weight.  In each run every set picks tokens with chance 1 / (threshold * size), by a hash
common to all sets, so that two similar sets pick a common token more than once on average; sets
that pick the same token form a bucket.  Buckets of more than ``DIRECT`` sets are split again, up
to ``DEPTH`` depths, by freshly picked tokens of ``SPLITS`` runs; one that hardly shrinks is not
replaced by its parts.  It, all smaller ones, and what is still large in the end, are compared by
brute force, large ones block against block in separate tasks.  The chance to miss a pair at the
threshold is below 1e-5 at every depth.

Buckets with the same members are compared once; those still to be split stay one for each run,
since their repeats find the pairs.  Before any text is touched, the members of a bucket are parted
by their picks: two similar sets share 42 picks or more on average, so sets with fewer than
``SHARED_PICKS`` in common, directly and through others of the bucket, are not compared, and members
left alone go (a similar pair is parted with chance below 1e-7).  Then buckets whose members all lie
in one larger bucket go.  So a set's tokens are sent about as often as it has groups of near copies,
and large blocks are measured in sets and in bytes.  A pair that shares several buckets counts in the first of
them only.  Brute force returns no pairs but, for each set, the weight of its links, and the links
of a spanning forest, so that its output grows with the members and not with their square; classes
are the connected components of the forests.  Similarities are exact, from whole sets of 64-bit
shingle hashes; no bucket is capped.

Edge cases: a text of fewer than five words is one shingle; a null, empty or blank text has no
shingles, no links and a class of its own; repeated rows are copies; the class id is the least
doc_id of the class, null only if all its ids are null; an empty table gives no rows; extra
columns are not used.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm import common
from corpuslens.llm.components import components

WORDS, THRESHOLD = 5, 0.8
RUNS, DEPTH = 14, 3
#: Runs whose picks split a large bucket, and the share of its sets that a part of it must not exceed.
SPLITS, SHRUNK = 4, 0.5
#: Sets of a bucket that is compared rather than split; sets and bytes of tokens of a block of a large bucket.
DIRECT, BLOCK, BLOCK_BYTES = 4096, 2048, 8 << 20
#: The side of members that are compared among themselves; of two blocks they are 0 and 1.
WITHIN = 2
#: Picks that similar sets share; see :func:`parted_chance`.
SHARED_PICKS = 11
#: Rows of a matrix of pairs that are worked on at once.
_STRIPE = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Seeds of the picks: one for each run and depth.
_SEEDS = np.random.default_rng(7).integers(1, 2**63, (RUNS * DEPTH, 1), dtype=np.uint64)
#: Shingles whose picks are drawn at once.
_SLICE = 16_384


class Shingler:
    """Sets of shingle hashes, remembering the hashes of words."""

    def __init__(self, words: int = WORDS, most: int = 100_000):
        self.words, self.most, self.known = words, most, {}

    def set_of(self, text: str) -> np.ndarray:
        """The sorted, distinct shingle hashes of a whole text."""
        known = self.known
        words = text.split()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > self.most:
            known.clear()
        if not len(codes):
            return codes
        n = max(1, len(codes) - self.words + 1)
        hashes = np.full(n, len(codes) if n == 1 else self.words, np.uint64)
        for k in range(min(self.words, len(codes))):
            hashes = (hashes ^ codes[k:k + n]) * _ODD
            hashes ^= hashes >> np.uint64(31)
        return np.unique(hashes)


def picks(tokens: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(run and depth, token) of the tokens that a set picks."""
    if not len(tokens):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    chance = min(1.0, 1 / (threshold * len(tokens)))
    limit = np.uint64(min(2**64 - 1, int(chance * 2.0**64)))
    slots, found = [], []
    for start in range(0, len(tokens), _SLICE):
        part = tokens[start:start + _SLICE]
        drawn = (part[None, :] ^ _SEEDS) * _ODD
        drawn ^= drawn >> np.uint64(32)
        slot, at = np.nonzero(drawn * _ODD <= limit)
        slots.append(slot)
        found.append(part[at])
    return np.concatenate(slots).astype(np.int32), np.concatenate(found).view(np.int64)


def _describer():
    shingler = Shingler()

    def describe(texts: list[str]) -> list[list]:
        sets = [shingler.set_of(t) for t in texts]
        picked = [picks(s) for s in sets]
        return [[xxhash.xxh3_128_digest(s.tobytes()) for s in sets], list(map(len, sets)),
                [slots for slots, _ in picked], [tokens for _, tokens in picked]]
    return describe


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each set and bucket, with the set; sets of large buckets go to all pairs of blocks with theirs."""
    shingler = Shingler()
    for batch in batches:
        for start in range(0, len(batch), 200):
            rows = {c: [] for c in ("part", "side", "bucket", "set_id", "weight", "keys", "tokens")}
            for r in batch.iloc[start:start + 200].itertuples(index=False):
                tokens = shingler.set_of(r.text).tobytes()
                keys = np.sort(np.array([b["key"] for b in r.buckets], np.int64)).tobytes()
                for b in r.buckets:
                    blocks = b["blocks"]
                    own = xxhash.xxh64_intdigest(r.set_id, seed=b["key"] & (2**63 - 1)) % blocks
                    for other in range(blocks):
                        low, high = min(own, other), max(own, other)
                        part = b["key"] if blocks == 1 else xxhash.xxh64_intdigest(f"{b['key']}:{low}:{high}") - 2**63
                        for c, v in zip(rows, (part, WITHIN if low == high else int(own != low), b["key"], r.set_id, r.weight, keys, tokens), strict=True):
                            rows[c].append(v)
            yield pd.DataFrame(rows)


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of sets with sets; without ``right`` of ``left`` with itself."""
    sets = left if right is None else left + right
    m, n = len(left), len(left if right is None else right)
    if m == 1 and n == 1 and right is not None or m == 2 and right is None:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]]) if right is None else np.array([[both]])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    sizes = np.diff(np.r_[starts, len(values)])
    token = np.repeat(np.cumsum(sizes > 1) - 1, sizes)
    shared = np.repeat(sizes > 1, sizes)
    token, owner = token[shared], owner[shared]
    total = int(token[-1]) + 1 if len(token) else 0
    out = np.zeros((m, n), np.float32)
    width = max(256, 2_000_000 // len(sets))
    cuts = np.searchsorted(token, np.arange(0, total + width, width))
    for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
        has = np.zeros((len(sets), min(width, total - k * width)), np.float32)
        has[owner[i:j], token[i:j] - k * width] = 1
        out += has[:m] @ (has if right is None else has[m:]).T
    if right is None:
        np.fill_diagonal(out, [len(s) for s in left])
    np.rint(out, out=out)
    return out.astype(np.int32)


def _shared_before(left: list[np.ndarray], right: list[np.ndarray], bucket: int) -> np.ndarray:
    """Which pairs share a bucket whose key is less than this one's."""
    rows = [k[k < bucket] for k in left + right]
    names = np.unique(np.concatenate(rows))
    if not len(names):
        return np.zeros((len(left), len(right)), bool)
    shared = np.zeros((len(left), len(right)), bool)
    for start in range(0, len(names), _STRIPE):
        part = names[start:start + _STRIPE]
        has = np.zeros((len(rows), len(part)), np.float32)
        for i, k in enumerate(rows):
            has[i, np.searchsorted(part, k[(k >= part[0]) & (k <= part[-1])])] = 1
        shared |= has[:len(left)] @ has[len(left):].T > 0
    return shared


def compare(bucket: int, sides: np.ndarray, weights: np.ndarray, keys: list[np.ndarray], sets: list[np.ndarray],
            threshold: float = THRESHOLD) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each member the weight of its links that count here, and the links of a spanning forest.

    A block that met no member of the other one has nothing to compare.
    """
    within = bool((sides == WITHIN).any())
    left, right = np.flatnonzero(sides == (WITHIN if within else 0)), np.flatnonzero(sides == 1)
    if not len(left) or len(left) < 2 and within or not within and not len(right):
        return np.zeros(len(sides), np.int64), []
    if within:
        right = left
    pick = lambda what, which: [what[i] for i in which]
    both = overlaps(pick(sets, left), None if within else pick(sets, right))
    sizes = np.array([len(s) for s in sets])
    linked = np.zeros(both.shape, bool)
    for i in range(0, len(left), _STRIPE):
        stripe = both[i:i + _STRIPE]
        linked[i:i + _STRIPE] = stripe >= threshold * (sizes[left[i:i + _STRIPE]][:, None] + sizes[right][None, :] - stripe) - 1e-9
    del both
    if within:
        np.fill_diagonal(linked, False)
    links, forest = np.zeros(len(sides), np.int64), []
    if not linked.any():
        return links, forest
    here = linked & ~_shared_before(pick(keys, left), pick(keys, right), bucket)
    for i in range(0, len(left), _STRIPE):
        stripe = here[i:i + _STRIPE]
        links[left[i:i + _STRIPE]] += stripe @ weights[right]
        if not within:
            links[right] += stripe.T @ weights[left[i:i + _STRIPE]]
    label = least_linked(linked, left, right, len(sides))
    return links, [(i, int(label[i])) for i in np.flatnonzero(label != np.arange(len(sides)))]


def least_linked(linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` members the least member that links reach, given which of ``left`` and ``right`` are linked."""
    label = np.arange(n)
    while True:
        old = label.copy()
        for i in range(0, len(left), _STRIPE):
            stripe, rows = linked[i:i + _STRIPE], left[i:i + _STRIPE]
            label[rows] = np.minimum(label[rows], np.where(stripe, label[right][None, :], n).min(axis=1))
            np.minimum.at(label, right, np.where(stripe, label[rows][:, None], n).min(axis=0))
        if (label == old).all():
            return label


def _compare_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by part; each part is compared when its rows are complete."""
    held: list = []

    def done() -> list[tuple]:
        ids = [r.set_id for r in held]
        links, forest = compare(
            held[0].bucket, np.array([r.side for r in held]), np.array([r.weight for r in held], np.int64),
            [np.frombuffer(r.keys, np.int64) for r in held], [np.frombuffer(r.tokens, np.uint64) for r in held])
        return ([(ids[i], None, int(links[i])) for i in np.flatnonzero(links)] + [(ids[i], ids[j], 0) for i, j in forest])

    out: list[tuple] = []
    for batch in batches:
        for row in batch.itertuples(index=False):
            if held and held[0].part != row.part:
                out += done()
                held = []
            held.append(row)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["a", "b", "links"])
                out = []
    if held:
        out += done()
    yield pd.DataFrame(out, columns=["a", "b", "links"])


def _sizes(rows: DataFrame, *others: str) -> DataFrame:
    """Buckets with two members or more: key, count, run and two hashes of the members."""
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "set_id")).alias(f"mark{i}") for i in (1, 2)]
    sizes = rows.groupBy("key").agg(F.count("*").alias("count"), *marks, *[F.first(c).alias(c) for c in ("run", *others)])
    return sizes.where(F.col("count") > 1)


def _single(sizes: DataFrame, last: bool = False) -> DataFrame:
    """(key, count, twin) of one bucket of those with equal members; of those still to be split, whose repeats give the
    recall, of one for each run, with equal ``twin``."""
    split = F.lit(False) if last else F.col("count") > DIRECT
    single = sizes.groupBy("count", "mark1", "mark2", F.when(split, F.col("run")).alias("of")).agg(F.min("key").alias("key"))
    return single.select("key", "count", F.when(F.col("of").isNotNull(), F.xxhash64("count", "mark1", "mark2")).alias("twin"))


def buckets(classes: DataFrame) -> DataFrame:
    """(key, count, set_id) of all buckets to compare.  ``classes`` has set_id, slots and tokens."""
    first = classes.select("set_id", F.explode(F.filter(
        F.arrays_zip("slots", "tokens"), lambda x: x["slots"] % DEPTH == 0)).alias("p")).select(
        "set_id", F.floor(F.col("p.slots") / DEPTH).cast("int").alias("run"),
        F.xxhash64("p.slots", "p.tokens").alias("key")).distinct()
    level = common.written(first.join(_single(_sizes(first)), "key"), "buckets")
    out = [level.where("twin is null")]
    for depth in range(1, DEPTH):
        parents = level.where("twin is not null")
        if parents.isEmpty():
            break
        picked = F.expr(f"filter(arrays_zip(slots, tokens), x -> x.slots % {DEPTH} = {depth} and "
                        f"pmod(x.slots div {DEPTH} - run, {RUNS}) < {SPLITS})")
        split = parents.select("set_id", "run", F.col("key").alias("parent"), F.col("count").alias("whole")).join(
            classes.select("set_id", "slots", "tokens"), "set_id").select(
            "set_id", "run", "parent", "whole", F.explode(picked).alias("p")).select(
            "set_id", "run", "parent", "whole", F.xxhash64("parent", "p.slots", "p.tokens").alias("key")).distinct()
        below = common.written(_sizes(split, "parent", "whole"), "sizes")
        # Those that keep most of their members would only be multiplied by more splits.
        dense = below.where(F.col("count") > SHRUNK * F.col("whole")).select(F.col("parent").alias("key")).distinct()
        ready = parents.select("key", "twin").distinct().join(dense, "key").groupBy("twin").agg(F.min("key").alias("key"))
        out.append(parents.join(ready.select("key"), "key", "left_semi"))
        open_ones = below.join(dense.select(F.col("key").alias("parent")), "parent", "left_anti")
        level = common.written(split.select("set_id", "run", "key").join(_single(open_ones, depth + 1 == DEPTH), "key"), "buckets")
        out.append(level.where("twin is null"))
    return functools.reduce(DataFrame.unionByName, [x.select("key", "count", "set_id") for x in out])


def _part_by_picks(batches: Iterator[pd.DataFrame], shared: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by bucket; the parts of each bucket that common picks hold together, without lone members."""
    held: list = []

    def done() -> list[tuple]:
        near = overlaps([np.unique(r.picks) for r in held]) >= shared
        rows = np.arange(len(held))
        label = least_linked(near, rows, rows, len(held))
        sizes = np.bincount(label, minlength=len(held))
        return [(xxhash.xxh64_intdigest(held[k].set_id, seed=held[k].key & (2**63 - 1)) - 2**63, int(sizes[k]), held[i].set_id)
                for i, k in enumerate(label.tolist()) if sizes[k] > 1]

    out: list[tuple] = []
    for batch in batches:
        for row in batch.itertuples(index=False):
            if held and held[0].key != row.key:
                out += done()
                held = []
            held.append(row)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["key", "count", "set_id"])
                out = []
    if held:
        out += done()
    yield pd.DataFrame(out, columns=["key", "count", "set_id"])


def _maximal(members: DataFrame) -> DataFrame:
    """Without buckets whose members all lie in one larger bucket: that of all members' largest ones, if it is the same."""
    top = members.groupBy("set_id").agg(F.max_by("key", F.struct("count", "key")).alias("top"))
    inside = members.join(top, "set_id").groupBy("key").agg(F.min("top").alias("low"), F.max("top").alias("high")).where(
        (F.col("low") == F.col("high")) & (F.col("low") != F.col("key"))).select("key")
    return common.written(members.join(inside, "key", "left_anti"), "members")


def candidates(classes: DataFrame) -> DataFrame:
    """(key, count, set_id) of the buckets whose members are compared, parted by picks and without those inside others."""
    found = _maximal(buckets(classes))
    chosen = classes.select("set_id", F.transform(F.arrays_zip("slots", "tokens"), lambda x: F.hash(x["slots"], x["tokens"])).alias("picks"))
    small = found.where(F.col("count") <= DIRECT).join(chosen, "set_id").select("key", "set_id", "picks")
    parts = common.written(small.repartition("key").sortWithinPartitions("key").mapInPandas(
        functools.partial(_part_by_picks, shared=SHARED_PICKS), "key long, count long, set_id binary"), "parts")
    single = _single(_sizes(parts.withColumn("run", F.lit(0))), last=True).select("key")
    return _maximal(parts.join(single, "key").unionByName(found.where(F.col("count") > DIRECT).select("key", "count", "set_id")))


def parted_chance(shared: int = SHARED_PICKS) -> float:
    """A bound of the chance that a pair at the threshold shares fewer picks: it shares RUNS * DEPTH or more on average,
    a sum of independent draws (Chernoff)."""
    mean = RUNS * DEPTH
    r = (shared - 1) / mean
    return math.exp(-mean * (1 - r + r * math.log(r)))


def join(docs: DataFrame) -> DataFrame:
    """Every row's doc_id with ``class_id``, ``n_links`` (other rows at least as similar as the threshold) and row key."""
    return _classed(common.with_row_key(docs)).drop("root")


def _classed(docs: DataFrame) -> DataFrame:
    """:func:`join` of documents with row keys, with ``root``, one value for each class, null without shingles."""
    keyed = docs.select("doc_id", *common.ROW_KEY, common.whole_text().alias("__cl_text"))
    drawn = common.written(common.with_python(
        keyed, "__cl_text", _describer, "set_id binary, n int, slots array<int>, tokens array<bigint>"), "sets")
    said = drawn.where("n > 0")
    picked = common.written(said.groupBy("set_id").agg(
        F.count("*").alias("weight"), F.min("doc_id").alias("least"), F.min(F.struct(*common.ROW_KEY)).alias("at"),
        F.first("n").alias("n"), F.first("slots").alias("slots"), F.first("tokens").alias("tokens")), "classes")
    # Once the candidates are known, the picks of all sets are only in the way.
    rows, classes = common.written(drawn.drop("slots", "tokens"), "rows"), common.written(picked.drop("slots", "tokens"), "narrow")
    common.discard(drawn)
    found_in = candidates(picked)
    common.discard(picked)
    sizes = found_in.join(classes.select("set_id", "n"), "set_id").groupBy("key").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    held = found_in.join(sizes, "key").groupBy("set_id").agg(F.collect_set(F.struct("key", "blocks")).alias("buckets"))
    wanted = common.written(classes.join(held, "set_id").select(
        "set_id", "weight", "buckets", *[F.col(f"at.{k}").alias(k) for k in common.ROW_KEY]), "wanted")
    texts = common.only_rows(keyed, wanted).select("set_id", "weight", "buckets", F.col("__cl_text").alias("text"))
    members = texts.mapInPandas(_emit, "part long, side int, bucket long, set_id binary, weight long, keys binary, tokens binary")
    found = common.written(members.repartition("part").sortWithinPartitions("part").mapInPandas(
        _compare_parts, "a binary, b binary, links long"), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("set_id")).agg(F.sum("links").alias("links"))
    # Without links there is nothing to connect.
    roots = components(found.where("b is not null").select("a", "b")).select(F.col("a").alias("set_id"), F.col("b").alias("root"))
    placed = classes.select("set_id", "weight", "least").join(roots, "set_id", "left").join(links, "set_id", "left").withColumn(
        "root", F.coalesce("root", "set_id"))
    ids = placed.groupBy("root").agg(F.min("least").alias("class_id"))
    result = placed.join(ids, "root").select(
        "set_id", "root", "class_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = rows.select("doc_id", *common.ROW_KEY, "set_id", "n").join(result, "set_id", "left")
    alone = F.col("n") == 0
    return joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                         F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *common.ROW_KEY, "root")


def expected_miss(depth: int, runs: int = RUNS, splits: int = SPLITS) -> float:
    """The chance that no run finds a pair just at the threshold at so many depths."""
    drawn = np.arange(2**runs)[:, None] >> np.arange(runs) & 1
    chance = (1 - math.exp(-1)) ** drawn.sum(axis=1) * math.exp(-1) ** (runs - drawn.sum(axis=1))
    split = np.max([np.roll(drawn, -k, axis=1) for k in range(splits)], axis=0) @ (1 << np.arange(runs))
    found, at = np.unique(split, return_inverse=True)
    weight = np.bincount(at, chance)
    alive, odds = np.array([2**runs - 1]), np.ones(1)
    for _ in range(depth - 1):
        alive, odds = np.bitwise_and.outer(alive, found).ravel(), np.outer(odds, weight).ravel()
        alive, at = np.unique(alive, return_inverse=True)
        odds = np.bincount(at, odds)
    return float(odds @ np.exp(-np.bitwise_count(alive).astype(float)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with the first of each class: least doc_id, then reading order; texts without words all stay."""
    keyed = common.with_row_key(docs)
    classed = common.written(_classed(keyed), "classed")
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", *common.ROW_KEY)
    linked = classed.where("n_links > 0")
    first = linked.groupBy("root").agg(F.min(place).alias("__cl_first"))
    gone = linked.join(first, "root").where(~place.eqNullSafe(F.col("__cl_first"))).select(*common.ROW_KEY)
    return keyed.join(gone, common.ROW_KEY, "left_anti").select(*docs.columns)
