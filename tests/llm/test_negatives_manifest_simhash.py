import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpus import documents, odd_texts, prose
from corpuslens.llm import hard_negatives, merkle_manifest, simhash_index


# Hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, score double, `rank` int, own long, no int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 1, 2, 3) for r in rows], VECTORS).repartition(3)


def labelled_rows(n=400, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((25, dim))
    out = []
    for i in range(n):
        v = centres[rng.integers(25)] + rng.standard_normal(dim) * 0.2
        out.append((i, [round(float(x), 3) for x in v], int(rng.integers(4))))
    return out


def brute_mine(rows, anchor, positives=5, negatives=5):
    whole = [(v, [int(np.floor(256.0 * x)) for x in e], lab) for v, e, lab in rows
             if lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    order = lambda p: (-p[0], p[1] is None, p[1])
    out = []
    for i, (a, va, la) in enumerate(whole):
        if a is None or not anchor(a):
            continue
        scores = [(sum(x * y for x, y in zip(va, v)), b, lab) for j, (b, v, lab) in enumerate(whole) if j != i and len(v) == len(va)]
        for ps, p, _ in sorted((s for s in scores if s[2] == la), key=order)[:positives]:
            inside = sorted((s for s in scores if s[2] != la and 80 * ps <= 100 * s[0] <= 100 * ps), key=order)[:negatives]
            out += [(a, p, k + 1, n, ps, s) for k, (s, n, _) in enumerate(inside)]
    return Counter(out)


def mined(spark, rows):
    return Counter(tuple(r) for r in hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0).collect())


def test_hard_negatives_equal_brute_force(spark):
    rows = labelled_rows()
    odd = [(1000, None, 1), (1010, [float("nan")] * 12, 1), (1020, [1.0] * 11 + [None], 1), (1030, [1.0] * 12, None),
           (1040, [0.0] * 12, 2), (1050, [], 1), (1051, [], 2), (1052, [], 1), (1060, [0.5, 1.5], 1), (1061, [0.5, 1.4], 1), (1062, [0.5, 1.3], 3),
           (None, rows[0][1], 1), (None, rows[0][1], rows[0][2]), rows[10], rows[10], rows[11], (1070, [float("inf")] * 12, 1)]
    assert mined(spark, rows + odd) == brute_mine(rows + odd, lambda v: v % 10 == 0)
    assert mined(spark, []) == Counter()


def test_hard_negatives_over_several_passes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_CELLS", 12 * 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    monkeypatch.setattr(hard_negatives, "GROUP_BYTES", 3000)
    rows = labelled_rows(500, seed=3) + [(5000 + i, labelled_rows(1, seed=9)[0][1], i % 2) for i in range(100)]
    assert mined(spark, rows) == brute_mine(rows, lambda v: v % 10 == 0)


def test_scores_beyond_doubles_are_exact():
    rows = np.array([[2.0**40, 1.0], [2.0**40, 2.0]])
    assert hard_negatives.exact_scores(rows, np.array([2.0**20, 1.0]), wide=True).tolist() == [2**60 + 1, 2**60 + 2]
    assert hard_negatives.exact_scores(rows, np.array([2.0**40, 1.0]), wide=True).tolist() == [2**63 - 1] * 2


def test_bounds_along_the_tree_skip_candidates():
    rng = np.random.default_rng(4)
    cells = np.floor(rng.standard_normal((300, 16)) * 256)
    base = np.floor(rng.standard_normal(16) * 256)
    points = base + rng.integers(-3, 4, (40, 16))
    order, parent, edge = hard_negatives.spanning_tree(points)
    assert sorted(order.tolist()) == list(range(40)) and (parent >= 0).sum() == 39
    seen = {int(order[0])}
    for i in order[1:].tolist():
        assert int(parent[i]) in seen
        seen.add(i)
    scored = 0
    anchors = {"order": order, "parent": parent, "edge": edge, "cells": points}
    for i, rows, scores in hard_negatives.walk(anchors, cells, lambda i, low, high: high >= 200_000):
        truth = cells @ points[i]
        assert set(np.flatnonzero(truth >= 200_000)) <= set(rows.tolist()) and (truth[rows] == scores).all()
        scored += len(rows)
    assert scored < 40 * 300 / 4


# Merkle manifest

def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(values):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def brute_tree(nodes, arity):
    """(top, the siblings of each node by level)."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i:i + arity] for i in range(0, len(nodes), arity)]
        for k, i in enumerate(at):
            run = runs[i // arity]
            paths[k].append(run[:i % arity] + run[i % arity + 1:])
            at[k] = i // arity
        nodes = [digest(r) for r in runs]
    return nodes[0], paths


def brute_manifest(rows, arity):
    """rows: (doc_id, text, lang, source, n_chars)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    tops, found = [], []
    for lang in langs:
        mine = [(r[0] is not None, r[0] or 0, brute_leaf((r[0], r[3], r[2], r[4], r[1])), r) for r in rows if r[2] == lang]
        mine.sort(key=lambda x: x[:3])
        top, paths = brute_tree([m[2] for m in mine], arity)
        tops.append(top)
        found.append([(m, p) for m, p in zip(mine, paths)])
    root, above = brute_tree(tops, arity)
    out = []
    for top, up, members in zip(tops, above, found):
        for (_, _, leaf, r), p in members:
            told = r[4] + 1 if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else r[4]
            siblings = [s for level in p + up for s in level]
            out.append((r[0], leaf, top, root, digest(siblings), told == r[4]))
    return Counter(out)


def manifest_rows(spark, rows, **how):
    from corpuslens.llm import queries
    old = merkle_manifest.manifest
    docs = documents(spark, [r[:4] for r in rows]).repartition(3)
    if how:
        merkle_manifest.manifest = lambda d, c: old(d, c, **how)
    table, queries.read_table = queries.read_table, lambda *a: docs
    try:
        out = queries.op12_merkle_manifest(spark, "").collect()
    finally:
        merkle_manifest.manifest, queries.read_table = old, table
    for r in out:
        assert r.verified == (r.folded_root == r.root)
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in out)


def with_chars(rows):
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def language_rows():
    rows = with_chars([(i * 3 % 1000, f"text {i}", random.Random(i).choice(["en", "de", "ü", "Z", None, ""]), "a") for i in range(150)])
    return rows + with_chars([(d, t, "en", None) for d, t in odd_texts()] + [(7, "alone", "only", "s")])


@pytest.mark.parametrize("how", [{}, {"arity": 2, "stride": 2}, {"arity": 3, "stride": 2}])
def test_manifest_equals_brute_force(spark, how):
    assert manifest_rows(spark, language_rows(), **how) == brute_manifest(language_rows(), how.get("arity", 2))


def test_manifest_of_one_and_of_none(spark):
    one = with_chars([(14, "x", "en", "a")])
    assert manifest_rows(spark, one) == brute_manifest(one, 2)
    assert manifest_rows(spark, []) == Counter()


def test_requests_for_some_leaves(spark):
    nodes = [digest([str(i)]) for i in range(37)]
    leaves = spark.createDataFrame([("t", i, n) for i, n in enumerate(nodes)], "tree string, rank long, digest string")
    held = merkle_manifest.store(leaves, 2, 2)
    asked = merkle_manifest.prove(held, leaves.where("rank in (0, 17, 36)"))
    top, paths = brute_tree(nodes, 2)
    got = {r["rank"]: r for r in asked.withColumn("top", merkle_manifest.folded(F.col("digest"), F.col("digits"), F.col("siblings"))).collect()}
    assert set(got) == {0, 17, 36} and {r.top for r in got.values()} == {top}
    assert all(r.siblings == paths[k] for k, r in got.items())


# SimHash

def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, most=2):
    parent = {c: c for c in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    codes = sorted(parent)
    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= most:
                parent[find(a)] = find(b)
    return {c: find(c) for c in codes}


def brute_near(rows):
    codes = [brute_fingerprint(t) for _, t in rows]
    of, least = brute_components(codes), {}
    for (d, _), c in zip(rows, codes):
        if d is not None:
            least[of[c]] = min(d, least.get(of[c], d))
    return Counter((d, f"{c:016x}", least.get(of[c])) for (d, _), c in zip(rows, codes))


def near_rows(spark, rows):
    return Counter(tuple(r) for r in simhash_index.near_duplicates(documents(spark, rows).repartition(4)).collect())


def test_simhash_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    rows = odd_texts() + [(None, "shared by none"), (None, "Shared BY none"), (40, "ÀÉ UPPER ÀÉ"), (41, "ÀÉ upper ÀÉ"), (42, "a b"), (43, "b\x0bc d")]
    for g in range(60):
        words = prose(g, 200).split()
        for k in range(rng.randint(1, 4)):
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = "other"
            rows.append((1000 + len(rows), " ".join(copy)))
    want = brute_near(rows)
    assert near_rows(spark, rows) == want
    assert near_rows(spark, []) == Counter()
    for name, value in (("LEAF", 16), ("GROUP", 4), ("FAN", 2), ("HOT_ROWS", 1)):
        monkeypatch.setattr(simhash_index, name, value)
    assert near_rows(spark, rows) == want


def test_links_reach_all_codes_in_reach(spark, monkeypatch):
    rng = random.Random(8)
    codes = {rng.getrandbits(64) for _ in range(300)}
    for c in list(codes)[:80]:
        for _ in range(4):
            c ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            codes.add(c)
    codes |= {c ^ 1 << b for c in list(codes)[:1] for b in range(64)}
    monkeypatch.setattr(simhash_index, "LEAF", 32)
    monkeypatch.setattr(simhash_index, "FAN", 4)
    signed = lambda c: c - (c >> 63 << 64)
    table = spark.createDataFrame([(signed(c),) for c in codes], "code long")
    found = [(r.a % 2**64, r.b % 2**64) for r in simhash_index.links(table).collect()]
    assert all((a ^ b).bit_count() <= 2 or brute_components(codes)[a] == brute_components(codes)[b] for a, b in found[:20])
    parent = {c: c for c in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in found:
        parent[find(a)] = find(b)
    groups, want = {}, {}
    for c, r in brute_components(codes).items():
        groups.setdefault(find(c), set()).add(c)
        want.setdefault(r, set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_gray_rank(spark):
    codes = [0, 1, 3, 2, 6, 7, 5, 4]
    rows = spark.createDataFrame([(c,) for c in codes + [-1]], "code long").select("code", simhash_index.gray_rank(F.col("code")).alias("r"))
    got = {r.code: r.r for r in rows.collect()}
    assert [got[c] + 2**63 for c in codes] == list(range(8)) and got[-1] == int("aaaaaaaaaaaaaaaa", 16) - 2**63
