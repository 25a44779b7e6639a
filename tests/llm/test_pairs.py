import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus import documents, odd_texts, prose
from corpuslens.llm import components, jaccard_join, line_chunks, mixing, rotated_codes


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both and 5 * both >= 4 * either:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, d if not sets[i] else least.get(find(i)), links[i]) for i, (d, _) in enumerate(rows))


def near_copies():
    rng = random.Random(5)
    rows = []
    for g in range(12):
        words = prose(g, rng.choice([12, 60, 300])).split()
        for _ in range(rng.randint(1, 9)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            rows.append((len(rows) * 10 + 100, " ".join(copy)))
    return rows + [(9000 + i, "one two three four") for i in range(3)] + odd_texts()


def join_rows(spark, rows):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join(documents(spark, rows).repartition(4)).collect())


def test_parts_by_picks_lose_nothing(spark, monkeypatch):
    assert jaccard_join.parted_chance() < 1e-7
    rng = random.Random(9)
    common_part = prose(77, 60)
    rows = [(i, common_part + " " + prose(1000 + i // 3, 40 + i % 7) + f" end{rng.randrange(2)}") for i in range(120)]
    assert join_rows(spark, rows) == brute_join(rows)
    # Blocks by bytes: every bucket has several.
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 4000)
    assert join_rows(spark, rows) == brute_join(rows)


def test_only_rows_with_and_without_bitmaps(spark, tmp_path, monkeypatch):
    from corpuslens.llm import common
    spark.range(100_000).withColumn("v", F.col("id") % 7).repartition(3).write.parquet(str(tmp_path / "t"))
    keyed = common.with_row_key(spark.read.parquet(str(tmp_path / "t")))
    wanted = keyed.where("id % 1000 = 5").select(*common.ROW_KEY, F.col("id").alias("mark"))
    for most in (10**9, 0):
        monkeypatch.setattr(common, "MAX_BITMAP_BYTES", most)
        got = common.only_rows(keyed, wanted).select("id", "mark").collect()
        assert sorted((r.id, r.mark) for r in got) == [(i, i) for i in range(5, 100_000, 1000)]


def test_join_equals_brute_force(spark):
    assert join_rows(spark, near_copies()) == brute_join(near_copies())


def test_join_splits_and_blocks_equal_brute_force(spark, monkeypatch):
    """Small limits: buckets are split again and large ones compared block against block."""
    monkeypatch.setattr(jaccard_join, "DIRECT", 6)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    words = prose(77, 80).split()
    rows = [(i, " ".join([*words[:k], f"w{i}", *words[k:]])) for i, k in enumerate(np.random.default_rng(1).integers(0, 80, 40).tolist())]
    got, want = {r[0]: r for r in join_rows(spark, rows)}, {r[0]: r for r in brute_join(rows)}
    assert all(got[d][1] == want[d][1] and got[d][2] <= want[d][2] for d in want)
    # Three splits of a dense group are the hardest case: see expected_miss.
    assert sum(r[2] for r in got.values()) >= (1 - 1.5 * jaccard_join.expected_miss(3)) * sum(r[2] for r in want.values())


def test_groups_with_a_shared_core_keep_their_links(spark, monkeypatch):
    """All core tokens have the same members in every run; one run alone may pick none of them at the next depth."""
    monkeypatch.setattr(jaccard_join, "DIRECT", 6)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rows = [(100 * g + i, f"{prose(300 + g, 60)} own{g}x{i}") for g in range(12) for i in range(10)]
    assert join_rows(spark, rows) == brute_join(rows)
    assert all(jaccard_join.expected_miss(depth) < 1e-5 for depth in range(1, jaccard_join.DEPTH + 1))


def test_one_of_each(spark):
    rows = near_copies()
    docs = documents(spark, rows)
    kept = [r.doc_id for r in jaccard_join.one_of_each(docs).collect()]
    classes = {(d, c) for (d, c, n) in brute_join(rows) if n and c is not None}
    for d, c in classes:
        assert d is None or (d in kept) == (d == c)
    assert Counter(kept)[6] == 1 and {1, 2, 3, 8} <= set(kept) and jaccard_join.one_of_each(docs).columns == docs.columns
    assert jaccard_join.join(docs.where("false")).count() == 0 and jaccard_join.one_of_each(docs.where("false")).count() == 0


def test_one_of_each_keeps_classes_with_equal_ids_apart(spark, tmp_path):
    a, b, c = prose(41, 30), prose(42, 30), prose(43, 30)
    documents(spark, [(5, a), (8, a), (5, b), (9, b), (None, c), (None, c)]).write.parquet(f"{tmp_path}/documents")
    kept = jaccard_join.one_of_each(spark.read.parquet(f"{tmp_path}/documents")).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(5, a), (5, b), (None, c)])


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (3, 2)]
    got = {r.a: r.b for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 130)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_chunks(rows):
    """Texts without repeated chunks; rows come in order."""
    import hashlib
    import re
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines = (text or "").split("\n")
        long = [line.count(" ") >= 49 for line in lines]
        ends = [i for i in range(len(lines)) if i == len(lines) - 1 or long[i] or long[i + 1]
                or md5("\n".join(lines[max(0, i - 1):i + 1]))[0] in "0123"]
        spans = list(zip([0, *[e + 1 for e in ends[:-1]]], ends))
        gone, here = set(), []
        for a, b in [*spans, (0, len(lines) - 1)] if len(spans) > 1 else [(0, len(lines) - 1)]:
            t = "\n".join(lines[a:b + 1])
            n = b - a + 1
            worth = n == len(lines) or (t.count(" ") + n >= 10 if n > 1 else t.count(" ") >= 49)
            if re.search("[^\\x20\\x09-\\x0D]", t) and worth:
                if t in seen or t in here:
                    gone |= set(range(a, b + 1))
                here.append(t)
        seen |= set(here)
        out.append((d, text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def lined(seed):
    rng = random.Random(seed)
    passages = [prose(900 + i, rng.choice([6, 12, 55, 80])) for i in range(12)]
    rows = []
    for i in range(60):
        parts = [prose(seed * 1000 + i * 20 + k, rng.randint(2, 14)) for k in range(rng.randint(1, 8))]
        for _ in range(rng.randint(0, 4)):
            at, p = rng.randrange(len(parts) + 1), rng.randrange(10)
            parts[at:at] = passages[p:p + rng.randint(1, 3)]
        rows.append((1000 + i, "\n".join(parts)))
    return rows + [(2000 + i, rows[i][1]) for i in range(5)] + odd_texts()


def test_line_chunks_equal_brute_force(spark):
    rows = lined(2)
    got = line_chunks.deduplicate(documents(spark, rows).coalesce(1)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(brute_chunks(rows))
    cleaned = line_chunks.cleaned(documents(spark, rows))
    assert cleaned.columns == documents(spark, []).columns and all(r.n_chars == len(r.text or "") for r in cleaned.where("n_chars is not null").collect())
    assert not {2000, 2001} & {r.doc_id for r in cleaned.collect()}
    assert line_chunks.deduplicate(documents(spark, rows).where("false")).count() == 0


def test_period_schedule_serves_each_source_within_a_block():
    rng = random.Random(1)
    for n in (1, 2, 7, 30):
        weights = {f"s{i}": rng.random() + 0.01 for i in range(n)}
        shares = mixing.in_slots(weights, 64 * n)
        assert sum(shares.values()) == 64 * n and min(shares.values()) >= 1
        table, served = mixing.schedule(shares), Counter()
        for t, (s, k, release, deadline, slot) in enumerate(table * 2):
            assert slot == t % len(table) and release <= slot < deadline and k == served[s] % shares[s]
            served[s] += 1
            assert mixing.deviation(served, shares, t + 1) < 1
        assert deviation_of_period(served, shares) == 0


def deviation_of_period(served, shares):
    return max(abs(served[s] - Fraction(2 * n)) for s, n in shares.items())


def test_mix_follows_the_given_targets_over_many_periods(spark):
    """Within a block of the weights themselves, small ones too, however long the mix is."""
    targets = {"big": 0.7363, "mid": 0.2617, "small": 0.0020}
    docs = documents(spark, [(i, "x" * 10, "en", s) for s, n in (("big", 2900), ("mid", 1040), ("small", 8)) for i in range(n)])
    slots = sorted((r["__cl_slot"], r.source) for r in mixing.place(docs, targets, block_chars=10).collect())
    total, count = sum(map(Fraction, targets.values())), Counter()
    assert len({t for t, _ in slots}) == len(slots) == 3948
    for t, s in slots[:3900]:
        count[s] += 1
        assert all(abs(count[x] - Fraction(w) / total * (t + 1)) < 1 for x, w in targets.items())


def test_mix_places_every_document(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 300), "en", rng.choice(["big"] * 6 + ["b", "c", None])) for i in range(600)]
    rows += [(r[0], r[1], "en", "big") for r in odd_texts()]
    docs = documents(spark, rows).repartition(7)
    targets = {"big": 0.5, "b": 0.25, None: 0.25}
    placed = mixing.place(docs, targets, block_chars=500).toPandas()
    assert len(placed) == len(rows)
    order = placed.sort_values(["__cl_file", "__cl_row"])
    for _, part in order.groupby("__cl_source"):
        chars = part.text.fillna("").str.len().clip(lower=1)
        assert part["__cl_start"].tolist() == (chars.cumsum() - chars).tolist()
    assert placed[placed.source == "c"]["__cl_slot"].isna().all() and not placed[placed.source != "c"]["__cl_slot"].isna().any()
    slots = placed.dropna(subset=["__cl_slot"]).drop_duplicates(["__cl_source", "__cl_block_no"])
    assert slots["__cl_slot"].is_unique and ((slots["__cl_slot"] >= slots["__cl_release"]) & (slots["__cl_slot"] < slots["__cl_deadline"])).all()
    mixed = mixing.mixed(docs, targets, block_chars=500)
    assert mixed.columns == docs.columns and mixed.count() == len(rows)
    assert mixing.mixed(docs.where("false")).count() == 0 and mixing.place(docs.where("false")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, `rank` int, score double")


def brute_nearest(rows, queries, wanted=5):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for q, (i, v) in enumerate(good):
        if i is not None and queries(i):
            near = [(-float(v @ w) / float(np.linalg.norm(v) * np.linalg.norm(w)), j is None, j) for k, (j, w) in enumerate(good)
                    if k != q and len(w) == len(v)]
            out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(sorted(near, key=lambda x: (round(x[0], 12), x[1], x[2] or 0))[:wanted])]
    return out


@pytest.mark.parametrize("dim", [1, 2, 3, 17, 64])
def test_nearest_equal_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(i, rng.standard_normal(dim).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (50, rows[50][1]), (None, rows[3][1]), (1100, None), (1101, []), (1150, [0.0] * dim),
             (1102, [float("nan")] * dim), (1103, [float("inf")] * dim), (1104, [None] * dim), (1200, [1.0] * (dim + 1)), (1201, [2.0] * (dim + 1))]
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in rotated_codes.search(
        vectors(spark, rows).repartition(3), F.col("vec_id") % 50 == 0).collect())
    want = sorted((a, b, c, round(s, 9)) for a, b, c, s in brute_nearest(rows, lambda i: i % 50 == 0))
    if dim > 1:
        hits = sum((Counter(x[::2] for x in want) & Counter(x[::2] for x in got)).values())
        assert len(got) == len(want) and hits >= 0.95 * len(want)
    else:
        assert [x[::3] for x in got] == [x[::3] for x in want]


def test_nearest_of_nothing(spark):
    assert rotated_codes.search(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert rotated_codes.search(vectors(spark, [(50, [1.0, 2.0])]), F.col("vec_id") % 50 == 0).count() == 0
