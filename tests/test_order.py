"""Distributed order statistics against numpy, with hot values and few buckets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import order


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in ("a", "b"):
        x = np.where(rng.random(400) < 0.4, 1.5, np.round(rng.normal(size=400), 2))
        rows += [(g, i, float(v)) for i, v in enumerate(x)]
    return rows, spark.createDataFrame(rows, "g string, id long, x double").cache()


def average_rank(values):
    v = np.asarray(values)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_average_ranks(data):
    rows, df = data
    got = {(r["g"], r["id"]): r["rk"] for r in order.with_average_rank(df, ["g"], "x", "rk", buckets=5).collect()}
    for g in ("a", "b"):
        mine = [(i, x) for gg, i, x in rows if gg == g]
        for (i, _), rank in zip(mine, average_rank([x for _, x in mine])):
            assert got[(g, i)] == rank


def test_exact_quantiles(data):
    rows, df = data
    got = {r["g"]: r for r in order.exact_quantiles(df, ["g"], "x", {"q1": 0.25, "q9": 0.9}, buckets=5).collect()}
    for g in ("a", "b"):
        v = [x for gg, _, x in rows if gg == g]
        assert got[g]["q1"] == pytest.approx(np.quantile(v, 0.25), abs=1e-12)
        assert got[g]["q9"] == pytest.approx(np.quantile(v, 0.9), abs=1e-12)


def test_weighted_quantile_is_quantile_of_copies(spark):
    df = spark.createDataFrame([("g", 1.0, 3), ("g", 2.0, 0), ("g", 5.0, 2)], "g string, x double, w int")
    assert order.exact_quantiles(df, ["g"], "x", {"m": 0.5}, weight="w").first()["m"] == 1.0


def test_ordinal_ranks_split_a_hot_value(data):
    rows, df = data
    got = order.ordinal_ranks(df, ["g"], "x", ["id"], "rk", buckets=4).collect()
    for g in ("a", "b"):
        mine = sorted((r["rk"], r["x"]) for r in got if r["g"] == g)
        assert [k for k, _ in mine] == list(range(1, 401))
        assert [x for _, x in mine] == sorted(x for _, x in mine)


def test_following_row_crosses_buckets(spark):
    df = spark.createDataFrame([("g", float(i), i) for i in range(50)], "g string, x double, n long")
    rows = order.prefix_sums(df, ["g"], "x", {"s": F.col("n")}, following=["n"], buckets=7).collect()
    for r in rows:
        assert r["s"] == sum(range(r["n"])) and r["s_total"] == sum(range(50))
        assert (r["following"]["n"] if r["following"] else None) == (r["n"] + 1 if r["n"] < 49 else None)


def test_hash_positions_are_whole_and_limited(data):
    from corpuslens.functions.keys import md5_key
    _, df = data
    every = order.hash_positions(df, ["g"], md5_key(1, "id"), "p", buckets=6)
    assert sorted(r["p"] for r in every.filter("g = 'a'").collect()) == list(range(1, 401))
    few = order.hash_positions(df, ["g"], md5_key(1, "id"), "p", limit=7, buckets=6)
    want = {(r["g"], r["id"]) for r in every.filter("p <= 7").collect()}
    assert {(r["g"], r["id"]) for r in few.collect()} == want
