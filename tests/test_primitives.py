"""Sliced (hot key) paths must give what plain windows and brute force give."""

import random

import pytest
from pyspark.sql import functions as F, Window as W

from sparkloom.operators import ordered as o
from sparkloom.operators.neighbours import knn
from sparkloom.operators.quantiles import exact_quantiles, grouped_quantiles


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows; times are unique per row."""
    rng = random.Random(1)
    rows = [(("hot" if i % 10 else f"k{i % 7}"), i * 10 + rng.randint(0, 5), rng.choice([None, float(rng.randint(0, 99))]), i) for i in range(600)]
    return spark.createDataFrame(rows, "k string, t long, v double, id long").cache()


@pytest.mark.parametrize("before,frame", [("through", 0), ("rows", -1)])
def test_running_matches_window(hot, before, frame):
    specs = {"s": o.Spec("sum", F.col("v")), "c": o.Spec("count", F.col("v")), "m": o.Spec("max", F.col("v")), "l": o.Spec("last", F.col("v"))}
    got = o.running(hot, ["k"], ["t", "id"], specs, before=before, rows_per_slice=37)
    w = W.partitionBy("k").orderBy("t", "id").rowsBetween(W.unboundedPreceding, frame)
    want = hot.select("id", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("c"), F.max("v").over(w).alias("m"), F.last("v", True).over(w).alias("l"))
    a = sorted(map(tuple, got.select("id", "s", "c", "m", "l").collect()))
    assert a == sorted(map(tuple, want.collect()))


def test_slices_are_used(hot):
    assert o.slice_count(hot, 37) > 5
    assert o.slice_count(hot) == 1


def test_descending_and_previous(hot):
    w = W.partitionBy("k").orderBy("t", "id")
    got = o.following(o.previous(hot, ["k"], ["t", "id"], {"p": "v"}, rows_per_slice=41), ["k"], ["t", "id"], {"n": "v"}, rows_per_slice=41)
    want = hot.select("id", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"))
    assert sorted(map(tuple, got.select("id", "p", "n").collect())) == sorted(map(tuple, want.collect()))


def test_sliding_matches_range_frame(spark, hot):
    d = hot.withColumn("ts", F.timestamp_micros("t"))
    got = o.sliding(d, ["k"], "ts", {"w": 200}, {"n": F.lit(1), "s": F.coalesce("v", F.lit(0.0))}, rows_per_slice=50)
    w = W.partitionBy("k").orderBy("t").rangeBetween(-200, -1)
    want = hot.select("id", F.count("*").over(w).alias("n"), F.coalesce(F.sum(F.coalesce("v", F.lit(0.0))).over(w), F.lit(0.0)).alias("s"))
    a = {r[0]: (round(r[1]), round(r[2], 6)) for r in got.select("id", "n_w", "s_w").collect()}
    assert a == {r[0]: (r[1], round(r[2], 6)) for r in want.collect()}


def test_asof_and_tiles(spark, hot):
    right = spark.createDataFrame([("hot", 50, 1), ("hot", 3000, 2), ("k0", 10, 3)], "k string, u long, x int")
    got = {r["id"]: r["x"] for r in o.asof(hot.select("k", "t", "id"), right, ["k"], "t", "u", ["x"], rows_per_slice=60).collect()}
    for r in hot.collect():
        seen = [x for k, u, x in (("hot", 50, 1), ("hot", 3000, 2), ("k0", 10, 3)) if k == r["k"] and u <= r["t"]]
        assert got[r["id"]] == (seen[-1] if seen else None)
    tiles = o.tiles(hot, ["t", "id"], 7, "q", rows_per_slice=60)
    want = hot.withColumn("q", F.ntile(7).over(W.orderBy("t", "id")))
    assert sorted(map(tuple, tiles.select("id", "q").collect())) == sorted(map(tuple, want.select("id", "q").collect()))


def test_quantiles_narrow_to_exact(spark):
    rng = random.Random(3)
    rows = [(rng.lognormvariate(0, 2), float(rng.randint(0, 3)), None) for _ in range(3000)]
    d = spark.createDataFrame(rows, "a double, b double, c double")
    got = exact_quantiles(d, ["a", "b", "c"], [0.1, 0.5, 0.99], buckets=8, finish_at=5)
    for c in ("a", "b"):
        want = d.agg(F.percentile(c, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.99)))).first()[0]
        assert got[c] == pytest.approx(want)
    assert got["c"] == [None, None, None]
    g = grouped_quantiles(d, ["b"], "a", {"m": 0.5}, rows_per_slice=100).collect()
    want = {r[0]: r[1] for r in d.groupBy("b").agg(F.percentile("a", 0.5)).collect()}
    assert {r["b"]: pytest.approx(r["m"]) for r in g} == want


def test_knn_equals_brute_force(spark):
    rng = random.Random(5)
    pts = [(i, rng.choice([0.0, rng.gauss(0, 1), rng.gauss(50, 3)]), rng.gauss(0, 1) if i % 3 else 0.0) for i in range(250)]
    d = spark.createDataFrame(pts, "d long, x double, y double")
    got = {}
    for r in knn(d.withColumnRenamed("d", "q"), d, "q", "d", ["x", "y"], 4, skip_self=True).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["d"]))
    for i, x, y in pts:
        best = sorted(((((x - a) ** 2 + (y - b) ** 2) ** 0.5, j) for j, a, b in pts if j != i))[:4]
        assert [j for _, j in sorted(got[i])] == [j for _, j in best]
