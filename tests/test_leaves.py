"""Nearest neighbours in many dimensions against all distances."""

import numpy as np
import pytest

from sparkloom.operators import leaves


def brute(q, d, k, skip):
    out = {}
    for i, x in q:
        far = sorted((float(np.sqrt(sum((b - a) ** 2 for a, b in zip(x, y)))), j) for j, y in d if not (skip and i == j))
        out[i] = [(j, pytest.approx(f, abs=1e-12)) for f, j in far[:k]]
    return out


@pytest.mark.parametrize(("dims", "leaf"), [(8, 25), (2, 10), (1, 5), (8, 10_000)])
def test_nearest(spark, dims, leaf):
    rng = np.random.default_rng(dims)
    base = rng.standard_normal((6, dims)) * 3
    pts = np.round(base[rng.integers(0, 6, 400)] + rng.standard_normal((400, dims)), 3)
    pts[50:120] = pts[50]  # a third of the queries and donors at one place
    names = [f"c{i}" for i in range(dims)]
    rows = [(i, *map(float, p)) for i, p in enumerate(pts)]
    schema = "id long, " + ", ".join(f"{c} double" for c in names)
    df = spark.createDataFrame(rows + [(900, *[None] * dims), (901, *[float("nan")] * dims)], schema).repartition(4)
    out = leaves.nearest(df.withColumnRenamed("id", "q"), df, "q", "id", names, 4, skip_self=True, leaf=leaf)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["q"], r["rank"])):
        got.setdefault(r["q"], []).append((r["id"], r["distance"]))
    points = [(r[0], r[1:]) for r in rows]
    assert got == brute(points, points, 4, True)


def test_few_donors_and_none(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "id long, a double, b double")
    q = spark.createDataFrame([(7, 0.0, 0.0)], "q long, a double, b double")
    assert [tuple(r) for r in leaves.nearest(q, df, "q", "id", ["a", "b"], 5).orderBy("rank").collect()] == [(7, 1, 0.0, 1), (7, 2, 5.0, 2)]
    assert leaves.nearest(q, df.limit(0), "q", "id", ["a", "b"], 5).collect() == []
    assert leaves.nearest(q.limit(0), df, "q", "id", ["a", "b"], 5).collect() == []


def test_tree():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((5000, 8))
    tree = leaves.build_tree(x, 20)
    sizes = np.bincount(tree.leaf(x), minlength=tree.leaves)
    assert tree.leaves == 20 and sizes.min() > 150 and sizes.max() < 400
    q, r = x[:50], np.full(50, 1.5)
    row, leaf = tree.reached(q, r)
    found = set(zip(row.tolist(), leaf.tolist()))
    own = tree.leaf(x)
    for i in range(50):
        near = np.sqrt(((x - q[i]) ** 2).sum(1)) <= 1.5
        assert {(i, l) for l in own[near].tolist()} <= found
    assert len(found) < 50 * 20
    assert leaves.build_tree(np.ones((100, 3)), 10).leaves == 1


def test_imputation_in_five_dimensions(spark):
    from sparkloom.operators.impute import knn_impute

    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 5))
    y = [None if i % 7 == 0 else float(x[i].sum()) for i in range(300)]
    df = spark.createDataFrame([(i, *map(float, x[i]), y[i]) for i in range(300)], "id long, a double, b double, c double, d double, e double, y double")
    got = {r["id"]: r["y"] for r in knn_impute(df, "id", "y", list("abcde"), 3).collect()}
    for i in range(300):
        near = sorted((j for j in range(300) if y[j] is not None), key=lambda j: ((x[i] - x[j]) ** 2).sum())[:3]
        assert got[i] == pytest.approx(y[i] if y[i] is not None else np.mean([y[j] for j in near]))
