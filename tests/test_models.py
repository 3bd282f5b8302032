"""Quantile regression, Cox, recursive forecasts, hyperband and random features against plain numpy."""

import datetime
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import forecast, kernels, models as m, regression as reg, tuning


def least_loss(x, y, q):
    corners = (np.linalg.solve(x[list(c)], y[list(c)]) for c in itertools.combinations(range(len(y)), x.shape[1]) if np.linalg.matrix_rank(x[list(c)]) == x.shape[1])
    return min(reg.pinball(y - x @ b, q) for b in corners)


@pytest.mark.parametrize("q", [0.1, 0.5, 0.9])
def test_rows_in_memory(q):
    """The corner walk against all corners; also with ties, repeated rows and a constant column."""
    rng = np.random.default_rng(3)
    for n, p in [(12, 1), (30, 2), (25, 3), (40, 2)]:
        x, y = np.column_stack([np.ones(n), rng.standard_normal((n, p - 1))]), rng.standard_normal(n) * 10
        for a, b in ((x, y), (np.round(x), np.round(y))):
            got = reg.pinball(b - np.column_stack([a, np.zeros(n)]) @ reg.solve_rows(np.column_stack([a, np.zeros(n)]), b, q), q)
            want = least_loss(a, b, q) if np.linalg.matrix_rank(a) == p else got
            assert got == pytest.approx(want, rel=1e-8)


@pytest.mark.parametrize("band", [20_000, 60])
def test_quantile_regression(spark, band, monkeypatch):
    """With a small band the Newton passes and the two sums of far rows are what finds the same optimum."""
    monkeypatch.setattr(reg, "BAND", band)
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.standard_normal(1500) * 1000, rng.integers(0, 4, 1500)])
    y = 3 + x @ [0.02, -5] + rng.exponential(2 + x[:, 1])
    df = spark.createDataFrame([(float(b), float(v[0]), int(v[1]), 7) for b, v in zip(y, x)] + [(None, 1.0, 1, 7), (1.0, None, 1, 7)], "y double, a double, b int, c int")
    qs = [0.1, 0.5, 0.9]
    fit = {(r["quantile"], r["term"]): r["coefficient"] for r in reg.quantile_regression(df, "y", ["a", "b", "c"], qs, band=band).collect()}
    full = np.column_stack([np.ones(1500), x])
    for q in qs:
        b = np.array([fit[q, t] for t in ("(intercept)", "a", "b")])
        assert fit[q, "c"] == 0
        r = y - full @ b
        assert (r < -1e-9).sum() <= q * 1500 <= (r < 1e-9).sum()
        assert reg.pinball(r, q) == pytest.approx(reg.pinball(y - full @ reg.solve_rows(full, y, q), q), rel=1e-9)
    assert reg.quantile_regression(df.limit(0), "y", ["a"], qs).collect() == []


def plain_cox(t, e, x):
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        g, h = np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
        w = np.exp(x @ beta)
        for i in np.flatnonzero(e):
            risk = t >= t[i]
            mean = (w[risk, None] * x[risk]).sum(0) / w[risk].sum()
            g += x[i] - mean
            h += (x[risk].T * w[risk]) @ x[risk] / w[risk].sum() - np.outer(mean, mean)
        beta = beta + np.linalg.solve(h, g)
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


@pytest.mark.parametrize("slice_rows", [None, 9])
def test_cox(spark, slice_rows):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.standard_normal(300), rng.integers(0, 2, 300) * 40.0])
    t = np.ceil(rng.exponential(20 / np.exp(x @ [0.7, -0.02])))
    e = rng.random(300) < 0.7
    df = spark.createDataFrame([(int(a), int(b), float(c), float(d)) for a, b, (c, d) in zip(t, e, x)] + [(3, 1, None, 1.0)], "t long, e int, a double, b double")
    got = {r["term"]: r for r in reg.cox_model(df, "t", "e", ["a", "b"], rows_per_slice=slice_rows).collect()}
    beta, error = plain_cox(t, e, x)
    assert [got[c]["coefficient"] for c in "ab"] == pytest.approx(beta.tolist(), abs=1e-6)
    assert [got[c]["std_error"] for c in "ab"] == pytest.approx(error.tolist(), rel=1e-5)
    assert got["a"]["hazard_ratio"] == pytest.approx(np.exp(beta[0])) and got["a"]["p_value"] < 1e-6
    with pytest.raises(ValueError):
        reg.cox_model(df.where("e = 0"), "t", "e", ["a"])


def test_recursive_forecast_is_a_plain_loop(spark):
    start = datetime.date(2024, 1, 1)
    rng = np.random.default_rng(6)
    values = {k: [float(10 * (d % 7) + 3 * k + rng.integers(0, 4)) for d in range(60)] for k in range(5)}
    rows = [(k, start + datetime.timedelta(days=d), v) for k, own in values.items() for d, v in enumerate(own)] + [(9, start, 1.0)]
    series = spark.createDataFrame(rows, "k long, day date, v double").repartition(4)
    until = start + datetime.timedelta(days=52)
    model = forecast.fit_one_step(series, "k", "day", "v", F.lit(until))
    got = {(r["k"], r["horizon"]): (r["day"], r["forecast"]) for r in forecast.recursive_forecast(series, "k", "day", "v", 7, until, model=model).collect()}
    assert set(got) == {(k, h) for k in range(5) for h in range(1, 8)}  # the series of one day has no lags
    for k, own in values.items():
        past = own[:53]
        for h in range(1, 8):
            day = until + datetime.timedelta(days=h)
            new = model.predict(np.array([[past[-1], past[-2], past[-7], day.weekday()]]))[0]
            assert got[k, h] == (day, pytest.approx(new))
            past.append(new)
    assert max(abs(got[k, h][1] - values[k][52 + h]) for k in values for h in range(1, 8)) < 25


def test_trees_sent_to_tasks_predict_as_the_model(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    df = spark.range(400).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), F.sin("id").alias("label"))
    v = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model = GBTRegressor(maxIter=5, maxDepth=4, seed=1).fit(v)
    rows = model.transform(v).select("a", "b", "prediction").collect()
    assert forecast.tree_arrays(model).predict(np.array([r[:2] for r in rows])) == pytest.approx([r[2] for r in rows])


def test_budgets_of_brackets():
    assert tuning.rungs(81, 1, 27) == [(81, 1), (27, 3), (9, 9), (3, 27)]  # 243 + 81 units
    assert tuning.brackets(81)[0] == [(81, 1), (27, 3), (9, 9), (3, 27), (1, 81)] and tuning.brackets(81)[1] == [(34, 3), (11, 9), (3, 27), (1, 81)]
    assert [b[0] for b in tuning.brackets(9)] == [(9, 1), (5, 3), (3, 9)] and tuning.brackets(1) == [[(1, 1)]]


@pytest.mark.parametrize("resource", ["rows", "trees"])
def test_hyperband(spark, resource):
    d = m.prepare(spark.range(3000).select("id", (F.col("id") % 10).alias("a"), F.rand(1).alias("b"), ((F.col("id") % 10 > 4) != (F.rand(2) < 0.1)).cast("int").alias("y")), "id", ["a", "b"], "y")
    name = "logistic" if resource == "rows" else "forest"
    draw = (lambda n, s: m.draw_params(name, n, s)) if resource == "rows" else (lambda n, s: [{"maxDepth": 1 + i % 3} for i in range(n)])
    out = tuning.hyperband(d, name, "binary", most=3, resource=resource, draw=draw).collect()
    assert sorted((r["bracket"], r["rung"], r["trial"], r["budget"]) for r in out if r["bracket"] == 0 and r["rung"] == 0) == [(0, 0, i, 1) for i in range(3)]
    assert sum(r["bracket"] == 0 and r["rung"] == 1 for r in out) == 1 and sum(r["bracket"] == 1 for r in out) == 2
    first = [r for r in out if r["bracket"] == 0 and r["rung"] == 0]
    assert [r["trial"] for r in first if r["kept"]] == [max(first, key=lambda r: (r["score"], -r["trial"]))["trial"]]
    train = m.split(d)[0].count()
    assert all(r["n_rows"] == train or resource == "rows" and r["budget"] == 1 and abs(r["n_rows"] - train / 3) < 0.1 * train for r in out)
    assert max(r["score"] for r in out) > 0.8


def test_radial_features(spark):
    rng = np.random.default_rng(7)
    pts = rng.standard_normal((600, 2))
    rows = [(i, float(a), float(b), int(a * a + b * b < 1.2)) for i, (a, b) in enumerate(pts)] + [(600, None, 1.0, 0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    scales = [(0.0, 1.0), (0.0, 1.0)]
    wide = kernels.radial_features(df, ["a", "b"], scales, size=4000, gamma=0.5)
    v = np.array([r["features"].toArray() for r in wide.orderBy("id").limit(40).collect()])
    want = np.exp(-0.5 * ((pts[:40, None] - pts[None, :40]) ** 2).sum(-1))
    assert np.abs(v @ v.T - want).max() < 0.08
    d = m.prepare(df, "id", ["a", "b"], "y")
    ev = m.EVALUATORS["binary"][1]()
    auc = lambda rows: ev.evaluate(m.train(rows, "svm", "binary").transform(rows))
    assert auc(d) < 0.7 < 0.97 < auc(kernels.radial_features(d.drop("features"), ["a", "b"], scales, gamma=1.0))


def test_bags_and_calibration_are_judged_on_other_rows(spark):
    d = m.prepare(spark.range(4000).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), (F.rand(3) < 0.3).cast("int").alias("noise")), "id", ["a", "b"], "noise")
    tr, te = m.split(d, 50)
    out = m.balanced_bags(tr, 5, te)
    ev = m.EVALUATORS["binary"][1]
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    auc = lambda rows: BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(rows)
    assert {r["key"] for r in out.collect()} == {r["key"] for r in te.select("key").collect()}
    assert abs(auc(out) - 0.5) < 0.06 < auc(m.balanced_bags(tr, 5)) - 0.5  # noise can't be learned, only remembered
    rows = spark.range(4000).select(F.col("id").alias("key"), (F.rand(5) < F.pow(F.rand(4), 2)).cast("double").alias("label"), F.rand(4).alias("score"))
    tr, te = m.split(rows, 50)
    for method in ("sigmoid", "isotonic"):
        got = m.calibrate(tr, method, te)
        brier = got.agg(F.avg(F.pow(F.col("calibrated") - F.col("label"), 2)), F.avg(F.pow(F.col("score") - F.col("label"), 2))).first()
        assert got.count() == te.count() and brier[0] < brier[1]


def test_uplift_is_cross_fitted_and_weighs_by_propensity(spark):
    """A planted effect of 5 where a > 0.5, treated more often there."""
    df = spark.range(4000).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("u"), F.randn(4).alias("e"))
    df = df.withColumn("arm", (F.col("u") < F.when(F.col("a") > 0.5, 0.7).otherwise(0.3)).cast("int"))
    df = df.withColumn("y", F.col("b") * 3 + F.col("arm") * F.when(F.col("a") > 0.5, 5.0).otherwise(0.0) + F.col("e") * 0.3)
    out = m.uplift(df, "id", "arm", "y", ["a", "b"]).join(df, "id")
    got = {r["high"]: r for r in out.groupBy((F.col("a") > 0.5).alias("high")).agg(F.avg("t_uplift").alias("t"), F.avg("x_uplift").alias("x"), F.avg("propensity").alias("g"), F.count("*").alias("n")).collect()}
    assert got[True]["n"] + got[False]["n"] == 4000
    for col in "tx":
        assert abs(got[True][col] - 5) < 0.5 and abs(got[False][col]) < 0.5
    assert got[True]["g"] > 0.58 and got[False]["g"] < 0.42
