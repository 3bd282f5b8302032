"""Quantised vector search against the exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import retrieval as r, vectors as v

DATA = "/root/testdata/sf0.001"


def table(spark, n=900, d=16, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((30, d))
    return spark.createDataFrame([(i, [float(x) for x in base[i % 30] + 0.6 * rng.standard_normal(d)]) for i in range(n)], "id long, e array<double>")


@pytest.mark.parametrize("block", [256, 40])
def test_recall(spark, block):
    df = table(spark).unionByName(spark.createDataFrame([(5000, None), (5001, [0.0] * 16)], "id long, e array<double>"))
    q = df.where("id % 9 = 0 OR id >= 5000").select(F.col("id").alias("q"), F.col("e").alias("qe"))
    model = v.fit_quantiser(df, "id", "e", cells=12, parts=8)
    assert 1 <= model.probes <= 12
    got = v.quantised_top_k(df, "id", "e", q, "q", "qe", 10, model, block=block)
    exact = r.dense_top_k(df.where("id < 5000"), "id", "e", q.where("q < 5000"), "q", "qe", 10)
    assert got.groupBy("q").count().where("count <> 10").count() == 0
    both = got.join(exact.select("q", "id", F.col("score").alias("s")), ["q", "id"])
    assert both.count() >= 0.95 * exact.count() and both.where("abs(score - s) > 1e-5").count() == 0
    assert got.where("q >= 5000 OR id >= 5000").count() == 0 and got.where("q = id AND rank = 1").count() == q.count() - 2


def test_index_holds_every_vector_and_codes_are_near(spark):
    df = table(spark, 300)
    model = v.fit_quantiser(df, "id", "e", cells=6, parts=4, sample=200)
    index = {x["key"]: x for x in v.build_index(df, "id", "e", model).collect()}
    assert set(index) == set(range(300))
    for row in df.collect():
        own = np.array(row["e"]) / np.linalg.norm(row["e"])
        x = index[row["id"]]
        code = np.frombuffer(bytes(x["codes"]), dtype=np.uint8)
        again = model.centres[x["cell"]] + np.concatenate([model.points[p, c] for p, c in enumerate(code)])
        assert np.argmin(((own - model.centres) ** 2).sum(1)) == x["cell"] and np.linalg.norm(own - again) < 0.7 * np.linalg.norm(own - model.centres[x["cell"]]) + 1e-9
    assert v.quantised_top_k(df, "id", "e", df.limit(0).select(F.col("id").alias("q"), F.col("e").alias("qe")), "q", "qe", 3, model).collect() == []
    with pytest.raises(ValueError):
        v.fit_quantiser(df, "id", "e", parts=5)
