"""Interpretation and fairness queries, and user extension points."""

import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sparkloom.functions.exprs import rnd, skew_g1
from sparkloom.operators import explain as e, gates, metrics, models as m, transforms
from sparkloom.operators.neighbours import knn
from sparkloom.plans.catalog import query
from sparkloom.plans.met import CLS, CM
from sparkloom.plans.mod import FEATS, data, shared


def fitted(t, name="logistic", **kw):
    return m.train(m.split(data(t))[0], name, "binary", **kw)


@query("int_01")
@shared("y")
def int_01(t):
    a = e.importances(fitted(t, "forest", n_estimators=8, max_depth=5), FEATS, t.spark).withColumn("model", F.lit("forest"))
    return a.unionByName(e.importances(fitted(t), FEATS, t.spark).withColumn("model", F.lit("logistic")))


@query("int_02", """SELECT 'c_acctbal' AS feature, round(avg(abs(2 * (c_acctbal - m))), 4) AS mean_abs FROM orders_target, (SELECT avg(c_acctbal) AS m FROM orders_target)
  UNION ALL SELECT 'c_nationkey', round(avg(abs(-30 * (c_nationkey - m))), 4) FROM orders_target, (SELECT avg(c_nationkey) AS m FROM orders_target)""", "orders_target")
def int_02(t):
    return e.linear_contributions(t.orders_target, {"c_acctbal": 2.0, "c_nationkey": -30.0})


@query("int_03")
@shared("y")
def int_03(t):
    model = fitted(t, "forest", n_estimators=8, max_depth=5)
    asm = VectorAssembler(inputCols=FEATS, outputCol="features")
    score = lambda d: e.probability(model.transform(asm.transform(d)))
    d = t.orders_target.select("o_orderkey", *[F.col(c).cast("double").alias(c) for c in FEATS])
    phi = e.shapley_sample(d, "o_orderkey", FEATS, score, permutations=4)
    return phi.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("phi")), 4).alias("mean_abs"))


@query("int_04")
@shared("y")
def int_04(t):
    model = fitted(t)
    asm = VectorAssembler(inputCols=FEATS, outputCol="features")
    ev = m.EVALUATORS["binary"][1]()
    score = lambda d: float(ev.evaluate(model.transform(asm.transform(d))))
    d = t.orders_target.select("o_orderkey", F.col("y").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in FEATS])
    return e.permutation_importance(d, "o_orderkey", FEATS, score)


@query("int_05", """WITH a AS (SELECT l_partkey AS f, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1), b AS (SELECT l_partkey AS f, count(*) AS x FROM lineitem GROUP BY 1)
  SELECT count(*) AS shared, round(count(*) / 50, 4) AS share FROM (SELECT f FROM (SELECT f FROM a ORDER BY round(x, 2) DESC, CAST(f AS VARCHAR) LIMIT 50) INTERSECT SELECT f FROM (SELECT f FROM b ORDER BY x DESC, CAST(f AS VARCHAR) LIMIT 50))""")
def int_05(t):
    g = t.lineitem.groupBy(F.col("l_partkey").cast("string").alias("feature"))
    return e.top_overlap(g.agg(F.round(F.sum("l_extendedprice"), 2).alias("importance")), g.agg(F.count("*").alias("importance")), 50)


@query("int_06", """SELECT seg, CAST(band AS BIGINT) AS band, count(*) AS n, CAST(sum(w) AS BIGINT) AS errors, CAST(grouping(seg) * 2 + grouping(band) AS BIGINT) AS level, round(avg(w), 4) AS error_rate
  FROM (SELECT grp AS seg, floor(weight / 100000) AS band, (y <> pred)::INT AS w FROM preds) GROUP BY CUBE (seg, band)""", "preds")
def int_06(t):
    return e.error_segments(t.preds, {"seg": F.col("grp"), "band": F.floor(F.col("weight") / 100000)}, F.col("y") != F.col("pred"))


@query("int_07", f"SELECT grp, {CLS} FROM (SELECT grp, {CM} FROM preds GROUP BY grp)", "preds")
def int_07(t):
    return metrics.classification(t.preds, ["grp"])


@query("int_08", """SELECT round(min(r) / max(r), 4) AS disparate_impact, round(max(r) - min(r), 4) AS parity_gap, round(max(tp) - min(tp), 4) AS opportunity_gap FROM (SELECT grp, avg(pred) AS r, avg(pred) FILTER (y = 1) AS tp FROM preds GROUP BY 1)""", "preds")
def int_08(t):
    return e.disparity(t.preds, "grp")


@query("int_09", """WITH p AS (SELECT grp, score, sum(count(*) FILTER (y = 1)) OVER (PARTITION BY grp ORDER BY score DESC) / sum(count(*) FILTER (y = 1)) OVER (PARTITION BY grp) AS tpr FROM preds GROUP BY 1, 2) SELECT grp, max(score) AS threshold FROM p WHERE tpr >= 0.9 GROUP BY 1""", "preds")
def int_09(t):
    return e.group_thresholds(t.preds, "grp", 0.9)


@query("int_10", """WITH p AS (SELECT c_custkey AS id, c_acctbal / 1000 AS a, c_nationkey::DOUBLE AS b FROM customer), r AS (SELECT q.id AS query, d.id AS neighbour, sqrt(pow(d.a - q.a, 2) + pow(d.b - q.b, 2)) AS x, row_number() OVER (PARTITION BY q.id ORDER BY sqrt(pow(d.a - q.a, 2) + pow(d.b - q.b, 2)), d.id) AS rank FROM p q JOIN p d ON q.id <> d.id)
  SELECT query, neighbour, CAST(rank AS INTEGER) AS rank, round(x, 6) AS distance FROM r WHERE rank <= 3""")
def int_10(t):
    q = t.customer.select(F.col("c_custkey").alias("query"), (F.col("c_acctbal") / 1000).alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    out = knn(q, q.withColumnRenamed("query", "neighbour"), "query", "neighbour", ["a", "b"], 3, skip_self=True)
    return out.select("query", "neighbour", "rank", rnd(F.col("distance"), 6).alias("distance"))


@query("int_10_wide", """WITH v AS (SELECT vec_id, embedding[1:8]::DOUBLE[] AS x FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id)
  SELECT vec_id, neighbour, round(d, 5) AS distance, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour)::INT AS rank FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) <= 5""")
def int_10_wide(t):
    """Five nearest neighbours of every row in eight dimensions."""
    from sparkloom.operators.leaves import nearest

    coords = [F.col("embedding")[i] for i in range(8)]
    own = t.embeddings.select("vec_id", F.col("vec_id").alias("neighbour"), "embedding")
    return nearest(own, own, "vec_id", "neighbour", coords, 5, skip_self=True, leaf=200).select("vec_id", "neighbour", rnd(F.col("distance"), 5).alias("distance"), "rank")


@query("int_11", "SELECT c_nationkey % 4 AS cluster, count(*) AS n, round(avg(c_acctbal), 4) AS mean_c_acctbal, round(avg(o_totalprice), 4) AS mean_o_totalprice, round(avg(y), 4) AS label_share, count(*) FILTER (y = 1) AS n_label FROM orders_target GROUP BY 1", "orders_target")
def int_11(t):
    return e.cluster_profile(t.orders_target.withColumn("cluster", F.col("c_nationkey") % 4), "cluster", ["c_acctbal", "o_totalprice"], "y")


@query("int_12")
@shared("y")
def int_12(t):
    ev = m.EVALUATORS["binary"][1]()

    def run(cols):
        tr, te = m.split(m.prepare(t.orders_target, "o_orderkey", cols, "y"))
        return float(ev.evaluate(m.train(tr, "logistic", "binary", max_iter=30).transform(te)))
    return e.ablation(t.orders_target, FEATS, run)


@query("udf_01", "SELECT event_id, round(sqrt(value) / (SELECT max(sqrt(value)) FROM events), 6) AS value FROM events")
def udf_01(t):
    def fit(train, c):
        top = train.agg(F.max(F.sqrt(c))).first()[0]
        return transforms.Fitted(lambda df: df.withColumn(c, F.sqrt(c) / F.lit(top)))

    transforms.register_transform("root_share", fit)
    out = transforms.fit_plan(t.events, {"value": ["root_share"]}).transform(t.events)
    return out.select("event_id", rnd(F.col("value"), 6).alias("value"))


@query("udf_02", """SELECT 'late_share' AS "check", CASE WHEN avg((ts > TIMESTAMP '2024-01-20')::INT) > 0.25 THEN 'WARNING' ELSE 'PASS' END AS status, round(avg((ts > TIMESTAMP '2024-01-20')::INT), 4) AS metric, 0.25::DOUBLE AS threshold, '' AS detail FROM events""")
def udf_02(t):
    late = F.avg((F.col("ts") > F.lit("2024-01-20").cast("timestamp_ntz")).cast("double"))
    own = gates.Check("late_share", {"_l": late}, lambda: (F.col("_l"), F.col("_l") > 0.25, F.lit("")), 0.25, gates.WARNING)
    return gates.run_checks(t.events, [own])


@query("udf_03")
def udf_03(t):
    from pyspark.ml.classification import NaiveBayes

    m.register_model("bayes", {"binary"}, lambda **k: NaiveBayes(modelType="gaussian", weightCol="weight"))
    tr, te = m.split(data(t))
    ev = m.EVALUATORS["binary"][1]()
    return t.spark.createDataFrame([("bayes", round(float(ev.evaluate(m.train(tr, "bayes", "binary").transform(te))), 4))], "model string, roc_auc double")


@query("udf_04", "SELECT count(*) AS n, round(avg(abs(value - 50)), 4) AS mean_gap, round(skewness(value), 4) AS skew_builtin FROM events")
def udf_04(t):
    """A vectorised scalar function next to built-ins."""
    @F.pandas_udf("double")
    def gap(v: pd.Series) -> pd.Series:
        return (v - 50).abs()

    return t.events.select("value", gap("value").alias("g")).agg(F.count("*").alias("n"), rnd(F.avg("g")).alias("mean_gap"), rnd(skew_g1("value")).alias("skew_builtin"))


@query("udf_04_grouped", "SELECT day, round(skewness(value), 4) AS skew FROM (SELECT strftime(ts, '%Y-%m-%d') || '/' || event_type AS day, value FROM events) GROUP BY 1 HAVING count(*) > 2")
def udf_04_grouped(t):
    """A grouped vectorised aggregate over mergeable parts: power sums per slice, merged per group.

    The Python function sees one hashed slice of a group at a time, so a hot group is never in one call.
    """
    def sums(frames):
        for pdf in frames:
            v = pdf["value"]
            g = pd.DataFrame({"day": pdf["day"], "n": 1.0, "a": v, "b": v ** 2, "c": v ** 3}).groupby("day", as_index=False).sum()
            yield g

    d = t.events.select(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("/"), "event_type").alias("day"), "value")
    s = d.mapInPandas(sums, "day string, n double, a double, b double, c double").groupBy("day").agg(*[F.sum(x).alias(x) for x in "nabc"])
    n, mean = F.col("n"), F.col("a") / F.col("n")
    m2 = F.col("b") / n - mean * mean
    m3 = F.col("c") / n - 3 * mean * F.col("b") / n + 2 * mean * mean * mean
    return s.where("n > 2").select("day", rnd(m3 / F.pow(m2, 1.5) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"))


@query("udf_05", r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS n_words FROM documents WHERE text <> ''")
def udf_05(t):
    """A Python table function that cuts texts into parts of 100 words, called through a lateral join."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="part int, n_words int")
    class WordParts:
        def eval(self, text: str):
            words = (text or "").split()
            for i in range(0, max(len(words), 1), 100):
                yield i // 100, len(words[i:i + 100])

    t.spark.udtf.register("word_parts", WordParts)
    parts = t.spark.sql("SELECT doc_id, n_words FROM {docs}, LATERAL word_parts(text)", docs=t.documents.select("doc_id", "text"))
    return parts.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"))


@query("udf_05_series", "SELECT brand, round(list_reduce(list(qty ORDER BY day), lambda a, x: 0.7 * a + 0.3 * x), 4) AS level FROM demand GROUP BY 1", "demand")
def udf_05_series(t):
    """applyInPandas per series; a series is bounded by its calendar."""
    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("day")["qty"].to_numpy()
        level = v[0]
        for x in v[1:]:
            level = 0.7 * level + 0.3 * x
        return pd.DataFrame({"brand": [pdf["brand"].iloc[0]], "level": [round(float(level), 4)]})

    return t.demand.groupBy("brand").applyInPandas(smooth, "brand string, level double")


