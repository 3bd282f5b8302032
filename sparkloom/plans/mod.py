"""Model queries; the tables carry a planted signal (see views.orders_target)."""

from functools import wraps

from pyspark.sql import functions as F

from sparkloom.functions.exprs import rnd
from sparkloom.operators import features, forecast, kernels, models as m, regression as reg, tuning
from sparkloom.operators.metrics import auc, regression
from sparkloom.operators.retrieval import tokens
from sparkloom.plans.catalog import query
from sparkloom.plans.views import H

FEATS = ["c_acctbal", "o_totalprice", "c_nationkey"]


def data(t, target="y"):
    return m.prepare(t.orders_target, "o_orderkey", FEATS, target)


def shared(*columns):
    """The query's fits and scores read these columns of orders_target from one join, held while the query runs."""
    def wrap(fn):
        @wraps(fn)
        def run(t):
            rows = t.orders_target.select("o_orderkey", *FEATS, *columns).persist()
            t.orders_target = rows
            try:
                return fn(t)
            finally:
                rows.unpersist()

        return run

    return wrap


def binary(t, name, **kw):
    tr, te = m.split(data(t))
    out = m.train(tr, name, "binary", **kw).transform(te)
    ev = m.EVALUATORS["binary"][1]()
    return t.spark.createDataFrame([(name, te.count(), round(float(ev.evaluate(out)), 4))], "model string, n_test long, roc_auc double")


def number(t, name, **kw):
    tr, te = m.split(data(t, "target"))
    out = m.train(tr, name, "regression", **kw).transform(te)
    return regression(out, "label", "prediction").withColumn("model", F.lit(name))


@query("mod_01")
@shared("y")
def mod_01(t):
    return binary(t, "logistic")


@query("mod_02")
@shared("y")
def mod_02(t):
    return binary(t, "forest")


@query("mod_03")
@shared("target")
def mod_03(t):
    return number(t, "forest_regressor", n_estimators=10)


@query("mod_04")
@shared("y")
def mod_04(t):
    one = binary(t, "boosted", n_estimators=10)
    d = m.prepare(t.orders_target.withColumn("cls", (F.col("y") + (F.col("c_acctbal") > 9000).cast("int"))), "o_orderkey", FEATS, "cls")
    tr, te = m.split(d)
    f1 = m.EVALUATORS["multiclass"][1]().evaluate(m.train(tr, "boosted", "multiclass", n_estimators=5, max_depth=3).transform(te))
    return one.withColumn("multiclass_f1", F.lit(round(float(f1), 4)))


@query("mod_05")
@shared("target")
def mod_05(t):
    return number(t, "boosted_regressor", n_estimators=10)


@query("mod_06", "SELECT round(regr_slope(target, c_acctbal), 6) AS slope, round(regr_intercept(target, c_acctbal), 4) AS intercept, round(regr_r2(target, c_acctbal), 6) AS r2 FROM orders_target", "orders_target")
def mod_06(t):
    d = m.prepare(t.orders_target, "o_orderkey", ["c_acctbal"], "target")
    f = m.train(d, "linear", "regression")
    return t.spark.createDataFrame([(round(float(f.coefficients[0]), 6), round(float(f.intercept), 4), round(float(f.summary.r2), 6))], "slope double, intercept double, r2 double")


@query("mod_07")
@shared("target")
def mod_07(t):
    return number(t, "ridge").unionByName(number(t, "lasso"))


@query("mod_08")
@shared("y")
def mod_08(t):
    """Balanced bags fitted on one part of the rows and judged on the other."""
    tr, te = m.split(data(t))
    d = m.balanced_bags(tr, 20, te)
    return auc(d.select(F.col("label").cast("int").alias("y"), F.round("score", 4).alias("score"))).select(rnd(F.col("auc")).alias("roc_auc"))


@query("mod_09")
@shared("y")
def mod_09(t):
    return binary(t, "svm", max_iter=20)


@query("mod_09_kernel")
def mod_09_kernel(t):
    """A ring that no straight margin separates: area under the curve of the linear machine on the features and on random Fourier features."""
    names = ["c_acctbal", "c_nationkey"]
    far = F.pow((F.col("c_acctbal") - 4500) / 3175, 2) + F.pow((F.col("c_nationkey") - 12) / 7.2, 2)
    d = m.prepare(t.customer.withColumn("ring", (far < 1.3).cast("int")), "c_custkey", names, "ring")
    tr, te = m.split(d)
    scales = kernels.standard_scales(tr, names)
    ev = m.EVALUATORS["binary"][1]()
    wide = lambda rows: kernels.radial_features(rows.drop("features"), names, scales, gamma=1.0)
    plain, ring = m.train(tr, "svm", "binary").transform(te), m.train(wide(tr), "svm", "binary").transform(wide(te))
    return t.spark.createDataFrame([("linear", round(float(ev.evaluate(plain)), 4)), ("fourier", round(float(ev.evaluate(ring)), 4))], "model string, roc_auc double")


@query("mod_10")
def mod_10(t):
    return m.choose_k(t.customer.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey")), ["c_acctbal", "c_nationkey"])[1]


DB = """pts AS (SELECT c_custkey AS id, floor(c_acctbal / 100) AS x, c_nationkey::DOUBLE * 2 AS y FROM customer), nb AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 4.0),
  core AS (SELECT a AS id FROM nb GROUP BY 1 HAVING count(*) >= 5), reach AS (SELECT id AS node, id AS root FROM core UNION SELECT nb.b, reach.root FROM reach JOIN nb ON nb.a = reach.node JOIN core ON core.id = nb.b),
  lab AS (SELECT node, min(root) AS label FROM reach GROUP BY 1), edge AS (SELECT DISTINCT nb.a AS id FROM nb JOIN core ON core.id = nb.b)"""


@query("mod_11", f"""WITH RECURSIVE {DB} SELECT count(*) AS n_rows, (SELECT count(DISTINCT label) FROM lab) AS n_clusters, count(*) - (SELECT count(*) FROM edge) AS n_noise FROM pts""")
def mod_11(t):
    d = t.customer.select(F.col("c_custkey").alias("id"), F.floor(F.col("c_acctbal") / 100).cast("double").alias("x"), (F.col("c_nationkey").cast("double") * 2).alias("y"))
    return m.dbscan(d, "id", ["x", "y"], 2.0, 5).agg(F.count("*").alias("n_rows"), F.count_distinct("cluster").alias("n_clusters"), F.count_if(F.col("cluster").isNull()).alias("n_noise"))


@query("mod_12")
def mod_12(t):
    return m.silhouette(m.bisecting(t.customer.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey")), ["c_acctbal", "c_nationkey"]))


@query("mod_13", "SELECT round(avg(target), 4) AS mean_guess, round(avg(abs(target - m)), 4) AS mae_of_mean, (SELECT arg_min(y, (-n, y)) FROM (SELECT y, count(*) AS n FROM orders_target GROUP BY 1)) AS mode_guess FROM orders_target, (SELECT avg(target) AS m FROM orders_target)", "orders_target")
def mod_13(t):
    mean = t.orders_target.agg(F.avg("target")).first()[0]
    mode = t.orders_target.groupBy("y").count().agg(F.min_by("y", F.struct(-F.col("count"), F.col("y")))).first()[0]
    return t.orders_target.agg(rnd(F.avg("target")).alias("mean_guess"), rnd(F.avg(F.abs(F.col("target") - F.lit(mean)))).alias("mae_of_mean"), F.lit(mode).alias("mode_guess"))


@query("mod_14", """WITH f AS (SELECT brand, qty, lag(qty, 1) OVER w AS n1, lag(qty, 7) OVER w AS n7 FROM demand WINDOW w AS (PARTITION BY brand ORDER BY day))
  SELECT brand, round(avg(abs(qty - n1)), 4) AS naive_mae, round(avg(abs(qty - n7)), 4) AS seasonal_mae FROM f WHERE n7 IS NOT NULL GROUP BY 1""", "demand")
def mod_14(t):
    f = features.lags(t.demand, "brand", "day", "qty", [1, 7]).where("lag_7 IS NOT NULL")
    return f.groupBy("brand").agg(rnd(F.avg(F.abs(F.col("qty") - F.col("lag_1")))).alias("naive_mae"), rnd(F.avg(F.abs(F.col("qty") - F.col("lag_7")))).alias("seasonal_mae"))


@query("mod_15")
def mod_15(t):
    return m.lag_forecast(t.demand, "brand", "day", "qty", [1, 7])


@query("mod_15_recursive")
def mod_15_recursive(t):
    """Forecasts of the last week of each series, every step on the predictions before it, beside what came."""
    import datetime

    last = t.demand.agg(F.max("day")).first()[0]
    out = forecast.recursive_forecast(t.demand, "brand", "day", "qty", 7, last - datetime.timedelta(days=7))
    return out.join(t.demand, ["brand", "day"]).select("brand", "horizon", "day", F.round("forecast", 4).alias("forecast"), F.col("qty").alias("actual"))


@query("mod_16", """WITH RECURSIVE d AS (SELECT brand, qty::DOUBLE AS x, row_number() OVER (PARTITION BY brand ORDER BY day) AS i FROM demand),
  f AS (SELECT brand, i, CASE WHEN x > 0 THEN x END AS z, CASE WHEN x > 0 THEN 1.0::DOUBLE END AS p, CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 2.0 END AS q, CASE WHEN x > 0 THEN 0.1::DOUBLE ELSE 0.0 END AS b FROM d WHERE i = 1
    UNION ALL SELECT f.brand, d.i, CASE WHEN x > 0 THEN CASE WHEN z IS NULL THEN x ELSE z + 0.1 * (x - z) END ELSE z END, CASE WHEN x > 0 THEN CASE WHEN z IS NULL THEN q ELSE p + 0.1 * (q - p) END ELSE p END,
      CASE WHEN x > 0 THEN 1.0 ELSE q + 1 END, b + 0.1 * (CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END - b) FROM f JOIN d ON d.brand = f.brand AND d.i = f.i + 1)
  SELECT brand, round(z / p, 5) AS croston, round(z / p * 0.95, 5) AS sba, round(b * z, 5) AS tsb FROM f WHERE i = (SELECT max(i) FROM d)""", "demand")
def mod_16(t):
    return m.intermittent_forecast(t.demand, "brand", "day", "qty")


@query("mod_17", "SELECT brand, round(list_reduce(list(qty ORDER BY day), lambda a, x: 0.8 * a + 0.2 * x), 5) AS forecast FROM demand GROUP BY 1", "demand")
def mod_17(t):
    return features.ewma(t.demand, "brand", "day", "qty", 0.2).select("brand", rnd(F.col("ewma"), 5).alias("forecast"))


@query("mod_18")
def mod_18(t):
    pairs = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("w"))
    return m.recommend(pairs, "o_custkey", "l_suppkey", "w").select("user", "item", F.round("rating", 4).alias("rating"))


@query("mod_19")
def mod_19(t):
    return m.topics(t.documents.select("doc_id", tokens(F.col("text")).alias("words")), "doc_id", "words", 4)


@query("mod_20")
def mod_20(t):
    return m.principal_components(t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 3)


@query("mod_21")
def mod_21(t):
    d = t.lineitem.select(F.xxhash64(*t.lineitem.columns).alias("id"), "l_quantity", "l_extendedprice", "l_discount")
    return m.isolation_scores(d, "id", ["l_quantity", "l_extendedprice", "l_discount"], trees=10).agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.round(F.max("score"), 4).alias("top"))


@query("mod_22")
def mod_22(t):
    """Brier score before and after, on rows that the calibration has not seen."""
    scored = t.preds.select(F.col("id").alias("key"), F.col("y").cast("double").alias("label"), "score")
    tr, te = m.split(scored, 50)
    gap = lambda d: d.agg(rnd(F.avg(F.pow(F.col("calibrated") - F.col("label"), 2)), 5).alias("brier"), rnd(F.avg(F.pow(F.col("score") - F.col("label"), 2)), 5).alias("brier_before"))
    return gap(m.calibrate(tr, "sigmoid", te)).withColumn("method", F.lit("sigmoid")).unionByName(gap(m.calibrate(tr, "isotonic", te)).withColumn("method", F.lit("isotonic")))


@query("mod_23")
def mod_23(t):
    d = m.prepare(t.lineitem.withColumn("key", F.xxhash64(*t.lineitem.columns)).withColumn("ret", (F.col("l_returnflag") == "R").cast("int")), "key", ["l_discount", "l_tax", "ret"], "l_quantity")
    return t.spark.createDataFrame([(n, round(float(m.train(d, n, "regression").intercept), 4)) for n in ("poisson", "tweedie")], "model string, intercept double")


@query("mod_23_quantile", """WITH g AS (SELECT l_discount::DOUBLE AS x, l_quantity::DOUBLE AS y, count(*) AS w FROM lineitem GROUP BY 1, 2), q AS (SELECT unnest([0.1, 0.5, 0.9]) AS q),
  line AS (SELECT DISTINCT (b.y - a.y) / (b.x - a.x) AS k, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS c FROM g a JOIN g b ON a.x < b.x WHERE abs(b.y - a.y) <= 8),
  r AS (SELECT q, k, c, sum(w * CASE WHEN y > c + k * x THEN q * (y - c - k * x) ELSE (q - 1) * (y - c - k * x) END) AS loss FROM g, line, q GROUP BY q, k, c)
  SELECT q::DOUBLE AS quantile, (SELECT count(*) FROM lineitem) AS n_rows, round(min(loss), 3) AS loss, true AS balanced FROM r GROUP BY q""")
def mod_23_quantile(t):
    """Least pinball loss of quantity on discount; balanced: rows below the fit are no more than the quantile's share of all, those not above it no less."""
    qs = [0.1, 0.5, 0.9]
    fit = reg.quantile_regression(t.lineitem, "l_quantity", ["l_discount"], qs)
    line = {(r["quantile"], r["term"]): r["coefficient"] for r in fit.collect()}
    r = lambda q: F.col("l_quantity") - (F.lit(line[q, "(intercept)"]) + F.lit(line[q, "l_discount"]) * F.col("l_discount"))
    n = F.count("*")
    one = lambda q: F.struct(F.lit(q).alias("quantile"), n.alias("n_rows"), F.round(F.sum(F.greatest(q * r(q), (q - 1) * r(q))), 3).alias("loss"),
                             ((F.count_if(r(q) < -1e-9) <= q * n + 1e-6) & (F.count_if(r(q) <= 1e-9) >= q * n - 1e-6)).alias("balanced"))
    return t.lineitem.agg(F.array(*[one(q) for q in qs]).alias("a")).select(F.inline("a"))


@query("mod_23_coefficients")
def mod_23_coefficients(t):
    fit = reg.quantile_regression(t.orders_target, "target", FEATS, [0.1, 0.5, 0.9])
    return fit.select("quantile", "term", F.round("coefficient", 6).alias("coefficient"))


@query("mod_24", """SELECT l_partkey, count(*) AS n, round(regr_slope(ln(l_quantity), ln(l_extendedprice)), 5) AS elasticity FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1 HAVING count(*) > 2 AND var_pop(ln(l_extendedprice)) > 1e-9""")
def mod_24(t):
    g = t.lineitem.where("l_quantity > 0 AND l_extendedprice > 0").groupBy("l_partkey").agg(F.count("*").alias("n"), F.regr_slope(F.log("l_quantity"), F.log("l_extendedprice")).alias("e"), F.var_pop(F.log("l_extendedprice")).alias("v"))
    return g.where("n > 2 AND v > 1e-9").select("l_partkey", "n", rnd(F.col("e"), 5).alias("elasticity"))


@query("mod_25")
def mod_25(t):
    return m.survival_model(t.survival, "days", "event", ["arm"])


@query("mod_25_cox", """WITH RECURSIVE r AS (SELECT days, sum(event) AS d, sum(event * arm) AS d1, sum(sum(1 - arm)) OVER (ORDER BY days DESC) AS n0, sum(sum(arm)) OVER (ORDER BY days DESC) AS n1 FROM survival GROUP BY days),
  fit AS (SELECT 0 AS k, 0.0::DOUBLE AS b UNION ALL
    SELECT k + 1, b + (SELECT sum(d1 - d * n1 * exp(b) / (n0 + n1 * exp(b))) / sum(d * n0 * n1 * exp(b) / pow(n0 + n1 * exp(b), 2)) FROM r) FROM fit WHERE k < 25)
  SELECT 'arm' AS term, round(b, 6) AS coefficient, round(exp(b), 6) AS hazard_ratio, round(1 / sqrt((SELECT sum(d * n0 * n1 * exp(b) / pow(n0 + n1 * exp(b), 2)) FROM r)), 6) AS std_error FROM fit WHERE k = 25""", "survival")
def mod_25_cox(t):
    out = reg.cox_model(t.survival, "days", "event", ["arm"])
    return out.select("term", *[rnd(F.col(c), 6).alias(c) for c in ("coefficient", "hazard_ratio", "std_error")])


@query("mod_26")
def mod_26(t):
    u = m.uplift(t.ab, "user_id", "arm", "spend", ["before", "segment"])
    return u.select("user_id", F.round("t_uplift", 3).alias("t_uplift"), F.round("x_uplift", 3).alias("x_uplift"))


@query("mod_27")
@shared("y")
def mod_27(t):
    return m.train_many(data(t), ["logistic", "tree", "forest", "no_such_model"], "binary", n_estimators=8, max_depth=5)


@query("mod_28")
@shared("y")
def mod_28(t):
    return m.cross_validate(data(t), "logistic", "binary", 3)


@query("mod_29")
@shared("y")
def mod_29(t):
    return m.search(data(t), "logistic", "binary", m.draw_params("logistic", 4), 2)


@query("mod_30")
@shared("y")
def mod_30(t):
    return m.search(data(t), "forest", "binary", m.grid_trials(numTrees=[5, 10], maxDepth=[3, 5]), 2)


@query("mod_31")
@shared("y")
def mod_31(t):
    return m.halving(data(t), "logistic", "binary", m.draw_params("logistic", 6))


@query("mod_31_hyperband", f"""WITH t AS (SELECT {H("concat(CAST(o_orderkey AS VARCHAR), '|sample')", 1000000)} AS slot FROM orders_target WHERE {H("concat(CAST(o_orderkey AS VARCHAR), '|split')", 100)} >= 20),
  plan(bracket, rung, n_trials, budget) AS (VALUES (0, 0, 9, 1), (0, 1, 3, 3), (0, 2, 1, 9), (1, 0, 5, 3), (1, 1, 1, 9), (2, 0, 3, 9))
  SELECT bracket, rung, n_trials::BIGINT AS n_trials, budget, (SELECT count(*) FROM t WHERE slot < 1000000 * budget // 9) AS n_rows, true AS best_kept FROM plan""", "orders_target")
def mod_31_hyperband(t):
    """Rungs of every bracket with their trials and training rows, and whether the best trial of each rung was kept."""
    out = tuning.hyperband(data(t), "logistic", "binary", most=9)
    best = F.max(F.when(F.col("kept"), F.col("score"))) == F.max("score")
    return out.groupBy("bracket", "rung", "budget").agg(F.count("*").alias("n_trials"), F.max("n_rows").alias("n_rows"), best.alias("best_kept"))


@query("mod_32", """SELECT user_id AS dataset, count(*) * 40 AS rows, CAST(5 AS BIGINT) AS n_features, round(count(DISTINCT event_type) / 10, 2) AS categorical_share, user_id % 3 = 0 AS time_indexed,
  CASE WHEN count(*) * 40 < 100 THEN 'linear_only' WHEN user_id % 3 = 0 THEN 'boosted_with_lags' WHEN count(*) * 40 > 1000000 THEN 'boosted_only' WHEN count(DISTINCT event_type) / 10 > 0.3 THEN 'boosted_categorical' WHEN count(*) * 40 > 100000 THEN 'boosted_no_svm' ELSE 'all_models' END AS advice FROM events GROUP BY user_id""")
def mod_32(t):
    p = t.events.groupBy(F.col("user_id").alias("dataset")).agg((F.count("*") * 40).alias("rows"), F.round(F.count_distinct("event_type") / 10, 2).alias("categorical_share"))
    return m.model_advice(p.withColumn("n_features", F.lit(5).cast("bigint")).withColumn("time_indexed", F.col("dataset") % 3 == 0))


@query("mod_33")
def mod_33(t):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    from sparkloom.session import new_scratch_path

    cats = ["c_mktsegment"]
    stages = m.linear_pipeline(cats, ["c_acctbal", "o_totalprice"]).getStages() + [LogisticRegression(labelCol="y", maxIter=20)]
    model = m.stored(Pipeline(stages=stages).fit(t.orders_target))
    out = m.batch_score(model, t.orders_target, F.year("o_orderdate"), new_scratch_path(t.spark, "scores"), ["o_orderkey"])
    return out.groupBy("day").agg(F.count("*").alias("n"), F.round(F.avg("prediction"), 4).alias("rate"))


@query("mod_34")
@shared("y")
def mod_34(t):
    tr, te = m.split(data(t))
    parts = [m.scores(m.train(tr, n, "binary", n_estimators=8, max_depth=5), te) for n in ("logistic", "forest", "tree")]
    out = m.ensemble(parts)
    return auc(out.select(F.col("label").cast("int").alias("y"), F.round("score", 4).alias("score"))).select(rnd(F.col("auc")).alias("roc_auc"))


