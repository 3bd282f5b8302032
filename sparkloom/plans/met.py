"""Metric queries over predictions built from the tables."""

from pyspark.sql import functions as F, Window as W

from sparkloom.functions.exprs import hash_bucket, rnd
from sparkloom.operators import metrics as m, splits
from sparkloom.operators.ordered import previous
from sparkloom.plans.catalog import query
from sparkloom.plans.spl import _poisson_sql
from sparkloom.plans.views import H

CM = "count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 1 AND pred = 0) AS fn"
CLS = """round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0), 4) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1"""
PTS = """pts AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM (SELECT score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM preds GROUP BY score))"""
AUC = "sum(neg * (tp - pos / 2)) / any_value(p * n)"


@query("met_01", f"SELECT {CLS} FROM (SELECT {CM} FROM preds)", "preds")
def met_01(t):
    return m.classification(t.preds)


MC = f"mc AS (SELECT o_orderstatus AS y, CASE WHEN {H('o_orderkey', 3)} = 0 THEN 'F' ELSE o_orderstatus END AS p FROM orders)"


@query("met_02", f"""WITH {MC}, c AS (SELECT cls, count(*) FILTER (y = cls AND p = cls) AS hit, count(*) FILTER (y = cls) AS nt, count(*) FILTER (p = cls) AS np FROM mc, (SELECT DISTINCT y AS cls FROM mc) GROUP BY cls),
  s AS (SELECT *, coalesce(hit / nullif(np, 0), 0) AS pr, coalesce(hit / nullif(nt, 0), 0) AS re, coalesce(2 * hit / nullif(nt + np, 0), 0) AS f FROM c)
  SELECT round(sum(hit) / sum(nt), 4) AS accuracy, round(sum(pr * nt) / sum(nt), 4) AS weighted_precision, round(sum(re * nt) / sum(nt), 4) AS weighted_recall, round(sum(f * nt) / sum(nt), 4) AS weighted_f1,
  round(avg(pr), 4) AS macro_precision, round(avg(re), 4) AS macro_recall, round(avg(f), 4) AS macro_f1 FROM s""")
def met_02(t):
    d = t.orders.select(F.col("o_orderstatus").alias("y"), F.when(hash_bucket("o_orderkey", 3) == 0, "F").otherwise(F.col("o_orderstatus")).alias("p"))
    return m.multiclass(d, "y", "p")


@query("met_03", f"""WITH {PTS}, o AS (SELECT a.grp AS class, sum(a.n * ((SELECT count(*) FROM preds b WHERE b.grp <> a.grp AND b.score < a.score) + 0.5 * (SELECT count(*) FROM preds b WHERE b.grp <> a.grp AND b.score = a.score))) / (sum(a.n) * (SELECT count(*) FROM preds b WHERE b.grp <> a.grp)) AS auc
    FROM (SELECT grp, score, count(*) AS n FROM preds GROUP BY 1, 2) a GROUP BY a.grp)
  SELECT 'binary' AS class, round({AUC}, 6) AS auc FROM pts UNION ALL SELECT class, round(auc, 6) FROM o UNION ALL SELECT 'macro', round(avg(auc), 6) FROM o""", "preds")
def met_03(t):
    one = m.auc(t.preds).select(F.lit("binary").alias("class"), "auc")
    rest = m.auc_one_vs_rest(t.preds, "grp", "score")
    macro = rest.agg(F.avg("auc").alias("auc")).select(F.lit("macro").alias("class"), "auc")
    return one.unionByName(rest).unionByName(macro).select("class", rnd(F.col("auc"), 6).alias("auc"))


@query("met_04", """SELECT round(avg(e * e), 4) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - sum(e * e) / (var_pop(target) * count(*)), 4) AS r2
  FROM (SELECT target, target - estimate AS e FROM preds)""", "preds")
def met_04(t):
    return m.regression(t.preds, "target", "estimate")


@query("met_05")
def met_05(t):
    from sparkloom.operators.models import cluster_kmeans, silhouette

    d = t.customer.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    return silhouette(cluster_kmeans(d, ["c_acctbal", "c_nationkey"], 4))


@query("met_06", """SELECT a.y, b.pred, count(p.id) AS n FROM (SELECT DISTINCT CAST(y AS VARCHAR) AS y FROM preds) a, (SELECT DISTINCT CAST(pred AS VARCHAR) AS pred FROM preds) b
  LEFT JOIN preds p ON CAST(p.y AS VARCHAR) = a.y AND CAST(p.pred AS VARCHAR) = b.pred GROUP BY 1, 2""", "preds")
def met_06(t):
    return m.confusion_matrix(t.preds, "y", "pred")


@query("met_07", f"WITH {PTS} SELECT score, round(fp / n, 5) AS fpr, round(tp / p, 5) AS tpr, round(tp / (tp + fp), 5) AS precision FROM pts", "preds")
def met_07(t):
    return m.curve_points(t.preds).select("score", *[rnd(F.col(c), 5).alias(c) for c in ("fpr", "tpr", "precision")])


@query("met_08", """SELECT CAST(least(greatest(floor((estimate + 2000) * 20 / 24000), 0), 19) AS BIGINT) AS bin, count(*) AS n, round(avg(target), 4) AS actual, round(avg(estimate), 4) AS predicted,
  round(avg(target - estimate), 4) AS residual, round(stddev_samp(target - estimate), 4) AS residual_sd FROM preds GROUP BY 1""", "preds")
def met_08(t):
    return m.residual_bins(t.preds, "target", "estimate", -2000.0, 22000.0, 20)


@query("met_09", f"WITH {PTS} SELECT round(sum(pos * (tp / (tp + fp))) / any_value(p), 6) AS ap FROM pts", "preds")
def met_09(t):
    return m.average_precision(t.preds).select(rnd(F.col("ap"), 6).alias("ap"))


@query("met_10", f"WITH {PTS} SELECT round(2 * {AUC} - 1, 6) AS gini FROM pts", "preds")
def met_10(t):
    return m.auc(t.preds).select(rnd(2 * F.col("auc") - 1, 6).alias("gini"))


@query("met_11", f"WITH {PTS} SELECT round(max(abs(tp / p - fp / n)), 6) AS ks FROM pts", "preds")
def met_11(t):
    return m.ks_of_scores(t.preds).select(rnd(F.col("ks"), 6).alias("ks"))


@query("met_12", """SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(score), 5) AS predicted, round(avg(y), 5) AS observed, any_value(b) AS brier, any_value(s) AS slope, any_value(i) AS intercept
  FROM preds, (SELECT round(avg(pow(score - y, 2)), 6) AS b, round(regr_slope(y, score), 5) AS s, round(regr_intercept(y, score), 5) AS i FROM preds) GROUP BY 1""", "preds")
def met_12(t):
    b = m.brier(t.preds).first()
    return m.calibration(t.preds).withColumns({k: F.lit(b[k]) for k in ("brier", "slope", "intercept")})


@query("met_13", """WITH r AS (SELECT y, ntile(10) OVER (ORDER BY score DESC, id) AS tile FROM preds), g AS (SELECT tile, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM r GROUP BY 1)
  SELECT CAST(tile AS INTEGER) AS tile, n, pos, round((pos / n) / (SELECT avg(y) FROM preds), 4) AS lift, round(sum(pos) OVER (ORDER BY tile) / sum(pos) OVER (), 4) AS gain FROM g""", "preds")
def met_13(t):
    return m.gains(t.preds)


@query("met_14", "SELECT round(sum(weight) FILTER (y = 1 AND pred = 1), 2) AS caught, round(sum(weight) FILTER (y = 1), 2) AS total, round(sum(weight) FILTER (y = 1 AND pred = 1) / sum(weight) FILTER (y = 1), 4) AS weighted_recall FROM preds", "preds")
def met_14(t):
    return m.weighted_recall(t.preds)


@query("met_15", f"WITH {PTS}, c AS (SELECT score, fp * 1.0::DOUBLE + (p - tp) * 5.0::DOUBLE AS cost FROM pts) SELECT score AS threshold, cost FROM c ORDER BY cost, score DESC LIMIT 1", "preds")
def met_15(t):
    return m.best_threshold(t.preds, 1.0, 5.0)


@query("met_16", f"WITH {PTS} SELECT round(max(tp / p), 4) AS recall FROM pts WHERE tp / (tp + fp) >= 0.8", "preds")
def met_16(t):
    return m.recall_at_precision(t.preds, 0.8)


@query("met_17", f"""SELECT round(tp / (tp + fn), 4) AS sensitivity, round(tn / (tn + fp), 4) AS specificity, round(tp / (tp + fp), 4) AS ppv, round(tn / (tn + fn), 4) AS npv,
  round(tp / (tp + fp) - fn / (fn + tn), 4) AS arr, round(1 / (tp / (tp + fp) - fn / (fn + tn)), 4) AS nnt FROM (SELECT {CM} FROM preds)""", "preds")
def met_17(t):
    return m.clinical(t.preds)


@query("met_18", f"""WITH s AS (SELECT *, {H('user_id', 20)} AS risk FROM survival) SELECT count(*) AS pairs, round(avg(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END), 4) AS c_index
  FROM s a JOIN s b ON a.event = 1 AND a.days < b.days""", "survival")
def met_18(t):
    return m.concordance(t.survival.withColumn("risk", hash_bucket("user_id", 20)), "days", "event", "risk")


BIN = "(({x} > 0.33)::INT + ({x} > 0.66)::INT)"


@query("met_19", f"""SELECT round((count(*) FILTER (y = 1 AND n > o) - count(*) FILTER (y = 1 AND n < o)) / count(*) FILTER (y = 1), 4) AS nri_events, round((count(*) FILTER (y = 0 AND n < o) - count(*) FILTER (y = 0 AND n > o)) / count(*) FILTER (y = 0), 4) AS nri_nonevents,
  round((count(*) FILTER (y = 1 AND n > o) - count(*) FILTER (y = 1 AND n < o)) / count(*) FILTER (y = 1) + (count(*) FILTER (y = 0 AND n < o) - count(*) FILTER (y = 0 AND n > o)) / count(*) FILTER (y = 0), 4) AS nri
  FROM (SELECT y, {BIN.format(x='score')} AS n, {BIN.format(x='(weight / 500000)')} AS o FROM preds)""", "preds")
def met_19(t):
    b = lambda x: (x > 0.33).cast("int") + (x > 0.66).cast("int")
    return m.reclassification(t.preds, b(F.col("weight") / 500000), b(F.col("score")))


@query("met_20", """WITH f AS (SELECT brand, qty AS a, lag(qty, 7) OVER w AS f, lag(qty, 1) OVER w AS n1 FROM demand WINDOW w AS (PARTITION BY brand ORDER BY day)), g AS (SELECT *, abs(a - f) AS e FROM f WHERE f IS NOT NULL)
  SELECT brand, round(avg(CASE WHEN a <> 0 THEN e / abs(a) END), 4) AS mape, round(sum(e) / sum(abs(a)), 4) AS wape, round(avg(CASE WHEN abs(a) + abs(f) > 0 THEN 2 * e / (abs(a) + abs(f)) ELSE 0 END), 4) AS smape,
  round(avg(e) / avg(abs(a - n1)), 4) AS mase, round(sum(f - a) / sum(a), 4) AS bias, round(quantile_cont(e, 0.9), 4) AS p90 FROM g GROUP BY 1""", "demand")
def met_20(t):
    w = W.partitionBy("brand").orderBy("day")
    d = t.demand.select("brand", "qty", F.lag("qty", 7).over(w).alias("f"), F.lag("qty", 1).over(w).alias("n1")).where("f IS NOT NULL")
    return m.forecast_errors(d, "qty", "f", "n1", ["brand"])


@query("met_21", """WITH f AS (SELECT brand, qty AS a, lag(qty, 7) OVER (PARTITION BY brand ORDER BY day) AS f FROM demand)
  SELECT brand, round(avg(CASE WHEN a >= f THEN 0.9 * (a - f) ELSE -0.1 * (a - f) END), 4) AS pinball_90, round(avg(CASE WHEN a > f THEN 3 * (a - f) ELSE f - a END), 4) AS stock_loss FROM f WHERE f IS NOT NULL GROUP BY 1""", "demand")
def met_21(t):
    d = t.demand.select("brand", F.col("qty").alias("a"), F.lag("qty", 7).over(W.partitionBy("brand").orderBy("day")).alias("f")).where("f IS NOT NULL")
    return d.groupBy("brand").agg(rnd(F.avg(m.pinball(F.col("a"), F.col("f"), 0.9))).alias("pinball_90"), rnd(F.avg(m.stock_loss(F.col("a"), F.col("f"), 3.0, 1.0))).alias("stock_loss"))


@query("met_22", """WITH r AS (SELECT user_id, (event_type = 'purchase')::INT AS rel, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events),
  h AS (SELECT *, sum(rel) OVER (PARTITION BY user_id ORDER BY r) AS h FROM r WHERE r <= 10),
  p AS (SELECT user_id, sum(rel) AS hits, sum(CASE WHEN rel = 1 THEN h / r END) AS ap, min(CASE WHEN rel = 1 THEN r END) AS f, sum(rel / log2(r + 1)) AS dcg FROM h GROUP BY 1),
  n AS (SELECT user_id, sum(rel) AS k, least(sum(rel), 10) AS b FROM r GROUP BY 1), i AS (SELECT user_id, sum(1 / log2(g + 1)) AS idcg FROM n, (SELECT unnest(generate_series(1, 10)) AS g) WHERE g <= b GROUP BY 1)
  SELECT count(*) AS n_queries, round(avg(hits / 10), 4) AS precision, round(avg(coalesce(hits / nullif(k, 0), 0)), 4) AS recall, round(avg((hits > 0)::INT), 4) AS hit_rate, round(avg(coalesce(ap / nullif(b, 0), 0)), 4) AS map,
  round(avg(coalesce(1 / f, 0)), 4) AS mrr, round(avg(coalesce(dcg / idcg, 0)), 4) AS ndcg FROM p JOIN n USING (user_id) LEFT JOIN i USING (user_id)""")
def met_22(t):
    return m.ranking(t.events, "user_id", [F.desc("value"), F.asc("event_id")], F.col("event_type") == "purchase", 10)


@query("met_23", """WITH pop AS (SELECT l_partkey AS item, count(*) AS n FROM lineitem GROUP BY 1), shown AS (SELECT l_partkey AS item, count(*) AS s FROM lineitem WHERE l_discount > 0.09 GROUP BY 1)
  SELECT round(count(*) / (SELECT count(DISTINCT p_partkey) FROM part), 4) AS coverage, round(1 - sum(pow(s / (SELECT sum(s) FROM shown), 2)), 6) AS diversity,
  round(sum(s * -log2(n / (SELECT sum(n) FROM pop))) / (SELECT sum(s) FROM shown), 4) AS novelty FROM shown JOIN pop USING (item)""")
def met_23(t):
    pop = t.lineitem.groupBy(F.col("l_partkey").alias("item")).agg(F.count("*").alias("n"))
    lists = t.lineitem.where("l_discount > 0.09").select(F.col("l_partkey").alias("item"))
    return m.catalogue_spread(lists, "item", t.part.select(F.col("p_partkey").alias("item")), pop)


@query("met_24", """WITH r AS (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS a, rank() OVER (ORDER BY target) + (count(*) OVER (PARTITION BY target) - 1) / 2 AS b FROM orders_target)
  SELECT count(*) AS n, round(corr(a, b), 4) AS rho FROM r""", "orders_target")
def met_24(t):
    return m.spearman(t.orders_target, "c_acctbal", "target")


@query("met_25", "SELECT count(*) AS n, round(avg((a = b)::INT), 4) AS exact_match, round(avg((a <= b)::INT), 4) AS citation_accuracy FROM ratings", "ratings")
def met_25(t):
    return t.ratings.agg(F.count("*").alias("n"), rnd(F.avg((F.col("a") == F.col("b")).cast("double"))).alias("exact_match"),
                         rnd(F.avg((F.col("a") <= F.col("b")).cast("double"))).alias("citation_accuracy"))


def turn_pairs(t):
    """Each turn next to the turn before it, as (candidate, reference); keyed by (conv_id, turn)."""
    before = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return t.conversations.select("conv_id", "turn", F.col("text").alias("candidate")).join(before, ["conv_id", "turn"])


@query("met_26")
def met_26(t):
    pairs = turn_pairs(t)
    b = m.bleu(pairs, ["conv_id", "turn"], "candidate", "reference").withColumn("k", F.lit(1))
    r = pairs.agg(F.count("*").alias("n"), rnd(F.avg(m.rouge_l("candidate", "reference"))).alias("rouge_l")).withColumn("k", F.lit(1))
    return b.join(r, "k").drop("k")


@query("met_27", """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.95), 5) AS p95, round(quantile_cont(value, 0.99), 5) AS p99,
  round(avg((value > 200)::INT), 4) AS error_rate, round(avg(value * 0.0001 + 0.002), 6) AS cost_per_request FROM events GROUP BY 1""")
def met_27(t):
    return m.latency(t.events, "event_type", "value", F.col("value") > 200, F.col("value") * 0.0001 + 0.002)


@query("met_28", """WITH n AS (SELECT count(*) AS n FROM ratings), o AS (SELECT sum(pow(a - b, 2)) AS s FROM ratings), e AS (SELECT sum(pow(x.a - y.b, 2) * x.n * y.n) AS s FROM (SELECT a, count(*) AS n FROM ratings GROUP BY 1) x, (SELECT b, count(*) AS n FROM ratings GROUP BY 1) y)
  SELECT n.n AS n, round(1 - o.s / (e.s / n.n), 4) AS kappa FROM n, o, e""", "ratings")
def met_28(t):
    return m.quadratic_kappa(t.ratings, "a", "b")


@query("met_29", "WITH b AS (" + " UNION ALL ".join(f"SELECT sum(w * hit) / sum(w) AS m FROM (SELECT (y = pred)::INT AS hit, {_poisson_sql(r).replace('event_id', 'id')} AS w FROM preds)" for r in range(20))
       + ") SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS n_reps FROM b", "preds")
def met_29(t):
    reps = splits.bootstrap_means(t.preds.withColumn("hit", (F.col("y") == F.col("pred")).cast("double")), "id", "hit", 20)
    return reps.agg(rnd(F.percentile("mean", 0.025), 6).alias("low"), rnd(F.percentile("mean", 0.975), 6).alias("high"), F.count("*").alias("n_reps"))


@query("met_30", """WITH r AS (SELECT *, ntile(10) OVER (ORDER BY before DESC, user_id) AS tile FROM (SELECT * REPLACE (round(before, 2) AS before) FROM ab)), g AS (SELECT tile, count(*) FILTER (arm = 1) AS nt, count(*) FILTER (arm = 0) AS nc, coalesce(sum(converted) FILTER (arm = 1), 0) AS yt, coalesce(sum(converted) FILTER (arm = 0), 0) AS yc FROM r GROUP BY 1),
  c AS (SELECT tile, sum(nt) OVER w AS nt, sum(nc) OVER w AS nc, sum(yt) OVER w AS yt, sum(yc) OVER w AS yc FROM g WINDOW w AS (ORDER BY tile))
  SELECT CAST(tile AS INTEGER) AS tile, round(yt - coalesce(yc * nt / nullif(nc, 0), 0), 4) AS qini, round(coalesce(yt / nullif(nt, 0), 0) - coalesce(yc / nullif(nc, 0), 0), 4) AS uplift FROM c""", "ab")
def met_30(t):
    return m.qini(t.ab.withColumn("before", F.round("before", 2)), "before", "user_id", "arm", "converted")


@query("met_31", """WITH d AS (SELECT brand, day, 1000 + sum(qty) OVER (PARTITION BY brand ORDER BY day) % 500 AS v FROM demand), r AS (SELECT *, v / lag(v) OVER w - 1 AS r, v / max(v) OVER (PARTITION BY brand ORDER BY day) - 1 AS dd FROM d WINDOW w AS (PARTITION BY brand ORDER BY day)),
  q AS (SELECT brand, quantile_cont(r, 0.05) AS v5 FROM r GROUP BY 1)
  SELECT r.brand, round(avg(r) / stddev_samp(r) * sqrt(252), 4) AS sharpe, round(avg(r) / sqrt(avg(CASE WHEN r < 0 THEN r * r WHEN r IS NOT NULL THEN 0 END)) * sqrt(252), 4) AS sortino, round(min(dd), 5) AS max_drawdown,
  round(any_value(v5), 5) AS var_95, round(avg(r) FILTER (r <= v5), 5) AS cvar_95, round(avg((r > 0)::INT), 5) AS win_rate FROM r JOIN q ON q.brand = r.brand GROUP BY 1""", "demand")
def met_31(t):
    w = W.partitionBy("brand").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return m.portfolio(t.demand.select("brand", "day", (F.sum("qty").over(w) % 500 + 1000).alias("v")), "brand", "day", "v")
