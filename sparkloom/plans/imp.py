"""Missing-value queries."""

from pyspark.sql import functions as F

from sparkloom.functions.exprs import hash_bucket, rnd
from sparkloom.operators import impute as m, profile as p, transforms as f
from sparkloom.plans.catalog import query
from sparkloom.plans.prf import EN, union
from sparkloom.plans.views import H


@query("imp_01", """SELECT event_id, coalesce(event_type, (SELECT event_type FROM events_null WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type,
  round(coalesce(value, (SELECT avg(value) FROM events_null)), 4) AS value FROM events_null""", "events_null")
def imp_01(t):
    out = m.table_wide(t.events_null, t.events_null, {"event_type": "mode", "value": "mean"})
    return out.select("event_id", "event_type", rnd(F.col("value")).alias("value"))


def hour(df):
    return df.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


W = "OVER (PARTITION BY user_id ORDER BY hour {o} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("imp_02", f"SELECT user_id, strftime(hour, '%Y-%m-%d %H') AS hour, value, last_value(value IGNORE NULLS) {W.format(o='')} AS filled FROM hourly_gap", "hourly_gap")
def imp_02(t):
    return hour(m.fill_forward(t.hourly_gap, ["user_id"], "hour", "value", "filled"))


@query("imp_03", f"SELECT user_id, strftime(hour, '%Y-%m-%d %H') AS hour, value, last_value(value IGNORE NULLS) {W.format(o='DESC')} AS filled FROM hourly_gap", "hourly_gap")
def imp_03(t):
    return hour(m.fill_backward(t.hourly_gap, ["user_id"], "hour", "value", "filled"))


@query("imp_04", """SELECT user_id, strftime(hour, '%Y-%m-%d %H') AS hour, value, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hour ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS filled FROM hourly_gap""", "hourly_gap")
def imp_04(t):
    return hour(m.fill_forward_limited(t.hourly_gap, ["user_id"], "hour", "value", "filled", 3 * 3600))


@query("imp_05", f"""WITH s AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN hour END IGNORE NULLS) {W.format(o='')} AS t0, last_value(value IGNORE NULLS) {W.format(o='')} AS v0,
  last_value(CASE WHEN value IS NOT NULL THEN hour END IGNORE NULLS) {W.format(o='DESC')} AS t1, last_value(value IGNORE NULLS) {W.format(o='DESC')} AS v1 FROM hourly_gap)
  SELECT user_id, strftime(hour, '%Y-%m-%d %H') AS hour, round(coalesce(value, CASE WHEN date_diff('hour', t0, t1) <= 12 THEN v0 + (v1 - v0) * date_diff('hour', t0, hour) / date_diff('hour', t0, t1) END), 9) AS filled,
  coalesce(value IS NULL AND date_diff('hour', t0, t1) > 12, false) AS long_gap FROM s""", "hourly_gap")
def imp_05(t):
    out = m.interpolate(t.hourly_gap, ["user_id"], "hour", "value", "filled", 12 * 3600)
    return hour(out).select("user_id", "hour", rnd(F.col("filled"), 9).alias("filled"), "long_gap")


def gapped(t, share=50):
    return t.orders_target.select(
        F.col("o_orderkey").alias("id"), (F.col("c_acctbal") / 1000).alias("a"), (F.col("o_totalprice") / 100000).alias("b"),
        F.when(hash_bucket("o_orderkey", share) != 0, F.col("target")).alias("target"))


GAPPED = f"gapped AS (SELECT o_orderkey AS id, c_acctbal / 1000 AS a, o_totalprice / 100000 AS b, CASE WHEN {H('o_orderkey', 50)} <> 0 THEN target END AS target FROM orders_target)"


@query("imp_06", "WITH " + GAPPED + """, r AS (SELECT q.id, d.target AS v, row_number() OVER (PARTITION BY q.id ORDER BY sqrt(pow(d.a - q.a, 2) + pow(d.b - q.b, 2)), d.id) AS k
  FROM gapped q JOIN gapped d ON q.target IS NULL AND d.target IS NOT NULL)
  SELECT g.id, round(coalesce(g.target, f.v), 4) AS target FROM gapped g LEFT JOIN (SELECT id, avg(v) AS v FROM r WHERE k <= 5 GROUP BY id) f USING (id)""", "orders_target")
def imp_06(t):
    out = m.knn_impute(gapped(t), "id", "target", ["a", "b"], 5)
    return out.select("id", rnd(F.col("target")).alias("target"))


def check_fill(t, out):
    """How close the filled values are to the values that were taken away."""
    truth = t.orders_target.select(F.col("o_orderkey").alias("id"), F.col("target").alias("truth"))
    gone = out.join(truth, "id").where(hash_bucket("id", 50) == 0)
    return gone.agg(F.count("*").alias("n_filled"), F.count("target").alias("n_present"), (F.corr("target", "truth") > 0.5).alias("follows_truth"))


@query("imp_07")
def imp_07(t):
    return check_fill(t, m.iterative_impute(gapped(t), "id", ["a", "b", "target"], 10))


@query("imp_08")
def imp_08(t):
    return check_fill(t, m.iterative_impute(gapped(t), "id", ["a", "b", "target"], 2, forest=True))


@query("imp_09")
def imp_09(t):
    return check_fill(t, m.low_rank_impute(gapped(t), "id", ["a", "b", "target"]))


@query("imp_10", """SELECT event_id, round(coalesce(value, (SELECT median(value) FROM events_null)), 4) AS value, CAST(value IS NULL AS INTEGER) AS value_is_missing FROM events_null""", "events_null")
def imp_10(t):
    fitted = f.fit_plan(t.events_null, {"value": ["indicator_feature", "median_imputation"]})
    return fitted.transform(t.events_null).select("event_id", rnd(F.col("value")).alias("value"), "value_is_missing")


@query("imp_11", "SELECT \"column\", null_pct, CASE WHEN null_pct = 0 THEN 'none' WHEN \"column\" = 'ts' AND null_pct < 10 THEN 'forward_backward_fill' WHEN \"column\" = 'ts' THEN 'knn_or_indicator' "
       "WHEN null_pct > 50 THEN 'low_rank' WHEN \"column\" = 'event_type' THEN 'forest' WHEN null_pct < 30 THEN 'mean_or_median' ELSE 'knn_or_iterative' END AS strategy FROM ("
       + union("SELECT '{c}' AS \"column\", round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_pct FROM events_null", EN) + ")", "events_null")
def imp_11(t):
    s = p.column_summary(t.events_null).withColumn("temporal", F.col("column") == "ts").withColumn("mixed", F.col("column") == "event_type")
    return m.choose_strategy(s)
