"""Rule queries."""

from pyspark.sql import functions as F

from sparkloom.functions.exprs import hash_bucket
from sparkloom.operators import finance, marketing, profile as p, retail, rules as r, splits
from sparkloom.plans.catalog import query
from sparkloom.plans.dom_retail import PATTERN
from sparkloom.plans.views import H


def plan(t, *rows):
    return t.spark.createDataFrame(rows, "column string, plan string")


@query("rul_01", "SELECT 'value' AS subject, 'warning' AS severity, 'use_median' AS advice, true AS auto_correctable FROM (SELECT skewness(value) AS s FROM events_null) WHERE abs(s) > 1", "events_null")
def rul_01(t):
    s = p.numeric_summary(t.events_null, ["value", "user_id"])
    return r.mean_on_skewed(plan(t, ("value", "mean_imputation,standard_scaling"), ("user_id", "mean_imputation")), s)


@query("rul_02", """SELECT 'value' AS subject, 'warning' AS severity, 'use_robust_scaling' AS advice, true AS auto_correctable FROM (SELECT 100.0 * count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) / count(*) AS o FROM events_null,
  (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events_null)) WHERE o > 3""", "events_null")
def rul_02(t):
    s = p.numeric_summary(t.events_null, ["value", "user_id"])
    return r.scaling_with_outliers(plan(t, ("value", "standard_scaling"), ("user_id", "standard_scaling")), s, 3.0)


@query("rul_03", """SELECT CAST(CAST(band AS BIGINT) AS VARCHAR) AS subject, 'critical' AS severity, 'score_not_monotonic' AS advice, false AS auto_correctable FROM (SELECT floor(weight / 50000) AS band, avg(y) AS r, lag(avg(y)) OVER (ORDER BY floor(weight / 50000)) AS p FROM preds GROUP BY 1) WHERE r < p""", "preds")
def rul_03(t):
    return r.falling_rates(finance.band_rates(t.preds, F.floor(F.col("weight") / 50000), "y"))


@query("rul_04", """WITH g AS (SELECT o_custkey, count(*) AS frequency, round(sum(o_totalprice), 2) AS monetary FROM orders GROUP BY 1)
  SELECT 'event_type' AS rule, round(max(s) - min(s), 4) AS value, max(s) - min(s) < 0.05 AS broken FROM (SELECT avg((value > 50)::INT) AS s FROM events GROUP BY event_type)
  UNION ALL SELECT 'frequency~monetary', round(abs(corr(frequency, monetary)), 4), round(abs(corr(frequency, monetary)), 4) > 0.9 FROM g""")
def rul_04(t):
    last = t.orders.agg(F.max("o_orderdate")).first()[0]
    rfm = marketing.rfm(t.orders, "o_custkey", "o_orderdate", "o_totalprice", F.lit(last))
    return r.flat_retention(t.events, "event_type", F.avg((F.col("value") > 50).cast("double"))).unionByName(r.entangled(rfm, "frequency", "monetary"))


@query("rul_05", "SELECT brand AS subject, 'warning' AS severity, 'intermittent_method' AS advice, false AS auto_correctable FROM (" + PATTERN + ") WHERE zero_share > 0.3", "demand")
def rul_05(t):
    return r.intermittent(retail.demand_pattern(t.demand, "brand", "qty"), "brand")


@query("rul_06", "SELECT CAST(days AS INTEGER) AS days, method, needed, days < needed AS broken FROM (SELECT date_diff('day', min(ts), max(ts)) AS days FROM events), (VALUES ('seasonal', 730), ('clv', 180)) v(method, needed)")
def rul_06(t):
    return r.short_history(t.events, "ts", {"seasonal": 730, "clv": 180})


@query("rul_07", f"SELECT a >= b AS broken, strftime(a, '%Y-%m-%d') AS train_end, strftime(b, '%Y-%m-%d') AS test_start FROM (SELECT max(ts) FILTER ({H('event_id', 1000)} >= 200) AS a, min(ts) FILTER ({H('event_id', 1000)} < 200) AS b FROM events)")
def rul_07(t):
    return r.mixed_periods(splits.hash_split(t.events, "event_id"), "part", "ts")


@query("rul_08", """SELECT c AS subject, 'critical' AS severity, 'drop_identifier' AS advice, true AS auto_correctable FROM (SELECT 'o_orderkey' AS c, count(DISTINCT o_orderkey) AS d, count(*) AS n FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), count(*) FROM orders) WHERE d / n > 0.95 AND n > 100""")
def rul_08(t):
    return r.identifiers_used(p.idlike_columns(t.orders), ["o_orderkey", "o_custkey"])


@query("rul_09", f"""SELECT user_id AS dataset, count(*) AS n, count(*) FILTER ({H('event_id', 4)} = 0) AS n_actions, count(*) FILTER (event_type = 'error' AND {H('event_id', 4)} <> 0) AS n_blocking,
  CASE WHEN count(*) FILTER (event_type = 'error' AND {H('event_id', 4)} <> 0) > 0 THEN 'block' WHEN count(*) FILTER ({H('event_id', 4)} = 0) > 0 THEN 'correct' ELSE 'advise' END AS verdict FROM events WHERE value > 120 GROUP BY 1""")
def rul_09(t):
    f = t.events.where("value > 120").select(F.col("user_id").alias("dataset"), F.when(F.col("event_type") == "error", "critical").otherwise("warning").alias("severity"), (hash_bucket("event_id", 4) == 0).alias("auto_correctable"))
    return r.verdicts(f, "dataset")
