"""Single-column transform queries: fitted on one table, applied to the whole of it."""

from pyspark.sql import functions as F

from sparkloom.functions.exprs import rnd
from sparkloom.operators import profile as p, transforms as f
from sparkloom.plans.catalog import query
from sparkloom.plans.eda import KEEP
from sparkloom.plans.prf import numeric_sql
from sparkloom.plans.views import H


def ev(t):
    return t.events_null.select("event_id", "event_type", "value", "user_id")


def run(t, name, column, digits=4, **kw):
    d = ev(t)
    out = f.fit_apply(d, d, name, column, **kw)
    return out.select("event_id", *[rnd(F.col(c), digits).alias(c) if out.schema[c].dataType.simpleString() == "double" else c
                                    for c in out.columns if c not in ("event_id", "user_id")])


BOTH = "SELECT event_id, event_type, {v} FROM events_null"


def keep(expr, frm="events_null"):
    """value replaced, event_type kept."""
    return f"SELECT event_id, event_type, round({expr}, 4) AS value FROM {frm}"


@query("ftr_01", "SELECT event_id, event_type FROM events_null", "events_null")
def ftr_01(t):
    return run(t, "drop", "value")


@query("ftr_02", keep("coalesce(value, (SELECT median(value) FROM events_null))"), "events_null")
def ftr_02(t):
    return run(t, "median_imputation", "value")


@query("ftr_03", """SELECT event_id, coalesce(event_type, (SELECT event_type FROM events_null WHERE event_type IS NOT NULL GROUP BY 1
  ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type, round(value, 4) AS value FROM events_null""", "events_null")
def ftr_03(t):
    return run(t, "mode_imputation", "event_type")


@query("ftr_04", keep("CASE WHEN (SELECT min(value) FROM events_null) > 0 THEN ln(1 + value) ELSE value END"), "events_null")
def ftr_04(t):
    return run(t, "log_transform", "value")


@query("ftr_05")
def ftr_05(t):
    return run(t, "yeo_johnson_transform", "value")


@query("ftr_06", keep("(value - m) / s", "events_null, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events_null)"), "events_null")
def ftr_06(t):
    return run(t, "standard_scaling", "value")


Q = "events_null, (SELECT quantile_cont(value, 0.25) AS a, median(value) AS m, quantile_cont(value, 0.75) AS b FROM events_null)"


@query("ftr_07", keep("CASE WHEN value < a - 1.5 * (b - a) THEN a - 1.5 * (b - a) WHEN value > b + 1.5 * (b - a) THEN b + 1.5 * (b - a) ELSE value END", Q), "events_null")
def ftr_07(t):
    return run(t, "clip_outliers", "value")


@query("ftr_08", "SELECT event_id, round(value, 4) AS value, " + ", ".join(
    f"CASE WHEN event_type = '{c}' THEN 1 ELSE 0 END AS event_type_{c}" for c in ("error", "purchase", "signup", "view")) + " FROM events_null", "events_null")
def ftr_08(t):
    return run(t, "one_hot_encoding", "event_type")


CODES = "(SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events_null WHERE event_type IS NOT NULL))"


@query("ftr_09", f"SELECT e.event_id, c.code AS event_type, round(e.value, 4) AS value FROM events_null e LEFT JOIN {CODES} c USING (event_type)", "events_null")
def ftr_09(t):
    return run(t, "label_encoding", "event_type")


@query("ftr_10", """SELECT e.event_id, round(coalesce(m.m, (SELECT avg(value) FROM events_null)), 4) AS event_type, round(e.value, 4) AS value FROM events_null e
  LEFT JOIN (SELECT event_type, avg(value) AS m FROM events_null WHERE value IS NOT NULL GROUP BY 1) m ON e.event_type IS NOT DISTINCT FROM m.event_type""", "events_null")
def ftr_10(t):
    return run(t, "target_encoding", "event_type", target="value")


@query("ftr_11", """SELECT e.event_id, round((m.s + 100 * p) / (m.n + 100), 4) AS event_type, round(e.value, 4) AS value FROM (SELECT *, (SELECT avg(value) FROM events_null) AS p FROM events_null) e
  LEFT JOIN (SELECT event_type, sum(value) AS s, count(*) AS n FROM events_null WHERE value IS NOT NULL GROUP BY 1) m ON e.event_type IS NOT DISTINCT FROM m.event_type""", "events_null")
def ftr_11(t):
    return run(t, "target_encoding", "event_type", target="value", smoothing=100.0)


@query("ftr_12", f"""WITH k AS (SELECT *, {H('event_id', 5)} AS fold FROM events_null)
  SELECT k.event_id, round((a.s - b.s) / (a.n - b.n), 4) AS event_type_oof FROM k
  JOIN (SELECT event_type, sum(value) AS s, count(value) AS n FROM k GROUP BY 1) a ON a.event_type IS NOT DISTINCT FROM k.event_type
  JOIN (SELECT event_type, fold, sum(value) AS s, count(value) AS n FROM k GROUP BY 1, 2) b ON b.event_type IS NOT DISTINCT FROM k.event_type AND b.fold = k.fold""", "events_null")
def ftr_12(t):
    out = f.out_of_fold_encoding(ev(t), "event_type", "value", "event_id")
    return out.select("event_id", rnd(F.col("event_type_oof")).alias("event_type_oof"))


@query("ftr_13", """SELECT o_orderkey, CAST(year(d) AS INTEGER) AS placed_year, CAST(month(d) AS INTEGER) AS placed_month, CAST(isodow(d) - 1 AS INTEGER) AS placed_dayofweek
  FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS d FROM orders)""")
def ftr_13(t):
    d = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("placed"))
    return f.fit_apply(d, d, "extract_dates", "placed").drop("placed")


@query("ftr_14", "SELECT event_id, event_type, round(value, 4) AS value, CAST(value IS NULL AS INTEGER) AS value_is_missing FROM events_null", "events_null")
def ftr_14(t):
    return run(t, "indicator_feature", "value")


@query("ftr_15", """SELECT e.event_id, round(f.f, 4) AS event_type, round(e.value, 4) AS value FROM events_null e LEFT JOIN
  (SELECT event_type, count(*) / sum(count(*)) OVER () AS f FROM events_null WHERE event_type IS NOT NULL GROUP BY 1) f USING (event_type)""", "events_null")
def ftr_15(t):
    return run(t, "frequency_encoding", "event_type")


@query("ftr_16", f"""SELECT e.event_id, e.event_type, round(e.value, 4) AS value, CAST(c.code & 1 AS INTEGER) AS event_type_bit0, CAST((c.code >> 1) & 1 AS INTEGER) AS event_type_bit1,
  CAST((c.code >> 2) & 1 AS INTEGER) AS event_type_bit2 FROM events_null e LEFT JOIN {CODES} c USING (event_type)""", "events_null")
def ftr_16(t):
    return run(t, "binary_encoding", "event_type")


@query("ftr_17", keep("(value - m) / (b - a)", Q), "events_null")
def ftr_17(t):
    return run(t, "robust_scaling", "value")


@query("ftr_18", keep("value / (SELECT max(abs(value)) FROM events_null)"), "events_null")
def ftr_18(t):
    return run(t, "maxabs_scaling", "value")


@query("ftr_19", "SELECT event_id, event_type, round(value, 4) AS value, round(value * value, 4) AS value_squared FROM events_null", "events_null")
def ftr_19(t):
    return run(t, "polynomial_features", "value")


@query("ftr_20", "SELECT event_id, event_type, round(value, 4) AS value, round(1 / (abs(value) + 1), 4) AS value_reciprocal FROM events_null", "events_null")
def ftr_20(t):
    return run(t, "reciprocal", "value")


@query("ftr_21", r"SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '([\d.]+)', 1), '') AS DOUBLE) AS props FROM events")
def ftr_21(t):
    d = t.events.select("event_id", "props")
    return f.fit_apply(d, d, "extract_numeric", "props")


@query("ftr_22", """SELECT event_id, event_type, CAST(CASE WHEN value <= lo - 0.001 * (hi - lo) THEN NULL WHEN value <= lo + (hi - lo) / 4 THEN 0 WHEN value <= lo + (hi - lo) / 4 * 2 THEN 1
  WHEN value <= lo + (hi - lo) / 4 * 3 THEN 2 WHEN value <= hi THEN 3 END AS INTEGER) AS value FROM events_null, (SELECT min(value) AS lo, max(value) AS hi FROM events_null)""", "events_null")
def ftr_22(t):
    return run(t, "ordinal_groups", "value")


@query("ftr_23", "SELECT doc_id, CAST(len(string_split(text, ',')) AS INTEGER) AS text_count FROM documents")
def ftr_23(t):
    d = t.documents.select("doc_id", "text")
    return f.fit_apply(d, d, "count_list_items", "text").drop("text")


@query("ftr_24", keep("(value - lo) / (hi - lo)", "events_null, (SELECT min(value) AS lo, max(value) AS hi FROM events_null)"), "events_null")
def ftr_24(t):
    return run(t, "minmax_scaling", "value")


@query("ftr_25", f"SELECT event_id, {H('user_id', 64)} AS user_id FROM events")
def ftr_25(t):
    d = t.events.select("event_id", "user_id")
    return f.fit_apply(d, d, "hashing_encoding", "user_id")


@query("ftr_26", """SELECT c_mktsegment AS category, CAST(good AS BIGINT) AS good, CAST(bad AS BIGINT) AS bad, round(ln((good / sum(good) OVER ()) / (bad / sum(bad) OVER ())), 4) AS woe,
  round((good / sum(good) OVER () - bad / sum(bad) OVER ()) * ln((good / sum(good) OVER ()) / (bad / sum(bad) OVER ())), 6) AS iv_part
  FROM (SELECT c_mktsegment, count(*) FILTER (y = 0) AS good, count(*) FILTER (y = 1) AS bad FROM orders_target GROUP BY 1)""", "orders_target")
def ftr_26(t):
    w = f.woe_table(t.orders_target, "c_mktsegment", "y")
    return w.select(F.col("_v").alias("category"), "good", "bad", rnd(F.col("_woe")).alias("woe"), rnd(F.col("iv_part"), 6).alias("iv_part"))


@query("ftr_27", """SELECT event_id, CAST((value > a)::INT + (value > m)::INT + (value > b)::INT AS INTEGER) AS bin, CASE WHEN value IS NULL THEN NULL WHEN value < 18.5 THEN 'underweight'
  WHEN value < 25 THEN 'normal' WHEN value < 30 THEN 'overweight' ELSE 'obese' END AS class FROM """ + Q, "events_null")
def ftr_27(t):
    d = ev(t)
    binned = f.fit_apply(d, d.withColumn("class", f.domain_class(F.col("value"), "bmi")), "quantile_bins", "value")
    return binned.select("event_id", F.col("value").alias("bin"), "class")


@query("ftr_28", """WITH a AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'error' THEN 1 WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'signup' THEN 3
    WHEN event_type = 'view' THEN 4 END AS code, coalesce(value, (SELECT median(value) FROM events_null)) AS v FROM events_null)
  SELECT event_id, CAST(code AS BIGINT) AS event_type, round((v - (SELECT avg(v) FROM a)) / (SELECT stddev_samp(v) FROM a), 4) AS value, 5 AS n_applied, 1 AS n_skipped, 1 AS n_error
  FROM (SELECT * FROM a)""".replace("5 AS n_applied", "3 AS n_applied"), "events_null")
def ftr_28(t):
    plan = {"value": ["median_imputation", "indicator_feature", "standard_scaling"], "event_type": ["label_encoding", "no_such_step"]}
    d = ev(t)
    fitted = f.fit_plan(d, plan, on_error="skip")
    counts = {r["status"]: r["count"] for r in fitted.log.groupBy("status").count().collect()}
    out = fitted.transform(d).select("event_id", "event_type", rnd(F.col("value")).alias("value"))
    return out.withColumns({"n_applied": F.lit(counts.get("applied", 0)), "n_skipped": F.lit(counts.get("skipped", 0)), "n_error": F.lit(counts.get("error", 0))})


@query("ftr_29", """SELECT "column", concat_ws(',', CASE WHEN null_pct >= 30 THEN 'consider_dropping' WHEN null_pct > 0 THEN 'median_imputation' END,
  CASE WHEN abs(skewness) > 1 THEN CASE WHEN min > 0 THEN 'log_transform' ELSE 'yeo_johnson_transform' END END, CASE WHEN outlier_pct > 5 THEN 'clip_outliers' END, 'standard_scaling') AS plan FROM ("""
       + numeric_sql(["value", "user_id"], "events_null", "count(x)", KEEP) + """) UNION ALL SELECT 'event_type', concat_ws(',', CASE WHEN count(*) > count(event_type) THEN 'mode_imputation' END,
  CASE WHEN count(DISTINCT event_type) <= 2 THEN 'label_encoding' WHEN count(DISTINCT event_type) <= 10 THEN 'one_hot_encoding' WHEN count(DISTINCT event_type) <= 50 THEN 'label_encoding'
  ELSE 'target_encoding' END) FROM events_null""", "events_null")
def ftr_29(t):
    return f.plan_of(p.numeric_summary(t.events_null, ["value", "user_id"], "valid"), p.column_summary(t.events_null, ["event_type"]))


@query("ftr_30")
def ftr_30(t):
    """Tree and linear pipelines, fitted on the training part, stored, loaded and applied."""
    from sparkloom.functions.exprs import hash_bucket
    from sparkloom.operators.models import linear_pipeline, stored, tree_pipeline

    d = t.orders_target.select("o_orderkey", "c_mktsegment", "o_orderpriority", "o_totalprice", "c_acctbal", "y")
    train = d.where(hash_bucket("o_orderkey", 5) != 0)
    cats, nums = ["c_mktsegment", "o_orderpriority"], ["o_totalprice", "c_acctbal"]
    tree = stored(tree_pipeline(cats, nums).fit(train)).transform(d)
    linear = stored(linear_pipeline(cats, nums).fit(train)).transform(d)
    from pyspark.ml.functions import vector_to_array

    a = tree.select("o_orderkey", F.size(vector_to_array("features")).alias("tree_width"))
    b = linear.select("o_orderkey", F.size(vector_to_array("features")).alias("linear_width"))
    return a.join(b, "o_orderkey").groupBy("tree_width", "linear_width").agg(F.count("*").alias("n"))
