"""Retail and logistics queries."""

from pyspark.sql import functions as F

from sparkloom.functions.exprs import rnd
from sparkloom.operators import retail as r
from sparkloom.plans.catalog import query

LP = "lineitem JOIN part ON l_partkey = p_partkey"


def lines(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))


@query("dom_11", f"""WITH b AS (SELECT DISTINCT l_orderkey, p_brand FROM {LP}), n AS (SELECT count(DISTINCT l_orderkey) AS n FROM b), c AS (SELECT p_brand, count(*) AS k FROM b GROUP BY 1)
  SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS n_both, round(count(*) / any_value(n), 6) AS support, round(count(*) / any_value(ca.k), 6) AS confidence, round(count(*) * any_value(n)::DOUBLE / (any_value(ca.k) * any_value(cb.k)), 6) AS lift
  FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand JOIN c ca ON ca.p_brand = x.p_brand JOIN c cb ON cb.p_brand = y.p_brand, n GROUP BY 1, 2""")
def dom_11(t):
    return r.basket_pairs(lines(t), "l_orderkey", "p_brand", 0.01)


@query("dom_11_rules")
def dom_11_rules(t):
    sets, rules = r.frequent_sets(lines(t), "l_orderkey", "p_type", 0.05, 0.1)
    return sets.select(F.array_join(F.array_sort("items"), ",").alias("items"), "freq")


SALES = """SELECT period, count(*) AS n_orders, round(avg(net), 4) AS aov, round(avg(n), 4) AS basket_size, round(sum(back) / sum(n), 4) AS return_rate, round(sum(net) / sum(gross), 4) AS margin, round(sum(net), 4) AS net
  FROM (SELECT year(l_shipdate) AS period, l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS net, sum(l_extendedprice) AS gross, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS back FROM lineitem GROUP BY 1, 2) GROUP BY 1"""


@query("dom_12", f"""WITH s AS ({SALES}) SELECT CAST(a.period AS INTEGER) AS period, a.n_orders, a.aov, a.basket_size, a.return_rate, a.margin, a.net, round(a.net / b.net - 1, 4) AS growth FROM s a LEFT JOIN s b ON b.period = a.period - 1""")
def dom_12(t):
    s = r.sales_figures(t.lineitem, F.year("l_shipdate"))
    before = s.select((F.col("period") + 1).alias("period"), F.col("net").alias("_b"))
    return s.join(before, "period", "left").withColumn("growth", rnd(F.try_divide(F.col("net"), F.col("_b")) - 1)).drop("_b")


TYPES = "(SELECT CAST(l_shipdate AS DATE) AS day, p_type, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


@query("dom_13", f"""WITH d AS (SELECT DISTINCT day FROM {TYPES}), k AS (SELECT DISTINCT p_type FROM part), g AS (SELECT d.day, k.p_type, coalesce(q, 0) AS q FROM d CROSS JOIN k LEFT JOIN {TYPES} s ON s.day = d.day AND s.p_type = k.p_type)
  SELECT a.p_type AS a, b.p_type AS b, round(corr(a.q, b.q), 4) AS r, NULL::DOUBLE AS lift FROM g a JOIN g b ON a.day = b.day AND a.p_type < b.p_type GROUP BY 1, 2
  UNION ALL SELECT p_brand, 'promo', round(avg(l_quantity) FILTER (l_discount >= 0.08), 4), round(avg(l_quantity) FILTER (l_discount >= 0.08) / avg(l_quantity) FILTER (l_discount < 0.08) - 1, 6) FROM {LP} GROUP BY 1""")
def dom_13(t):
    """Correlations of product types, then promotion mean and lift per brand."""
    daily = lines(t).groupBy(F.to_date("l_shipdate").alias("day"), "p_type").agg(F.sum("l_quantity").alias("q"))
    kinds = sorted(x[0] for x in t.part.select("p_type").distinct().collect())
    a = r.cannibalisation(daily, "day", "p_type", "q", kinds).withColumn("lift", F.lit(None).cast("double"))
    b = r.promotion_lift(lines(t), "p_brand", F.col("l_discount") >= 0.08, "l_quantity")
    return a.unionByName(b.select(F.col("p_brand").alias("a"), F.lit("promo").alias("b"), F.col("promo").alias("r"), "lift"))


@query("dom_14", "SELECT brand, count(*) AS n_days, count(*) FILTER (qty = 0) AS stockout_days, round(avg(qty), 4) AS observed_mean, round(avg(qty) FILTER (qty > 0), 4) AS uncensored_mean FROM demand GROUP BY 1", "demand")
def dom_14(t):
    return r.censored_demand(t.demand, "brand", "qty")


@query("dom_15", """WITH f AS (SELECT brand, day, qty, lag(qty, 7) OVER (PARTITION BY brand ORDER BY day) AS f FROM demand), b AS (SELECT day, sum(f) AS bottom_up, sum(qty) AS actual FROM f GROUP BY 1)
  SELECT strftime(b.day, '%Y-%m-%d') AS day, round(b.bottom_up, 2) AS bottom_up, round(p.actual, 2) AS top_level, abs(b.bottom_up - p.actual) < 1e-6 AS coherent FROM b JOIN b p ON p.day = b.day - 7 WHERE b.bottom_up IS NOT NULL""", "demand")
def dom_15(t):
    out = r.reconcile(t.demand, "brand", "day", "qty")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), rnd(F.col("bottom_up"), 2).alias("bottom_up"), rnd(F.col("top_level"), 2).alias("top_level"), "coherent")


PATTERN = """SELECT brand, round(count(*) / count(*) FILTER (qty > 0), 4) AS interval, round(pow(stddev_samp(qty) FILTER (qty > 0) / avg(qty) FILTER (qty > 0), 2), 4) AS cv2, round(stddev_samp(qty) / avg(qty), 4) AS cv,
  round(1 - count(*) FILTER (qty > 0) / count(*), 4) AS zero_share, CASE WHEN count(*) / count(*) FILTER (qty > 0) < 1.32 THEN CASE WHEN pow(stddev_samp(qty) FILTER (qty > 0) / avg(qty) FILTER (qty > 0), 2) < 0.49 THEN 'smooth' ELSE 'erratic' END
  WHEN pow(stddev_samp(qty) FILTER (qty > 0) / avg(qty) FILTER (qty > 0), 2) < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS pattern FROM demand GROUP BY 1"""


@query("dom_16", PATTERN, "demand")
def dom_16(t):
    return r.demand_pattern(t.demand, "brand", "qty")


@query("dom_17", "SELECT brand, round(1.645 * stddev_samp(qty) * sqrt(7), 4) AS safety_stock, round(avg(qty) * 7 + 1.645 * stddev_samp(qty) * sqrt(7), 4) AS reorder_point, round(sqrt(2 * avg(qty) * 365 * 50 / 2), 4) AS eoq FROM demand GROUP BY 1", "demand")
def dom_17(t):
    return r.stock_policy(t.demand, "brand", "qty", 7, 1.645, 50.0, 2.0)


@query("dom_18", f"""WITH v AS (SELECT l_partkey AS part, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1), c AS (SELECT part, sum(revenue) OVER (ORDER BY revenue DESC, part DESC) / (SELECT sum(revenue) FROM v) AS s FROM v),
  m AS (SELECT part, stddev_samp(q) / avg(q) AS cv FROM (SELECT l_partkey AS part, date_trunc('month', l_shipdate) AS mo, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1)
  SELECT part, round(s, 6) AS share, CASE WHEN s <= 0.8 THEN 'A' WHEN s <= 0.95 THEN 'B' ELSE 'C' END AS abc, round(cv, 4) AS cv, CASE WHEN cv <= 0.5 THEN 'X' WHEN cv <= 1.0 THEN 'Y' ELSE 'Z' END AS xyz FROM c JOIN m USING (part)""")
def dom_18(t):
    v = t.lineitem.groupBy(F.col("l_partkey").alias("part")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    m = t.lineitem.groupBy(F.col("l_partkey").alias("part"), F.date_trunc("month", "l_shipdate").alias("mo")).agg(F.sum("l_quantity").alias("q"))
    return r.abc_classes(v, "part", "revenue").join(r.xyz_classes(m, "part", "q"), "part").select("part", rnd(F.col("share"), 6).alias("share"), "abc", "cv", "xyz")


@query("dom_19", """WITH l AS (SELECT l_orderkey, l_quantity, l_linestatus, date_diff('day', o_orderdate, l_shipdate) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  o AS (SELECT l_orderkey, bool_and(l_linestatus = 'F') AS f, bool_and(days <= 0) AS t FROM l GROUP BY 1)
  SELECT round(sum(l_quantity) FILTER (l_linestatus = 'F') / sum(l_quantity), 4) AS fill_rate, round(avg((days <= 0)::INT), 4) AS on_time, round(avg((days <= 0 AND l_linestatus = 'F')::INT), 4) AS otif, round(avg(abs(days)), 4) AS cycle_days,
  (SELECT round(avg((f AND t)::INT), 4) FROM o) AS perfect_order, round(sum(l_quantity) / (SELECT sum(p_size) FROM part), 4) AS turnover, round(365 * (SELECT sum(p_size) FROM part) / sum(l_quantity), 4) AS days_of_supply FROM l""")
def dom_19(t):
    from sparkloom.operators.logistics import service_levels

    l = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_quantity", (F.col("l_linestatus") == "F").alias("filled"), F.datediff("l_shipdate", "o_orderdate").alias("days"))
    return service_levels(l, "l_orderkey", "l_quantity", t.part.agg(F.sum("p_size")).first()[0])


@query("dom_20", """WITH m AS (SELECT l_suppkey AS supplier, date_trunc('month', l_shipdate) AS month, avg(date_diff('day', o_orderdate, l_shipdate)) AS delay, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
  SELECT supplier, strftime(month, '%Y-%m') AS month, n, round(avg(delay) OVER w, 7) AS rolling_delay, round(var_samp(delay) OVER w, 6) AS rolling_variance FROM m WINDOW w AS (PARTITION BY supplier ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def dom_20(t):
    from sparkloom.operators.logistics import rolling_service

    l = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    m = l.groupBy(F.col("l_suppkey").alias("supplier"), F.date_trunc("month", "l_shipdate").alias("month")).agg(F.avg(F.datediff("l_shipdate", "o_orderdate")).alias("delay"), F.count("*").alias("n"))
    out = rolling_service(m, "supplier", "month", "delay", 3)
    return out.select("supplier", F.date_format("month", "yyyy-MM").alias("month"), "n", rnd(F.col("rolling_mean"), 7).alias("rolling_delay"), rnd(F.col("rolling_variance"), 6).alias("rolling_variance"))


@query("dom_21", "SELECT brand, round(quantile_cont(qty, 0.8), 4) AS order_quantity FROM demand GROUP BY 1", "demand")
def dom_21(t):
    return r.newsvendor(t.demand, "brand", "qty", 0.8).select("brand", rnd(F.col("order_quantity")).alias("order_quantity"))


