"""Cross-column and time feature queries."""

from pyspark.sql import functions as F

from sparkloom.functions.exprs import days_between, hash_bucket, haversine_km, ratio, rnd
from sparkloom.operators import features as x, ordered as o, profile as p
from sparkloom.plans.catalog import query
from sparkloom.plans.prf import NUM, numeric_sql
from sparkloom.plans.views import H


def stamp(c="ts"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("fea_01", """SELECT o_orderkey, round(o_totalprice / nullif(c_acctbal, 0), 4) AS price_ratio, round(o_totalprice - c_acctbal, 4) AS gap, round(o_totalprice * c_acctbal, 4) AS product FROM orders_target""", "orders_target")
def fea_01(t):
    a, b = F.col("o_totalprice"), F.col("c_acctbal")
    return t.orders_target.select("o_orderkey", rnd(ratio(a, b)).alias("price_ratio"), rnd(a - b).alias("gap"), rnd(a * b).alias("product"))


@query("fea_02", "SELECT concat_ws('|', c_mktsegment, o_orderpriority) AS pair, count(*) AS n, round(avg(y), 4) AS rate FROM orders_target GROUP BY 1", "orders_target")
def fea_02(t):
    return t.orders_target.groupBy(F.concat_ws("|", "c_mktsegment", "o_orderpriority").alias("pair")).agg(F.count("*").alias("n"), rnd(F.avg("y")).alias("rate"))


@query("fea_03", """SELECT o_custkey, date_diff('day', max(o_orderdate), DATE '2002-01-01') AS recency, date_diff('day', min(o_orderdate), DATE '2002-01-01') AS tenure FROM orders GROUP BY 1""")
def fea_03(t):
    at = F.lit("2002-01-01").cast("date")
    return t.orders.groupBy("o_custkey").agg(days_between(at, F.max("o_orderdate")).alias("recency"), days_between(at, F.min("o_orderdate")).alias("tenure"))


GEO = f"SELECT event_id, user_id, ts, {H('event_id', 120)} - 60 AS lat, {H('event_id * 3', 300)} - 150 AS lon FROM events"


@query("fea_04", f"""WITH g AS ({GEO}), p AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT event_id, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(la)) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2)))), 3) AS km FROM p""")
def fea_04(t):
    g = t.events.select("event_id", "user_id", "ts", (hash_bucket("event_id", 120) - 60).alias("lat"), (hash_bucket(F.col("event_id") * 3, 300) - 150).alias("lon"))
    out = o.previous(g, ["user_id"], ["ts", "event_id"], {"la": "lat", "lo": "lon"})
    return out.select("event_id", rnd(haversine_km(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon")), 3).alias("km"))


@query("fea_05", "SELECT user_id, round(ln(1 + count(*)), 6) AS log_count FROM events GROUP BY 1")
def fea_05(t):
    return t.events.groupBy("user_id").agg(rnd(F.log1p(F.count("*").cast("double")), 6).alias("log_count"))


@query("fea_06", """SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(weekofyear(ts) AS INTEGER) AS week,
  CAST(dayofyear(ts) AS INTEGER) AS doy, CAST(isodow(ts) >= 6 AS INTEGER) AS weekend, CAST(hour(ts) < 8 OR hour(ts) >= 18 AS INTEGER) AS after_hours,
  CAST(CAST(ts AS DATE) = last_day(ts) AS INTEGER) AS month_end, CAST(least(abs(day(ts) - 15), day(last_day(ts)) - day(ts)) AS INTEGER) AS to_payday FROM events""")
def fea_06(t):
    return t.events.select("event_id", *[e.alias(n) for n, e in x.calendar(F.col("ts")).items()])


HOL = "SELECT DISTINCT CAST(ts AS DATE) AS h FROM events WHERE value > 280"


@query("fea_07", f"""WITH h AS ({HOL}), d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), n AS (SELECT day, min(h) AS nx FROM d LEFT JOIN h ON h >= day GROUP BY 1)
  SELECT strftime(day, '%Y-%m-%d') AS day, CAST(coalesce(nx = day, false) AS INTEGER) AS is_holiday, CAST(least(coalesce(date_diff('day', day, nx), 30), 30) AS INTEGER) AS days_to_holiday, count(*) AS n
  FROM events JOIN n ON CAST(ts AS DATE) = day GROUP BY 1, 2, 3""")
def fea_07(t):
    hol = t.events.where("value > 280").select(F.to_date("ts").alias("h"))
    out = x.holiday_features(t.events.withColumn("day", F.to_date("ts")), "day", hol, "h")
    return out.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "is_holiday", "days_to_holiday").agg(F.count("*").alias("n"))


@query("fea_08", """SELECT brand, strftime(day, '%Y-%m-%d') AS day, qty, lag(qty, 7) OVER w AS lag_7, lag(qty, 14) OVER w AS lag_14, lag(qty, 28) OVER w AS lag_28 FROM demand
  WINDOW w AS (PARTITION BY brand ORDER BY day)""", "demand")
def fea_08(t):
    return x.lags(t.demand, "brand", "day", "qty", [7, 14, 28]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("fea_09", """SELECT brand, strftime(day, '%Y-%m-%d') AS day, round(avg(qty) OVER w, 4) AS roll_mean, round(stddev_samp(qty) OVER w, 4) AS roll_std, min(qty) OVER w AS roll_min, max(qty) OVER w AS roll_max
  FROM demand WINDOW w AS (PARTITION BY brand ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""", "demand")
def fea_09(t):
    r = x.rolling(t.demand, "brand", "day", "qty", 7)
    return r.select("brand", F.date_format("day", "yyyy-MM-dd").alias("day"), rnd(F.col("roll_mean")).alias("roll_mean"), rnd(F.col("roll_std")).alias("roll_std"), "roll_min", "roll_max")


def trail_sql(h):
    return f"count(*) OVER w{h} AS n_{h}h, round(coalesce(sum(value) OVER w{h}, 0), 4) AS sum_{h}h, round(avg(value) OVER w{h}, 7) AS mean_{h}h"


@query("fea_10", "SELECT event_id, " + ", ".join(trail_sql(h) for h in (1, 4, 24, 168)) + " FROM (SELECT *, epoch_us(ts) AS us FROM events) WINDOW " + ", ".join(
    f"w{h} AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {h * 3_600_000_000} PRECEDING AND 1 PRECEDING)" for h in (1, 4, 24, 168)))
def fea_10(t):
    hs = [1, 4, 24, 168]
    out = x.trailing(t.events.select("event_id", "user_id", "ts", "value"), "user_id", "ts", F.col("value"), hs)
    return out.select("event_id", *[e for h in hs for e in (f"n_{h}h", rnd(F.col(f"sum_{h}h")).alias(f"sum_{h}h"), rnd(F.col(f"mean_{h}h"), 7).alias(f"mean_{h}h"))])


@query("fea_11", """WITH w AS (SELECT event_id, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT event_id, round(CASE WHEN s > 1e-6 THEN (value - m) / s END, 3) AS z, coalesce(abs(CASE WHEN s > 1e-6 THEN (value - m) / s END) > 3, false) AS flag FROM w""")
def fea_11(t):
    return x.deviation(t.events, "user_id", ["ts", "event_id"], "value").select("event_id", rnd(F.col("z"), 3).alias("z"), "flag")


@query("fea_12", """WITH w AS (SELECT event_id, ts, value, lag(value) OVER w AS pv, lag(ts) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT event_id, round(value - pv, 4) AS delta, round((value - pv) / ((epoch_us(ts) - epoch_us(pt)) / 1e6), 6) AS per_second FROM w""")
def fea_12(t):
    out = x.change_rate(t.events, "user_id", ["ts", "event_id"], "value", "ts")
    return out.select("event_id", rnd(F.col("delta")).alias("delta"), rnd(F.col("per_second"), 6).alias("per_second"))


@query("fea_13", """SELECT event_id, round(abs(value - s), 4) AS off FROM events JOIN (SELECT event_type, round(avg(value), 2) AS s FROM events GROUP BY 1) USING (event_type)""")
def fea_13(t):
    points = t.events.groupBy("event_type").agg(F.round(F.avg("value"), 2).alias("s"))
    return t.events.join(points, "event_type").select("event_id", rnd(F.abs(F.col("value") - F.col("s"))).alias("off"))


@query("fea_14", """WITH r AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g,
    max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events)
  SELECT event_id, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS since_reset, round((epoch_us(ts) - epoch_us(m)) / 1e6, 6) AS seconds_since FROM r""")
def fea_14(t):
    d = t.events.select("event_id", "user_id", "ts", "event_type")
    out = x.since_event(d, "user_id", ["ts", "event_id"], "ts", F.col("event_type") == "signup", F.col("event_type") == "error")
    return out.select("event_id", "since_reset", rnd(F.col("seconds_since"), 6).alias("seconds_since"))


@query("fea_15", "SELECT event_id, " + ", ".join(f"count(CASE WHEN event_type = 'error' THEN 1 END) OVER w{h} AS alarms_{h}h" for h in (1, 8, 24)) + " FROM (SELECT *, epoch_us(ts) AS us FROM events) WINDOW " + ", ".join(
    f"w{h} AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {h * 3_600_000_000} PRECEDING AND 1 PRECEDING)" for h in (1, 8, 24)))
def fea_15(t):
    hour = 3_600_000_000
    out = o.sliding(t.events.select("event_id", "user_id", "ts", "event_type"), ["user_id"], "ts", {f"{h}h": h * hour for h in (1, 8, 24)},
                    {"alarms": F.when(F.col("event_type") == "error", 1)})
    return out.select("event_id", *[F.round(F.col(f"alarms_{h}h")).cast("bigint").alias(f"alarms_{h}h") for h in (1, 8, 24)])


@query("fea_16", """SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 9) AS brand_mean, round(avg(p_retailprice) OVER (PARTITION BY p_type), 9) AS type_mean FROM part""")
def fea_16(t):
    levels = t.part.rollup("p_type", "p_brand").agg(F.sum("p_retailprice").alias("s"), F.count("*").alias("n"), F.grouping_id().alias("g"))
    types = levels.where("g = 1").select("p_type", (F.col("s") / F.col("n")).alias("type_mean"))
    brands = levels.where("g = 0").groupBy("p_brand").agg((F.sum("s") / F.sum("n")).alias("brand_mean"))
    return t.part.join(types, "p_type").join(brands, "p_brand").select("p_partkey", rnd(F.col("brand_mean"), 9).alias("brand_mean"), rnd(F.col("type_mean"), 9).alias("type_mean"))


@query("fea_17", """SELECT p_partkey, round(p_retailprice / avg(p_retailprice) OVER (PARTITION BY p_type), 4) AS to_mean, rank() OVER (PARTITION BY p_type ORDER BY p_retailprice) AS rank FROM part""")
def fea_17(t):
    out = x.group_relative(t.part, "p_type", "p_retailprice", "p_partkey")
    return out.select("p_partkey", rnd(F.col("to_mean")).alias("to_mean"), "rank")


@query("fea_18", "SELECT user_id, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, count(*) AS n FROM events GROUP BY 1")
def fea_18(t):
    return t.events.groupBy("user_id").agg(rnd(F.sum("value")).alias("total"), rnd(F.avg("value")).alias("mean"), rnd(F.stddev_samp("value")).alias("std"), F.count("*").alias("n"))


@query("fea_19", """WITH m AS (SELECT brand, date_trunc('month', day) AS month, sum(qty) AS qty FROM demand GROUP BY 1, 2)
  SELECT a.brand, strftime(a.month, '%Y-%m') AS month, round(a.qty, 4) AS qty, round((a.qty - b.qty) / nullif(b.qty, 0), 4) AS growth FROM m a LEFT JOIN m b ON a.brand = b.brand AND b.month = a.month - INTERVAL 12 MONTH""", "demand")
def fea_19(t):
    m = t.demand.groupBy("brand", F.trunc("day", "month").alias("month")).agg(F.sum("qty").alias("qty"))
    out = x.growth(m, "brand", F.col("month"), "qty", F.add_months("month", 12))
    return out.select("brand", F.date_format("month", "yyyy-MM").alias("month"), rnd(F.col("qty")).alias("qty"), rnd(F.col("growth")).alias("growth"))


ASOF = """SELECT l.event_id, r.event_id AS click_id, r.value AS click_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') r ON l.user_id = r.user_id AND l.ts >= r.ts"""


def asof_clicks(t):
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.where("event_type = 'click'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    return o.asof(left, right, ["user_id"], "ts", "at", ["click_id", "click_value"]).select("event_id", "click_id", "click_value")


@query("fea_20", ASOF)
def fea_20(t):
    return asof_clicks(t)


@query("fea_21", "SELECT user_id, count(*) AS n, count(*) AS n_v1, round(sum(value), 4) AS total FROM events GROUP BY 1")
def fea_21(t):
    from sparkloom.session import new_scratch_path

    path = new_scratch_path(t.spark, "features")
    first = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    x.write_version(first, path, 1, "counts")
    x.write_version(first.join(t.events.groupBy("user_id").agg(F.sum("value").alias("total")), "user_id"), path, 2, "counts and totals")
    latest, rolled = x.read_version(t.spark, path), x.read_version(t.spark, path, 1)
    return latest.join(rolled.select("user_id", F.col("n").alias("n_v1")), "user_id").select("user_id", "n", "n_v1", F.round("total", 4).alias("total"))


@query("fea_22", f"""SELECT s."column", s.null_pct, s.mean, s.std, s.min, s.max, c.r AS importance FROM ({numeric_sql(NUM, 'lineitem', 'count(*)', ['null_pct', 'mean', 'std', 'min', 'max'])}) s
  JOIN ({' UNION ALL '.join(f"SELECT '{c}' AS c, round(abs(corr({c}, l_extendedprice)), 4) AS r FROM lineitem" for c in NUM)}) c ON s."column" = c.c""")
def fea_22(t):
    s = p.numeric_summary(t.lineitem, NUM).select("column", "null_pct", "mean", "std", "min", "max")
    imp = p.target_correlations(t.lineitem, NUM, "l_extendedprice", -1.0).select("column", F.abs("r").alias("importance"))
    return s.join(imp, "column")


@query("fea_23")
def fea_23(t):
    from sparkloom.operators.models import interaction_gain

    d = t.orders_target.select("o_orderkey", "c_acctbal", "o_totalprice", "y")
    return interaction_gain(d, "o_orderkey", ["c_acctbal", "o_totalprice"], F.col("c_acctbal") * F.col("o_totalprice"), "y")


def select_sql(cols, table):
    from itertools import combinations
    pairs = " UNION ALL ".join(f"SELECT '{b}' AS b, abs(corr({a}, {b})) AS r FROM {table}" for a, b in combinations(cols, 2))
    return f"SELECT c AS \"column\", c NOT IN (SELECT b FROM ({pairs}) WHERE r > 0.95) AS kept FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in cols)}) v(c)"


@query("fea_24", select_sql(["c_acctbal", "o_totalprice", "target", "c_nationkey"], "orders_target"), "orders_target")
def fea_24(t):
    from sparkloom.operators.models import drop_correlated

    return drop_correlated(t.orders_target, ["c_acctbal", "o_totalprice", "target", "c_nationkey"], 0.95)


@query("fea_25")
def fea_25(t):
    from sparkloom.operators.models import eliminate_features

    rows = t.orders_target.select("c_acctbal", "o_totalprice", "c_nationkey", "o_custkey", "y").persist()  # one join for all fits
    try:
        return eliminate_features(rows, ["c_acctbal", "o_totalprice", "c_nationkey", "o_custkey"], "y", 2)
    finally:
        rows.unpersist()


@query("fea_26", "SELECT user_id, strftime(hour, '%Y-%m-%d %H') AS hour, round(value, 4) AS value FROM hourly_gap", "hourly_gap")
def fea_26(t):
    return t.hourly_gap.select("user_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), rnd(F.col("value")).alias("value"))


@query("fea_27", """WITH s AS (SELECT brand, day, avg(qty) OVER w AS ma, list_sort(list(qty) OVER w) AS l FROM demand WINDOW w AS (PARTITION BY brand ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
  e AS (SELECT brand, list_reduce(list(qty ORDER BY day), lambda a, x: 0.7 * a + 0.3 * x) AS ewma FROM demand GROUP BY 1)
  SELECT s.brand, strftime(day, '%Y-%m-%d') AS day, round(ma, 4) AS moving_avg, l[len(l) // 2 + 1] AS median_filter, round(ewma, 4) AS ewma FROM s JOIN e USING (brand)""", "demand")
def fea_27(t):
    return x.smooth(t.demand, "brand", "day", "qty").join(x.ewma(t.demand, "brand", "day", "qty", 0.3), "brand").select(
        "brand", F.date_format("day", "yyyy-MM-dd").alias("day"), rnd(F.col("moving_avg")).alias("moving_avg"), "median_filter", rnd(F.col("ewma")).alias("ewma"))


@query("fea_28", f"""SELECT p_partkey, round((p_size * CASE {H('p_partkey', 3)} WHEN 0 THEN 1.0 WHEN 1 THEN 10.7639 ELSE 43560.0 END)::DOUBLE, 4) AS sqft,
  round((p_size * CASE {H('p_partkey', 4)} WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 WHEN 2 THEN 1e5 ELSE 1.0 END)::DOUBLE, 4) AS money FROM part""")
def fea_28(t):
    unit = F.element_at(F.array(F.lit(" sqft"), F.lit(" sqm"), F.lit(" acre")), (hash_bucket("p_partkey", 3) + 1).cast("int"))
    word = F.element_at(F.array(F.lit("k"), F.lit("M"), F.lit(" Lac"), F.lit("")), (hash_bucket("p_partkey", 4) + 1).cast("int"))
    texts = t.part.select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("area"), F.concat(F.lit("$"), F.col("p_size").cast("string"), word).alias("price"))
    return texts.select("p_partkey", rnd(x.parse_area(F.col("area"))).alias("sqft"), rnd(x.parse_money(F.col("price"))).alias("money"))


@query("fea_29", "SELECT substr(md5(CAST(c_custkey AS VARCHAR)), 1, 3) AS code, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1")
def fea_29(t):
    return t.customer.groupBy(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 3).alias("code")).agg(F.count("*").alias("n"), rnd(F.avg("c_acctbal")).alias("mean"))


@query("fea_30", "SELECT sha256('pepper' || CAST(c_custkey AS VARCHAR)) AS id, c_mktsegment FROM customer")
def fea_30(t):
    return t.customer.select(F.sha2(F.concat(F.lit("pepper"), F.col("c_custkey").cast("string")), 256).alias("id"), "c_mktsegment")
