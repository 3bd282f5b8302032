"""Marketing queries."""

from pyspark.sql import functions as F

from sparkloom.operators import marketing as k
from sparkloom.plans.catalog import query


@query("dom_01", """WITH g AS (SELECT o_custkey, date_diff('day', max(o_orderdate), (SELECT max(o_orderdate) FROM orders)) AS recency, count(*) AS frequency, round(sum(o_totalprice), 2) AS monetary FROM orders GROUP BY 1)
  SELECT *, CAST(ntile(5) OVER (ORDER BY -recency, o_custkey) AS INTEGER) AS r, CAST(ntile(5) OVER (ORDER BY frequency, o_custkey) AS INTEGER) AS f, CAST(ntile(5) OVER (ORDER BY monetary, o_custkey) AS INTEGER) AS m FROM g""")
def dom_01(t):
    last = t.orders.agg(F.max("o_orderdate")).first()[0]
    return k.rfm(t.orders, "o_custkey", "o_orderdate", "o_totalprice", F.lit(last))


@query("dom_02", """WITH g AS (SELECT o_custkey, avg(o_totalprice) AS aov, count(*) AS n, greatest(date_diff('day', min(o_orderdate), max(o_orderdate)) / 365.0, 1.0) AS y FROM orders GROUP BY 1)
  SELECT o_custkey, round(aov, 7) AS aov, round(n / y, 4) AS per_year, round(y::DOUBLE, 4) AS years, round(aov * (n / y) * y, 2) AS clv FROM g""".replace("/ 365.0", "/ 365.0::DOUBLE"))
def dom_02(t):
    return k.lifetime_value(t.orders, "o_custkey", "o_orderdate", "o_totalprice")


@query("dom_03", """WITH g AS (SELECT o_custkey, date_diff('day', max(o_orderdate), TIMESTAMP '2001-06-01') AS idle, date_diff('day', min(o_orderdate), TIMESTAMP '2001-06-01') AS age, count(*) AS n FROM orders GROUP BY 1)
  SELECT o_custkey, idle, idle > 30 AS churned_30, idle > 60 AS churned_60, idle > 90 AS churned_90, CASE WHEN idle > 90 THEN 'lost' WHEN idle > 30 THEN 'at_risk' WHEN age <= 30 THEN 'new' WHEN n >= 10 THEN 'loyal' ELSE 'active' END AS stage FROM g""")
def dom_03(t):
    return k.churn_flags(t.orders, "o_custkey", "o_orderdate", F.lit("2001-06-01").cast("timestamp_ntz"))


@query("dom_04", """WITH s AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS p FROM orders), f AS (SELECT o_custkey, min(p) AS cohort FROM s GROUP BY 1), k AS (SELECT cohort, p - cohort AS k FROM s JOIN f USING (o_custkey)),
  z AS (SELECT cohort, count(*) AS size FROM f GROUP BY 1)
  SELECT CAST(cohort AS INTEGER) AS cohort, any_value(size) AS size, CAST(k AS INTEGER) AS k, count(*) AS n, round(count(*) / any_value(size), 4) AS share FROM k JOIN z USING (cohort) GROUP BY cohort, k""")
def dom_04(t):
    return k.cohorts(t.orders, "o_custkey", F.year("o_orderdate"), lambda p, c: p - c)


@query("dom_05", """WITH a AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'view' GROUP BY 1),
  b AS (SELECT user_id, t0, min(ts) AS t1 FROM events JOIN a USING (user_id) WHERE event_type = 'click' AND ts > t0 AND ts <= t0 + INTERVAL 1 DAY GROUP BY 1, 2),
  c AS (SELECT user_id, min(ts) AS t2 FROM events JOIN b USING (user_id) WHERE event_type = 'purchase' AND ts > t1 AND ts <= t0 + INTERVAL 1 DAY GROUP BY 1),
  s AS (SELECT 1 AS step, 'view' AS name, count(*) AS n FROM a UNION ALL SELECT 2, 'click', count(*) FROM b UNION ALL SELECT 3, 'purchase', count(*) FROM c)
  SELECT step, name, n, round(n / first(n) OVER (ORDER BY step), 4) AS of_first, round(1 - n / lag(n) OVER (ORDER BY step), 4) AS drop_off FROM s""")
def dom_05(t):
    return k.funnel(t.events, "user_id", "ts", "event_type", ["view", "click", "purchase"], "1 DAY")


PATHS = """r AS (SELECT *, coalesce(sum((channel = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS path FROM touches),
  e AS (SELECT user_id, path, ts AS done FROM r WHERE channel = 'purchase'),
  p AS (SELECT r.*, row_number() OVER w AS i, count(*) OVER (PARTITION BY r.user_id, r.path) AS n, pow(2.0, -((epoch_us(done) - epoch_us(ts)) / 1e6) / 604800) AS d FROM r JOIN e ON e.user_id = r.user_id AND e.path = r.path WHERE channel <> 'purchase' WINDOW w AS (PARTITION BY r.user_id, r.path ORDER BY ts, event_id))"""


@query("dom_06", f"""WITH {PATHS}, q AS (SELECT *, sum(d) OVER (PARTITION BY user_id, path) AS ds FROM p)
  SELECT channel, count(*) FILTER (i = 1) AS first, count(*) FILTER (i = n) AS last, round(sum(1 / n), 4) AS linear, round(sum(d / ds), 4) AS time_decay,
  round(sum(CASE WHEN n = 1 THEN 1.0 WHEN n = 2 THEN 0.5 WHEN i = 1 OR i = n THEN 0.4 ELSE 0.2 / (n - 2) END::DOUBLE), 4) AS position FROM q GROUP BY 1""", "touches")
def dom_06(t):
    p = k.paths(t.touches, "user_id", ["ts", "event_id"], F.col("channel") == "purchase")
    return k.attribution(p, "user_id", "channel")


@query("dom_07")
def dom_07(t):
    return k.markov_removal(t.touches, "user_id", ["ts", "event_id"], "channel", F.col("channel") == "purchase")


@query("dom_08", """WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
  SELECT user_id, round(sum(n * CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 10 ELSE 0 END)::DOUBLE, 4) AS score, arg_min(event_type, (-n, event_type)) AS favourite,
  round(coalesce(sum(n) FILTER (event_type = 'click'), 0) / nullif(coalesce(sum(n) FILTER (event_type = 'view'), 0), 0), 4) AS click_per_view,
  round(coalesce(sum(n) FILTER (event_type = 'purchase'), 0) / nullif(coalesce(sum(n) FILTER (event_type = 'click'), 0), 0), 4) AS purchase_per_click FROM n GROUP BY 1""")
def dom_08(t):
    return k.engagement(t.events, "user_id", "event_type", {"view": 1, "click": 2, "purchase": 10}, {"click": "view", "purchase": "click"})


@query("dom_09", """WITH g AS (SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'signup') AS s,
    sum(value) FILTER (event_type = 'purchase') AS r FROM events GROUP BY 1)
  SELECT period, round(c / v, 4) AS ctr, round(p / c, 4) AS cvr, round(r / (v * 0.3::DOUBLE), 4) AS roas, round(v * 0.3::DOUBLE / p, 4) AS cpa, round(v * 0.3::DOUBLE / s, 4) AS cac FROM g""")
def dom_09(t):
    return k.kpis(t.events, F.date_format("ts", "yyyy-MM-dd"), "event_type", "value", 0.3)


@query("dom_10", """SELECT segment, count(*) FILTER (arm = 1) AS n_treated, count(*) FILTER (arm = 0) AS n_control, round(avg(converted) FILTER (arm = 1), 4) AS treated, round(avg(converted) FILTER (arm = 0), 4) AS control,
  round(avg(converted) FILTER (arm = 1) - avg(converted) FILTER (arm = 0), 4) AS uplift FROM ab GROUP BY 1""", "ab")
def dom_10(t):
    return k.segment_uplift(t.ab, "segment", "arm", "converted")
