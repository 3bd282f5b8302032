"""Manufacturing, healthcare, finance and social queries."""

from pyspark.sql import functions as F

from sparkloom.functions.exprs import hash_bucket, rnd
from sparkloom.operators import finance as fi, graph as gr, healthcare as he, manufacturing as mf, social as so
from sparkloom.plans.catalog import query
from sparkloom.plans.views import H

ORDER = ["ts", "event_id"]


def failed():
    return F.col("event_type") == "error"


def sensor(t):
    return t.events.select("event_id", "user_id", "ts", "event_type", "value")


DAILY = "(SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS x, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1, 2)"


def daily(t):
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("x"), F.count("*").alias("n"), F.count_if(failed()).alias("bad"))


@query("dom_22", f"""SELECT user_id, count(*) AS n, round(any_value(m), 8) AS centre, round(any_value(m - 3 * s), 5) AS lower, round(any_value(m + 3 * s), 5) AS upper, count(*) FILTER (abs(x - m) > 3 * s) AS violations
  FROM {DAILY} JOIN (SELECT user_id, avg(x) AS m, stddev_samp(x) AS s FROM {DAILY} GROUP BY 1) USING (user_id) GROUP BY 1""")
def dom_22(t):
    return mf.control_chart(daily(t), "user_id", "x")


DAY = "(SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1)"


@query("dom_22_attributes", f"""SELECT day, n, bad, round(bad / n, 5) AS share, round(greatest(0, p - 3 * sqrt(p * (1 - p) / n)), 5) AS p_low, round(p + 3 * sqrt(p * (1 - p) / n), 5) AS p_high, abs(bad / n - p) > 3 * sqrt(p * (1 - p) / n) AS p_out, abs(bad - c) > 3 * sqrt(c) AS c_out
  FROM {DAY}, (SELECT sum(bad) / sum(n) AS p, avg(bad) AS c FROM {DAY})""")
def dom_22_attributes(t):
    d = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if(failed()).alias("bad"))
    return mf.attribute_charts(d, "n", "bad")


def _run(c, n, k=None):
    return f"coalesce(sum(({c})::INT) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {k or n}, false)"


@query("dom_23", f"""WITH z AS (SELECT user_id, day, (x - m) / s AS z FROM {DAILY} JOIN (SELECT user_id, avg(x) AS m, stddev_samp(x) AS s FROM {DAILY} GROUP BY 1) USING (user_id)),
  d AS (SELECT *, z - lag(z) OVER (PARTITION BY user_id ORDER BY day) AS d FROM z), dd AS (SELECT *, d * lag(d) OVER (PARTITION BY user_id ORDER BY day) AS dd FROM d)
  SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(z, 5) AS z, abs(z) > 3 AS rule_1, {_run('z > 0', 9)} OR {_run('z < 0', 9)} AS rule_2, {_run('d > 0', 5)} OR {_run('d < 0', 5)} AS rule_3, {_run('dd < 0', 12)} AS rule_4,
  {_run('z > 2', 3, 2)} OR {_run('z < -2', 3, 2)} AS rule_5, {_run('z > 1', 5, 4)} OR {_run('z < -1', 5, 4)} AS rule_6, {_run('abs(z) < 1', 15)} AS rule_7, {_run('abs(z) > 1', 8)} AS rule_8 FROM dd""")
def dom_23(t):
    out = mf.nelson_rules(daily(t), "user_id", "day", "x")
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd")).withColumn("z", rnd(F.col("z"), 5))


@query("dom_24", """WITH p AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), g AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS so, avg(abs(value - p)) / 1.128 AS sw FROM p GROUP BY 1)
  SELECT user_id, round(200 / (6 * sw), 5) AS cp, round(least(200 - m, m) / (3 * sw), 5) AS cpk, round(200 / (6 * so), 5) AS pp, round(least(200 - m, m) / (3 * so), 5) AS ppk FROM g""")
def dom_24(t):
    return mf.capability(sensor(t), "user_id", ORDER, "value", 0.0, 200.0)


@query("dom_25", """WITH g AS (SELECT strftime(ts, '%Y-%m-%d') AS period, 1 - avg((event_type = 'error')::INT) AS a, 1 - avg((value > 120)::INT) AS p, 1 - avg((value > 200)::INT) AS q, 1 - avg((event_type = 'error' OR value > 200)::INT) AS f, avg((value > 200)::INT) AS r, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1)
  SELECT period, round(a, 5) AS availability, round(p, 5) AS performance, round(q, 5) AS quality, round(a * p * q, 5) AS oee, round(f, 5) AS first_pass_yield, round(1e6 * r, 2) AS dpmo, e AS downtime_events FROM g""")
def dom_25(t):
    return mf.oee(t.events, F.date_format("ts", "yyyy-MM-dd"), failed(), F.col("value") > 120, F.col("value") > 200)


@query("dom_26", """WITH w AS (SELECT user_id, event_type, epoch_us(ts) AS u, max(CASE WHEN event_type = 'error' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lf,
    min(CASE WHEN event_type <> 'error' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ng FROM events)
  SELECT user_id, count(*) AS failures, round(avg((u - lf) / 3.6e9), 5) AS mtbf_hours, round(avg((ng - u) / 3.6e9), 5) AS mttr_hours FROM w WHERE event_type = 'error' GROUP BY 1""")
def dom_26(t):
    return mf.reliability(sensor(t), "user_id", ORDER, failed())


@query("dom_27", """WITH s AS (SELECT event_id, user_id, ts, sum(value - 60 - 5) OVER w AS su, sum(60 - 5 - value) OVER w AS sl FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
  SELECT event_id, round(su - least(0, min(su) OVER w), 4) AS cusum_high, round(sl - least(0, min(sl) OVER w), 4) AS cusum_low FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def dom_27(t):
    out = mf.cusum(sensor(t), "user_id", ORDER, "value", 60.0, 5.0)
    return out.select("event_id", rnd(F.col("cusum_high")).alias("cusum_high"), rnd(F.col("cusum_low")).alias("cusum_low"))


@query("dom_28", """WITH w AS (SELECT event_id, (min(CASE WHEN event_type = 'error' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - epoch_us(ts)) / 3.6e9 AS h FROM events)
  SELECT event_id, round(h, 6) AS hours_left, CAST(coalesce(h <= 24, false) AS INTEGER) AS fails_soon FROM w""")
def dom_28(t):
    out = mf.failure_labels(sensor(t), "user_id", ORDER, failed(), 24)
    return out.select("event_id", rnd(F.col("hours_left"), 6).alias("hours_left"), "fails_soon")


@query("dom_29", """WITH w AS (SELECT *, value > 150 AS a, event_type = 'error' AS f, min(CASE WHEN event_type = 'error' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - epoch_us(ts) AS nf,
    epoch_us(ts) - max(CASE WHEN value > 150 THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS la FROM events)
  SELECT count(*) FILTER (a) AS alarms, count(*) FILTER (f) AS failures, round(count(*) FILTER (a AND nf <= 86400000000) / count(*) FILTER (a), 5) AS precision, round(count(*) FILTER (f AND la <= 86400000000) / count(*) FILTER (f), 5) AS recall,
  round((count(*) FILTER (a) - count(*) FILTER (a AND nf <= 86400000000)) / count(DISTINCT CAST(ts AS DATE)), 5) AS false_per_day FROM w""")
def dom_29(t):
    return mf.alarm_quality(sensor(t), "user_id", ORDER, F.col("value") > 150, failed(), 24)


RISK = "r AS (SELECT days, sum(event) AS d, sum(count(*)) OVER (ORDER BY days DESC) AS n FROM survival GROUP BY days)"
KM = "km AS (SELECT days, d, n, exp(sum(CASE WHEN d < n THEN ln(1 - d / n) END) OVER (ORDER BY days)) * (1 - max((d >= n)::INT) OVER (ORDER BY days)) AS s FROM r)"


@query("dom_30", f"WITH {RISK}, {KM} SELECT days, CAST(d AS BIGINT) AS d, CAST(n AS BIGINT) AS at_risk, round(s, 6) AS survival, (SELECT min(days) FROM km WHERE s <= 0.5) AS median FROM km", "survival")
def dom_30(t):
    km = he.kaplan_meier(t.survival, "days", "event")
    mid = he.median_survival(km, "days").first()[0]
    return km.select("days", "d", "at_risk", rnd(F.col("survival"), 6).alias("survival"), F.lit(mid).cast("bigint").alias("median"))


@query("dom_31", """WITH r AS (SELECT days, sum(event) AS d, sum(event) FILTER (arm = 1) AS d1, sum(count(*)) OVER (ORDER BY days DESC) AS n, sum(count(*) FILTER (arm = 1)) OVER (ORDER BY days DESC) AS n1 FROM survival GROUP BY days)
  SELECT CAST(sum(d1) AS BIGINT) AS observed, round(sum(d * n1 / n), 4) AS expected, round(pow(sum(d1) - sum(d * n1 / n), 2) / sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END), 4) AS chi_square FROM r""", "survival")
def dom_31(t):
    return he.log_rank(t.survival, "days", "event", "arm")


@query("dom_32", f"""WITH {RISK}, {KM}, b AS (SELECT days, n, coalesce(lag(s) OVER (ORDER BY days), 1) AS s0 FROM km), k AS (SELECT days, event * (1 + user_id % 2) AS cause, count(*) AS dk FROM survival WHERE event = 1 GROUP BY 1, 2)
  SELECT CAST(cause AS BIGINT) AS cause, k.days, round(sum(s0 * dk / n) OVER (PARTITION BY cause ORDER BY k.days), 6) AS incidence FROM k JOIN b ON b.days = k.days""", "survival")
def dom_32(t):
    d = t.survival.withColumn("cause", F.col("event") * (1 + F.col("user_id") % 2))
    return he.cumulative_incidence(d, "days", "cause").select("cause", "days", rnd(F.col("incidence"), 6).alias("incidence"))


VISITS = f"(SELECT o_orderkey, o_custkey, o_orderdate AS admit, o_orderdate + to_days(CAST(1 + {H('o_orderkey', 14)} AS INTEGER)) AS discharge FROM orders)"


@query("dom_33", f"""SELECT o_orderkey, date_diff('day', admit, discharge) AS length_of_stay, coalesce(date_diff('day', discharge, lead(admit) OVER (PARTITION BY o_custkey ORDER BY admit, o_orderkey)) BETWEEN 0 AND 30, false) AS readmitted FROM {VISITS}""")
def dom_33(t):
    v = t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("admit"), F.date_add(F.to_date("o_orderdate"), (1 + hash_bucket("o_orderkey", 14)).cast("int")).alias("discharge"))
    return he.stays(v, "o_custkey", "admit", "discharge", "o_orderkey").select("o_orderkey", "length_of_stay", "readmitted")


@query("dom_34", """WITH c AS (SELECT o_custkey, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 3) AS code FROM orders), w AS (SELECT DISTINCT o_custkey, CASE WHEN code LIKE 'a1%' THEN 6 WHEN code LIKE 'a%' THEN 1 WHEN code LIKE 'b%' THEN 2 WHEN code LIKE 'c%' THEN 3 END AS w FROM c)
  SELECT o_custkey, CAST(sum(w) AS BIGINT) AS index FROM w WHERE w IS NOT NULL GROUP BY 1""")
def dom_34(t):
    c = t.orders.select("o_custkey", F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 3).alias("code"))
    return he.comorbidity_index(c, "o_custkey", "code", {"a": 1, "b": 2, "c": 3, "a1": 6})


@query("dom_35", """WITH i AS (SELECT o_orderkey, o_custkey, o_orderpriority AS p, o_orderdate AS s, o_orderdate + INTERVAL 60 DAY AS e FROM orders)
  SELECT a.o_custkey, a.o_orderkey, EXISTS (SELECT 1 FROM i b WHERE b.p = '5-LOW' AND b.o_custkey = a.o_custkey AND b.s <= a.e AND b.e >= a.s) AS interacts FROM i a WHERE a.p = '1-URGENT'""")
def dom_35(t):
    i = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("s"), F.date_add(F.to_date("o_orderdate"), 60).alias("e"))
    return he.overlaps(i, "o_custkey", "s", "e", "o_orderkey", F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW")


@query("dom_36", """SELECT grp AS key, count(*) AS n, round(avg(1 - score), 6) AS rate, round(sum((1 - score) * 0.45::DOUBLE * weight) / sum(weight), 6) AS extra FROM preds GROUP BY 1
  UNION ALL SELECT CAST(band AS VARCHAR), n, round(r, 6), coalesce((r >= lag(r) OVER (ORDER BY band))::INT, 1)::DOUBLE FROM (SELECT floor(score * 5) AS band, count(*) AS n, avg(y) AS r FROM preds GROUP BY 1)
  UNION ALL SELECT v || '/' || a, n, round(sum(b) OVER (PARTITION BY v ORDER BY a) / sum(n) OVER (PARTITION BY v ORDER BY a), 6), NULL FROM (SELECT year(o_orderdate) AS v, date_diff('year', o_orderdate, l_shipdate) AS a, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
  UNION ALL SELECT was || '>' || event_type, n, round(n / sum(n) OVER (PARTITION BY was), 6), NULL FROM (SELECT was, event_type, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS NOT NULL GROUP BY 1, 2)""".replace("CAST(band AS VARCHAR)", "CAST(CAST(band AS BIGINT) AS VARCHAR)"), "preds")
def dom_36(t):
    """Expected loss by segment, default rate by score band, vintage curves, roll rates."""
    none = F.lit(None).cast("double")
    a = fi.expected_loss(t.preds, "grp", 1 - F.col("score"), 0.45, F.col("weight")).select(F.col("grp").alias("key"), "n", F.col("pd").alias("rate"), F.col("loss_rate").alias("extra"))
    b = fi.band_rates(t.preds, F.floor(F.col("score") * 5), "y").select(F.col("band").cast("string").alias("key"), "n", "rate", F.col("monotonic").cast("int").cast("double").alias("extra"))
    l = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    v = fi.vintage_curve(l, F.year("o_orderdate"), F.year("l_shipdate") - F.year("o_orderdate"), F.col("l_returnflag") == "R")
    v = v.select(F.concat_ws("/", "vintage", "age").alias("key"), "n", F.col("cumulative_bad").alias("rate"), none.alias("extra"))
    r = fi.roll_rates(sensor(t), "user_id", ORDER, "event_type").select(F.concat_ws(">", "was", "now").alias("key"), "n", "rate", none.alias("extra"))
    return a.unionByName(b).unionByName(v).unionByName(r)


@query("dom_37", """WITH r AS (SELECT o_orderpriority AS cur, o_orderdate AS d, round(avg(o_totalprice) / 100000, 4) AS rate FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
  SELECT o.o_orderkey, r.rate, round(o.o_totalprice * r.rate, 6) AS converted FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') o ASOF LEFT JOIN r ON r.cur = o.o_orderpriority AND o.o_orderdate >= r.d""")
def dom_37(t):
    r = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("cur"), F.col("o_orderdate").alias("d")).agg(F.round(F.avg("o_totalprice") / 100000, 4).alias("rate"))
    o = t.orders.where("o_orderstatus = 'O'").select("o_orderkey", F.col("o_orderpriority").alias("cur"), "o_orderdate", "o_totalprice")
    return fi.convert_currency(o, r, "cur", "o_orderdate", "o_totalprice", "d", "rate").select("o_orderkey", "rate", rnd(F.col("converted"), 6).alias("converted"))


@query("dom_38", """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS place FROM events), w AS (SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) <= 3600000000 AS r FROM e)
  SELECT w.event_id, coalesce(r, false) AS repeat, EXISTS (SELECT 1 FROM e a JOIN e b ON a.user_id = b.user_id AND b.place <> a.place AND (b.ts, b.event_id) < (a.ts, a.event_id) AND epoch_us(a.ts) - epoch_us(b.ts) <= 86400000000 WHERE a.event_id = w.event_id) AS several_places FROM w""")
def dom_38(t):
    e = sensor(t).join(t.events.select("event_id", (F.get_json_object("props", "$.k").cast("int") % 3).alias("place")), "event_id")
    a = fi.repeat_flags(e, ["user_id", "event_type"], ORDER, 3600)
    return fi.place_flags(a, "user_id", ORDER, "place", 86400).select("event_id", "repeat", "several_places")


@query("dom_39", """WITH g AS (SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'signup') AS s FROM events GROUP BY 1)
  SELECT period, round((c + p) / nullif(v, 0), 5) AS engagement, round(c / nullif(p, 0), 5) AS click_to_purchase, s AS new_followers, round((s - lag(s) OVER (ORDER BY period)) / nullif(lag(s) OVER (ORDER BY period), 0), 5) AS growth FROM g""")
def dom_39(t):
    return so.engagement_rates(t.events, F.date_format("ts", "yyyy-MM-dd"), "event_type")


@query("dom_39_response", """WITH w AS (SELECT user_id, event_type, epoch_us(ts) AS u, min(CASE WHEN event_type = 'click' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM events)
  SELECT user_id, count(*) AS asks, round(avg((n - u) / 1e6), 3) AS response_seconds FROM w WHERE event_type = 'view' GROUP BY 1""")
def dom_39_response(t):
    return so.response_time(sensor(t), "user_id", ORDER, F.col("event_type") == "view", F.col("event_type") == "click")


TEXT = "length(text) AS n_chars, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n_words, " + ", ".join(f"len(regexp_extract_all(text, '{rx}')) AS {n}" for n, rx in so.SHAPES.items())


@query("dom_40", f"SELECT doc_id AS id, {TEXT} FROM documents UNION ALL SELECT -1 - conv_id * 1000 - turn, {TEXT} FROM conversations")
def dom_40(t):
    f = [e.cast("bigint").alias(n) for n, e in so.text_features("text").items()]
    return t.documents.select(F.col("doc_id").alias("id"), *f).unionByName(t.conversations.select((-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("id"), *f))


@query("dom_41", """WITH p AS (SELECT user_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS g FROM events), s AS (SELECT user_id, count(*) AS n, avg(g) AS m, stddev_samp(g) AS s, (epoch_us(max(ts)) - epoch_us(min(ts))) / 8.64e10 AS a FROM p GROUP BY 1)
  SELECT user_id, n, round(s / m, 5) AS interval_cv, round(n / a, 5) AS posts_per_day, coalesce(s / m, 9) < 0.8 AS regular FROM s""")
def dom_41(t):
    return so.bot_scores(sensor(t), "user_id", ORDER)


@query("dom_42", """SELECT user_id, count(*) FILTER ((epoch_us(ts) - epoch_us(t0)) / 3.6e9 <= 1) AS first_1h, count(*) FILTER ((epoch_us(ts) - epoch_us(t0)) / 3.6e9 <= 24) AS first_24h FROM events JOIN (SELECT user_id, min(ts) AS t0 FROM events GROUP BY 1) USING (user_id) GROUP BY 1""")
def dom_42(t):
    return so.early_velocity(t.events, "user_id", "ts", [1, 24])


# A small lexicon over the invented words of the texts.
LEXICON = [("the", 1.0, False), ("and", 0.5, False), ("with", 0.8, False), ("not", -1.5, False), ("for", -0.5, False), ("le", 0.7, False), ("und", -0.4, True), ("der", 0.9, False), ("que", -0.8, True), ("of", -0.3, False)]


@query("dom_43", "WITH lex(word, weight, flag) AS (VALUES " + ", ".join(f"('{w}', {x}::DOUBLE, {str(f).lower()})" for w, x, f in LEXICON) + r"""), w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: w <> '')) AS word FROM documents),
  g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (weight > 0) AS p, count(*) FILTER (weight < 0) AS q, coalesce(sum(weight), 0) AS s, count(*) FILTER (flag) AS t FROM w LEFT JOIN lex USING (word) GROUP BY 1)
  SELECT doc_id, round(s / sqrt(s * s + 15), 5) AS compound, round(p / n, 5) AS positive, round(q / n, 5) AS negative, t AS toxic_words FROM g""")
def dom_43(t):
    lex = t.spark.createDataFrame(LEXICON, "word string, weight double, flag boolean")
    return so.sentiment(t.documents, "doc_id", "text", lex)


def _rounds(first: str, step: str, n: int) -> str:
    """CTEs r0 .. rn, each made from the one before."""
    return ", ".join([f"r0 AS ({first})", *[f"r{i} AS ({step.replace('PREV', f'r{i - 1}')})" for i in range(1, n + 1)]])


ARCS = "arcs AS (SELECT a AS src, b AS dst FROM edges UNION ALL SELECT b, a FROM edges), deg AS (SELECT src AS node, count(*) AS out FROM arcs GROUP BY 1)"
RANKS = _rounds("SELECT node, out, 1.0::DOUBLE / (SELECT count(*) FROM deg) AS rank FROM deg",
                "SELECT d.node, d.out, 0.15::DOUBLE / (SELECT count(*) FROM deg) + 0.85::DOUBLE * coalesce(g.got, 0) AS rank FROM deg d LEFT JOIN (SELECT dst, sum(p.rank / p.out) AS got FROM arcs JOIN PREV p ON p.node = arcs.src GROUP BY 1) g ON g.dst = d.node", 10)


@query("dom_44", f"WITH {ARCS}, {RANKS} SELECT node, round(rank, 6) AS rank FROM r10", "edges")
def dom_44(t):
    return gr.page_rank(t.edges).select("node", F.round("rank", 6).alias("rank"))


@query("dom_45", """WITH arcs AS (SELECT a AS s, b AS d FROM edges UNION ALL SELECT b, a FROM edges), deg AS (SELECT s AS node, count(*) AS degree FROM arcs GROUP BY 1),
  tri AS (SELECT x.a AS a, x.b AS b, y.b AS c FROM edges x JOIN edges y ON x.b = y.a JOIN edges z ON z.a = x.a AND z.b = y.b), per AS (SELECT node, count(*) AS t FROM (SELECT unnest([a, b, c]) AS node FROM tri) GROUP BY 1)
  SELECT node, degree, coalesce(t, 0) AS triangles, round(coalesce(2 * coalesce(t, 0) / nullif(degree * (degree - 1), 0), 0), 6) AS clustering FROM deg LEFT JOIN per USING (node)""", "edges")
def dom_45(t):
    return gr.triangles(t.edges)


@query("dom_45_components", """WITH RECURSIVE arcs AS (SELECT a AS s, b AS d FROM edges UNION ALL SELECT b, a FROM edges), reach AS (SELECT DISTINCT s AS node, s AS root FROM arcs UNION SELECT arcs.d, reach.root FROM reach JOIN arcs ON arcs.s = reach.node)
  SELECT node, min(root) AS label FROM reach GROUP BY 1""", "edges")
def dom_45_components(t):
    return gr.components(t.edges)


CORE = _rounds("SELECT a, b FROM edges", "SELECT e.a, e.b FROM PREV e JOIN (SELECT n FROM (SELECT a AS n FROM PREV UNION ALL SELECT b FROM PREV) GROUP BY n HAVING count(*) >= 3) x ON x.n = e.a JOIN (SELECT n FROM (SELECT a AS n FROM PREV UNION ALL SELECT b FROM PREV) GROUP BY n HAVING count(*) >= 3) y ON y.n = e.b", 12)


@query("dom_45_core", f"WITH {CORE} SELECT node, count(*) AS d FROM (SELECT a AS node FROM r12 UNION ALL SELECT b FROM r12) GROUP BY 1", "edges")
def dom_45_core(t):
    return gr.k_core(t.edges, 3)


@query("dom_45_core_numbers")
def dom_45_core_numbers(t):
    return gr.core_numbers(t.edges)


LABELS = _rounds("SELECT DISTINCT src AS node, src AS label FROM arcs",
                 "SELECT node, label FROM (SELECT arcs.src AS node, p.label, row_number() OVER (PARTITION BY arcs.src ORDER BY count(*) DESC, p.label) AS i FROM arcs JOIN PREV p ON p.node = arcs.dst GROUP BY arcs.src, p.label) WHERE i = 1", 4)


@query("dom_46", f"WITH {ARCS}, {LABELS} SELECT node, label FROM r4", "edges")
def dom_46(t):
    return gr.communities(t.edges, 4)


@query("dom_47", "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS position, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, round(avg((event_type = 'click')::INT), 5) AS ctr FROM events GROUP BY 1")
def dom_47(t):
    return so.position_ctr(t.events, F.get_json_object("props", "$.k").cast("int") % 10, F.col("event_type") == "click")
