"""Derived views: the same expression in Spark and in SQL.

The given tables have no nulls, labels or roles; these views derive them row by row, so every
query that reads one grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.exprs import hash_bucket as h, micros


def H(key: str, buckets: int) -> str:
    """SQL of hash_bucket."""
    return f"(concat('0x', substr(md5(CAST({key} AS VARCHAR)), 1, 8))::BIGINT % {buckets})"


SPARK, SQL, PARENTS = {}, {}, {}


def view(name: str, sql: str, parents: tuple[str, ...] = ()):
    def wrap(fn):
        SPARK[name], SQL[name], PARENTS[name] = fn, sql, parents
        return fn

    return wrap


@view("events_null", f"""SELECT event_id, ts, user_id,
  CASE WHEN {H('event_id', 11)} = 0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN {H('event_id', 7)} = 0 THEN NULL ELSE value END AS value, props FROM events""")
def _events_null(t):
    return t.events.select(
        "event_id", "ts", "user_id",
        F.when(h("event_id", 11) != 0, F.col("event_type")).alias("event_type"),
        F.when(h("event_id", 7) != 0, F.col("value")).alias("value"), "props")


@view("lineitem_leak", "SELECT *, l_extendedprice * 2 + 1 AS leak FROM lineitem")
def _lineitem_leak(t):
    return t.lineitem.withColumn("leak", F.col("l_extendedprice") * 2 + 1)


@view("lineitem_dup", f"""SELECT * FROM lineitem UNION ALL
  SELECT * FROM lineitem WHERE {H('l_orderkey * 10 + l_linenumber', 10)} = 0""")
def _lineitem_dup(t):
    return t.lineitem.unionByName(t.lineitem.where(h(F.col("l_orderkey") * 10 + F.col("l_linenumber"), 10) == 0))


@view("orders_target", f"""SELECT o.*, c.c_nationkey, c.c_acctbal, c.c_mktsegment,
  CAST(c.c_acctbal + 50 * {H('o_orderkey', 100)} > 7000 AS INTEGER) AS y,
  2 * c.c_acctbal + {H('o_orderkey', 100)} AS target
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def _orders_target(t):
    joined = t.orders.join(t.customer.drop("c_name"), F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    noise = h("o_orderkey", 100)
    return joined.withColumns({
        "y": (F.col("c_acctbal") + 50 * noise > 7000).cast("int"),
        "target": 2 * F.col("c_acctbal") + noise})


@view("preds", """SELECT o_orderkey AS id, y, score, CAST(score > 0.5 AS INTEGER) AS pred, c_mktsegment AS grp,
  o_totalprice AS weight, target, 2 * c_acctbal + 50 AS estimate, o_orderdate AS placed FROM (
  SELECT *, floor(least(greatest((round(c_acctbal * 100) + 100000) / 110, 0), 10000)) / 10000 AS score FROM orders_target)""",
      ("orders_target",))
def _preds(t):
    cents = F.round(F.col("c_acctbal") * 100)
    score = F.floor(F.least(F.greatest((cents + 100000) / 110, F.lit(0.0)), F.lit(10000.0))) / 10000
    return t.orders_target.withColumn("score", score).select(
        F.col("o_orderkey").alias("id"), "y", "score", (F.col("score") > 0.5).cast("int").alias("pred"),
        F.col("c_mktsegment").alias("grp"), F.col("o_totalprice").alias("weight"), "target",
        (2 * F.col("c_acctbal") + 50).alias("estimate"), F.col("o_orderdate").alias("placed"))


@view("ref_half", "SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16'")
def _ref_half(t):
    return t.events.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))


@view("cur_half", "SELECT * REPLACE (value * 1.3 AS value) FROM events WHERE ts >= TIMESTAMP '2024-01-16'")
def _cur_half(t):
    return t.events.where(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).withColumn("value", F.col("value") * 1.3)


@view("ab", f"""SELECT user_id, {H('user_id', 2)} AS arm,
  max(CASE WHEN event_type = 'purchase' AND ts < TIMESTAMP '2024-01-08' THEN 1 ELSE 0 END) AS converted,
  sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS spend,
  sum(CASE WHEN ts < TIMESTAMP '2024-01-04' THEN value ELSE 0 END) AS before,
  {H('user_id', 3)} AS segment
  FROM events GROUP BY user_id""")
def _ab(t):
    bought = F.col("event_type") == "purchase"
    early = F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz")
    pre = F.col("ts") < F.lit("2024-01-04").cast("timestamp_ntz")
    return t.events.groupBy("user_id").agg(
        F.max(F.when(bought & early, 1).otherwise(0)).alias("converted"),
        F.sum(F.when(bought, F.col("value")).otherwise(0.0)).alias("spend"),
        F.sum(F.when(pre, F.col("value")).otherwise(0.0)).alias("before"),
    ).select("user_id", h("user_id", 2).alias("arm"), "converted", "spend", "before", h("user_id", 3).alias("segment"))


@view("demand", """SELECT b.p_brand AS brand, d.day AS day, coalesce(s.qty, 0) AS qty FROM
  (SELECT DISTINCT p_brand FROM part) b
  CROSS JOIN (SELECT CAST(unnest(generate_series(min(l_shipdate)::DATE, max(l_shipdate)::DATE, INTERVAL 1 DAY)) AS DATE) AS day FROM lineitem) d
  LEFT JOIN (SELECT p_brand, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS qty
             FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) s
  ON s.p_brand = b.p_brand AND s.day = d.day""")
def _demand(t):
    from sparkloom.operators.features import densify_days

    daily = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("p_brand").alias("brand"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("qty"))
    return densify_days(daily, ["brand"], "day", {"qty": 0.0}, span=t.lineitem.agg(
        F.to_date(F.min("l_shipdate")).alias("lo"), F.to_date(F.max("l_shipdate")).alias("hi")),
        keys_from=t.part.select(F.col("p_brand").alias("brand")).distinct())


@view("hourly_gap", f"""SELECT g.user_id, g.hour, s.value FROM
  (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM
    (SELECT user_id, date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events GROUP BY user_id)) g
  LEFT JOIN (SELECT user_id, date_trunc('hour', ts) AS hour, round(avg(value), 6) AS value FROM events GROUP BY 1, 2) s
  ON s.user_id = g.user_id AND s.hour = g.hour""")
def _hourly_gap(t):
    from sparkloom.operators.features import resample

    return resample(t.events, ["user_id"], "ts", "hour", F.round(F.avg("value"), 6).alias("value"))


@view("touches", """SELECT user_id, event_id, ts, event_type AS channel, value FROM events WHERE event_type <> 'signup'""")
def _touches(t):
    return t.events.where("event_type <> 'signup'").select("user_id", "event_id", "ts", F.col("event_type").alias("channel"), "value")


@view("survival", """SELECT s.user_id, CAST(coalesce(date_diff('microsecond', s.t0, f.t1), date_diff('microsecond', s.t0, TIMESTAMP '2024-01-31')) // 86400000000 AS BIGINT) AS days,
  CASE WHEN f.t1 IS NULL THEN 0 ELSE 1 END AS event, CAST(s.user_id % 2 AS INTEGER) AS arm
  FROM (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'signup' GROUP BY user_id) s
  LEFT JOIN (SELECT e.user_id, min(e.ts) AS t1 FROM events e
    JOIN (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'signup' GROUP BY user_id) b
    ON b.user_id = e.user_id AND e.ts > b.t0 WHERE e.event_type = 'purchase' AND e.value > 150 GROUP BY e.user_id) f
  ON f.user_id = s.user_id""")
def _survival(t):
    first = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("t0"))
    big = t.events.where("event_type = 'purchase' AND value > 150").select("user_id", "ts")
    hit = big.join(first, "user_id").where("ts > t0").groupBy("user_id").agg(F.min("ts").alias("t1"))
    end = F.coalesce(F.col("t1"), F.lit("2024-01-31").cast("timestamp_ntz"))
    span = F.floor((micros(end) - micros("t0")) / F.lit(86_400_000_000))
    return first.join(hit, "user_id", "left").select(
        "user_id", span.cast("bigint").alias("days"), F.col("t1").isNotNull().cast("int").alias("event"),
        (F.col("user_id") % 2).cast("int").alias("arm"))


@view("edges", """SELECT DISTINCT least(user_id, nxt) AS a, greatest(user_id, nxt) AS b FROM (
  SELECT user_id, lead(user_id) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS nxt
  FROM events WHERE event_type = 'purchase') WHERE nxt IS NOT NULL AND nxt <> user_id""")
def _edges(t):
    from sparkloom.operators.ordered import following

    bought = t.events.where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.date_trunc("hour", "ts").alias("hour"))
    near = following(bought, ["hour"], ["ts", "event_id"], {"nxt": "user_id"})
    return near.where("nxt IS NOT NULL AND nxt <> user_id").select(
        F.least("user_id", "nxt").alias("a"), F.greatest("user_id", "nxt").alias("b")).distinct()


# One row per event, read as a training run: project = user, run order = event id.
@view("runs", f"""SELECT user_id AS project, event_id AS run_id, ts AS finished,
  CASE {H('event_id', 3)} WHEN 0 THEN 'forest' WHEN 1 THEN 'linear' ELSE 'boosted' END AS model,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN event_type = 'error' OR {H('event_id', 13)} = 0 THEN NULL ELSE round({H('event_id', 1000)} / 1000.0, 3) END AS roc_auc,
  CASE WHEN event_type = 'error' THEN NULL ELSE round({H('event_id', 997)} / 1000.0, 3) END AS cv_roc_auc,
  round({H('event_id', 97)} / 1000.0, 3) AS cv_std,
  round({H('event_id', 1000)} / 1000.0 + {H('event_id', 89)} / 1000.0, 3) AS train_score,
  md5(concat(CAST({H('event_id', 50)} AS VARCHAR), event_type)) AS params FROM events""")
def _runs(t):
    bad = F.col("event_type") == "error"
    model = F.element_at(F.array(F.lit("forest"), F.lit("linear"), F.lit("boosted")), (h("event_id", 3) + 1).cast("int"))
    return t.events.select(
        F.col("user_id").alias("project"), F.col("event_id").alias("run_id"), F.col("ts").alias("finished"),
        model.alias("model"), F.when(bad, "failed").otherwise("ok").alias("status"),
        F.when(~(bad | (h("event_id", 13) == 0)), F.round(h("event_id", 1000) / 1000.0, 3)).alias("roc_auc"),
        F.when(~bad, F.round(h("event_id", 997) / 1000.0, 3)).alias("cv_roc_auc"),
        F.round(h("event_id", 97) / 1000.0, 3).alias("cv_std"),
        F.round(h("event_id", 1000) / 1000.0 + h("event_id", 89) / 1000.0, 3).alias("train_score"),
        F.md5(F.concat(h("event_id", 50).cast("string"), F.col("event_type"))).alias("params"))


# One row per document, read as a knowledge entry.
@view("kb", f"""SELECT CASE WHEN {H('doc_id', 9)} = 0 THEN NULL ELSE 'k' || CAST(doc_id // 2 AS VARCHAR) END AS id,
  text AS title, text AS body, source AS category, lang AS area,
  DATE '2024-01-01' + CAST({H('doc_id', 40)} AS INTEGER) AS added_date,
  CASE {H('doc_id', 5)} WHEN 0 THEN 'deprecation' WHEN 1 THEN 'pitfall' ELSE 'technique' END AS kind,
  CASE WHEN {H('doc_id', 6)} = 0 THEN ['cross-cutting', lang] ELSE [lang] END AS tags,
  CASE {H('doc_id', 3)} WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS tier,
  doc_id AS seq FROM documents""")
def _kb(t):
    kind = F.when(h("doc_id", 5) == 0, "deprecation").when(h("doc_id", 5) == 1, "pitfall").otherwise("technique")
    return t.documents.select(
        F.when(h("doc_id", 9) != 0, F.concat(F.lit("k"), F.floor(F.col("doc_id") / 2).cast("string"))).alias("id"),
        F.col("text").alias("title"), F.col("text").alias("body"), F.col("source").alias("category"),
        F.col("lang").alias("area"), F.date_add(F.lit("2024-01-01").cast("date"), h("doc_id", 40).cast("int")).alias("added_date"),
        kind.alias("kind"),
        F.when(h("doc_id", 6) == 0, F.array(F.lit("cross-cutting"), F.col("lang"))).otherwise(F.array("lang")).alias("tags"),
        (h("doc_id", 3) + 1).cast("int").alias("tier"), F.col("doc_id").alias("seq"))


# One dataset per user: its column names are derived from what the user did.
@view("catalog_columns", f"""SELECT DISTINCT user_id AS dataset, event_type || CASE {H('event_id', 6)} WHEN 0 THEN '_id' WHEN 1 THEN '_outcome' WHEN 2 THEN '_price' WHEN 3 THEN '_end_date' WHEN 4 THEN '_label' ELSE '' END AS "column" FROM events""")
def _catalog_columns(t):
    k = h("event_id", 6)
    tail = F.when(k == 0, "_id").when(k == 1, "_outcome").when(k == 2, "_price").when(k == 3, "_end_date").when(k == 4, "_label").otherwise("")
    return t.events.select(F.col("user_id").alias("dataset"), F.concat("event_type", tail).alias("column")).distinct()


# Two raters per document.
@view("ratings", f"""SELECT doc_id AS item, {H('doc_id', 4)} AS a,
  CASE WHEN {H('doc_id * 7', 10)} < 7 THEN {H('doc_id', 4)} ELSE {H('doc_id * 11', 4)} END AS b FROM documents""")
def _ratings(t):
    same = h(F.col("doc_id") * 7, 10) < 7
    return t.documents.select(F.col("doc_id").alias("item"), h("doc_id", 4).alias("a"),
                              F.when(same, h("doc_id", 4)).otherwise(h(F.col("doc_id") * 11, 4)).alias("b"))
