"""Generic relational categories, in the form a Spark user writes them."""

from pyspark.sql import functions as F, Window as W

from sparkloom.functions.exprs import hash_bucket, rnd
from sparkloom.operators import ordered as o, quantiles as q
from sparkloom.plans.catalog import query
from sparkloom.plans.fea import ASOF, asof_clicks
from sparkloom.plans.views import H


def numeric_columns(df):
    return [c for c, k in df.dtypes if k in ("bigint", "int", "double", "float") or k.startswith("decimal")]


@query("rel_01", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem")
def rel_01(t):
    return t.lineitem.select(*numeric_columns(t.lineitem)).drop("l_tax")


@query("rel_02", "SELECT event_id, value FROM events_null WHERE value IS NOT NULL AND event_type <> 'view' AND value > 100", "events_null")
def rel_02(t):
    return t.events_null.where("value IS NOT NULL AND event_type <> 'view' AND value > 100").select("event_id", "value")


@query("rel_03", "SELECT event_id, round(m, 4) AS mean FROM events_null LEFT JOIN (SELECT event_type, avg(value) AS m FROM events_null GROUP BY 1) USING (event_type)", "events_null")
def rel_03(t):
    means = t.events_null.groupBy("event_type").agg(F.avg("value").alias("m"))
    return t.events_null.join(means, "event_type", "left").select("event_id", rnd(F.col("m")).alias("mean"))


@query("rel_04", """SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_orders, coalesce(b.n, 0) AS n_big FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a
  FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1) b ON a.k = b.k""")
def rel_04(t):
    a = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"))
    b = t.orders.where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_big"))
    return a.join(b, "k", "full").fillna(0)


@query("rel_05", "SELECT count(*) AS n, round(corr(value, user_id), 4) AS r FROM events_null WHERE value IS NOT NULL AND event_type IS NOT NULL", "events_null")
def rel_05(t):
    both = t.events_null.where("value IS NOT NULL AND event_type IS NOT NULL")
    return both.agg(F.count("*").alias("n"), rnd(F.corr("value", "user_id")).alias("r"))


@query("rel_06", ASOF)
def rel_06(t):
    return asof_clicks(t)


BANDS = [(0.0, 10.0, "low"), (10.0, 50.0, "mid"), (50.0, 150.0, "high"), (150.0, 1e9, "top")]


@query("rel_07", "SELECT band, count(*) AS n, round(sum(value), 2) AS total FROM events JOIN (VALUES (0.0, 10.0, 'low'), (10.0, 50.0, 'mid'), (50.0, 150.0, 'high'), (150.0, 1e9, 'top')) b(lo, hi, band) ON value >= lo AND value < hi GROUP BY 1")
def rel_07(t):
    """Range join against a fixed band table, written as a lookup in the band list."""
    bands = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"), F.lit(n).alias("band")) for a, b, n in BANDS])
    hit = F.filter(bands, lambda b: (F.col("value") >= b["lo"]) & (F.col("value") < b["hi"]))
    return t.events.select("value", F.inline(hit)).groupBy("band").agg(F.count("*").alias("n"), rnd(F.sum("value"), 2).alias("total"))


@query("rel_08", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def rel_08(t):
    big = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(big, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("rel_09", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def rel_09(t):
    open_ = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(open_, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("rel_10", "SELECT event_id, c_mktsegment AS segment FROM events JOIN customer ON user_id = c_custkey")
def rel_10(t):
    from sparkloom.streaming.streams import replay

    segments = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return replay(t.spark, t.path("events"), lambda s: s.join(segments, "user_id").select("event_id", "segment"))


@query("rel_11", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS n_parts, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY 1")
def rel_11(t):
    n = t.lineitem.count()
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("n_parts"), rnd(F.count("*") / F.lit(float(n)), 6).alias("share"))


@query("rel_12", """SELECT p_type, p_brand, CAST(grouping(p_type) * 2 + grouping(p_brand) AS BIGINT) AS level, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY CUBE (p_type, p_brand)
  UNION ALL SELECT p_type, p_brand, 10 + CAST(grouping(p_type) * 2 + grouping(p_brand) AS BIGINT), round(sum(l_quantity), 2) FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ROLLUP (p_type, p_brand)""")
def rel_12(t):
    both = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "p_brand").agg(F.sum("l_extendedprice").alias("e"), F.sum("l_quantity").alias("q"))
    a = both.cube("p_type", "p_brand").agg(F.grouping_id().alias("level"), rnd(F.sum("e"), 2).alias("revenue"))
    b = both.rollup("p_type", "p_brand").agg((F.grouping_id() + 10).alias("level"), rnd(F.sum("q"), 2).alias("revenue"))
    return a.unionByName(b)


@query("rel_13", "SELECT event_type, round(quantile_cont(value, 0.1), 5) AS p10, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.9), 5) AS p90 FROM events GROUP BY 1")
def rel_13(t):
    out = q.grouped_quantiles(t.events, ["event_type"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return out.select("event_type", *[rnd(F.col(c), 5).alias(c) for c in ("p10", "p50", "p90")])


@query("rel_14", """SELECT user_id, row_number() OVER (ORDER BY total DESC, user_id) AS place, CAST(ntile(5) OVER (ORDER BY total DESC, user_id) AS INTEGER) AS fifth FROM (SELECT user_id, round(sum(value), 2) AS total FROM events GROUP BY 1)""")
def rel_14(t):
    totals = t.events.groupBy("user_id").agg((-F.round(F.sum("value"), 2)).alias("total"))
    n = totals.count()
    return o.row_numbers(totals, [], ["total", "user_id"], "place").select("user_id", "place", o.tile_of(F.col("place"), n, 5).alias("fifth"))


@query("rel_15", """SELECT event_id, lag(value) OVER w AS prev, lead(value) OVER w AS next, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS total,
  first_value(value) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def rel_15(t):
    d = t.events.select("event_id", "user_id", "ts", "value")
    a = o.previous(d, ["user_id"], ["ts", "event_id"], {"prev": "value"})
    b = o.following(a, ["user_id"], ["ts", "event_id"], {"next": "value"})
    c = o.running(b, ["user_id"], ["ts", "event_id"], {"total": o.Spec("sum", F.col("value"))})
    firsts = t.events.groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("first"))
    return c.join(firsts, "user_id").select("event_id", "prev", "next", rnd(F.col("total"), 2).alias("total"), "first")


@query("rel_16", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def rel_16(t):
    return t.events.orderBy(F.desc("value"), "event_id").limit(20).select("event_id", "value")


@query("rel_17", "SELECT event_type, event_id, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 5")
def rel_17(t):
    w = W.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return t.events.withColumn("k", F.row_number().over(w)).where("k <= 5").select("event_type", "event_id", "k")


@query("rel_18", "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def rel_18(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("rel_19", "SELECT 'both' AS part, user_id, event_type FROM (SELECT user_id, event_type FROM ref_half INTERSECT SELECT user_id, event_type FROM cur_half) UNION ALL SELECT 'gone', user_id, event_type FROM (SELECT user_id, event_type FROM ref_half EXCEPT ALL SELECT user_id, event_type FROM cur_half)",
       ("ref_half", "cur_half"))
def rel_19(t):
    a, b = (d.select("user_id", "event_type") for d in (t.ref_half, t.cur_half))
    return a.intersect(b).withColumn("part", F.lit("both")).unionByName(a.exceptAll(b).withColumn("part", F.lit("gone")))


@query("rel_20", "SELECT grp, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1 FROM preds GROUP BY 1", "preds")
def rel_20(t):
    wide = t.preds.groupBy("grp").pivot("pred", [0, 1]).count().fillna(0)
    return wide.withColumnsRenamed({"0": "pred_0", "1": "pred_1"})


@query("rel_21", "SELECT o_orderkey, 'o_totalprice' AS name, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'o_custkey', o_custkey::DOUBLE FROM orders")
def rel_21(t):
    return t.orders.select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double")).unpivot("o_orderkey", ["o_totalprice", "o_custkey"], "name", "value")


@query("rel_22", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def rel_22(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("rel_23", f"SELECT event_id, value FROM events ORDER BY {H('event_id', 1 << 31)}, event_id LIMIT 500")
def rel_23(t):
    return t.events.orderBy(hash_bucket("event_id", 1 << 31), "event_id").limit(500).select("event_id", "value")


@query("rel_24", r"""SELECT p_partkey, upper(p_name) AS up, replace(p_name, ' ', '_') AS joined, split_part(p_name, ' ', 1) AS word, contains(lower(p_type), 'e') AS has_e, trim('  ' || p_brand || ' ') AS brand,
  regexp_extract(p_brand, '([0-9]+)', 1) AS digits FROM part""")
def rel_24(t):
    return t.part.select("p_partkey", F.upper("p_name").alias("up"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("joined"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"),
                         F.contains(F.lower("p_type"), F.lit("e")).alias("has_e"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("brand"),
                         F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"))


@query("rel_25", "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dow, count(*) AS n FROM orders GROUP BY 1, 2")
def rel_25(t):
    return t.orders.groupBy(F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM").alias("month"), F.weekday("o_orderdate").alias("dow")).agg(F.count("*").alias("n"))


@query("rel_26", "SELECT event_id, round(ln(1 + value), 6) AS l, round(sqrt(value), 6) AS s, round(pow(value, 1.5), 4) AS p, greatest(least(value, 100), 5) AS c, round(abs(value - 50), 4) AS a FROM events")
def rel_26(t):
    v = F.col("value")
    return t.events.select("event_id", rnd(F.log1p(v), 6).alias("l"), rnd(F.sqrt(v), 6).alias("s"), rnd(F.pow(v, 1.5)).alias("p"),
                           F.greatest(F.least(v, F.lit(100.0)), F.lit(5.0)).alias("c"), rnd(F.abs(v - 50)).alias("a"))


@query("rel_27", "SELECT doc_id, CAST(len(list_distinct(string_split(text, ' '))) AS INTEGER) AS n_words, list_max(list_transform(string_split(text, ' '), lambda w: length(w))) AS longest, list_contains(string_split(text, ' '), 'the') AS has_the FROM documents")
def rel_27(t):
    words = F.split("text", " ")
    return t.documents.select("doc_id", F.size(F.array_distinct(words)).alias("n_words"), F.array_max(F.transform(words, lambda w: F.length(w))).cast("bigint").alias("longest"),
                              F.array_contains(words, "the").alias("has_the"))


@query("rel_28", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def rel_28(t):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))
