"""Split and sampling queries."""

from pyspark.sql import functions as F

from sparkloom.functions.exprs import rnd
from sparkloom.operators import splits as s
from sparkloom.plans.catalog import query
from sparkloom.plans.views import H

HASHED = f"(SELECT *, row_number() OVER (PARTITION BY {{c}} ORDER BY {H('o_orderkey', 1 << 31)}, o_orderkey) AS rn FROM orders_target)"


@query("spl_01", f"SELECT o_orderkey, CASE WHEN {H('o_orderkey', 1000)} < 200 THEN 'test' ELSE 'train' END AS part FROM orders")
def spl_01(t):
    return s.hash_split(t.orders, "o_orderkey").select("o_orderkey", "part")


@query("spl_02", f"SELECT o_orderkey, o_orderpriority, CASE WHEN rn <= round(0.2 * n) THEN 'test' ELSE 'train' END AS part FROM {HASHED.format(c='o_orderpriority')} JOIN (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) USING (o_orderpriority)", "orders_target")
def spl_02(t):
    return s.stratified_split(t.orders_target, "o_orderkey", "o_orderpriority").select("o_orderkey", "o_orderpriority", "part")


@query("spl_03", f"SELECT o_orderkey, CAST(rn % 5 AS INTEGER) AS fold FROM {HASHED.format(c='y')}", "orders_target")
def spl_03(t):
    return s.stratified_folds(t.orders_target, "o_orderkey", "y").select("o_orderkey", "fold")


@query("spl_04", f"SELECT event_id, CAST({H('user_id', 5)} AS INTEGER) AS fold FROM events")
def spl_04(t):
    return s.group_folds(t.events, "user_id").select("event_id", "fold")


CUTS = ["2024-01-10", "2024-01-17", "2024-01-24", "2024-01-31"]


@query("spl_05", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT event_id, {i} AS step, CASE WHEN ts < TIMESTAMP '{a}' - INTERVAL 1 DAY THEN 'train' WHEN ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}' THEN 'test' END AS part FROM events"
    for i, (a, b) in enumerate(zip(CUTS, CUTS[1:]))) + ") WHERE part IS NOT NULL")
def spl_05(t):
    return s.walk_forward(t.events.select("event_id", "ts"), "ts", CUTS, "1 DAY").select("event_id", "step", "part")


@query("spl_06", f"SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-20' AND {H('user_id', 5)} <> 0 THEN 'train' WHEN ts >= TIMESTAMP '2024-01-20' AND {H('user_id', 5)} = 0 THEN 'test' ELSE 'unused' END AS part FROM events")
def spl_06(t):
    return s.time_and_user_split(t.events, "ts", "2024-01-20", "user_id").select("event_id", "part")


@query("spl_07", f"SELECT count(*) AS n_rows, CAST(sum({H('o_orderkey || chr(124) || o_orderstatus', 1 << 31)}) % 1000000007 AS BIGINT) AS fingerprint FROM orders WHERE {H('o_orderkey', 1000)} < 200")
def spl_07(t):
    return s.sentinel(s.hash_split(t.orders, "o_orderkey").where("part = 'test'"), "o_orderkey", ["o_orderkey", "o_orderstatus"])


@query("spl_08", "SELECT y, round(any_value(w), 6) AS weight, count(*) AS n FROM (SELECT y, (count(*) OVER ())::DOUBLE / (2 * count(*) OVER (PARTITION BY y)) AS w FROM orders_target) GROUP BY y", "orders_target")
def spl_08(t):
    return s.class_weights(t.orders_target, "y").groupBy("y").agg(rnd(F.max("weight"), 6).alias("weight"), F.count("*").alias("n"))


BAG = """SELECT o_orderkey, y, {b} AS bag FROM orders_target, (SELECT CAST(round(1000 * least(1.0, 0.5 * count(*) FILTER (y = 1) / count(*) FILTER (y = 0))) AS BIGINT) AS r FROM orders_target)
  WHERE y = 1 OR {h} < r"""


@query("spl_09", " UNION ALL ".join(BAG.format(b=b, h=H(f"o_orderkey || '-{b}'", 1000)) for b in (0, 1)), "orders_target")
def spl_09(t):
    a, b = (s.undersample(t.orders_target, "o_orderkey", "y", 0.5, bag) for bag in (0, 1))
    return a.unionByName(b).select("o_orderkey", "y", "bag")


@query("spl_10", f"""WITH d AS (SELECT o_orderkey, c_acctbal / 1000 AS a, o_totalprice / 100000 AS b FROM orders_target WHERE y = 1 AND o_orderstatus = 'P'),
  p AS (SELECT x.o_orderkey, z.o_orderkey AS other, x.a, x.b, z.a AS za, z.b AS zb, row_number() OVER (PARTITION BY x.o_orderkey ORDER BY sqrt((x.a - z.a) ** 2 + (x.b - z.b) ** 2), z.o_orderkey) AS r FROM d x JOIN d z ON x.o_orderkey <> z.o_orderkey),
  u AS (SELECT *, {H("o_orderkey || '-' || other", 1000)} / 1000.0::DOUBLE AS u FROM p WHERE r <= 3)
  SELECT o_orderkey, other, round(a + u * (za - a), 10) AS a, round(b + u * (zb - b), 10) AS b FROM u""", "orders_target")
def spl_10(t):
    d = t.orders_target.select("o_orderkey", (F.col("c_acctbal") / 1000).alias("a"), (F.col("o_totalprice") / 100000).alias("b"),
                               F.expr("cast(y = 1 and o_orderstatus = 'P' as int)").alias("y"))
    made = s.smote(d, "o_orderkey", "y", ["a", "b"], 3)
    return made.select("o_orderkey", "other", F.round("a", 10).alias("a"), F.round("b", 10).alias("b"))


def _poisson_sql(rep):
    u = f"(('0x' || substr(md5(event_id || chr(35) || {rep}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
    return "CASE " + " ".join(f"WHEN {u} < {p!r}::DOUBLE THEN {i}" for i, p in enumerate(s.POISSON)) + f" ELSE {len(s.POISSON)} END"


@query("spl_11", " UNION ALL ".join(f"SELECT {r} AS rep, round(sum(w * value) / sum(w), 4) AS mean FROM (SELECT value, {_poisson_sql(r)} AS w FROM events)" for r in range(20)))
def spl_11(t):
    return s.bootstrap_means(t.events, "event_id", "value", 20).select("rep", rnd(F.col("mean")).alias("mean"))


@query("spl_12", f"""WITH it AS (SELECT s_suppkey AS l_suppkey, row_number() OVER (ORDER BY md5(CAST(s_suppkey AS VARCHAR)), s_suppkey) - 1 AS n FROM supplier),
  k AS (SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey), u AS (SELECT o_custkey, count(*) AS k, (SELECT count(*) FROM it) - count(*) AS free FROM k GROUP BY 1),
  f AS (SELECT u.*, it.l_suppkey, row_number() OVER (PARTITION BY u.o_custkey ORDER BY it.n) - 1 AS j FROM u CROSS JOIN it LEFT JOIN k ON k.o_custkey = u.o_custkey AND k.l_suppkey = it.l_suppkey WHERE k.l_suppkey IS NULL)
  SELECT o_custkey, l_suppkey FROM f WHERE (j - {H("o_custkey", 1 << 31)} % free + free) % free < k""")
def spl_12(t):
    pairs = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return s.negative_pairs(pairs, "o_custkey", "l_suppkey", t.supplier.withColumnRenamed("s_suppkey", "l_suppkey"))
