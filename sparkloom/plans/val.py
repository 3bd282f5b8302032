"""Validation queries."""

from pyspark.sql import functions as F

from sparkloom.functions.exprs import hash_bucket
from sparkloom.operators import gates as g, profile as p
from sparkloom.plans.catalog import query
from sparkloom.plans.prf import DUP, EN, union
from sparkloom.plans.views import H

OT = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "c_nationkey",
      "c_acctbal", "c_mktsegment", "y", "target"]
LEAKS = ["o_totalprice", "c_acctbal", "c_nationkey", "target"]


def row(name, metric, fails, limit, status, detail, source):
    return (f"SELECT '{name}' AS \"check\", CASE WHEN {fails} THEN '{status}' ELSE 'PASS' END AS status, "
            f"round(CAST({metric} AS DOUBLE), 4) AS metric, CAST({limit} AS DOUBLE) AS threshold, {detail} AS detail {source}")


def leak_sql(columns, target, table, limit=0.99, op=">=", name="leakage"):
    inner = union(f"SELECT '{{c}}' AS c, round(abs(corr({{c}}, {target})), 12) AS r FROM {table}", columns)
    return row(name, "max(r)", f"bool_or(r {op} {limit})", limit, "HARD_STOP",
               f"coalesce(string_agg(c, ',' ORDER BY c) FILTER (r {op} {limit}), '')", f"FROM ({inner})")


FEW = row("few_rows", "count(*)", "count(*) < 50", 50, "HARD_STOP", "''", "FROM orders_target")
CONST_T = row("constant_target", "count(DISTINCT y)", "count(DISTINCT y) <= 1", 1, "HARD_STOP", "'y'", "FROM orders_target")
IMB = row("imbalance", "max(n) / min(n)", "count(*) <= 20 AND max(n) / min(n) > 10", 10, "WARNING", "'{t}'",
          "FROM (SELECT {t}, count(*)::DOUBLE AS n FROM {v} GROUP BY {t})")


def cols_sql(table, columns, keep, rule):
    inner = union(f"SELECT '{{c}}' AS c, count(*) AS n, count({{c}}) AS v, count(DISTINCT {{c}}) AS d FROM {table}", columns)
    name, cond, limit = {
        "mostly_missing": ("mostly_missing", "100.0 * (n - v) / n > 50", 50),
        "constant_column": ("constant_column", "d <= 1", 1),
        "id_like": ("id_like", f"d / n > 0.95 AND n > 100 AND c <> '{keep}'", 0.95)}[rule]
    return row(name, f"count(*) FILTER ({cond})", f"count(*) FILTER ({cond}) > 0", limit, "WARNING",
               f"coalesce(string_agg(c, ',' ORDER BY c) FILTER ({cond}), '')", f"FROM ({inner})")


def dup_sql(table, columns):
    return row("duplicate_rows", "100.0 * sum(n - 1) / sum(n)", "round(100.0 * sum(n - 1) / sum(n), 4) > 5", 5, "WARNING",
               "CAST(CAST(sum(n - 1) AS BIGINT) AS VARCHAR)", f"FROM (SELECT count(*) AS n FROM {table} GROUP BY {', '.join(columns)})")


@query("val_01", FEW, "orders_target")
def val_01(t):
    return g.run_checks(t.orders_target, [g.few_rows()])


@query("val_02", """SELECT dataset, CASE WHEN bool_or("column" = 'purchase_outcome') THEN 'PASS' ELSE 'HARD_STOP' END AS status FROM catalog_columns GROUP BY 1""", "catalog_columns")
def val_02(t):
    return g.targets_exist(t.catalog_columns, "purchase_outcome")


@query("val_03", CONST_T, "orders_target")
def val_03(t):
    return g.run_checks(t.orders_target, [g.constant_target("y")])


@query("val_04", leak_sql(["l_quantity", "l_discount", "l_tax", "leak"], "l_extendedprice", "lineitem_leak"), "lineitem_leak")
def val_04(t):
    return g.run_checks(t.lineitem_leak, [g.leakage(["l_quantity", "l_discount", "l_tax", "leak"], "l_extendedprice")])


@query("val_05", IMB.replace("{t}", "toxic").replace("{v}", "labels") + " UNION ALL "
       + IMB.replace("{t}", "o_orderpriority").replace("{v}", "orders"))
def val_05(t):
    return g.imbalance(t.labels, "toxic").unionByName(g.imbalance(t.orders, "o_orderpriority"))


MISS = f"""gone AS (SELECT event_id, user_id, CASE WHEN {H('event_id', 10)} < 6 THEN NULL ELSE value END AS value FROM events)"""


@query("val_06", "WITH " + MISS + " " + cols_sql("gone", ["event_id", "user_id", "value"], "", "mostly_missing"))
def val_06(t):
    gone = t.events.select("event_id", "user_id", F.when(hash_bucket("event_id", 10) >= 6, F.col("value")).alias("value"))
    return g.column_gates(gone).where("check = 'mostly_missing'")


LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
      "l_returnflag", "l_linestatus", "l_shipdate"]


@query("val_07", dup_sql("lineitem_dup", LI) + " UNION ALL " + row("kept_rows", "count(*)", "false", 0, "WARNING", "''",
       "FROM (SELECT DISTINCT * FROM lineitem_dup)"), "lineitem_dup")
def val_07(t):
    kept = g.run_checks(g.keep_first(t.lineitem_dup), [g.Check("kept_rows", {"_k": F.count("*")},
                        lambda: (F.col("_k"), F.lit(False), F.lit("")), 0, g.WARNING)])
    return g.duplicates(t.lineitem_dup).unionByName(kept)


@query("val_08", "WITH flat AS (SELECT l_orderkey, l_quantity, 1 AS c FROM lineitem) " + cols_sql("flat", ["l_orderkey", "l_quantity", "c"], "", "constant_column"))
def val_08(t):
    flat = t.lineitem.select("l_orderkey", "l_quantity", F.lit(1).alias("c"))
    return g.column_gates(flat).where("check = 'constant_column'")


@query("val_09", cols_sql("orders", OT[:6], "o_totalprice", "id_like"))
def val_09(t):
    return g.column_gates(t.orders, "o_totalprice").where("check = 'id_like'")


ALL = [FEW, CONST_T, leak_sql(LEAKS, "y", "orders_target"), IMB.replace("{t}", "y").replace("{v}", "orders_target"),
       *[cols_sql("orders_target", OT, "y", r) for r in ("mostly_missing", "constant_column", "id_like")],
       dup_sql("orders_target", OT)]


@query("val_10", "WITH checks AS (" + " UNION ALL ".join(ALL) + """)
  SELECT * FROM checks UNION ALL SELECT 'overall', CASE max(s) WHEN 2 THEN 'HARD_STOP' WHEN 1 THEN 'WARNING' ELSE 'PASS' END,
  CAST(max(s) AS DOUBLE), 2.0, CAST(count(*) FILTER (s > 0) AS VARCHAR) || ' of the checks failed'
  FROM (SELECT CASE status WHEN 'HARD_STOP' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END AS s FROM checks)""", "orders_target")
def val_10(t):
    return g.quality_report(t.orders_target, "y", LEAKS)


@query("val_11", r"""SELECT dataset, "column", regexp_matches(lower("column"), '(^|_)(target|label|output|result|outcome)($|_)|^y_|^churn_') AS flagged FROM catalog_columns""", "catalog_columns")
def val_11(t):
    return g.name_flags(t.catalog_columns, g.TARGET_NAMES)


@query("val_12_names", """SELECT dataset, "column", regexp_matches(lower("column"), 'result|outcome|final|total_year|end_date|completion') AS flagged FROM catalog_columns""", "catalog_columns")
def val_12_names(t):
    return g.name_flags(t.catalog_columns, g.FUTURE_NAMES)


@query("val_12", """SELECT count(*) AS n_rows, count(*) FILTER (l_shipdate > o_orderdate) AS n_late,
  round(100.0 * count(*) FILTER (l_shipdate > o_orderdate) / count(*), 4) AS late_pct,
  CASE WHEN count(*) FILTER (l_shipdate > o_orderdate) > 0 THEN 'HARD_STOP' ELSE 'PASS' END AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def val_12(t):
    both = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return g.late_values(both, F.col("l_shipdate"), F.col("o_orderdate"))


@query("val_13", leak_sql(["c_acctbal", "o_totalprice"], "target", "orders_target", 0.95, ">", "post_feature_leakage"), "orders_target")
def val_13(t):
    return g.run_checks(t.orders_target, [g.leakage(["c_acctbal", "o_totalprice"], "target", 0.95, True, "post_feature_leakage")])


@query("val_14", union("""SELECT '{c}' AS "column", count(*) AS n_groups, round((sum(s * s / n) - any_value(gs * gs / gn)) / any_value(gq - gs * gs / gn), 4) AS eta2,
  CASE WHEN round((sum(s * s / n) - any_value(gs * gs / gn)) / any_value(gq - gs * gs / gn), 4) > 0.95 THEN 'HARD_STOP' ELSE 'PASS' END AS status
  FROM (SELECT {c}, sum(target) AS s, count(*) AS n FROM orders_target GROUP BY {c})
  CROSS JOIN (SELECT sum(target) AS gs, sum(target * target) AS gq, count(*) AS gn FROM orders_target)""",
       ["o_custkey", "c_mktsegment", "o_orderpriority"]), "orders_target")
def val_14(t):
    return g.proxy_strength(t.orders_target, ["o_custkey", "c_mktsegment", "o_orderpriority"], "target")


@query("val_15", f"""WITH s AS (SELECT *, {H('event_id', 5)} AS f FROM events)
  SELECT 'row' AS level, count(*) AS n, CASE WHEN count(*) > 0 THEN 'HARD_STOP' ELSE 'PASS' END AS status FROM
    (SELECT event_type, props FROM s WHERE f = 0) a SEMI JOIN (SELECT event_type, props FROM s WHERE f <> 0) b USING (event_type, props)
  UNION ALL SELECT 'entity', count(*), CASE WHEN count(*) > 0 THEN 'HARD_STOP' ELSE 'PASS' END FROM
    (SELECT DISTINCT event_type FROM s WHERE f = 0) a SEMI JOIN (SELECT event_type FROM s WHERE f <> 0) b USING (event_type)""")
def val_15(t):
    fold = hash_bucket("event_id", 5)
    cols = ["event_type", "props"]
    return g.contamination(t.events.where(fold != 0).select(*cols), t.events.where(fold == 0).select(*cols), "event_type")


@query("val_16", row("samples_per_feature", "count(*)", "count(*) <= 60", 60, "WARNING", "'6'", "FROM orders"))
def val_16(t):
    return g.enough_samples(t.orders, t.orders.columns)


@query("val_17", "SELECT \"column\", null_pct, CASE WHEN null_pct = 0 THEN 'keep' WHEN null_pct < 5 THEN 'drop_rows' WHEN null_pct <= 30 THEN 'impute' ELSE 'drop_or_flag_column' END AS action FROM ("
       + union("SELECT '{c}' AS \"column\", round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_pct FROM events_null", EN) + ")", "events_null")
def val_17(t):
    return g.missing_policy(p.column_summary(t.events_null))


@query("val_18", """SELECT 'l_quantity' AS "column", 1.0::DOUBLE AS low, 45.0::DOUBLE AS high, count(l_quantity) AS n_valid,
  count(*) FILTER (l_quantity NOT BETWEEN 1 AND 45) AS n_outside FROM lineitem
  UNION ALL SELECT 'l_discount', 0.0, 0.05, count(l_discount), count(*) FILTER (l_discount NOT BETWEEN 0 AND 0.05) FROM lineitem""")
def val_18(t):
    return g.range_violations(t.lineitem, {"l_quantity": (1, 45), "l_discount": (0, 0.05)})


@query("val_19", """SELECT 'value' AS "column", a.n AS nulls_before, a.lo AS min_before, a.hi AS max_before, b.n AS nulls_after,
  b.lo AS min_after, b.hi AS max_after, CASE WHEN b.n > a.n THEN 'HARD_STOP' ELSE 'PASS' END AS status FROM
  (SELECT count(*) FILTER (value IS NULL) AS n, round(min(value), 4) AS lo, round(max(value), 4) AS hi FROM events_null) a,
  (SELECT count(*) FILTER (x IS NULL) AS n, round(min(x), 4) AS lo, round(max(x), 4) AS hi FROM
   (SELECT CASE WHEN value >= 20 THEN ln(1 + value) END AS x FROM events_null)) b""", "events_null")
def val_19(t):
    after = t.events_null.withColumn("value", F.when(F.col("value") >= 20, F.log1p("value")))
    return g.stage_contract(t.events_null, after, ["value"])


@query("val_20", union("""SELECT '{c}' AS "column", a.p AS baseline_pct, b.p AS current_pct,
  CASE WHEN b.p > 30 THEN 'BLOCK' WHEN b.p > 20 THEN 'ALERT' ELSE 'PASS' END AS status FROM
  (SELECT round(100.0 * (count(*) - count({c})) / count(*), 4) AS p FROM events) a,
  (SELECT round(100.0 * (count(*) - count({c})) / count(*), 4) AS p FROM events_null) b""", EN), "events_null")
def val_20(t):
    return g.missing_drift(p.column_summary(t.events), p.column_summary(t.events_null))
