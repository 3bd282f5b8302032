"""Profiling queries."""

from pyspark.sql import functions as F

from sparkloom.functions import patterns
from sparkloom.operators import profile as p
from sparkloom.plans.catalog import query

EN = ["event_id", "ts", "user_id", "event_type", "value", "props"]
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def union(template: str, columns, glue=" UNION ALL ") -> str:
    return glue.join(template.replace("{c}", c) for c in columns)


TARGETS = [("orders", "o_orderstatus", None), ("orders", "o_totalprice", None), ("orders", "o_totalprice", "o_orderdate"),
           ("labels", "quality", None), ("orders", None, None)]


def _target_sql(table, target, time):
    if target is None:
        return "SELECT '' AS target, '' AS time_column, 'clustering' AS problem_type"
    text = "true" if target == "o_orderstatus" else "false"
    last = "time_series" if time else "regression"
    return (f"SELECT '{target}' AS target, '{time or ''}' AS time_column, CASE WHEN count(DISTINCT {target}) <= 1 THEN 'constant_target' "
            f"WHEN count(DISTINCT {target}) = 2 THEN 'binary' WHEN {text} OR count(DISTINCT {target}) <= 20 THEN 'multiclass' "
            f"ELSE '{last}' END AS problem_type FROM {table}")


@query("prf_01", " UNION ALL ".join(_target_sql(*x) for x in TARGETS))
def prf_01(t):
    rows = [(c or "", ts or "", p.problem_type(getattr(t, tab), c, ts)) for tab, c, ts in TARGETS]
    return t.spark.createDataFrame(rows, "target string, time_column string, problem_type string")


@query("prf_02", f"""SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_cols, CAST({union('count(*) - count({c})', EN, ' + ')} AS BIGINT) AS n_missing,
  round(100.0 * ({union('count(*) - count({c})', EN, ' + ')}) / (6 * count(*)), 4) AS missing_pct FROM events_null""", "events_null")
def prf_02(t):
    return p.table_shape(t.events_null)


PRF_03 = union("""SELECT '{c}' AS column, count(*) AS n_rows, count(*) - count({c}) AS n_null,
  round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_pct, count(DISTINCT {c}) AS n_unique,
  round(1.0 * count(DISTINCT {c}) / count(*), 4) AS cardinality FROM events_null""", EN)


@query("prf_03", PRF_03, "events_null")
def prf_03(t):
    return p.column_summary(t.events_null)


def top_sql(columns, table, k):
    one = """SELECT * FROM (SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, count(*) AS n,
      CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INTEGER) AS rank
      FROM %s WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= %d""" % (table, k)
    return union(one, columns)


@query("prf_04", top_sql(["o_orderstatus", "o_orderpriority", "o_custkey"], "orders", 10))
def prf_04(t):
    return p.top_values(t.orders, ["o_orderstatus", "o_orderpriority", "o_custkey"], 10)


@query("prf_05", """SELECT 'l_shipdate' AS column, strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') AS min,
  strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS max, CAST(NULL AS DOUBLE) AS true_pct FROM lineitem
  UNION ALL SELECT 'returned', NULL, NULL, round(100.0 * avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END), 4) FROM lineitem""")
def prf_05(t):
    dates = p.datetime_summary(t.lineitem, ["l_shipdate"]).withColumn("true_pct", F.lit(None).cast("double"))
    flags = p.boolean_summary(t.lineitem, {"returned": F.col("l_returnflag") == "R"})
    return dates.unionByName(flags, allowMissingColumns=True)


def numeric_sql(columns, table, whole, keep):
    cells = {
        "n": "count(*)", "n_valid": "count(x)", "null_pct": "round(100.0 * (count(*) - count(x)) / count(*), 4)",
        "mean": "round(avg(x), 4)", "std": "round(stddev_samp(x), 4)", "min": "round(min(x), 4)",
        "p5": "round(any_value(q5), 4)", "p25": "round(any_value(q25), 4)", "median": "round(any_value(q50), 4)",
        "p75": "round(any_value(q75), 4)", "p95": "round(any_value(q95), 4)", "max": "round(max(x), 4)",
        "skewness": "round(skewness(x), 4)", "kurtosis": "round(kurtosis(x), 4)",
        "iqr_lower": "round(any_value(q25 - 1.5 * (q75 - q25)), 4)", "iqr_upper": "round(any_value(q75 + 1.5 * (q75 - q25)), 4)",
        "n_outliers": "count(CASE WHEN x < q25 - 1.5 * (q75 - q25) OR x > q75 + 1.5 * (q75 - q25) THEN 1 END)",
        "outlier_pct": f"round(100.0 * count(CASE WHEN x < q25 - 1.5 * (q75 - q25) OR x > q75 + 1.5 * (q75 - q25) THEN 1 END) / {whole}, 4)"}
    pick = ", ".join(f"{cells[k]} AS {k}" for k in keep)
    return union(f"""SELECT '{{c}}' AS column, {pick} FROM (SELECT CAST({{c}} AS DOUBLE) AS x, q5, q25, q50, q75, q95 FROM {table}
      CROSS JOIN (SELECT quantile_cont(CAST({{c}} AS DOUBLE), 0.05) AS q5, quantile_cont(CAST({{c}} AS DOUBLE), 0.25) AS q25,
      quantile_cont(CAST({{c}} AS DOUBLE), 0.5) AS q50, quantile_cont(CAST({{c}} AS DOUBLE), 0.75) AS q75,
      quantile_cont(CAST({{c}} AS DOUBLE), 0.95) AS q95 FROM {table}))""", columns)


KEEP6 = ["mean", "std", "min", "p25", "median", "p75", "max", "skewness", "n_outliers", "outlier_pct"]


@query("prf_06", numeric_sql(NUM, "lineitem", "count(*)", KEEP6))
def prf_06(t):
    return p.numeric_summary(t.lineitem, NUM).select("column", *KEEP6)


CORR = ["o_totalprice", "o_custkey", "c_acctbal", "c_nationkey", "y"]


@query("prf_07", "SELECT * FROM (" + union("SELECT '{c}' AS column, round(corr({c}, target), 4) AS r FROM orders_target", CORR)
       + ") WHERE abs(r) > 0.05", "orders_target")
def prf_07(t):
    return p.target_correlations(t.orders_target, CORR, "target")


@query("prf_08", """SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share
  FROM orders GROUP BY 1""")
def prf_08(t):
    return p.class_balance(t.orders, "o_orderpriority")


DUP = """SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates, round(100.0 * sum(n - 1) / sum(n), 4) AS duplicate_pct
  FROM (SELECT count(*) AS n FROM lineitem_dup GROUP BY ALL, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)""".replace("GROUP BY ALL,", "GROUP BY")


@query("prf_09", DUP, "lineitem_dup")
def prf_09(t):
    return p.duplicate_rows(t.lineitem_dup)


def _date_sql(table, texts, others):
    parts = []
    for c in texts + others:
        named = "date" in c or "time" in c
        part = f"coalesce(avg(CAST(regexp_matches({c}, '{patterns.DATE_LIKE}') AS INTEGER)), 0.0)" if c in texts else "0.0::DOUBLE"
        parts.append(f"SELECT '{c}' AS column, {str(named).lower()} AS by_name, round({part}, 4) AS match_share, "
                     f"{str(named).lower()} OR {part} > 0.7 AS date_like FROM (SELECT * FROM {table})" +
                     ("" if c in texts else " LIMIT 1"))
    return " UNION ALL ".join(f"({x})" for x in parts)


@query("prf_10", "WITH dated AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS placed, o_orderdate, o_orderpriority FROM orders)\n"
       + _date_sql("dated", ["placed", "o_orderpriority"], ["o_orderkey", "o_orderdate"]))
def prf_10(t):
    dated = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("placed"), "o_orderdate", "o_orderpriority")
    return p.datelike_columns(dated)


@query("prf_11", "SELECT \"column\", n_unique, cardinality FROM (" + union("""SELECT '{c}' AS column, count(*) AS n, count(DISTINCT {c}) AS n_unique,
  round(1.0 * count(DISTINCT {c}) / count(*), 4) AS cardinality FROM orders""",
  ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]) + ") WHERE n_unique / n > 0.95 AND n > 100")
def prf_11(t):
    return p.idlike_columns(t.orders)


def pattern_sql(table, c, battery):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column, '{n}' AS pattern, count(CASE WHEN regexp_matches({c}, '{rx}') THEN 1 END) AS n_rows, "
        f"round(avg(CASE WHEN regexp_matches({c}, '{rx}') THEN 1.0 ELSE 0 END), 4) AS share FROM {table}" for n, rx in battery.items())


@query("prf_12", pattern_sql("documents", "text", patterns.SEMANTIC) + " UNION ALL " + pattern_sql("pages", "html", patterns.SEMANTIC))
def prf_12(t):
    return p.pattern_shares(t.documents, ["text"], patterns.SEMANTIC).unionByName(
        p.pattern_shares(t.pages, ["html"], patterns.SEMANTIC))


@query("prf_13", pattern_sql("documents", "text", patterns.PERSONAL))
def prf_13(t):
    return p.pattern_shares(t.documents, ["text"], patterns.PERSONAL)
