"""Exploration queries."""

from itertools import combinations

from pyspark.sql import functions as F

from sparkloom.functions.exprs import rnd
from sparkloom.operators import explore as x, profile as p
from sparkloom.plans.catalog import query
from sparkloom.plans.prf import EN, NUM, numeric_sql, top_sql, union

KEEP = ["n", "n_valid", "null_pct", "mean", "std", "min", "p5", "p25", "median", "p75", "p95", "max", "skewness", "kurtosis",
        "n_outliers", "outlier_pct", "iqr_lower", "iqr_upper"]


@query("eda_01", numeric_sql(["value"], "events_null", "count(x)", KEEP) + " UNION ALL " + numeric_sql(["l_quantity", "l_extendedprice"], "lineitem", "count(x)", KEEP), "events_null")
def eda_01(t):
    a = p.numeric_summary(t.events_null, ["value"], "valid")
    return a.unionByName(p.numeric_summary(t.lineitem, ["l_quantity", "l_extendedprice"], "valid")).select("column", *KEEP)


REC = """SELECT "column", concat_ws(',', CASE WHEN null_pct >= 30 THEN 'advanced_imputation_needed' WHEN null_pct > 0 THEN 'median_imputation' END,
  CASE WHEN abs(skewness) > 1 THEN CASE WHEN min > 0 THEN 'log_transform' ELSE 'yeo_johnson_transform' END END,
  CASE WHEN n_outliers > 0 THEN 'clip_outliers' END, 'standard_scaling') AS transforms,
  CASE WHEN null_pct >= 30 THEN 'indicator_feature,knn_imputation' ELSE '' END AS engineering FROM ("""


@query("eda_02", REC + numeric_sql(["value", "user_id"], "events_null", "count(x)", KEEP) + ")", "events_null")
def eda_02(t):
    return x.recommend_numeric(p.numeric_summary(t.events_null, ["value", "user_id"], "valid"))


def hist_sql(c, table, bins=None):
    k = bins or "least(50, greatest(10, count(x) // 20))"
    return f"""SELECT bin, round(any_value(lo) + bin * (any_value(hi - lo) / any_value(k)), 4) AS low_edge, count(*) AS n FROM (
      SELECT lo, hi, k, CAST(least(floor((x - lo) * k / (hi - lo)), k - 1) AS BIGINT) AS bin FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {table})
      CROSS JOIN (SELECT min(x) AS lo, max(x) AS hi, {k} AS k FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {table})) WHERE x IS NOT NULL) GROUP BY bin"""


@query("eda_03", hist_sql("value", "events"))
def eda_03(t):
    return x.histogram(t.events, "value")


@query("eda_04", """WITH b AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) * pow(count(value), -0.2) AS h FROM events), s AS (SELECT *, ceil(20 * (hi - lo) / h) AS k FROM b),
  c AS (SELECT least(floor((value - lo) * k / (hi - lo)), k - 1) AS cell, count(*) AS m FROM events, s GROUP BY 1)
  SELECT round(lo + i * ((hi - lo) / 49), 6) AS x, round(sum(m * exp(-0.5 * pow((lo + i * ((hi - lo) / 49) - (lo + (cell + 0.5) * ((hi - lo) / k))) / h, 2))
  / (h * n) / sqrt(2 * pi())), 6) AS density FROM c, s, (SELECT unnest(generate_series(0, 49)) AS i) GROUP BY lo, hi, i""")
def eda_04(t):
    return x.density_curve(t.events, "value")


@query("eda_05", union("""SELECT '{c}' AS "column", round(min(x) FILTER (x >= a - 1.5 * (b - a)), 4) AS whisker_low, round(any_value(a), 4) AS q1,
  round(any_value(m), 4) AS median, round(any_value(b), 4) AS q3, round(max(x) FILTER (x <= b + 1.5 * (b - a)), 4) AS whisker_high
  FROM (SELECT {c} AS x FROM lineitem), (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.5) AS m, quantile_cont({c}, 0.75) AS b FROM lineitem)""", NUM))
def eda_05(t):
    return x.box_plot(t.lineitem, NUM)


CAT = union("""SELECT '{c}' AS "column", CAST(any_value(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS n_valid, count(*) AS n_unique, round(count(*) / any_value(n), 4) AS cardinality,
  arg_min({c}, (-k, {c})) AS mode, round(100.0 * max(k) / sum(k), 4) AS mode_pct FROM
  (SELECT CAST({c} AS VARCHAR) AS {c}, count(*) AS k FROM events_null WHERE {c} IS NOT NULL GROUP BY 1), (SELECT count(*) AS n FROM events_null)""",
            ["event_type", "props"])


@query("eda_06", CAT + "", "events_null")
def eda_06(t):
    return x.categorical_summary(t.events_null, ["event_type", "props"])


@query("eda_07", """SELECT "column", concat_ws(',', CASE WHEN n_null > 0 THEN 'mode_imputation' END, CASE WHEN n_unique <= 10 THEN 'one_hot_encoding'
  WHEN n_unique <= 50 THEN 'label_encoding' ELSE 'target_encoding' END) AS transforms, CASE WHEN n_unique <= 10 THEN '' WHEN n_unique <= 50
  THEN 'ordinal_groups' ELSE 'frequency_encoding,count_list_items' END AS engineering FROM (""" +
       union("""SELECT '{c}' AS "column", count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_unique FROM events_null""", ["event_type", "props"])
       + """ UNION ALL SELECT 'p_brand', count(*) - count(p_brand), count(DISTINCT p_brand) FROM part)""", "events_null")
def eda_07(t):
    s = p.column_summary(t.events_null, ["event_type", "props"]).unionByName(p.column_summary(t.part, ["p_brand"]))
    return x.recommend_categorical(s)


@query("eda_08", """SELECT strftime(date_trunc('month', ts), '%Y-%m') AS month, count(*) AS n,
  CAST((SELECT date_diff('second', min(ts), max(ts)) // 86400 FROM (SELECT ts FROM events)) AS BIGINT) AS range_days FROM events GROUP BY 1""")
def eda_08(t):
    return x.monthly_counts(t.events, "ts")


MATRIX = ["o_totalprice", "c_acctbal", "c_nationkey", "target", "y"]


def corr_sql(columns, table):
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM {table}" for a, b in combinations(columns, 2))


@query("eda_09", corr_sql(MATRIX, "orders_target"), "orders_target")
def eda_09(t):
    return x.correlations(t.orders_target, MATRIX)


@query("eda_10", "SELECT CAST(bin AS VARCHAR) AS value, n FROM (" + hist_sql("target", "orders_target", 50)
       + ") UNION ALL SELECT 'y=' || CAST(y AS VARCHAR), count(*) FROM orders_target GROUP BY y", "orders_target")
def eda_10(t):
    bins = x.histogram(t.orders_target, "target", 50).select(F.col("bin").cast("string").alias("value"), "n")
    return bins.unionByName(p.class_balance(t.orders_target, "y").select(F.concat(F.lit("y="), "value").alias("value"), "n"))


@query("eda_11", "SELECT * FROM (" + union("""SELECT '{c}' AS "column", count(*) - count({c}) AS n_null, round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_pct
  FROM events_null""", EN) + ") WHERE n_null > 0 ORDER BY null_pct DESC LIMIT 30", "events_null")
def eda_11(t):
    return x.missing_ranking(t.events_null)


@query("eda_12", """SELECT (CASE WHEN event_type IS NULL THEN '1' ELSE '0' END) || (CASE WHEN value IS NULL THEN '1' ELSE '0' END) AS pattern, count(*) AS n
  FROM events_null GROUP BY 1""", "events_null")
def eda_12(t):
    return x.missing_patterns(t.events_null, ["event_type", "value"])


@query("eda_13", union("""SELECT '{c}' AS "column", round(avg({c}) FILTER (value IS NULL), 4) AS mean_missing, round(avg({c}) FILTER (value IS NOT NULL), 4) AS mean_present,
  round((avg({c}) FILTER (value IS NULL) - avg({c}) FILTER (value IS NOT NULL)) / sqrt(var_samp({c}) FILTER (value IS NULL) / count({c}) FILTER (value IS NULL)
  + var_samp({c}) FILTER (value IS NOT NULL) / count({c}) FILTER (value IS NOT NULL)), 4) AS t FROM events_null""", ["event_id", "user_id"]), "events_null")
def eda_13(t):
    return x.missingness_probe(t.events_null, "value", ["event_id", "user_id"])


@query("eda_14", "SELECT * FROM (" + corr_sql(MATRIX, "orders_target") + ") WHERE abs(r) > 0.8", "orders_target")
def eda_14(t):
    return x.correlations(t.orders_target, MATRIX).where("abs(r) > 0.8")


VIF = ["o_totalprice", "c_acctbal", "c_nationkey", "y"]


def _determinant(places: list[int]) -> str:
    """SQL of the determinant of the correlations of some columns, by permutations."""
    from itertools import permutations

    terms = []
    for p in permutations(range(len(places))):
        turns = sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p)))
        cells = [f"r{min(places[i], places[j])}{max(places[i], places[j])}" for i, j in enumerate(p) if i != j]
        terms.append(("-" if turns % 2 else "+") + ("*".join(cells) or "1"))
    return "(" + " ".join(terms) + ")"


@query("eda_15", "WITH m AS (SELECT " + ", ".join(f"corr({VIF[i]}, {VIF[j]}) AS r{i}{j}" for i in range(4) for j in range(i + 1, 4)) + " FROM orders_target) "
       + " UNION ALL ".join(f"SELECT '{VIF[i]}' AS column, round({_determinant([j for j in range(4) if j != i])} / {_determinant([0, 1, 2, 3])}, 4) AS vif FROM m" for i in range(4)), "orders_target")
def eda_15(t):
    return x.vif(t.orders_target, VIF)


def anova_sql(group, value, table):
    return f"""SELECT '{group}' AS feature, 'anova_f' AS test, round(((sum(s * s / n) - pow(sum(s), 2) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))), 3) AS statistic,
      count(*) - 1 AS df1, CAST(sum(n) - count(*) AS BIGINT) AS df2 FROM (SELECT {group}, sum({value}) AS s, sum({value} * {value}) AS q, count({value}) AS n
      FROM {table} WHERE {value} IS NOT NULL AND {group} IS NOT NULL GROUP BY {group})"""


def chi_sql(a, b, table):
    return f"""SELECT '{a}' AS feature, 'chi_square' AS test, round(sum(o) * (sum(o * o / (ra * cb)) - 1), 3) AS statistic,
      (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df1, CAST(sum(o) AS BIGINT) AS df2 FROM (
      SELECT a, b, o::DOUBLE AS o, (sum(o) OVER (PARTITION BY a))::DOUBLE AS ra, (sum(o) OVER (PARTITION BY b))::DOUBLE AS cb
      FROM (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2))"""


@query("eda_16", anova_sql("c_mktsegment", "target", "orders_target") + " UNION ALL " + anova_sql("o_orderpriority", "target", "orders_target")
       + " UNION ALL " + chi_sql("c_mktsegment", "y", "orders_target"), "orders_target")
def eda_16(t):
    d = t.orders_target
    return x.anova(d, "c_mktsegment", "target").unionByName(x.anova(d, "o_orderpriority", "target")).unionByName(x.chi_square(d, "c_mktsegment", "y"))


@query("eda_17", union("""SELECT '{c}' AS "column", round(bc, 4) AS bimodality, CASE WHEN abs(g) > 1 THEN 'skewed' WHEN bc > 0.6 THEN 'bimodal'
  WHEN k < -1 THEN 'uniform' ELSE 'normal' END AS shape FROM (SELECT g, k, (g * g + 1) / (k + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))) AS bc
  FROM (SELECT skewness(x) AS g, kurtosis(x) AS k, count(x)::DOUBLE AS n FROM {c}))""", [])
       + " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(bc, 4) AS bimodality, CASE WHEN abs(g) > 1 THEN 'skewed' WHEN bc > 0.6 THEN 'bimodal'
  WHEN k < -1 THEN 'uniform' ELSE 'normal' END AS shape FROM (SELECT g, k, (g * g + 1) / (k + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))) AS bc
  FROM (SELECT skewness({c}) AS g, kurtosis({c}) AS k, count({c})::DOUBLE AS n FROM orders_target))""" for c in ("o_totalprice", "c_acctbal", "y", "target")), "orders_target")
def eda_17(t):
    return x.distribution_labels(t.orders_target, ["o_totalprice", "c_acctbal", "y", "target"])


@query("eda_18", "SELECT count(*) FILTER (abs(skewness) > 1) AS n_skewed, count(*) FILTER (outlier_pct > 10) AS n_outlier_heavy, "
       "(SELECT count(*) FILTER (u > 50) FROM (SELECT count(DISTINCT event_type) AS u FROM events UNION ALL SELECT count(DISTINCT props) FROM events)) AS n_high_cardinality FROM ("
       + numeric_sql(["value", "user_id"], "events", "count(x)", KEEP) + ")")
def eda_18(t):
    return x.complexity_counters(p.numeric_summary(t.events, ["value", "user_id"], "valid"), p.column_summary(t.events, ["event_type", "props"]))


@query("eda_19", """WITH u AS (SELECT user_id, sum(value) AS x FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY x, user_id) AS i, count(*) OVER () AS n FROM u)
  SELECT count(*) AS n_entities, round(sum(x) FILTER (i > n - ceil(n * 0.2)) / sum(x), 4) AS top_share,
  round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 4) AS gini FROM r""")
def eda_19(t):
    return x.concentration(t.events, "user_id", F.col("value"))


@query("eda_20", """WITH w AS (SELECT brand, qty, """ + ", ".join(f"lag(qty, {k}) OVER (PARTITION BY brand ORDER BY day) AS l{k}" for k in range(1, 8)) + """ FROM demand)
  """ + " UNION ALL ".join(f"SELECT brand, {k} AS lag, round(corr(qty, l{k}), 4) AS r FROM w GROUP BY brand" for k in range(1, 8)), "demand")
def eda_20(t):
    return x.autocorrelation(t.demand, "brand", "day", "qty", 7)


@query("eda_21", """WITH tr AS (SELECT *, isodow(day) - 1 AS dow, CASE WHEN count(*) OVER w = 7 THEN avg(qty) OVER w END AS trend FROM demand
    WINDOW w AS (PARTITION BY brand ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  se AS (SELECT brand, dow, avg(qty - trend) AS s FROM tr GROUP BY 1, 2), c AS (SELECT brand, dow, s - avg(s) OVER (PARTITION BY brand) AS season FROM se)
  SELECT brand, CAST(dow AS INTEGER) AS dow, round(any_value(season), 3) AS season, round(avg(trend), 3) AS trend, round(stddev_samp(qty - trend - season), 3) AS rest_sd
  FROM tr JOIN c USING (brand, dow) GROUP BY 1, 2""", "demand")
def eda_21(t):
    parts = x.decompose(t.demand, "brand", "day", "qty")
    return parts.groupBy("brand", "dow").agg(rnd(F.max("season"), 3).alias("season"), rnd(F.avg("trend"), 3).alias("trend"),
                                             rnd(F.stddev_samp("rest"), 3).alias("rest_sd"))


@query("eda_22", """WITH m AS (SELECT brand, day, qty, lag(qty) OVER (PARTITION BY brand ORDER BY day) AS prev FROM demand),
  r AS (SELECT *, count(*) OVER w AS n, stddev_samp(qty) OVER w AS vol, CASE WHEN stddev_pop(qty) OVER w > 0 AND stddev_pop(prev) OVER w > 0 THEN corr(qty, prev) OVER w END AS c FROM m WHERE prev IS NOT NULL
    WINDOW w AS (PARTITION BY brand ORDER BY day ROWS BETWEEN 27 PRECEDING AND CURRENT ROW))
  SELECT brand, strftime(day, '%Y-%m') AS month, round(avg(vol), 3) AS volatility, round(avg(c), 3) AS r FROM r WHERE n = 28 GROUP BY 1, 2""", "demand")
def eda_22(t):
    from pyspark.sql import Window as W

    m = t.demand.withColumn("prev", F.lag("qty").over(W.partitionBy("brand").orderBy("day"))).where("prev IS NOT NULL")
    out = x.rolling_relation(m, "brand", "day", "qty", "prev", 28)
    return out.groupBy("brand", F.date_format("day", "yyyy-MM").alias("month")).agg(rnd(F.avg("volatility"), 3).alias("volatility"), rnd(F.avg("r"), 3).alias("r"))
