"""Experiment statistics queries."""

from pyspark.sql import functions as F

from sparkloom.functions.exprs import hash_bucket
from sparkloom.operators import explore, stats as s
from sparkloom.plans.catalog import query
from sparkloom.plans.eda import anova_sql, chi_sql
from sparkloom.plans.prf import union
from sparkloom.plans.views import H

# the same rational approximation of the normal distribution as functions.exprs.normal_cdf
P = """(2 * (exp(-abs({z}) * abs({z}) / 2) / sqrt(2 * pi()) * (((((1.330274429 * k + -1.821255978) * k + 1.781477937) * k + -0.356563782) * k + 0.319381530) * k)))"""
ARMS = "SELECT " + ", ".join(f"count(*) FILTER (arm = {a})::DOUBLE AS n{a}, avg({{v}}) FILTER (arm = {a}) AS m{a}, var_samp({{v}}) FILTER (arm = {a}) AS v{a}" for a in (0, 1)) + " FROM ab"


@query("sta_01", f"""WITH w AS (SELECT *, m1 - m0 AS d, sqrt(v1 / n1 + v0 / n0) AS se FROM ({ARMS.format(v='spend')})), wz AS (SELECT *, d / se AS z, 1 / (1 + 0.2316419 * abs(d / se)) AS k FROM w),
  q AS (SELECT *, m1 - m0 AS d, (m1 * n1 + m0 * n0) / (n1 + n0) AS pool, sqrt(m1 * (1 - m1) / n1 + m0 * (1 - m0) / n0) AS un FROM ({ARMS.format(v='converted')})),
  qz AS (SELECT *, d / sqrt(pool * (1 - pool) * (1 / n1 + 1 / n0)) AS z, 1 / (1 + 0.2316419 * abs(d / sqrt(pool * (1 - pool) * (1 / n1 + 1 / n0)))) AS k FROM q)
  SELECT 'welch_t' AS test, round(d, 6) AS difference, round(z, 5) AS statistic, round({P.format(z='z')}, 5) AS p, round(d - 1.96 * se, 5) AS low, round(d + 1.96 * se, 5) AS high FROM wz
  UNION ALL SELECT 'proportion_z', round(d, 6), round(z, 5), round({P.format(z='z')}, 5), round(d - 1.96 * un, 5), round(d + 1.96 * un, 5) FROM qz""", "ab")
def sta_01(t):
    return s.welch(t.ab, "arm", "spend").unionByName(s.proportions_z(t.ab, "arm", "converted"))


@query("sta_02", """SELECT n, n1, round(c, 4) AS chi_square, c > 10.828 AS mismatch FROM (SELECT n, n1, pow(n1 - n / 2, 2) / (n / 2) + pow((n - n1) - n / 2, 2) / (n / 2) AS c FROM (SELECT count(*) AS n, count(*) FILTER (arm = 1) AS n1 FROM ab))""", "ab")
def sta_02(t):
    return s.sample_ratio(t.ab, "arm")


@query("sta_03", """SELECT c_mktsegment AS segment, count(*) AS n, CAST(ceil(2 * pow(2.8016, 2) * var_samp(o_totalprice) / pow(0.1 * avg(o_totalprice), 2)) AS BIGINT) AS n_per_arm,
  round(2.8016 * sqrt(4 * var_samp(o_totalprice) / count(*)), 5) AS mde FROM orders_target GROUP BY 1""", "orders_target")
def sta_03(t):
    return s.power(t.orders_target.withColumnRenamed("c_mktsegment", "segment"), "segment", "o_totalprice")


PV = f"pv AS (SELECT user_id AS family, event_id AS test, round(({H('event_id', 100000)} + 1) / 100001.0, 6) AS p FROM events)"


@query("sta_04", f"""WITH {PV}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, test) AS i, count(*) OVER (PARTITION BY family) AS m FROM pv)
  SELECT family, test, p, round(least(1.0, m * p), 6) AS bonferroni, round(least(1.0, max((m - i + 1) * p) OVER (PARTITION BY family ORDER BY p, test)), 6) AS holm,
  round(least(1.0, min(m / i * p) OVER (PARTITION BY family ORDER BY p DESC, test DESC)), 6) AS bh FROM r""")
def sta_04(t):
    pv = t.events.select(F.col("user_id").alias("family"), F.col("event_id").alias("test"), F.round((hash_bucket("event_id", 100000) + 1) / 100001.0, 6).alias("p"))
    return s.adjust_p(pv, "family", "test", "p")


@query("sta_05", f"""SELECT round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 5) AS cohens_d, round(c11 * c00 / (c10 * c01), 5) AS odds_ratio, round((c11 / (c11 + c10)) / (c01 / (c01 + c00)), 5) AS relative_risk FROM ({ARMS.format(v='spend')}),
  (SELECT """ + ", ".join(f"count(*) FILTER (arm = {i} AND converted = {j})::DOUBLE AS c{i}{j}" for i in (0, 1) for j in (0, 1)) + " FROM ab)", "ab")
def sta_05(t):
    return s.effect_sizes(t.ab, "arm", "spend", "converted")


@query("sta_06", chi_sql("o_orderpriority", "o_orderstatus", "orders") + " UNION ALL " + anova_sql("o_orderpriority", "o_totalprice", "orders"))
def sta_06(t):
    return explore.chi_square(t.orders, "o_orderpriority", "o_orderstatus").unionByName(explore.anova(t.orders, "o_orderpriority", "o_totalprice"))


@query("sta_07", union("""SELECT '{c}' AS "column", round(jb, 2) AS jarque_bera, jb < 5.991 AS normal FROM (SELECT count({c}) / 6 * (pow(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1)), 2) + pow(kurtosis_pop({c}), 2) / 4) AS jb FROM lineitem)""",
       ["l_quantity", "l_extendedprice", "l_discount"]))
def sta_07(t):
    return s.jarque_bera(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])


@query("sta_08", """SELECT any_value(m) AS median, round(any_value(mad), 4) AS mad, count(*) FILTER (0.6745 * abs(value - m) / mad > 3.5) AS n_outliers FROM events, (SELECT m, (SELECT median(abs(value - m)) FROM events) AS mad FROM (SELECT median(value) AS m FROM events))""")
def sta_08(t):
    return s.mad_outliers(t.events, "value")


@query("sta_09", """WITH f AS (SELECT regr_slope(target, c_acctbal) AS b, regr_intercept(target, c_acctbal) AS a, avg(c_acctbal) AS mx FROM orders_target), e AS (SELECT c_acctbal AS x, c_acctbal - mx AS d, target - (a + b * c_acctbal) AS e, b FROM orders_target, f)
  SELECT round(any_value(b), 6) AS slope, round(count(*) * pow(corr(e * e, x), 2), 4) AS lm, count(*) * pow(corr(e * e, x), 2) > 3.841 AS uneven, round(sqrt(sum(e * e) / (count(*) - 2) / sum(d * d)), 6) AS se, round(sqrt(sum(d * d * e * e) / pow(sum(d * d), 2)), 6) AS se_hc0 FROM e""", "orders_target")
def sta_09(t):
    return s.breusch_pagan(t.orders_target, "c_acctbal", "target")


DD = "avg(value) FILTER ({H} = {t} AND (ts >= TIMESTAMP '2024-01-16') = {p})"


def _dd(tr, p):
    return DD.format(H=H("user_id", 2), t=tr, p=p)


@query("sta_10", f"SELECT round({_dd(1, 'true')} - {_dd(1, 'false')}, 5) AS treated_change, round({_dd(0, 'true')} - {_dd(0, 'false')}, 5) AS control_change, round(({_dd(1, 'true')} - {_dd(1, 'false')}) - ({_dd(0, 'true')} - {_dd(0, 'false')}), 5) AS effect FROM events")
def sta_10(t):
    return s.diff_in_diff(t.events, hash_bucket("user_id", 2) == 1, F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"), "value")


@query("sta_11")
def sta_11(t):
    d = t.orders_target.select("o_orderkey", hash_bucket("o_orderkey", 2).alias("arm"), "c_acctbal", "o_totalprice", "target")
    return s.propensity_match(d, "o_orderkey", "arm", ["c_acctbal", "o_totalprice"], "target")


REPS = 20


@query("sta_12", "WITH s AS (SELECT avg(arm) AS share FROM ab), d AS (SELECT avg(spend) FILTER (arm = 1) - avg(spend) FILTER (arm <> 1) AS observed, " + ", ".join(
    f"avg(spend) FILTER ({H(f'user_id || chr(47) || {r}', 100000)} < floor(share * 100000)) - avg(spend) FILTER (NOT {H(f'user_id || chr(47) || {r}', 100000)} < floor(share * 100000)) AS d{r}" for r in range(REPS))
       + " FROM ab, s) SELECT round(observed, 5) AS observed, round((1 + " + " + ".join(f"(abs(d{r}) >= abs(observed))::INT" for r in range(REPS)) + f") / {REPS + 1}, 5) AS p FROM d", "ab")
def sta_12(t):
    return s.permutation_test(t.ab, "user_id", "arm", "spend", REPS)


@query("sta_13", """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS pos FROM events), w AS (SELECT pos, avg((event_type = 'click')::INT) AS c FROM e GROUP BY 1)
  SELECT user_id, count(*) AS n, round(avg((event_type = 'click')::INT), 5) AS ctr, round(avg((event_type = 'click')::INT * (SELECT max(c) FROM w) / c), 5) AS ctr_unbiased FROM e JOIN w USING (pos) GROUP BY 1""")
def sta_13(t):
    e = t.events.withColumn("pos", F.get_json_object("props", "$.k").cast("int") % 5)
    return s.inverse_propensity_ctr(e, "user_id", F.col("event_type") == "click", "pos")


@query("sta_14", """SELECT count(*) AS n, round(avg((a = b)::INT), 5) AS agreement, round((avg((a = b)::INT) - any_value(pe)) / (1 - any_value(pe)), 5) AS kappa FROM ratings,
  (SELECT sum(x.n * y.n) / pow((SELECT count(*) FROM ratings), 2) AS pe FROM (SELECT a AS c, count(*) AS n FROM ratings GROUP BY 1) x JOIN (SELECT b AS c, count(*) AS n FROM ratings GROUP BY 1) y USING (c))""", "ratings")
def sta_14(t):
    return s.cohen_kappa(t.ratings, "a", "b")


@query("sta_14_em")
def sta_14_em(t):
    votes = t.ratings.select("item", F.inline(F.array(*[F.struct(F.lit(r).alias("rater"), F.col(c).alias("label")) for r, c in (("a", "a"), ("b", "b"))])))
    third = t.ratings.select("item", F.lit("c").alias("rater"), F.col("a").alias("label")).where(hash_bucket(F.col("item") * 5, 4) != 0)
    return s.dawid_skene(votes.unionByName(third), "item", "rater", "label", 3)
