"""Drift and monitoring queries."""

from pyspark.sql import functions as F

from sparkloom.functions.exprs import hash_bucket, rnd
from sparkloom.operators import drift as d, gates as g, metrics as m, profile as p
from sparkloom.plans.catalog import query
from sparkloom.plans.prf import EN, union
from sparkloom.plans.views import H

HALVES = ("ref_half", "cur_half")
FEATURES = ["value", "user_id"]
CDF = """cdf AS (SELECT f, v, sum(r) OVER w / sum(r) OVER (PARTITION BY f) AS cr, sum(c) OVER w / sum(c) OVER (PARTITION BY f) AS cc, sum(r) OVER (PARTITION BY f) AS nr, sum(c) OVER (PARTITION BY f) AS nc,
  lead(v) OVER w AS nx FROM (SELECT f, v, sum(r) AS r, sum(c) AS c FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS f, {c}::DOUBLE AS v, {r} AS r, {1 - r} AS c FROM {tab}" for c in FEATURES for tab, r in (("ref_half", 1), ("cur_half", 0))) + ") GROUP BY 1, 2) WINDOW w AS (PARTITION BY f ORDER BY v))"


@query("drf_01", f"""WITH {CDF}, k AS (SELECT f, max(abs(cr - cc)) AS ks, any_value(nr)::DOUBLE AS n, any_value(nc)::DOUBLE AS m FROM cdf GROUP BY f), l AS (SELECT *, sqrt(n * m / (n + m)) * ks AS lam FROM k)
  SELECT f AS feature, CAST(n AS BIGINT) AS n_ref, CAST(m AS BIGINT) AS n_cur, round(ks, 6) AS ks, round(CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * (""" + " ".join(
    f"{'+' if j % 2 else '-'} exp(-2.0 * {j * j} * lam * lam)" for j in range(1, 41)) + "))) END, 6) AS p FROM l", HALVES)
def drf_01(t):
    return d.ks_test(t.ref_half, t.cur_half, FEATURES)


def bins_sql(c):
    e = ", ".join(f"quantile_cont({c}::DOUBLE, {i / 10}) AS e{i}" for i in range(1, 10))
    place = " + ".join(f"({c} > e{i})::INT" for i in range(1, 10))
    return f"""(SELECT b.bin, coalesce(r.n, 0) / (SELECT count(*) FROM ref_half) AS x, coalesce(k.n, 0) / (SELECT count(*) FROM cur_half) AS y FROM (SELECT unnest(generate_series(0, 9)) AS bin) b
      LEFT JOIN (SELECT {place} AS bin, count(*) AS n FROM ref_half, (SELECT {e} FROM ref_half) GROUP BY 1) r USING (bin) LEFT JOIN (SELECT {place} AS bin, count(*) AS n FROM cur_half, (SELECT {e} FROM ref_half) GROUP BY 1) k USING (bin))"""


PSI = "sum((greatest(y, 0.0001) - greatest(x, 0.0001)) * ln(greatest(y, 0.0001) / greatest(x, 0.0001)))"
KL = "sum(greatest(y, 0.0001) * ln(greatest(y, 0.0001) / greatest(x, 0.0001)))"
VERDICT = "CASE WHEN psi < 0.1 THEN 'stable' WHEN psi <= 0.2 THEN 'monitor' ELSE 'retrain' END"
PSIS = " UNION ALL ".join(f"SELECT '{c}' AS feature, round({PSI}, 6) AS psi, round({KL}, 6) AS kl FROM {bins_sql(c)}" for c in FEATURES)


@query("drf_02", f"SELECT feature, psi, {VERDICT} AS verdict FROM ({PSIS})", HALVES)
def drf_02(t):
    return d.psi(t.ref_half, t.cur_half, FEATURES).drop("kl")


CATS = "(SELECT coalesce(a.event_type, b.event_type) AS value, coalesce(a.n, 0) AS r, coalesce(b.n, 0) AS c FROM (SELECT event_type, count(*) AS n FROM ref_half GROUP BY 1) a FULL JOIN (SELECT event_type, count(*) AS n FROM cur_half GROUP BY 1) b USING (event_type))"
CHI = f"""SELECT 'event_type' AS feature, round(sum(pow(r - (r + c) * nr / (nr + nc), 2) / ((r + c) * nr / (nr + nc)) + pow(c - (r + c) * nc / (nr + nc), 2) / ((r + c) * nc / (nr + nc))), 4) AS chi_square, count(*) - 1 AS df,
  round({PSI.replace('y', '(c / nc)').replace('x', '(r / nr)')}, 6) AS psi FROM {CATS}, (SELECT (SELECT count(*) FROM ref_half)::DOUBLE AS nr, (SELECT count(*) FROM cur_half)::DOUBLE AS nc)"""
CHI = CHI.replace(PSI.replace('y', '(c / nc)').replace('x', '(r / nr)'), "sum((greatest(c / nc, 0.0001) - greatest(r / nr, 0.0001)) * ln(greatest(c / nc, 0.0001) / greatest(r / nr, 0.0001)))")


@query("drf_03", CHI + f" UNION ALL SELECT value, r::DOUBLE, c, NULL FROM {CATS}", HALVES)
def drf_03(t):
    """Shift statistics, then the frequencies themselves: (value, n_ref, n_cur)."""
    top = d.category_counts(t.ref_half, t.cur_half, "event_type").select(
        F.col("value").alias("feature"), F.col("n_ref").cast("double").alias("chi_square"), F.col("n_cur").alias("df"), F.lit(None).cast("double").alias("psi"))
    return d.category_shift(t.ref_half, t.cur_half, "event_type").unionByName(top)


@query("drf_04", f"WITH {CDF} SELECT feature, kl, kl > 0.05 AS alert, w.wasserstein FROM ({PSIS}) JOIN (SELECT f, round(sum(abs(cr - cc) * (nx - v)), 5) AS wasserstein FROM cdf GROUP BY f) w ON w.f = feature", HALVES)
def drf_04(t):
    kl = d.psi(t.ref_half, t.cur_half, FEATURES).select("feature", "kl", (F.col("kl") > 0.05).alias("alert"))
    return kl.join(d.wasserstein(t.ref_half, t.cur_half, FEATURES), "feature")


@query("drf_05", """SELECT round(avg((y = pred)::INT) FILTER (placed < TIMESTAMP '1999-01-01'), 4) AS before, round(avg((y = pred)::INT) FILTER (placed >= TIMESTAMP '1999-01-01'), 4) AS after,
  avg((y = pred)::INT) FILTER (placed < TIMESTAMP '1999-01-01') - avg((y = pred)::INT) FILTER (placed >= TIMESTAMP '1999-01-01') > 0.05 AS drifted FROM preds""", "preds")
def drf_05(t):
    early = F.col("placed") < F.lit("1999-01-01").cast("timestamp_ntz")
    hit = (F.col("y") == F.col("pred")).cast("double")
    a, b = F.avg(F.when(early, hit)), F.avg(F.when(~early, hit))
    return t.preds.agg(rnd(a).alias("before"), rnd(b).alias("after"), ((a - b) > 0.05).alias("drifted"))


@query("drf_06", """WITH r AS (SELECT * FROM preds WHERE placed < TIMESTAMP '1999-01-01'), c AS (SELECT * FROM preds WHERE placed >= TIMESTAMP '1999-01-01'),
  e AS (SELECT """ + ", ".join(f"quantile_cont(score, {i / 10}) AS e{i}" for i in range(1, 10)) + """ FROM r),
  s AS (SELECT b.bin, coalesce(x.n, 0) / (SELECT count(*) FROM r) AS x, coalesce(y.n, 0) / (SELECT count(*) FROM c) AS y FROM (SELECT unnest(generate_series(0, 9)) AS bin) b
    LEFT JOIN (SELECT """ + " + ".join(f"(score > e{i})::INT" for i in range(1, 10)) + """ AS bin, count(*) AS n FROM r, e GROUP BY 1) x USING (bin)
    LEFT JOIN (SELECT """ + " + ".join(f"(score > e{i})::INT" for i in range(1, 10)) + f""" AS bin, count(*) AS n FROM c, e GROUP BY 1) y USING (bin)),
  l AS (SELECT (SELECT avg((y = v)::INT) FROM r) AS x, (SELECT avg((y = v)::INT) FROM c) AS y FROM (SELECT unnest([0, 1]) AS v))
  SELECT 'score' AS feature, round({PSI}, 6) AS psi FROM s UNION ALL SELECT 'y', round({PSI}, 6) FROM l""", "preds")
def drf_06(t):
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    r, c = t.preds.where(F.col("placed") < cut), t.preds.where(F.col("placed") >= cut)
    return d.psi(r, c, ["score"]).select("feature", "psi").unionByName(d.category_shift(r, c, "y").select("feature", "psi"))


@query("drf_07", f"""WITH p AS (SELECT feature, {VERDICT} AS verdict FROM (SELECT feature, psi FROM ({PSIS}) UNION ALL SELECT feature, psi FROM ({CHI})))
  SELECT * FROM p UNION ALL SELECT 'overall', CASE WHEN bool_or(verdict = 'retrain') THEN 'retrain' WHEN bool_or(verdict = 'monitor') THEN 'monitor' ELSE 'stable' END FROM p""", HALVES)
def drf_07(t):
    num = d.psi(t.ref_half, t.cur_half, FEATURES).select("feature", "verdict")
    cat = d.category_shift(t.ref_half, t.cur_half, "event_type").select("feature", d._verdict(F.col("psi")).alias("verdict"))
    return d.report(num.unionByName(cat))


@query("drf_08", "SELECT * FROM (" + union("""SELECT '{c}' AS "column", a.p AS baseline_pct, b.p AS current_pct, CASE WHEN b.p > 30 THEN 'BLOCK' WHEN b.p > 20 THEN 'ALERT' ELSE 'PASS' END AS status, CASE WHEN '{c}' = 'props' THEN 'removed' ELSE 'same' END AS change FROM
  (SELECT round(100.0 * (count(*) - count({c})) / count(*), 4) AS p FROM events) a, (SELECT CASE WHEN '{c}' = 'props' THEN NULL ELSE round(100.0 * (count(*) - count({c})) / count(*), 4) END AS p FROM events_null) b""", EN) + ")", "events_null")
def drf_08(t):
    cur = t.events_null.drop("props")
    rates = g.missing_drift(p.column_summary(t.events), p.column_summary(cur))
    return rates.join(d.schema_drift(t.events, cur).select("column", "change"), "column", "full")


DAY = " + ".join(f"(value > e{i})::INT" for i in range(1, 10))
EDGES = ", ".join(f"quantile_cont(value, {i / 10}) AS e{i}" for i in range(1, 10))


@query("drf_09", f"""WITH e AS (SELECT {EDGES} FROM ref_half), r AS (SELECT {DAY} AS bin, count(*) AS n FROM ref_half, e GROUP BY 1), c AS (SELECT strftime(ts, '%Y-%m-%d') AS period, {DAY} AS bin, count(*) AS n FROM cur_half, e GROUP BY 1, 2),
  s AS (SELECT p.period, r.bin, p.n AS m, r.n / (SELECT sum(n) FROM r) AS x, coalesce(c.n, 0) / p.n AS y FROM (SELECT period, sum(n) AS n FROM c GROUP BY 1) p CROSS JOIN r LEFT JOIN c ON c.period = p.period AND c.bin = r.bin)
  SELECT period, n, psi, {VERDICT} AS verdict FROM (SELECT period, CAST(any_value(m) AS BIGINT) AS n, round({PSI}, 6) AS psi FROM s GROUP BY 1)""", HALVES)
def drf_09(t):
    return d.psi_by_period(t.ref_half, t.cur_half, "value", F.date_format("ts", "yyyy-MM-dd"))


@query("drf_10", "SELECT grp, count(*) AS n, round(avg((pred = other)::INT), 4) AS agreement, round(avg(abs(score - shadow)), 4) AS mean_gap FROM (SELECT grp, pred, score, (weight > 250000)::INT AS other, weight / 500000 AS shadow FROM preds) GROUP BY 1", "preds")
def drf_10(t):
    a = t.preds.select("id", "grp", "pred", "score")
    b = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 250000).cast("int").alias("other"), (F.col("o_totalprice") / 500000).alias("shadow"))
    return a.join(b, "id").groupBy("grp").agg(F.count("*").alias("n"), rnd(F.avg((F.col("pred") == F.col("other")).cast("double"))).alias("agreement"),
                                              rnd(F.avg(F.abs(F.col("score") - F.col("shadow")))).alias("mean_gap"))


@query("drf_11", f"""WITH s AS (SELECT CASE WHEN {H('event_id', 10)} = 0 THEN 1 ELSE 0 END AS arm, strftime(ts, '%Y-%m-%d') AS period, count(*) AS n, avg((event_type = 'error')::INT) AS e, quantile_cont(value, 0.95) AS q FROM events GROUP BY 1, 2)
  SELECT a.period, a.n AS n_canary, b.n AS n_control, round(a.e, 5) AS err_canary, round(b.e, 5) AS err_control, round(a.q, 5) AS p95_canary, round(b.q, 5) AS p95_control, a.e - b.e > 0.01 OR a.q > 1.2 * b.q AS rollback
  FROM s a JOIN s b ON a.period = b.period AND a.arm = 1 AND b.arm = 0""")
def drf_11(t):
    arm = F.when(hash_bucket("event_id", 10) == 0, 1).otherwise(0)
    out = d.canary(t.events, arm, F.date_format("ts", "yyyy-MM-dd"), F.col("event_type") == "error", "value")
    return out.where("n_canary > 0 AND n_control > 0")
