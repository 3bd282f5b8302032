"""Ledger queries; runs are derived from events (one event is one run)."""

from pyspark.sql import functions as F

from sparkloom.functions.exprs import hash_bucket
from sparkloom.operators import ledger as l
from sparkloom.plans.catalog import query
from sparkloom.plans.views import H

S = "coalesce(roc_auc, cv_roc_auc, 0.0)"


def score():
    return l.primary("roc_auc", "cv_roc_auc")


BEST = f"best AS (SELECT project, model, arg_min(run_id, (-{S}, run_id)) AS best_run, max({S}) AS best_score FROM runs WHERE status = 'ok' GROUP BY 1, 2)"


@query("led_01", f"WITH {BEST} SELECT project, model, best_run, best_score, CAST(row_number() OVER (PARTITION BY project ORDER BY best_score DESC, model) AS INTEGER) AS rank FROM best", "runs")
def led_01(t):
    return l.leaderboard(t.runs, "project", "model", score(), "run_id").drop("is_best")


@query("led_02", f"WITH {BEST} SELECT model, rank = 1 AS is_best, count(*) AS n, round(avg(best_score), 6) AS mean_score FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY best_score DESC, model) AS rank FROM best) GROUP BY 1, 2", "runs")
def led_02(t):
    b = l.leaderboard(t.runs, "project", "model", score(), "run_id")
    return b.groupBy("model", "is_best").agg(F.count("*").alias("n"), F.round(F.avg("best_score"), 6).alias("mean_score"))


@query("led_03", "SELECT model, count(*) AS n, max(run_id) AS last_run FROM runs GROUP BY 1", "runs")
def led_03(t):
    """Two appended batches, read back as one ledger."""
    from sparkloom.session import new_scratch_path

    path = new_scratch_path(t.spark, "ledger")
    mid = F.lit("2024-01-16").cast("timestamp_ntz")
    l.append_runs(t.runs.where(F.col("finished") < mid), path)
    l.append_runs(t.runs.where(F.col("finished") >= mid), path)
    return t.spark.read.parquet(path).groupBy("model").agg(F.count("*").alias("n"), F.max("run_id").alias("last_run"))


@query("led_04", f"""WITH {BEST}, b AS (SELECT project, arg_min(model, (-best_score, best_run)) AS best_model, max(best_score) AS best_score, arg_min(best_run, (-best_score, best_run)) AS run FROM best GROUP BY 1),
  f AS (SELECT project, model, count(*) AS n, count(*) FILTER (status = 'ok') AS ok FROM runs GROUP BY 1, 2)
  SELECT f.project, CAST(sum(n) AS BIGINT) AS n_runs, CAST(sum(n - ok) AS BIGINT) AS n_failed, any_value(best_model) AS best_model, round(any_value(best_score), 4) AS best_score, any_value(params) AS seed_params,
  coalesce(string_agg(model, ',' ORDER BY model) FILTER (ok = 0), '') AS skip_models FROM f LEFT JOIN b USING (project) LEFT JOIN (SELECT run_id, params FROM runs) r ON r.run_id = b.run GROUP BY 1""", "runs")
def led_04(t):
    return l.summary(t.runs, "project", "model", score(), "run_id")


@query("led_05", f"""WITH g AS (SELECT *, {S} AS score FROM runs WHERE status = 'ok'), p AS (SELECT *, lag(score) OVER w AS s, lag(model) OVER w AS m, lag(params) OVER w AS q FROM g WINDOW w AS (PARTITION BY project ORDER BY run_id))
  SELECT project, run_id, round(score, 4) AS score, round(score - s, 4) AS delta, concat_ws(',', CASE WHEN m <> model THEN 'model' END, CASE WHEN q <> params THEN 'params' END) AS changed FROM p""", "runs")
def led_05(t):
    return l.compare(t.runs, "project", "run_id", score())


@query("led_06", f"SELECT project, run_id, max({S}) OVER (PARTITION BY project ORDER BY run_id) AS best_so_far FROM runs WHERE status = 'ok'", "runs")
def led_06(t):
    return l.progression(t.runs, "project", "run_id", score()).select("project", "run_id", "best_so_far")


@query("led_07", f"SELECT model, arg_min(run_id, (-{S}, run_id)) AS best_run, max({S}) AS best_score FROM runs WHERE status = 'ok' GROUP BY 1", "runs")
def led_07(t):
    return l.best_run(t.runs, ["model"], score(), "run_id")


@query("led_08", f"""SELECT DISTINCT model, md5(concat(CAST({H('event_id * 3', 60)} AS VARCHAR), event_type)) AS params FROM events, (SELECT DISTINCT model FROM runs)
  EXCEPT SELECT model, params FROM runs""", "runs")
def led_08(t):
    models = t.runs.select("model").distinct().agg(F.collect_set("model")).first()[0]
    wanted = t.events.select(F.md5(F.concat(hash_bucket(F.col("event_id") * 3, 60).cast("string"), "event_type")).alias("params")).distinct().withColumn(
        "model", F.explode(F.array(*[F.lit(m) for m in sorted(models)])))
    return l.new_configs(wanted, t.runs, ["model", "params"])


@query("led_09", f"""WITH d AS (SELECT *, {S} AS score FROM runs), t AS (SELECT project, count(*) AS k, round(max(score) - min(score), 6) AS spread, max(score) AS best FROM
    (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, run_id) AS r FROM d WHERE status = 'ok') WHERE r <= 3 GROUP BY 1),
  g AS (SELECT project, round(max(abs(train_score - score)) FILTER (status = 'ok'), 6) AS gap, max(cv_std) FILTER (status = 'ok') AS cs, count(*) FILTER (status <> 'ok') / count(*) AS failed FROM d GROUP BY 1)
  SELECT project, coalesce(gap > 0.05, false) AS overfit, coalesce(cs > 0.05, false) AS unstable, coalesce(k >= 3 AND spread < 0.01, false) AS crowded, failed > 0.5 AS failing, coalesce(best < 0.6, false) AS weak FROM g LEFT JOIN t USING (project)""", "runs")
def led_09(t):
    return l.stability(t.runs, "project", score())


@query("led_10", f"""WITH a AS (SELECT project, max({S}) AS s FROM runs WHERE status = 'ok' AND finished >= TIMESTAMP '2024-01-16' GROUP BY 1), b AS (SELECT project, max({S}) AS s FROM runs WHERE status = 'ok' AND finished < TIMESTAMP '2024-01-16' GROUP BY 1)
  SELECT coalesce(a.project, b.project) AS project, a.s AS challenger, b.s AS champion, CASE WHEN a.s IS NULL THEN 'keep' WHEN b.s IS NULL OR a.s > b.s THEN 'promote' ELSE 'keep' END AS decision FROM a FULL JOIN b USING (project)""".replace("coalesce(a.project, b.project) AS project", "project"), "runs")
def led_10(t):
    mid = F.lit("2024-01-16").cast("timestamp_ntz")
    new, old = t.runs.where(F.col("finished") >= mid), t.runs.where(F.col("finished") < mid)
    return l.promote(l.best_run(new, ["project"], score(), "run_id"), l.best_run(old, ["project"], score(), "run_id"), "project")
