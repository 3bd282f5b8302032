"""Run ledger and leaderboard over one table of runs for all projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sparkloom.functions.exprs import count_when, ratio, rnd
from sparkloom.operators.ordered import Spec, previous, running


def primary(metric: str, *fallbacks: str) -> Column:
    """First metric present, else 0."""
    return F.coalesce(*[F.col(c) for c in (metric, *fallbacks)], F.lit(0.0))


def best_run(runs: DataFrame, keys: list[str], score: Column, run_id: str) -> DataFrame:
    """Best finished run per key; the earliest one on ties."""
    good = runs.where("status = 'ok'").withColumn("score", score)
    order = F.struct(-F.col("score"), F.col(run_id))
    return good.groupBy(*keys).agg(F.min_by(F.col(run_id), order).alias("best_run"), F.max("score").alias("best_score"))


def leaderboard(runs: DataFrame, project: str, model: str, score: Column, run_id: str) -> DataFrame:
    """Best score per model, ranked in each project (ties by model name)."""
    best = best_run(runs, [project, model], score, run_id)
    w = W.partitionBy(project).orderBy(F.desc("best_score"), model)  # one row per model
    return best.withColumn("rank", F.row_number().over(w)).withColumn("is_best", F.col("rank") == 1)


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").partitionBy("model").parquet(path)


def summary(runs: DataFrame, project: str, model: str, score: Column, run_id: str) -> DataFrame:
    """Runs, latest best model, and the models whose every run failed (to be skipped)."""
    per_model = runs.withColumn("score", score).groupBy(project, model).agg(
        F.count("*").alias("n"), count_when(F.col("status") == "ok").alias("ok"),
        F.max(F.when(F.col("status") == "ok", F.struct(F.col("score"), -F.col(run_id), F.col("params")))).alias("top"))
    return per_model.groupBy(project).agg(
        F.sum("n").alias("n_runs"), F.sum(F.col("n") - F.col("ok")).alias("n_failed"),
        F.max_by(model, "top").alias("best_model"), rnd(F.max("top.score")).alias("best_score"), F.max("top")["params"].alias("seed_params"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("ok") == 0, F.col(model)))), ",").alias("skip_models"))


def compare(runs: DataFrame, project: str, run_id: str, score: Column, **kw) -> DataFrame:
    """Score change against the previous finished run, and what changed."""
    good = runs.where("status = 'ok'").withColumn("score", score)
    prev = previous(good, [project], [run_id], {"_s": "score", "_m": "model", "_p": "params"}, **kw)
    change = F.concat_ws(",", F.when(F.col("_m") != F.col("model"), "model"), F.when(F.col("_p") != F.col("params"), "params"))
    return prev.select(project, run_id, rnd(F.col("score")).alias("score"), rnd(F.col("score") - F.col("_s")).alias("delta"), change.alias("changed"))


def progression(runs: DataFrame, project: str, run_id: str, score: Column, **kw) -> DataFrame:
    """Best score so far after each finished run."""
    good = runs.where("status = 'ok'").withColumn("score", score)
    return running(good, [project], [run_id], {"best_so_far": Spec("max", F.col("score"))}, **kw)


def new_configs(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(done.select(*keys).distinct(), keys, "left_anti")


def stability(runs: DataFrame, project: str, score: Column, floor: float = 0.6) -> DataFrame:
    """Warning flags per project: overfit, unstable folds, crowded top, many failures, weak best."""
    d = runs.withColumn("score", score)
    ok = F.col("status") == "ok"
    w = W.partitionBy(project).orderBy(F.desc("score"), "run_id")
    top = d.where(ok).withColumn("_r", F.row_number().over(w)).where("_r <= 3").groupBy(project).agg(
        F.count("*").alias("k"), (F.max("score") - F.min("score")).alias("spread"), F.max("score").alias("best"))
    g = d.groupBy(project).agg(
        F.max(F.when(ok, F.abs(F.col("train_score") - F.col("score")))).alias("gap"), F.max(F.when(ok, F.col("cv_std"))).alias("cv_std"),
        ratio(count_when(~ok), F.count("*")).alias("failed"))
    j = g.join(top, project, "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return j.select(project, flag(F.round(F.col("gap"), 6) > 0.05).alias("overfit"), flag(F.col("cv_std") > 0.05).alias("unstable"),
                    flag((F.col("k") >= 3) & (F.round(F.col("spread"), 6) < 0.01)).alias("crowded"), (F.col("failed") > 0.5).alias("failing"), flag(F.col("best") < floor).alias("weak"))


def promote(challenger: DataFrame, champion: DataFrame, key: str, margin: float = 0.0) -> DataFrame:
    a = challenger.select(key, F.col("best_score").alias("challenger"))
    b = champion.select(key, F.col("best_score").alias("champion"))
    verdict = F.when(F.col("champion").isNull(), "promote").when(F.col("challenger") > F.col("champion") + margin, "promote").otherwise("keep")
    return a.join(b, key, "full").withColumn("decision", F.when(F.col("challenger").isNull(), "keep").otherwise(verdict))
