"""Reviewer rules as predicates over profile, plan and ledger tables; rows are findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions.exprs import rnd, safe_corr


def finding(df: DataFrame, subject: str, broken: Column, severity: str, advice: str, fixable: bool) -> DataFrame:
    return df.where(broken).select(F.col(subject).cast("string").alias("subject"), F.lit(severity).alias("severity"), F.lit(advice).alias("advice"), F.lit(fixable).alias("auto_correctable"))


def mean_on_skewed(plan: DataFrame, summary: DataFrame) -> DataFrame:
    j = plan.join(summary.select("column", "skewness"), "column")
    return finding(j, "column", F.contains("plan", F.lit("mean_imputation")) & (F.abs("skewness") > 1), "warning", "use_median", True)


def scaling_with_outliers(plan: DataFrame, summary: DataFrame, limit: float = 5.0) -> DataFrame:
    j = plan.join(summary.select("column", "outlier_pct"), "column")
    return finding(j, "column", F.contains("plan", F.lit("standard_scaling")) & (F.col("outlier_pct") > limit), "warning", "use_robust_scaling", True)


def falling_rates(bands: DataFrame) -> DataFrame:
    return finding(bands, "band", ~F.col("monotonic"), "critical", "score_not_monotonic", False)


def flat_retention(df: DataFrame, group: str, rate: Column, spread: float = 0.05) -> DataFrame:
    g = df.groupBy(group).agg(rate.alias("r"))
    s = g.agg((F.max("r") - F.min("r")).alias("gap"))
    return s.select(F.lit(group).alias("rule"), rnd(F.col("gap")).alias("value"), (F.col("gap") < spread).alias("broken"))


def entangled(df: DataFrame, a: str, b: str, limit: float = 0.9) -> DataFrame:
    r = F.abs(safe_corr(F.col(a), F.col(b)))
    return df.agg(rnd(r).alias("value")).select(F.lit(f"{a}~{b}").alias("rule"), "value", (F.col("value") > limit).alias("broken"))


def intermittent(patterns: DataFrame, item: str) -> DataFrame:
    return finding(patterns, item, F.col("zero_share") > 0.3, "warning", "intermittent_method", False)


def short_history(df: DataFrame, ts: str, needs: dict[str, int]) -> DataFrame:
    days = df.agg(F.datediff(F.max(ts), F.min(ts)).alias("days"))
    return days.select("days", F.inline(F.array(*[F.struct(F.lit(n).alias("method"), F.lit(d).alias("needed")) for n, d in needs.items()]))).withColumn("broken", F.col("days") < F.col("needed"))


def mixed_periods(df: DataFrame, part: str, ts: str) -> DataFrame:
    """Random split of time-indexed rows: training reaches past the start of the test set."""
    s = df.agg(F.max(F.when(F.col(part) == "train", F.col(ts))).alias("a"), F.min(F.when(F.col(part) == "test", F.col(ts))).alias("b"))
    return s.select((F.col("a") >= F.col("b")).alias("broken"), F.date_format("a", "yyyy-MM-dd").alias("train_end"), F.date_format("b", "yyyy-MM-dd").alias("test_start"))


def identifiers_used(ids: DataFrame, features: list[str]) -> DataFrame:
    return finding(ids, "column", F.col("column").isin(features), "critical", "drop_identifier", True)


def verdicts(findings: DataFrame, group: str) -> DataFrame:
    """Per group: fix what can be fixed, block on other critical findings, else advise."""
    crit = (F.col("severity") == "critical") & ~F.col("auto_correctable")
    g = findings.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col("auto_correctable")).alias("n_actions"), F.count_if(crit).alias("n_blocking"))
    return g.withColumn("verdict", F.when(F.col("n_blocking") > 0, "block").when(F.col("n_actions") > 0, "correct").otherwise("advise"))


