"""Survival and patient-history analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions.exprs import days_between, ratio, rnd
from sparkloom.operators.ordered import Spec, following, running


def risk_table(df: DataFrame, time: str, event: str, by: list[str] = (), **kw) -> DataFrame:
    """Events, and rows still at risk, per distinct time (grouped first; times are whole periods)."""
    g = df.groupBy(*by, time).agg(F.sum(event).alias("d"), F.count("*").alias("n"))
    return running(g, list(by), [time], {"at_risk": Spec("sum", F.col("n"))}, descending=True, **kw)


def kaplan_meier(df: DataFrame, time: str, event: str, by: list[str] = (), **kw) -> DataFrame:
    """Survival at each time as exp of the running sum of log(1 - d / n)."""
    r = risk_table(df, time, event, by, **kw)
    step = F.when(F.col("d") < F.col("at_risk"), F.log(1 - ratio(F.col("d"), F.col("at_risk"))))
    ends = F.when(F.col("d") >= F.col("at_risk"), 1).otherwise(0)
    c = running(r.withColumn("_l", step).withColumn("_z", ends), list(by), [time], {"_s": Spec("sum", F.col("_l")), "_e": Spec("max", F.col("_z"))}, **kw)
    return c.withColumn("survival", F.when(F.col("_e") == 1, 0.0).otherwise(F.exp(F.coalesce("_s", F.lit(0.0))))).drop("_l", "_z", "_s", "_e")


def median_survival(km: DataFrame, time: str) -> DataFrame:
    return km.agg(F.min(F.when(F.col("survival") <= 0.5, F.col(time))).alias("median"))


def log_rank(df: DataFrame, time: str, event: str, arm: str, **kw) -> DataFrame:
    """Two-arm log-rank statistic from one row per event time."""
    g = df.groupBy(time).agg(F.sum(event).alias("d"), F.count("*").alias("n"), F.sum(F.when(F.col(arm) == 1, F.col(event)).otherwise(0)).alias("d1"),
                             F.sum(F.when(F.col(arm) == 1, 1).otherwise(0)).alias("n1"))
    r = running(g, [], [time], {"at_risk": Spec("sum", F.col("n")), "at_risk_1": Spec("sum", F.col("n1"))}, descending=True, **kw)
    d, at, at1 = F.col("d"), F.col("at_risk"), F.col("at_risk_1")
    e = d * at1 / at
    v = F.when(at > 1, d * (at1 / at) * (1 - at1 / at) * (at - d) / (at - 1)).otherwise(0.0)
    return r.agg(F.sum("d1").alias("observed"), rnd(F.sum(e)).alias("expected"), rnd(F.try_divide(F.pow(F.sum("d1") - F.sum(e), 2), F.sum(v))).alias("chi_square"))


def cumulative_incidence(df: DataFrame, time: str, cause: str, **kw) -> DataFrame:
    """Chance of each cause by each time when the causes compete (cause 0 is censored)."""
    g = df.withColumn("_any", (F.col(cause) > 0).cast("int"))
    km = kaplan_meier(g, time, "_any", **kw)
    before = running(km, [], [time], {"_s0": Spec("last", F.col("survival"))}, before="rows", **kw).withColumn("_s0", F.coalesce("_s0", F.lit(1.0)))
    per = df.where(F.col(cause) > 0).groupBy(time, cause).agg(F.count("*").alias("dk"))
    j = per.join(before.select(time, "at_risk", "_s0"), time)
    return running(j.withColumn("_h", F.col("_s0") * F.col("dk") / F.col("at_risk")), [cause], [time], {"incidence": Spec("sum", F.col("_h"))}, **kw).select(cause, time, "incidence")


def stays(df: DataFrame, patient: str, admit: str, discharge: str, key: str, within_days: int = 30, **kw) -> DataFrame:
    """Length of stay, and whether the next admission starts within some days of discharge."""
    n = following(df, [patient], [admit, key], {"_next": admit}, **kw)
    gap = days_between(F.col("_next"), F.col(discharge))
    return n.withColumn("length_of_stay", days_between(F.col(discharge), F.col(admit))).withColumn(
        "readmitted", F.coalesce(gap.between(0, within_days), F.lit(False))).drop("_next")


def comorbidity_index(codes: DataFrame, patient: str, code: str, weights: dict[str, int]) -> DataFrame:
    """Sum over code groups of the group weight, each group once. A group is a prefix of `weights`; a code is in that of its longest."""
    group = F.lit(None).cast("string")
    for p in sorted(weights, key=len):
        group = F.when(F.col(code).startswith(p), p).otherwise(group)
    weight = F.create_map(*[F.lit(x) for item in weights.items() for x in item])
    groups = codes.withColumn("_g", group).where("_g IS NOT NULL").select(patient, "_g").distinct()
    return groups.groupBy(patient).agg(F.sum(weight[F.col("_g")]).alias("index"))


def overlaps(df: DataFrame, patient: str, start: str, end: str, key: str, first: Column, second: Column, **kw) -> DataFrame:
    """Intervals of the first kind that overlap any of the second, without pairing them.

    One overlaps if a second interval that began earlier ends later than its start, or if the next
    second interval begins before its end.
    """
    kind = df.withColumn("_a", first).withColumn("_b", second)
    e = running(kind, [patient], [start, key], {"_open": Spec("max", F.when(F.col("_b"), F.col(end)))}, **kw)
    e = running(e, [patient], [start, key], {"_next": Spec("last", F.when(F.col("_b"), F.col(start)))}, descending=True, **kw)
    hit = (F.col("_open") >= F.col(start)) | (F.col("_next") <= F.col(end))
    return e.where("_a").select(patient, key, F.coalesce(hit, F.lit(False)).alias("interacts"))
