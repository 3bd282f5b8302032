"""Delivery and service figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from sparkloom.functions.exprs import rnd, sum_when


def service_levels(lines: DataFrame, order: str, quantity: str, stock: float) -> DataFrame:
    """lines: filled flag, days late (0 or less is on time). Line and order level service figures."""
    on_time = F.col("days") <= 0
    per = lines.groupBy(order).agg(
        F.sum(quantity).alias("q"), F.coalesce(sum_when(F.col("filled"), F.col(quantity)), F.lit(0.0)).alias("fq"), F.count("*").alias("n"),
        F.sum(on_time.cast("int")).alias("t"), F.sum((on_time & F.col("filled")).cast("int")).alias("otif"), F.sum(F.abs("days")).alias("d"),
        F.bool_and(F.col("filled") & on_time).alias("perfect"))
    n, q, s = F.sum("n"), F.sum("q"), F.lit(float(stock))
    return per.agg(rnd(F.sum("fq") / q).alias("fill_rate"), rnd(F.sum("t") / n).alias("on_time"), rnd(F.sum("otif") / n).alias("otif"), rnd(F.sum("d") / n).alias("cycle_days"),
                   rnd(F.avg(F.col("perfect").cast("double"))).alias("perfect_order"), rnd(q / s).alias("turnover"), rnd(365 * s / q).alias("days_of_supply"))


def rolling_service(monthly: DataFrame, key: str, month: str, value: str, months: int) -> DataFrame:
    """Rolling mean and variance of a monthly figure (few rows per key)."""
    w = W.partitionBy(key).orderBy(month).rowsBetween(-(months - 1), 0)
    return monthly.select("*", F.avg(value).over(w).alias("rolling_mean"), F.var_samp(value).over(w).alias("rolling_variance"))
