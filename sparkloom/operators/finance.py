"""Credit, currency and fraud analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sparkloom.functions.exprs import micros, ratio, rnd
from sparkloom.operators.ordered import Spec, asof, previous, running


def expected_loss(df: DataFrame, by: str, pd: Column, lgd: float, ead: Column) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), rnd(F.avg(pd), 6).alias("pd"), rnd(F.sum(pd * lgd * ead), 2).alias("expected_loss"), rnd(F.try_divide(F.sum(pd * lgd * ead), F.sum(ead)), 6).alias("loss_rate"))


def vintage_curve(df: DataFrame, vintage: Column, age: Column, bad: Column) -> DataFrame:
    """Cumulative bad share of each vintage by age (one row per vintage and age)."""
    g = df.groupBy(vintage.alias("vintage"), age.alias("age")).agg(F.count("*").alias("n"), F.sum(bad.cast("int")).alias("bad"))
    w = W.partitionBy("vintage").orderBy("age").rowsBetween(W.unboundedPreceding, 0)
    return g.select("vintage", "age", "n", rnd(ratio(F.sum("bad").over(w), F.sum("n").over(w)), 6).alias("cumulative_bad"))


def roll_rates(df: DataFrame, account: str, order: list[str], state: str, **kw) -> DataFrame:
    """Share of moves from each state to each next state."""
    m = previous(df, [account], order, {"was": state}, **kw).where("was IS NOT NULL").groupBy("was", state).agg(F.count("*").alias("n"))
    total = m.groupBy("was").agg(F.sum("n").alias("t"))
    return m.join(total, "was").select("was", F.col(state).alias("now"), "n", rnd(ratio(F.col("n"), F.col("t")), 6).alias("rate"))


def band_rates(df: DataFrame, band: Column, bad: str) -> DataFrame:
    """Bad rate per score band, and whether it falls as the band rises (few rows)."""
    g = df.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(bad).alias("_r"))
    w = W.orderBy("band")
    return g.select("band", "n", rnd(F.col("_r"), 6).alias("rate"), F.coalesce(F.col("_r") >= F.lag("_r").over(w), F.lit(True)).alias("monotonic"))


def convert_currency(df: DataFrame, rates: DataFrame, currency: str, at: str, amount: str, rate_at: str, rate: str, **kw) -> DataFrame:
    """Amount times the latest rate known at the time."""
    out = asof(df, rates, [currency], at, rate_at, [rate], **kw)
    return out.withColumn("converted", F.col(amount) * F.col(rate))


def repeat_flags(df: DataFrame, keys: list[str], order: list[str], seconds: int, **kw) -> DataFrame:
    """Rows that follow a row with the same keys within some seconds."""
    p = previous(df, keys, order, {"_t": order[0]}, **kw)
    return p.withColumn("repeat", F.coalesce(micros(order[0]) - micros("_t") <= seconds * 1_000_000, F.lit(False))).drop("_t")


def place_flags(df: DataFrame, user: str, order: list[str], place: str, seconds: int, **kw) -> DataFrame:
    """Rows with another place of the same user within some seconds before.

    The latest earlier row at another place is either the previous row, or the one that was latest
    for the previous row; so it is the last change of place, carried forward.
    """
    p = previous(df, [user], order, {"_p": place, "_t": order[0]}, **kw)
    moved = F.when(F.col("_p") != F.col(place), micros("_t"))
    r = running(p, [user], order, {"_other": Spec("last", moved)}, **kw)
    return r.withColumn("several_places", F.coalesce(micros(order[0]) - F.col("_other") <= seconds * 1_000_000, F.lit(False))).drop("_p", "_t", "_other")
