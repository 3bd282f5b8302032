"""Baskets, promotions and demand planning."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sparkloom.functions.exprs import count_when, ratio, rnd, safe_corr
from sparkloom.operators.ordered import Spec, running
from sparkloom.operators.quantiles import grouped_quantiles


def _frequent(df: DataFrame, basket: str, item: str, min_support: float):
    """Distinct (basket, item) rows of items above the support floor.

    At most average basket size / min_support items survive, so an item set per basket is bounded.
    """
    pairs = df.select(basket, item).distinct()
    n = df.agg(F.count_distinct(basket)).first()[0]
    counts = pairs.groupBy(item).agg(F.count("*").alias("n"))
    keep = counts.where(F.col("n") >= F.lit(min_support * max(n, 1)))
    return pairs.join(keep.select(item), item, "left_semi"), keep, n


def basket_pairs(df: DataFrame, basket: str, item: str, min_support: float = 0.01) -> DataFrame:
    """Support, confidence and lift of item pairs.

    Baskets with the same item set are counted together first, so pairs are formed once per distinct
    set of frequent items and not once per basket.
    """
    kept, counts, n = _frequent(df, basket, item, min_support)
    sets = kept.groupBy(basket).agg(F.sort_array(F.collect_set(item)).alias("s")).where(F.size("s") > 1)
    shapes = sets.groupBy("s").agg(F.count("*").alias("w"))
    firsts = shapes.select("s", "w", F.posexplode("s").alias("p", "a"))
    both = firsts.select("w", "a", F.explode(F.slice("s", F.col("p") + 2, F.size("s"))).alias("b"))
    g = both.groupBy("a", "b").agg(F.sum("w").alias("n_both"))
    ca, cb = (counts.select(F.col(item).alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    j = g.join(ca, "a").join(cb, "b")
    return j.select("a", "b", "n_both", rnd(F.col("n_both") / F.lit(float(n)), 6).alias("support"), rnd(ratio(F.col("n_both"), F.col("n_a")), 6).alias("confidence"),
                    rnd(F.col("n_both") * F.lit(float(n)) / (F.col("n_a").cast("double") * F.col("n_b")), 6).alias("lift"))


def frequent_sets(df: DataFrame, basket: str, item: str, min_support: float, min_confidence: float):
    """Frequent item sets and rules by FP-growth."""
    kept, _, _ = _frequent(df, basket, item, min_support)
    sets = kept.groupBy(basket).agg(F.collect_set(item).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(sets)
    return model.freqItemsets, model.associationRules


def sales_figures(lines: DataFrame, period: Column) -> DataFrame:
    """lines: order key, price, discount, quantity, flag. Order value, basket size, returns, margin."""
    orders = lines.groupBy(period.alias("period"), "l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.sum("l_extendedprice").alias("gross"), F.count("*").alias("n"),
        count_when(F.col("l_returnflag") == "R").alias("back"))
    return orders.groupBy("period").agg(F.count("*").alias("n_orders"), rnd(F.avg("net")).alias("aov"), rnd(F.avg("n")).alias("basket_size"),
                                        rnd(ratio(F.sum("back"), F.sum("n"))).alias("return_rate"), rnd(F.try_divide(F.sum("net"), F.sum("gross"))).alias("margin"),
                                        rnd(F.sum("net")).alias("net"))


def promotion_lift(df: DataFrame, item: str, promo: Column, quantity: str) -> DataFrame:
    m = lambda on: F.avg(F.when(promo == on, F.col(quantity)))
    return df.groupBy(item).agg(rnd(m(True)).alias("promo"), rnd(m(False)).alias("baseline"), rnd(F.try_divide(m(True), m(False)) - 1, 6).alias("lift"))


def cannibalisation(daily: DataFrame, day: str, item: str, quantity: str, items: list[str]) -> DataFrame:
    """Correlation of daily sales between items of one group."""
    wide = daily.groupBy(day).pivot(item, items).sum(quantity).fillna(0.0)
    pairs = list(combinations(items, 2))
    one = wide.agg(*[safe_corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rnd(F.col(f"r{i}")).alias("r")) for i, (a, b) in enumerate(pairs)])))


def censored_demand(series: DataFrame, item: str, quantity: str) -> DataFrame:
    """Days without sales are read as stock-outs and left out of the mean."""
    q = F.col(quantity)
    return series.groupBy(item).agg(F.count("*").alias("n_days"), count_when(q == 0).alias("stockout_days"), rnd(F.avg(q)).alias("observed_mean"), rnd(F.avg(F.when(q > 0, q))).alias("uncensored_mean"))


def reconcile(series: DataFrame, item: str, day: str, quantity: str, lag: int = 7) -> DataFrame:
    """Bottom-up total of item forecasts against the forecast of the total, per day."""
    w = W.partitionBy(item).orderBy(day)
    f = series.withColumn("_f", F.lag(quantity, lag).over(w))
    bottom = f.groupBy(day).agg(F.sum("_f").alias("bottom_up"), F.sum(quantity).alias("actual"))
    shifted = bottom.select(F.date_add(day, lag).alias(day), F.col("actual").alias("top_level"))
    return bottom.where("bottom_up IS NOT NULL").join(shifted, day).withColumn("coherent", F.abs(F.col("bottom_up") - F.col("top_level")) < 1e-6)


def demand_pattern(series: DataFrame, item: str, quantity: str) -> DataFrame:
    """Smooth, erratic, intermittent or lumpy, by interval between sales and size variation."""
    q = F.when(F.col(quantity) > 0, F.col(quantity))
    g = series.groupBy(item).agg(F.count("*").alias("n"), F.count(q).alias("k"), F.avg(q).alias("m"), F.stddev_samp(q).alias("s"),
                                 F.stddev_samp(quantity).alias("sd"), F.avg(quantity).alias("mean"))
    adi, cv2 = ratio(F.col("n"), F.col("k")), F.pow(F.try_divide(F.col("s"), F.col("m")), 2)
    kind = F.when((adi < 1.32) & (cv2 < 0.49), "smooth").when(adi < 1.32, "erratic").when(cv2 < 0.49, "intermittent").otherwise("lumpy")
    return g.select(item, rnd(adi).alias("interval"), rnd(cv2).alias("cv2"), rnd(F.try_divide(F.col("sd"), F.col("mean"))).alias("cv"),
                    rnd(1 - ratio(F.col("k"), F.col("n"))).alias("zero_share"), kind.alias("pattern"))


def stock_policy(series: DataFrame, item: str, quantity: str, lead_days: int, z: float, order_cost: float, hold_cost: float) -> DataFrame:
    m, s = F.avg(quantity), F.stddev_samp(quantity)
    safety = z * s * (lead_days ** 0.5)
    return series.groupBy(item).agg(rnd(safety).alias("safety_stock"), rnd(m * lead_days + safety).alias("reorder_point"), rnd(F.sqrt(2 * m * 365 * order_cost / hold_cost)).alias("eoq"))


def abc_classes(df: DataFrame, item: str, revenue: str, **kw) -> DataFrame:
    """A up to 80 % of revenue, B up to 95 %, C the rest."""
    total = df.agg(F.sum(revenue)).first()[0] or 1.0
    cum = running(df, [], [revenue, item], {"_c": Spec("sum", F.col(revenue))}, descending=True, **kw)
    share = F.col("_c") / F.lit(total)
    return cum.withColumn("share", share).withColumn("abc", F.when(F.col("share") <= 0.8, "A").when(F.col("share") <= 0.95, "B").otherwise("C")).drop("_c")


def xyz_classes(monthly: DataFrame, item: str, quantity: str) -> DataFrame:
    cv = F.try_divide(F.stddev_samp(quantity), F.avg(quantity))
    return monthly.groupBy(item).agg(rnd(cv).alias("cv"), F.when(cv <= 0.5, "X").when(cv <= 1.0, "Y").otherwise("Z").alias("xyz"))


def newsvendor(series: DataFrame, item: str, quantity: str, critical: float) -> DataFrame:
    return grouped_quantiles(series, [item], quantity, {"order_quantity": critical})
