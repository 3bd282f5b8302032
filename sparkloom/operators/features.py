"""Cross-column, group and time features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sparkloom.functions.exprs import micros
from sparkloom.operators.ordered import Spec, islands, previous, row_numbers, running, sliding


def densify_days(df: DataFrame, keys: list[str], day: str, fill: dict[str, float],
                 span: DataFrame | None = None, keys_from: DataFrame | None = None) -> DataFrame:
    """One row per key and day of the calendar; missing days get the fill values.

    The calendar is two scalars, so each key expands by itself (keys x days rows, no cross join).
    """
    lo, hi = (span or df.agg(F.min(day), F.max(day))).first()
    names = keys_from or df.select(*keys).distinct()
    if lo is None:
        return df
    grid = names.withColumn(day, F.explode(F.sequence(F.lit(lo), F.lit(hi), F.expr("INTERVAL 1 DAY"))))
    return grid.join(df, [*keys, day], "left").fillna(fill)


def resample(df: DataFrame, keys: list[str], ts: str, unit: str, *aggs: Column) -> DataFrame:
    """Aggregate to one cadence; every key gets all steps between its first and last."""
    step = F.date_trunc(unit, F.col(ts)).alias(unit)
    found = df.groupBy(*keys, step).agg(*aggs)
    span = df.groupBy(*keys).agg(F.date_trunc(unit, F.min(ts)).alias("lo"), F.date_trunc(unit, F.max(ts)).alias("hi"))
    grid = span.select(*keys, F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL 1 {unit.upper()}"))).alias(unit))
    return grid.join(found, [*keys, unit], "left")


def lags(series: DataFrame, key: str, at: str, value: str, steps: list[int]) -> DataFrame:
    """Lagged values of a dense series (its length is bounded by the calendar)."""
    w = W.partitionBy(key).orderBy(at)
    return series.select("*", *[F.lag(value, k).over(w).alias(f"lag_{k}") for k in steps])


def rolling(series: DataFrame, key: str, at: str, value: str, rows: int) -> DataFrame:
    """Mean, deviation, minimum and maximum of the previous rows of a dense series."""
    w = W.partitionBy(key).orderBy(at).rowsBetween(-rows, -1)
    return series.select("*", F.avg(value).over(w).alias("roll_mean"), F.stddev_samp(value).over(w).alias("roll_std"),
                         F.min(value).over(w).alias("roll_min"), F.max(value).over(w).alias("roll_max"))


def trailing(df: DataFrame, key: str, ts: str, value: Column, hours: list[int], **kw) -> DataFrame:
    """Count, sum and mean over trailing time ranges, current and later rows left out."""
    micro = 3_600_000_000
    widths = {f"{h}h": h * micro for h in hours}
    out = sliding(df, [key], ts, widths, {"n": F.lit(1), "sum": value}, **kw)
    means = {f"mean_{s}": F.when(F.col(f"n_{s}") > 0.5, F.col(f"sum_{s}") / F.col(f"n_{s}")) for s in widths}
    counts = {f"n_{s}": F.round(F.col(f"n_{s}")).cast("bigint") for s in widths}
    return out.withColumns(means).withColumns(counts)


def deviation(df: DataFrame, key: str, order: list[str], value: str, sigmas: float = 3.0, **kw) -> DataFrame:
    """z of each value against all earlier values of its key, from running sums of values less the mean of the table: a large mean costs no digits."""
    centre = df.agg(F.avg(F.when(F.abs(F.col(value).cast("double")) < float("inf"), F.col(value).cast("double")))).first()[0] or 0.0
    x = F.col(value).cast("double") - F.lit(centre)
    out = running(df, [key], order, {"_n": Spec("count", x), "_s": Spec("sum", x), "_q": Spec("sum", x * x)}, before="rows", **kw)
    mean = F.col("_s") / F.col("_n")
    var = (F.col("_q") - F.col("_s") * mean) / (F.col("_n") - 1)
    z = F.when((F.col("_n") > 1) & (var > 1e-12), (x - mean) / F.sqrt(var))
    return out.withColumn("z", z).withColumn("flag", F.coalesce(F.abs("z") > sigmas, F.lit(False))).drop("_n", "_s", "_q")


def change_rate(df: DataFrame, key: str, order: list[str], value: str, ts: str, **kw) -> DataFrame:
    """Difference to the previous row of the key, and per second."""
    out = previous(df, [key], order, {"_v": value, "_t": ts}, **kw)
    seconds = (micros(ts) - micros("_t")) / 1e6
    return out.withColumn("delta", F.col(value) - F.col("_v")).withColumn("per_second", F.try_divide(F.col("delta"), seconds)).drop("_v", "_t")


def since_event(df: DataFrame, key: str, order: list[str], ts: str, resets: Column, marks: Column, **kw) -> DataFrame:
    """Rows since the last reset, and seconds since the last earlier mark."""
    runs = islands(df, [key], order, resets, "_run", **kw)
    counted = row_numbers(runs, [key, "_run"], order, "since_reset", **kw)
    last = running(counted, [key], order, {"_mark": Spec("last", F.when(marks, F.col(ts)))}, before="rows", **kw)
    return last.withColumn("seconds_since", (micros(ts) - micros("_mark")) / 1e6).drop("_run", "_mark")


def group_relative(df: DataFrame, group: str, value: str, tie: str, **kw) -> DataFrame:
    """Value over its group mean, and rank in the group (ties share a rank)."""
    means = df.groupBy(group).agg(F.avg(value).alias("group_mean"))
    ranked = running(df, [group], [value], {"_below": Spec("count", F.lit(1))}, before="range", **kw)
    return ranked.join(means, group).withColumn("to_mean", F.try_divide(F.col(value), F.col("group_mean"))).withColumn(
        "rank", F.col("_below") + 1).drop("_below")


def calendar(ts: Column) -> dict[str, Column]:
    return {
        "year": F.year(ts), "month": F.month(ts), "dow": F.weekday(ts), "week": F.weekofyear(ts), "doy": F.dayofyear(ts),
        "weekend": (F.weekday(ts) >= 5).cast("int"), "after_hours": ((F.hour(ts) < 8) | (F.hour(ts) >= 18)).cast("int"),
        "month_end": (F.to_date(ts) == F.last_day(ts)).cast("int"),
        "to_payday": F.least(F.abs(F.dayofmonth(ts) - 15), F.dayofmonth(F.last_day(ts)) - F.dayofmonth(ts)),
    }


def holiday_features(df: DataFrame, day: str, holidays: DataFrame, holiday: str, cap: int = 30, literal_limit: int = 2000) -> DataFrame:
    """Whether a day is a holiday and days to the next one; worked out once per distinct day."""
    found = holidays.select(holiday).distinct().orderBy(holiday).limit(literal_limit + 1).collect()
    days = df.select(day).distinct()
    if len(found) <= literal_limit:
        listed = F.array(*[F.lit(r[0]) for r in found]) if found else F.array().cast("array<date>")
        nxt = days.withColumn("_next", F.array_min(F.filter(listed, lambda h: h >= F.col(day))))
    else:
        marks = holidays.select(F.col(holiday).alias(day)).distinct().withColumn("_h", F.col(day))
        both = days.withColumn("_h", F.lit(None).cast("date")).unionByName(marks)
        nxt = running(both, [], [day], {"_next": Spec("min", F.col("_h"))}, descending=True, before="through")
        nxt = nxt.groupBy(day).agg(F.min("_next").alias("_next"))
    gap = F.least(F.coalesce(F.datediff("_next", day), F.lit(cap)), F.lit(cap))
    return df.join(nxt.select(day, gap.alias("days_to_holiday")), day, "left").withColumn(
        "is_holiday", (F.col("days_to_holiday") == 0).cast("int"))


def growth(periods: DataFrame, key: str, period: Column, value: str, back: Column) -> DataFrame:
    """Change against the same key one season earlier, by an equi-join on the shifted period."""
    now = periods.withColumn("_p", period)
    then = periods.select(F.col(key), back.alias("_p"), F.col(value).alias("earlier"))
    return now.join(then, [key, "_p"], "left").withColumn("growth", F.try_divide(F.col(value) - F.col("earlier"), F.col("earlier"))).drop("_p")


def ewma(series: DataFrame, key: str, at: str, value: str, alpha: float) -> DataFrame:
    """Exponentially weighted mean at the end of each series (one series is bounded by its calendar)."""
    values = F.transform(F.sort_array(F.collect_list(F.struct(at, value))), lambda s: s[value])
    fold = F.aggregate(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))), F.element_at("v", 1), lambda acc, x: (1 - alpha) * acc + alpha * x)
    return series.groupBy(key).agg(values.alias("v")).select(key, fold.alias("ewma"))


def smooth(series: DataFrame, key: str, at: str, value: str, half: int = 2) -> DataFrame:
    """Centred moving average and median filter."""
    w = W.partitionBy(key).orderBy(at).rowsBetween(-half, half)
    return series.select("*", F.avg(value).over(w).alias("moving_avg"), F.sort_array(F.collect_list(value).over(w)).alias("_s")).withColumn(
        "median_filter", F.element_at("_s", (F.floor(F.size("_s") / 2) + 1).cast("int"))).drop("_s")


# Square feet per unit, and number words of prices.
SQFT = {"sqft": 1.0, "sqm": 10.7639, "sqyd": 9.0, "acre": 43560.0}
MAGNITUDE = {"k": 1e3, "m": 1e6, "lac": 1e5, "cr": 1e7}


def parse_area(text: Column) -> Column:
    low = F.lower(text)
    number = F.regexp_extract(low, r"([0-9]+\.?[0-9]*)", 1).try_cast("double")
    factor = F.lit(None).cast("double")
    for unit, f in SQFT.items():
        factor = F.when(low.endswith(unit), f).otherwise(factor)
    return number * factor


def parse_money(text: Column) -> Column:
    low = F.lower(text)
    number = F.regexp_extract(low, r"([0-9]+\.?[0-9]*)", 1).try_cast("double")
    word = F.regexp_extract(low, r"[0-9.]+ *(k|m|lac|cr)\b", 1)
    factor = F.lit(1.0)
    for unit, f in MAGNITUDE.items():
        factor = F.when(word == unit, f).otherwise(factor)
    return number * factor


def write_version(features: DataFrame, path: str, version: int, note: str) -> None:
    """Store a feature table under its version, next to a metadata row."""
    features.write.mode("overwrite").parquet(f"{path}/data/version={version}")
    meta = features.agg(F.count("*").alias("n_rows")).select(F.lit(version).alias("number"), F.lit(note).alias("note"), "n_rows",
                                                             F.lit(",".join(features.columns)).alias("columns"))
    meta.write.mode("overwrite").parquet(f"{path}/meta/version={version}")


def read_version(spark, path: str, version: int | None = None) -> DataFrame:
    """A stored version; the latest one by default, an earlier one to roll back."""
    number = version if version is not None else spark.read.parquet(f"{path}/meta").agg(F.max("number")).first()[0]
    return spark.read.parquet(f"{path}/data/version={number}")
