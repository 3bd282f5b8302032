"""Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_bucket(key: Column | str, buckets: int) -> Column:
    """Bucket of md5(key): the same in Spark and in any SQL engine with md5."""
    digest = F.substring(F.md5(col(key).cast("string")), 1, 8)
    return F.conv(digest, 16, 10).cast("bigint") % F.lit(buckets)


def rnd(c: Column, digits: int = 4) -> Column:
    """Round half up and turn -0.0 into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def share(condition: Column) -> Column:
    """Share of rows that satisfy a condition (null counts as no)."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def count_when(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def sum_when(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value))


def skew_g1(c: Column | str) -> Column:
    """Bias-corrected skewness; null below 3 values."""
    c = col(c)
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_g2(c: Column | str) -> Column:
    """Bias-corrected excess kurtosis; null below 4 values."""
    c = col(c)
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def safe_corr(a: Column, b: Column, window=None) -> Column:
    """Pearson r over rows where both are present; null where either is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    on = (lambda e: e.over(window)) if window is not None else (lambda e: e)
    return F.try_divide(on(F.covar_pop(x, y)), on(F.stddev_pop(x)) * on(F.stddev_pop(y)))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def ladder(value: Column, steps: list[tuple[float, object]], otherwise) -> Column:
    """First label whose upper bound exceeds the value: [(10, 'a'), (20, 'b')] otherwise 'c'."""
    expr = None
    for bound, label in steps:
        expr = F.when(value < bound, F.lit(label)) if expr is None else expr.when(value < bound, F.lit(label))
    return F.when(value.isNull(), F.lit(None)).otherwise(expr.otherwise(F.lit(otherwise)))


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch, for timestamps with or without a zone."""
    return F.unix_micros(col(ts).cast("timestamp"))


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start).cast("bigint")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def normal_cdf(x: Column) -> Column:
    """Normal distribution function, rational approximation with error below 7.5e-8."""
    # fixed values: published coefficients of the approximation
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + p * F.abs(x))
    poly = reduce(lambda acc, k: acc * t + k, reversed(b), F.lit(0.0)) * t
    tail = F.exp(-x * x / 2) / F.sqrt(2 * F.pi()) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def two_sided_p(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))
