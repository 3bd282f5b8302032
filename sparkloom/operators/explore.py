"""Exploration: the numbers behind distribution, association and time plots."""

from __future__ import annotations

import math

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sparkloom.functions.exprs import count_when, ratio, rnd, safe_corr, skew_g1, kurt_g2
from sparkloom.operators import profile as p
from sparkloom.operators.ordered import row_numbers


def recommend_numeric(summary: DataFrame) -> DataFrame:
    """Transform names per numeric column, from its summary."""
    heavy = F.col("null_pct") >= 30
    steps = F.array(
        F.when(heavy, "advanced_imputation_needed").when(F.col("null_pct") > 0, "median_imputation"),
        F.when(F.abs("skewness") > 1, F.when(F.col("min") > 0, "log_transform").otherwise("yeo_johnson_transform")),
        F.when(F.col("n_outliers") > 0, "clip_outliers"), F.lit("standard_scaling"))
    extra = F.when(heavy, F.array(F.lit("indicator_feature"), F.lit("knn_imputation"))).otherwise(F.array().cast("array<string>"))
    return summary.select("column", F.array_join(F.array_compact(steps), ",").alias("transforms"),
                          F.array_join(extra, ",").alias("engineering"))


def recommend_categorical(summary: DataFrame) -> DataFrame:
    """summary: column, n_null, n_unique."""
    u = F.col("n_unique")
    steps = F.array(F.when(F.col("n_null") > 0, "mode_imputation"),
                    F.when(u <= 10, "one_hot_encoding").when(u <= 50, "label_encoding").otherwise("target_encoding"))
    extra = F.when(u <= 10, "").when(u <= 50, "ordinal_groups").otherwise("frequency_encoding,count_list_items")
    return summary.select("column", F.array_join(F.array_compact(steps), ",").alias("transforms"), extra.alias("engineering"))


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Equal-width bins; by default n/20 of them, between 10 and 50."""
    x = F.col(column).cast("double")
    s = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    k = bins or min(50, max(10, s["n"] // 20))
    lo, width = s["lo"] or 0.0, ((s["hi"] or 0.0) - (s["lo"] or 0.0)) or 1.0
    place = F.least(F.floor((x - lo) * k / width), F.lit(k - 1)).cast("bigint")
    counts = df.where(x.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("bin", rnd(F.lit(lo) + F.col("bin") * F.lit(width / k)).alias("low_edge"), "n")


def density_curve(df: DataFrame, column: str, grid: int = 50, per_band: int = 20) -> DataFrame:
    """Gaussian density on a grid with Scott's bandwidth, from cell counts (never rows x grid). A cell is a `per_band`-th of the bandwidth, whatever the range."""
    x = F.col(column).cast("double")
    s = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("sd")).first()
    if not s["n"] or not s["sd"]:
        return df.sparkSession.createDataFrame([], "x double, density double")
    band = s["sd"] * s["n"] ** -0.2
    width = s["hi"] - s["lo"]
    cells = math.ceil(per_band * width / band)
    cell = F.least(F.floor((x - s["lo"]) * cells / width), F.lit(cells - 1))
    counts = df.where(x.isNotNull()).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    centre = F.lit(s["lo"]) + (F.col("cell") + 0.5) * F.lit(width / cells)
    points = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.lit(s["lo"]) + i * F.lit(width / (grid - 1)))
    z = (F.col("x") - F.col("c")) / band
    height = F.col("n") * F.exp(-z * z / 2) / F.lit(band * s["n"]) / F.sqrt(2 * F.pi())
    return counts.select("n", centre.alias("c"), F.explode(points).alias("x")).groupBy(
        F.round("x", 6).alias("x")).agg(rnd(F.sum(height), 6).alias("density"))


def box_plot(df: DataFrame, columns: list[str]) -> DataFrame:
    from sparkloom.operators.quantiles import exact_quantiles

    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    aggs, rows = [], []
    for i, c in enumerate(columns):
        a, m, b = q[c]
        lo, hi = a - 1.5 * (b - a), b + 1.5 * (b - a)
        x = F.col(c).cast("double")
        aggs += [F.min(F.when(x >= lo, x)).alias(f"lo{i}"), F.max(F.when(x <= hi, x)).alias(f"hi{i}")]
        rows.append((c, {"whisker_low": rnd(F.col(f"lo{i}")), "q1": rnd(F.lit(a)), "median": rnd(F.lit(m)),
                         "q3": rnd(F.lit(b)), "whisker_high": rnd(F.col(f"hi{i}"))}))
    return p.stack(df.agg(*aggs), rows)


def categorical_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    n = df.count()
    m = p.modes(df, columns)
    return m.select("column", F.lit(n).cast("bigint").alias("n"), "n_valid", "n_unique",
                    rnd(ratio(F.col("n_unique"), F.lit(n))).alias("cardinality"), "mode",
                    rnd(100 * ratio(F.col("mode_count"), F.col("n_valid"))).alias("mode_pct"))


def monthly_counts(df: DataFrame, column: str) -> DataFrame:
    """Records per month, with the span of the whole column on every row."""
    months = df.where(F.col(column).isNotNull()).groupBy(F.date_format(F.date_trunc("month", F.col(column)), "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    span = months.agg(F.min("lo"), F.max("hi")).first()
    days = (span[1] - span[0]).days if span[0] is not None else None
    return months.select("month", "n", F.lit(days).cast("bigint").alias("range_days"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every pair once (a before b), pairwise complete; all pairs in one aggregate."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[p.pair_corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return p.stack(wide, [(a, {"b": F.lit(b), "r": rnd(F.col(f"r{i}"))}) for i, (a, b) in enumerate(pairs)], label="a")


def missing_ranking(df: DataFrame, k: int = 30) -> DataFrame:
    return p.column_summary(df).where("n_null > 0").orderBy(F.desc("null_pct"), "column").limit(k).select("column", "n_null", "null_pct")


def missing_patterns(df: DataFrame, columns: list[str]) -> DataFrame:
    bits = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return df.groupBy(bits.alias("pattern")).agg(F.count("*").alias("n"))


def missingness_probe(df: DataFrame, flag: str, others: list[str]) -> DataFrame:
    """Means of other columns where `flag` is missing and where it is not, with Welch's t."""
    gone = F.col(flag).isNull()
    aggs, rows = [], []
    for i, c in enumerate(others):
        for tag, cond in (("m", gone), ("p", ~gone)):
            x = F.when(cond, F.col(c).cast("double"))
            aggs += [F.avg(x).alias(f"a{tag}{i}"), F.var_samp(x).alias(f"v{tag}{i}"), F.count(x).alias(f"n{tag}{i}")]
        t = F.try_divide(F.col(f"am{i}") - F.col(f"ap{i}"), F.sqrt(
            F.col(f"vm{i}") / F.col(f"nm{i}") + F.col(f"vp{i}") / F.col(f"np{i}")))
        rows.append((c, {"mean_missing": rnd(F.col(f"am{i}")), "mean_present": rnd(F.col(f"ap{i}")), "t": rnd(t)}))
    return p.stack(df.agg(*aggs), rows)


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation: diagonal of the inverted correlation matrix (p x p on the driver); infinite for columns that others determine.

    Correlations come unrounded from one pass, centred sums as Spark's corr keeps them.
    """
    import numpy as np

    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    r = df.agg(F.count("*"), *[F.corr(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")) for i, j in pairs]).first()[1:]
    m = np.eye(len(columns))
    for (i, j), x in zip(pairs, r):
        m[i, j] = m[j, i] = x if x is not None and np.isfinite(x) else 0.0
    values, vectors = np.linalg.eigh(m)
    near = values > 1e-12 * len(columns)
    inverse = (vectors[:, near] ** 2 / values[near]).sum(axis=1)
    tied = (vectors[:, ~near] ** 2).sum(axis=1) > 1e-9
    return df.sparkSession.createDataFrame([(c, float("inf") if tied[i] else round(float(inverse[i]), 4)) for i, c in enumerate(columns)], "column string, vif double")


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way F statistic from per-group sums."""
    x = F.col(value).cast("double")
    g = df.where(x.isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.count(x).alias("n"))
    one = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
                F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("b")
    return one.select(F.lit(group).alias("feature"), F.lit("anova_f").alias("test"),
                      rnd(F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k"))), 3).alias("statistic"),
                      (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two categorical columns: n * (sum(o^2 / (row * column)) - 1), so empty cells need no row."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    rows = cells.groupBy("a").agg(F.sum("o").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("cb"))
    one = cells.join(rows, "a").join(cols, "b").agg(
        F.sum("o").alias("n"), F.sum(F.col("o").cast("double") * F.col("o") / (F.col("ra").cast("double") * F.col("cb"))).alias("s"),
        F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    return one.select(F.lit(a).alias("feature"), F.lit("chi_square").alias("test"), rnd(F.col("n") * (F.col("s") - 1), 3).alias("statistic"),
                      ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("df1"), F.col("n").alias("df2"))


def distribution_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shape of each column by Sarle's bimodality coefficient and the two shape moments."""
    aggs, rows = [], []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.count(x).cast("double").alias(f"n{i}"), skew_g1(x).alias(f"g{i}"), kurt_g2(x).alias(f"k{i}")]
        n, g, k = F.col(f"n{i}"), F.col(f"g{i}"), F.col(f"k{i}")
        bc = (g * g + 1) / (k + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)))
        label = F.when(F.abs(g) > 1, "skewed").when(bc > 0.6, "bimodal").when(k < -1, "uniform").otherwise("normal")
        rows.append((c, {"bimodality": rnd(bc), "shape": label}))
    return p.stack(df.agg(*aggs), rows)


def complexity_counters(numeric: DataFrame, categorical: DataFrame) -> DataFrame:
    a = numeric.agg(count_when(F.abs("skewness") > 1).alias("n_skewed"), count_when(F.col("outlier_pct") > 10).alias("n_outlier_heavy"))
    b = categorical.agg(count_when(F.col("n_unique") > 50).alias("n_high_cardinality"))
    one = F.lit(1)
    return a.withColumn("_k", one).join(b.withColumn("_k", one), "_k").drop("_k")


def concentration(df: DataFrame, entity: str, weight: Column, top: float = 0.2, **kw) -> DataFrame:
    """Share held by the top part of the entities, and the Gini coefficient of their weights."""
    totals = df.groupBy(entity).agg(F.sum(weight).alias("x"))
    ranked = row_numbers(totals, [], ["x", entity], "i", **kw)
    s = totals.agg(F.count("*").alias("n"), F.sum("x").alias("t")).first()
    n = s["n"]
    cut = n - int(-(-n * top // 1))
    return ranked.agg(
        F.count("*").alias("n_entities"),
        rnd(F.try_divide(F.sum(F.when(F.col("i") > cut, F.col("x"))), F.sum("x"))).alias("top_share"),
        rnd(F.try_divide(2.0 * F.sum(F.col("i") * F.col("x")), F.count("*") * F.sum("x")) - F.lit((n + 1) / max(n, 1))).alias("gini"))


def autocorrelation(series: DataFrame, key: str, at: str, value: str, lags: int) -> DataFrame:
    """r of each series with itself k steps back; a series is bounded by its calendar."""
    w = W.partitionBy(key).orderBy(at)
    wide = series.select(key, F.col(value).alias("v"), *[F.lag(value, k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])
    out = wide.groupBy(key).agg(*[safe_corr(F.col("v"), F.col(f"l{k}")).alias(f"r{k}") for k in range(1, lags + 1)])
    return out.select(key, F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), rnd(F.col(f"r{k}")).alias("r")) for k in range(1, lags + 1)])))


def decompose(series: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Additive parts: centred 7-day trend, weekday index (mean zero over the week), rest."""
    w = W.partitionBy(key).orderBy(day)
    n = F.count("*").over(w.rowsBetween(-3, 3))
    trended = series.withColumn("trend", F.when(n == 7, F.avg(value).over(w.rowsBetween(-3, 3)))).withColumn("dow", F.weekday(day))
    raw = trended.groupBy(key, "dow").agg(F.avg(F.col(value) - F.col("trend")).alias("s"))
    centred = raw.withColumn("season", F.col("s") - F.avg("s").over(W.partitionBy(key))).drop("s")
    return trended.join(centred, [key, "dow"]).withColumn("rest", F.col(value) - F.col("trend") - F.col("season"))


def rolling_relation(series: DataFrame, key: str, at: str, a: str, b: str, rows: int) -> DataFrame:
    """Rolling volatility of a and rolling correlation of a and b over full frames."""
    w = W.partitionBy(key).orderBy(at).rowsBetween(-(rows - 1), 0)
    return series.select("*", F.count("*").over(w).alias("_n"), F.stddev_samp(a).over(w).alias("volatility"),
                         safe_corr(F.col(a), F.col(b), w).alias("r")).where(F.col("_n") == rows).drop("_n")

