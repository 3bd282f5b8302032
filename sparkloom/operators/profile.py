"""Profiles of every column of a table in a fixed number of passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from sparkloom.functions import patterns
from sparkloom.functions.exprs import count_when, ratio, rnd, safe_corr, share, skew_g1, kurt_g2
from sparkloom.operators.quantiles import exact_quantiles


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    return "categorical"


def columns_of(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds]


def stack(one_row: DataFrame, rows: list[tuple[str, dict[str, Column]]], label: str = "column") -> DataFrame:
    """One wide row of aggregates into one row per column."""
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias(label), *[e.alias(k) for k, e in stats.items()]) for name, stats in rows])))


def problem_type(df: DataFrame, target: str | None, time_column: str | None = None) -> str:
    """Kind of learning task a target column asks for."""
    if target is None:
        return "clustering"
    distinct = df.agg(F.count_distinct(target)).first()[0]
    if distinct <= 1:
        return "constant_target"
    if distinct == 2:
        return "binary"
    if kind_of(df.schema[target].dataType) != "numeric" or distinct <= 20:
        return "multiclass"
    return "time_series" if time_column in df.columns else "regression"


def table_shape(df: DataFrame) -> DataFrame:
    missing = sum((F.sum(F.col(c).isNull().cast("bigint")) for c in df.columns[1:]),
                  F.sum(F.col(df.columns[0]).isNull().cast("bigint")))
    return df.agg(F.count("*").alias("n_rows"), missing.alias("n_missing")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"),
        rnd(100 * ratio(F.col("n_missing"), F.col("n_rows") * len(df.columns))).alias("missing_pct"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value as text, n) for all columns at once; counted map-side before the shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).groupBy("column", "value").agg(F.count("*").alias("n"))


def column_summary(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Nulls, distinct values and cardinality per column; approx=True uses sketches (no value shuffle)."""
    columns = columns or df.columns
    if approx:
        wide = df.agg(F.count("*").alias("n"), *[e for i, c in enumerate(columns) for e in (
            F.count(c).alias(f"v{i}"), F.approx_count_distinct(c).alias(f"d{i}"))])
        base = stack(wide, [(c, {"n_rows": F.col("n"), "n_null": F.col("n") - F.col(f"v{i}"), "n_unique": F.col(f"d{i}")})
                            for i, c in enumerate(columns)])
    else:
        base = value_counts(df, columns).groupBy("column").agg(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
            F.count("value").alias("n_unique"))
    return base.select(
        "column", "n_rows", "n_null", rnd(100 * ratio(F.col("n_null"), F.col("n_rows"))).alias("null_pct"),
        "n_unique", rnd(ratio(F.col("n_unique"), F.col("n_rows"))).alias("cardinality"))


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """The k most frequent values per column; the row_number filter limits each task before the shuffle."""
    order = W.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    ranked = value_counts(df, columns).where("value IS NOT NULL").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value per column, the smallest one on ties."""
    counts = value_counts(df, columns).where("value IS NOT NULL")
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
                                        F.max("n").alias("mode_count"), F.sum("n").alias("n_valid"),
                                        F.count("*").alias("n_unique"))


def datetime_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.agg(*[e for i, c in enumerate(columns) for e in (F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"))])
    text = lambda name: F.date_format(F.col(name), "yyyy-MM-dd HH:mm:ss")
    return stack(wide, [(c, {"min": text(f"a{i}"), "max": text(f"b{i}")}) for i, c in enumerate(columns)])


def boolean_summary(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    wide = df.agg(*[rnd(100 * share(e)).alias(n) for n, e in columns.items()])
    return stack(wide, [(n, {"true_pct": F.col(n)}) for n in columns])


NUMERIC_PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


def numeric_summary(df: DataFrame, columns: list[str], outliers_of: str = "rows") -> DataFrame:
    """Moments, quantiles and IQR outliers; outlier share of all rows ('rows') or of valid ones ('valid').

    The quantile bounds are fitted first, so moments and outlier counts need one more pass together.
    """
    q = exact_quantiles(df, columns, NUMERIC_PROBS)
    aggs, rows = [F.count("*").alias("n")], []
    for i, c in enumerate(columns):
        p5, p25, p50, p75, p95 = q[c]
        lo = hi = None
        if p25 is not None:
            iqr = p75 - p25
            lo, hi = p25 - 1.5 * iqr, p75 + 1.5 * iqr
        x = F.col(c).cast("double")
        aggs += [F.count(c).alias(f"v{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), skew_g1(x).alias(f"g{i}"), kurt_g2(x).alias(f"k{i}"),
                 count_when((x < F.lit(lo)) | (x > F.lit(hi))).alias(f"o{i}")]
        whole = F.col("n") if outliers_of == "rows" else F.col(f"v{i}")
        d = lambda v: rnd(F.lit(v).cast("double"))
        rows.append((c, {
            "n": F.col("n"), "n_valid": F.col(f"v{i}"),
            "null_pct": rnd(100 * ratio(F.col("n") - F.col(f"v{i}"), F.col("n"))),
            "mean": rnd(F.col(f"m{i}")), "std": rnd(F.col(f"s{i}")), "min": rnd(F.col(f"a{i}")),
            "p5": d(p5), "p25": d(p25), "median": d(p50), "p75": d(p75), "p95": d(p95), "max": rnd(F.col(f"b{i}")),
            "skewness": rnd(F.col(f"g{i}")), "kurtosis": rnd(F.col(f"k{i}")), "iqr_lower": d(lo), "iqr_upper": d(hi),
            "n_outliers": F.col(f"o{i}"), "outlier_pct": rnd(100 * ratio(F.col(f"o{i}"), whole))}))
    return stack(df.agg(*aggs), rows)


def pair_corr(a: str, b: str) -> Column:
    """Pearson r over rows where both are present."""
    return safe_corr(F.col(a), F.col(b))


def target_correlations(df: DataFrame, columns: list[str], target: str, floor: float = 0.05) -> DataFrame:
    wide = df.agg(*[pair_corr(c, target).alias(f"r{i}") for i, c in enumerate(columns)])
    out = stack(wide, [(c, {"r": rnd(F.col(f"r{i}"))}) for i, c in enumerate(columns)])
    return out.where(F.abs("r") > floor)


def class_balance(df: DataFrame, target: str) -> DataFrame:
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = df.where(F.col(target).isNotNull()).count()
    return counts.select("value", "n", rnd(F.col("n") / F.lit(float(max(total, 1)))).alias("share"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                      F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates")).select(
        "n_rows", "n_duplicates", rnd(100 * ratio(F.col("n_duplicates"), F.col("n_rows"))).alias("duplicate_pct"))


def datelike_columns(df: DataFrame, floor: float = 0.7) -> DataFrame:
    """Columns whose name says date or time, or whose text values mostly look like dates."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    wide = df.agg(F.count("*").alias("n"), *[F.avg(F.col(c).rlike(patterns.DATE_LIKE).cast("double")).alias(f"s_{c}") for c in text])
    rows = []
    for c in df.columns:
        named = "date" in c.lower() or "time" in c.lower()
        part = F.coalesce(F.col(f"s_{c}"), F.lit(0.0)) if c in text else F.lit(0.0)
        rows.append((c, {"by_name": F.lit(named), "match_share": rnd(part), "date_like": F.lit(named) | (part > floor)}))
    return stack(wide, rows)


def idlike_columns(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    return column_summary(df, columns, approx).where("n_unique / n_rows > 0.95 AND n_rows > 100").select(
        "column", "n_unique", "cardinality")


def pattern_shares(df: DataFrame, columns: list[str], battery: dict[str, str]) -> DataFrame:
    """Rows and share of rows of each text column that match each pattern."""
    wide = df.agg(*[e for i, c in enumerate(columns) for p, rx in battery.items() for e in (
        count_when(F.col(c).rlike(rx)).alias(f"n_{i}_{p}"), share(F.col(c).rlike(rx)).alias(f"s_{i}_{p}"))])
    return stack(wide, [(c, {"pattern": F.lit(p), "n_rows": F.col(f"n_{i}_{p}"), "share": rnd(F.col(f"s_{i}_{p}"))})
                        for i, c in enumerate(columns) for p in battery])
