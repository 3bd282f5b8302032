"""Validation gates: rows of (check, status, metric, threshold, detail).

Checks hand in aggregate expressions; all of them are merged into one pass over the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions.exprs import count_when, hash_bucket, ratio, rnd
from sparkloom.operators import profile as p

PASS, WARNING, HARD_STOP = "PASS", "WARNING", "HARD_STOP"


class QualityGateError(RuntimeError):
    """A gate found a reason not to go on."""


@dataclass(frozen=True)
class Check:
    """aggs are computed in the shared pass; decide turns them into (metric, fails, detail)."""

    name: str
    aggs: dict[str, Column]
    decide: Callable[[], tuple[Column, Column, Column]]
    threshold: float
    on_fail: str = HARD_STOP


def _row(name, metric, fails, threshold, on_fail, detail) -> Column:
    return F.struct(
        F.lit(name).alias("check"), F.when(fails, on_fail).otherwise(PASS).alias("status"),
        rnd(metric.cast("double")).alias("metric"), F.lit(float(threshold)).alias("threshold"),
        detail.alias("detail"))


def run_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    wide = df.agg(*[e.alias(n) for c in checks for n, e in c.aggs.items()])
    rows = []
    for c in checks:
        metric, fails, detail = c.decide()
        rows.append(_row(c.name, metric, fails, c.threshold, c.on_fail, detail))
    return wide.select(F.inline(F.array(*rows)))


def few_rows(limit: int = 50) -> Check:
    return Check("few_rows", {"_n": F.count("*")}, lambda: (F.col("_n"), F.col("_n") < limit, F.lit("")), limit)


def constant_target(target: str) -> Check:
    return Check("constant_target", {"_t": F.count_distinct(target)},
                 lambda: (F.col("_t"), F.col("_t") <= 1, F.lit(target)), 1)


def _names_where(flags: dict[str, Column]) -> Column:
    named = F.array(*[F.when(f, F.lit(n)) for n, f in flags.items()])
    return F.array_join(F.array_sort(F.array_compact(named)), ",")


def leakage(columns: list[str], target: str, limit: float = 0.99, strict: bool = False, name: str = "leakage") -> Check:
    """Numeric columns that nearly equal the target (at least 10 rows where both are present)."""
    aggs = {}
    for i, c in enumerate(columns):
        both = F.col(c).isNotNull() & F.col(target).isNotNull()
        aggs[f"_{name}_r{i}"] = F.when(count_when(both) >= 10, F.abs(p.pair_corr(c, target)))

    def decide():
        r = [F.coalesce(F.col(f"_{name}_r{i}"), F.lit(0.0)) for i in range(len(columns))]
        hit = [(x > limit) if strict else (F.round(x, 12) >= limit) for x in r]
        worst = F.array_max(F.array(*r))
        return worst, F.exists(F.array(*hit), lambda x: x), _names_where(dict(zip(columns, hit)))

    return Check(name, aggs, decide, limit)


def target_exists(df: DataFrame, target: str | None) -> DataFrame:
    ok = target is None or target in df.columns
    return df.sparkSession.createDataFrame(
        [("target_exists", PASS if ok else HARD_STOP, float(ok), 1.0, target or "")],
        "check string, status string, metric double, threshold double, detail string")


def targets_exist(columns: DataFrame, target: str) -> DataFrame:
    """The same check over a catalogue of datasets: (dataset, column) rows."""
    found = F.max((F.col("column") == target).cast("int"))
    return columns.groupBy("dataset").agg(F.when(found == 1, PASS).otherwise(HARD_STOP).alias("status"))


def imbalance(df: DataFrame, target: str, limit: float = 10.0, max_classes: int = 20) -> DataFrame:
    """Largest over smallest class; targets with many values are skipped."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    one = counts.agg(F.count("*").alias("k"), ratio(F.max("n"), F.min("n")).alias("r"))
    fails = (F.col("k") <= max_classes) & (F.col("r") > limit)
    return one.select(F.inline(F.array(_row("imbalance", F.col("r"), fails, limit, WARNING, F.lit(target)))))


def column_gates(df: DataFrame, keep: str | None = None) -> DataFrame:
    """Mostly missing, constant and ID-like columns from one shared count of values."""
    s = p.column_summary(df)
    rules = {
        "mostly_missing": (100 * ratio(F.col("n_null"), F.col("n_rows")) > 50, 50.0),
        "constant_column": (F.col("n_unique") <= 1, 1.0),
        "id_like": ((ratio(F.col("n_unique"), F.col("n_rows")) > 0.95) & (F.col("n_rows") > 100)
                    & (F.col("column") != (keep or "")), 0.95),
    }
    wide = s.agg(*[F.array_join(F.array_sort(F.collect_list(F.when(f, F.col("column")))), ",").alias(n)
                   for n, (f, _) in rules.items()],
                 *[count_when(f).alias(f"_n_{n}") for n, (f, _) in rules.items()])
    return wide.select(F.inline(F.array(*[
        _row(n, F.col(f"_n_{n}"), F.col(f"_n_{n}") > 0, limit, WARNING, F.col(n)) for n, (_, limit) in rules.items()])))


def duplicates(df: DataFrame, limit: float = 5.0) -> DataFrame:
    d = p.duplicate_rows(df)
    return d.select(F.inline(F.array(_row("duplicate_rows", F.col("duplicate_pct"), F.col("duplicate_pct") > limit,
                                          limit, WARNING, F.col("n_duplicates").cast("string")))))


def keep_first(df: DataFrame) -> DataFrame:
    """Drop full-row copies, keeping one of each."""
    return df.dropDuplicates()


def quality_report(df: DataFrame, target: str, leak_columns: list[str]) -> DataFrame:
    """All gates and one overall row: exit 0, 1 or 2 for pass, warnings or a hard stop."""
    rows = (run_checks(df, [few_rows(), constant_target(target), leakage(leak_columns, target)])
            .unionByName(imbalance(df, target)).unionByName(column_gates(df, target)).unionByName(duplicates(df)))
    return rows.unionByName(overall(rows))


SEVERITY = {PASS: 0, WARNING: 1, HARD_STOP: 2}


def overall(rows: DataFrame) -> DataFrame:
    rank = F.when(F.col("status") == HARD_STOP, 2).when(F.col("status") == WARNING, 1).otherwise(0)
    worst = rows.agg(F.coalesce(F.max(rank), F.lit(0)).alias("s"), count_when(rank > 0).alias("bad"))
    return worst.select(
        F.lit("overall").alias("check"),
        F.when(F.col("s") == 2, HARD_STOP).when(F.col("s") == 1, WARNING).otherwise(PASS).alias("status"),
        F.col("s").cast("double").alias("metric"), F.lit(2.0).alias("threshold"),
        F.concat(F.col("bad").cast("string"), F.lit(" of the checks failed")).alias("detail"))


def enforce(report: DataFrame) -> int:
    """Exit code of a report (0, 1); raises on a hard stop. Reads one status per check."""
    found = [(r["check"], r["status"]) for r in report.select("check", "status").collect()]
    stops = [c for c, s in found if s == HARD_STOP]
    if stops:
        raise QualityGateError("stopped by " + ", ".join(sorted(stops)))
    return max((SEVERITY[s] for _, s in found), default=0)


# Name shapes that hint at a target or at knowledge from after the event.
TARGET_NAMES = r"(^|_)(target|label|output|result|outcome)($|_)|^y_|^churn_"
FUTURE_NAMES = r"result|outcome|final|total_year|end_date|completion"


def name_flags(names: DataFrame, pattern: str) -> DataFrame:
    return names.select("dataset", "column", F.lower("column").rlike(pattern).alias("flagged"))


def late_values(df: DataFrame, observed: Column, event: Column) -> DataFrame:
    """Values recorded after the event they are meant to predict."""
    return df.agg(F.count("*").alias("n_rows"), count_when(observed > event).alias("n_late")).select(
        "n_rows", "n_late", rnd(100 * ratio(F.col("n_late"), F.col("n_rows"))).alias("late_pct"),
        F.when(F.col("n_late") > 0, HARD_STOP).otherwise(PASS).alias("status"))


def proxy_strength(df: DataFrame, columns: list[str], target: str, limit: float = 0.95) -> DataFrame:
    """Share of target variance explained by group means of each column (eta squared)."""
    x = F.col(target).cast("double")
    whole = df.agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.count(x).alias("n")).first()
    total = (whole["q"] or 0.0) - (whole["s"] or 0.0) ** 2 / max(whole["n"], 1)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    groups = df.where(x.isNotNull()).select(x.alias("x"), F.inline(cells)).groupBy("column", "value").agg(
        F.sum("x").alias("s"), F.count("*").alias("n"))
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.lit((whole["s"] or 0.0) ** 2 / max(whole["n"], 1))
    eta = F.try_divide(between, F.lit(float(total)))
    return groups.groupBy("column").agg(F.count("*").alias("n_groups"), rnd(eta).alias("eta2")).withColumn(
        "status", F.when(F.col("eta2") > limit, HARD_STOP).otherwise(PASS))


def contamination(train: DataFrame, test: DataFrame, entity: str) -> DataFrame:
    """Rows of the test set whose full content or whose entity also occurs in the training set."""
    cols = train.columns
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]), 256)
    same_rows = test.select(row.alias("k")).join(train.select(row.alias("k")).distinct(), "k", "left_semi")
    same_keys = test.select(entity).distinct().join(train.select(entity).distinct(), entity, "left_semi")
    a = same_rows.agg(F.count("*").alias("n")).select(F.lit("row").alias("level"), "n")
    b = same_keys.agg(F.count("*").alias("n")).select(F.lit("entity").alias("level"), "n")
    return a.unionByName(b).withColumn("status", F.when(F.col("n") > 0, HARD_STOP).otherwise(PASS))


def enough_samples(df: DataFrame, features: list[str], factor: int = 10) -> DataFrame:
    return run_checks(df, [Check("samples_per_feature", {"_s": F.count("*")},
                                 lambda: (F.col("_s"), F.col("_s") <= factor * len(features), F.lit(str(len(features)))),
                                 factor * len(features), WARNING)])


def missing_policy(summary: DataFrame) -> DataFrame:
    action = F.when(F.col("null_pct") == 0, "keep").when(F.col("null_pct") < 5, "drop_rows").when(
        F.col("null_pct") <= 30, "impute").otherwise("drop_or_flag_column")
    return summary.select("column", "null_pct", action.alias("action"))


def range_violations(df: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside plausible limits, counted per measurement."""
    wide = df.agg(*[e for i, (c, (lo, hi)) in enumerate(rules.items()) for e in (
        F.count(c).alias(f"v{i}"), count_when(~F.col(c).between(lo, hi)).alias(f"o{i}"))])
    return p.stack(wide, [(c, {"low": F.lit(float(lo)), "high": F.lit(float(hi)), "n_valid": F.col(f"v{i}"),
                               "n_outside": F.col(f"o{i}")}) for i, (c, (lo, hi)) in enumerate(rules.items())])


def inside_ranges(df: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    for c, (lo, hi) in rules.items():
        df = df.where(F.col(c).isNull() | F.col(c).between(lo, hi))
    return df


def stage_contract(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Column by column: nulls and ranges before and after a transform."""
    def side(df, tag):
        wide = df.agg(*[e for i, c in enumerate(columns) for e in (
            F.count_if(F.col(c).isNull()).alias(f"n{i}"), F.min(F.col(c).cast("double")).alias(f"a{i}"),
            F.max(F.col(c).cast("double")).alias(f"b{i}"))])
        return p.stack(wide, [(c, {f"nulls_{tag}": F.col(f"n{i}"), f"min_{tag}": rnd(F.col(f"a{i}")),
                                   f"max_{tag}": rnd(F.col(f"b{i}"))}) for i, c in enumerate(columns)])
    both = side(before, "before").join(side(after, "after"), "column")
    return both.withColumn("status", F.when(F.col("nulls_after") > F.col("nulls_before"), HARD_STOP).otherwise(PASS))


def missing_drift(baseline: DataFrame, current: DataFrame, alert: float = 20.0, block: float = 30.0) -> DataFrame:
    """Baseline and current missing share per column."""
    a = baseline.select("column", F.col("null_pct").alias("baseline_pct"))
    b = current.select("column", F.col("null_pct").alias("current_pct"))
    status = F.when(F.col("current_pct") > block, "BLOCK").when(F.col("current_pct") > alert, "ALERT").otherwise(PASS)
    return a.join(b, "column", "full").withColumn("status", status)


def fold_by_key(key: str, buckets: int = 5) -> Column:
    return hash_bucket(key, buckets)
