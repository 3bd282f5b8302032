"""Single-column transforms: fit on one table, apply to any.

fit() reads the training table once or twice and returns a Fitted value of small literals or a
small mapping table; apply() is a plain projection or a join, so it stays lazy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions.exprs import hash_bucket
from sparkloom.operators.ordered import row_numbers
from sparkloom.operators.quantiles import exact_quantiles

# Columns that one-hot encoding may make; wider categories are asked for as a vector.
MAX_ONE_HOT = 200


@dataclass
class Fitted:
    """A fitted transform; `reason` is set when it does not apply and must be skipped."""

    apply: Callable[[DataFrame], DataFrame]
    new_columns: list[str] = field(default_factory=list)
    reason: str | None = None


def _skip(reason: str) -> Fitted:
    return Fitted(lambda df: df, reason=reason)


def _replace(column: str, expr: Column) -> Fitted:
    return Fitted(lambda df: df.withColumn(column, expr))


def _add(name: str, expr: Column) -> Fitted:
    return Fitted(lambda df: df.withColumn(name, expr), [name])


def _num(c: str) -> Column:
    return F.col(c).cast("double")


def drop(train, c):
    return Fitted(lambda df: df.drop(c))


def median_imputation(train, c):
    m = exact_quantiles(train, [c], [0.5])[c][0]
    return _skip("no values") if m is None else _replace(c, F.coalesce(_num(c), F.lit(m)))


def mean_imputation(train, c):
    m = train.agg(F.avg(_num(c))).first()[0]
    return _skip("no values") if m is None else _replace(c, F.coalesce(_num(c), F.lit(m)))


def mode_imputation(train, c):
    counts = train.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n"))
    m = counts.agg(F.min_by(F.col(c), F.struct(-F.col("_n"), F.col(c)))).first()[0]
    return _skip("no values") if m is None else _replace(c, F.coalesce(F.col(c), F.lit(m)))


def log_transform(train, c):
    low = train.agg(F.min(_num(c))).first()[0]
    return _replace(c, F.log1p(_num(c))) if low is not None and low > 0 else _skip("minimum is not above 0")


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    two = 2 - lam
    down = -F.log1p(-x) if abs(two) < 1e-9 else -(F.pow(1 - x, F.lit(two)) - 1) / two
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_lambda(train: DataFrame, c: str, low=-3.0, high=5.0, points=17, rounds=4) -> float | None:
    """Maximum likelihood lambda: every round is one aggregate over a grid, then the grid narrows."""
    x = _num(c)
    n = train.agg(F.count(x)).first()[0]
    if not n:
        return None
    best = 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        jac = F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("j")
        row = train.agg(jac, *[F.var_pop(yeo_johnson(x, g)).alias(f"v{i}") for i, g in enumerate(grid)]).first()
        import math

        def like(i):
            v = row[f"v{i}"]
            return -math.inf if not v or v <= 0 else -n / 2 * math.log(v) + (grid[i] - 1) * row["j"]
        i = max(range(points), key=like)
        best = grid[i]
        low, high = grid[max(i - 1, 0)], grid[min(i + 1, points - 1)]
    return best


def yeo_johnson_transform(train, c):
    lam = yeo_johnson_lambda(train, c)
    if lam is None:
        return _skip("no values")
    y = yeo_johnson(_num(c), lam)
    s = train.agg(F.avg(y).alias("m"), F.stddev_pop(y).alias("s")).first()
    return _skip("constant column") if not s["s"] else _replace(c, (y - F.lit(s["m"])) / F.lit(s["s"]))


def standard_scaling(train, c):
    s = train.agg(F.avg(_num(c)).alias("m"), F.stddev_samp(_num(c)).alias("s")).first()
    return _replace(c, (_num(c) - F.lit(s["m"])) / F.lit(s["s"])) if s["s"] else _skip("standard deviation is 0")


def clip_outliers(train, c):
    a, b = exact_quantiles(train, [c], [0.25, 0.75])[c]
    if a is None:
        return _skip("no values")
    lo, hi = a - 1.5 * (b - a), b + 1.5 * (b - a)
    return _replace(c, F.when(_num(c) < lo, F.lit(lo)).when(_num(c) > hi, F.lit(hi)).otherwise(_num(c)))


def robust_scaling(train, c):
    a, m, b = exact_quantiles(train, [c], [0.25, 0.5, 0.75])[c]
    return _replace(c, (_num(c) - F.lit(m)) / F.lit(b - a)) if a is not None and b > a else _skip("interquartile range is 0")


def maxabs_scaling(train, c):
    m = train.agg(F.max(F.abs(_num(c)))).first()[0]
    return _replace(c, _num(c) / F.lit(m)) if m else _skip("all values are 0")


def minmax_scaling(train, c):
    s = train.agg(F.min(_num(c)).alias("a"), F.max(_num(c)).alias("b")).first()
    return _replace(c, (_num(c) - F.lit(s["a"])) / F.lit(s["b"] - s["a"])) if s["a"] is not None and s["b"] > s["a"] else _skip("constant column")


def one_hot_encoding(train, c, most=MAX_ONE_HOT):
    """Sorted categories, first one dropped, a column each; null and unknown values give all zeros. More than `most` categories are an error: see one_hot_vector."""
    found = [r[0] for r in train.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct().orderBy("v").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{c} has more than {most} categories; one_hot_vector puts them in one column")
    text = F.col(c).cast("string")
    cols = [(f"{c}_{v}", F.when(text == v, 1).otherwise(0)) for v in found[1:]]
    return Fitted(lambda df: df.select("*", *[e.alias(n) for n, e in cols]).drop(c), [n for n, _ in cols])


def one_hot_vector(train, c):
    """One sparse vector column `<c>_onehot`, whatever the number of categories: place i is the category of label code i + 1; the first one, null and unknown values are all zeros."""
    from pyspark.ml.feature import OneHotEncoder

    codes = label_codes(train, c)
    width, out = max(codes.count() - 1, 1), f"{c}_onehot"
    place = F.when(F.col("_hot").isNull() | (F.col("_hot") < 1), F.lit(width)).otherwise(F.col("_hot") - 1).cast("double")  # the last place is dropped
    encoder = OneHotEncoder(inputCols=["_hot"], outputCols=[out], dropLast=True).fit(train.sparkSession.createDataFrame([(float(width),)], "_hot double"))
    return Fitted(lambda df: encoder.transform(_mapped(df, c, codes, "_code", None, out="_hot").withColumn("_hot", place)).drop("_hot", c), [out])


def label_codes(train: DataFrame, c: str) -> DataFrame:
    """Codes 0.. by the order of the value as text; numbered without a single-partition window."""
    distinct = train.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("_v")).distinct()
    return row_numbers(distinct, [], ["_v"], "_rn").select("_v", (F.col("_rn") - 1).cast("bigint").alias("_code"))


def _mapped(df: DataFrame, c: str, mapping: DataFrame, value: str, otherwise: Column | None, null_text: str | None = None,
            out: str | None = None) -> DataFrame:
    """Left join on the value as text. The optimizer broadcasts mappings that are small at run time."""
    key = F.col(c).cast("string") if null_text is None else F.coalesce(F.col(c).cast("string"), F.lit(null_text))
    joined = df.withColumn("_key", key).join(mapping.withColumnRenamed("_v", "_key"), "_key", "left")
    got = F.coalesce(F.col(value), otherwise) if otherwise is not None else F.col(value)
    return joined.withColumn(out or c, got).drop("_key", value)


def label_encoding(train, c):
    codes = label_codes(train, c)
    return Fitted(lambda df: _mapped(df, c, codes, "_code", None))


def frequency_encoding(train, c):
    n = train.agg(F.count(c)).first()[0]
    freq = train.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("_v")).agg((F.count("*") / F.lit(float(max(n, 1)))).alias("_f"))
    return Fitted(lambda df: _mapped(df, c, freq, "_f", None))


NULL_TEXT = "\u0000null"


def _category_sums(train, c, target):
    key = F.coalesce(F.col(c).cast("string"), F.lit(NULL_TEXT)).alias("_v")
    return train.where(F.col(target).isNotNull()).groupBy(key).agg(F.sum(_num(target)).alias("_s"), F.count("*").alias("_n"))


def target_encoding(train, c, target: str, smoothing: float = 0.0):
    """Mean target per category (null is one of them), shrunk to the prior by `smoothing` rows."""
    prior = train.agg(F.avg(_num(target))).first()[0]
    if prior is None:
        return _skip("target has no values")
    means = _category_sums(train, c, target).select("_v", ((F.col("_s") + smoothing * prior) / (F.col("_n") + smoothing)).alias("_m"))
    return Fitted(lambda df: _mapped(df, c, means, "_m", F.lit(prior), NULL_TEXT))


def out_of_fold_encoding(df: DataFrame, c: str, target: str, row_key: str, folds: int = 5, out: str | None = None) -> DataFrame:
    """Each row gets the category mean of the other folds: totals minus the totals of its own fold."""
    out = out or f"{c}_oof"
    keyed = df.withColumn("_v", F.coalesce(F.col(c).cast("string"), F.lit(NULL_TEXT))).withColumn("_fold", hash_bucket(row_key, folds))
    per_fold = keyed.where(F.col(target).isNotNull()).groupBy("_v", "_fold").agg(F.sum(_num(target)).alias("_fs"), F.count("*").alias("_fn"))
    totals = per_fold.groupBy("_v").agg(F.sum("_fs").alias("_ts"), F.sum("_fn").alias("_tn"))
    whole = per_fold.agg(F.sum("_fs"), F.sum("_fn")).first()
    prior = (whole[0] or 0.0) / max(whole[1] or 0, 1)
    rest = per_fold.join(totals, "_v").select(
        "_v", "_fold", F.try_divide(F.col("_ts") - F.col("_fs"), F.col("_tn") - F.col("_fn")).alias("_m"))
    return keyed.join(rest, ["_v", "_fold"], "left").withColumn(out, F.coalesce("_m", F.lit(prior))).drop("_v", "_m")


def extract_dates(train, c):
    ts = F.try_to_timestamp(F.col(c).cast("string"))
    names = {f"{c}_year": F.year(ts), f"{c}_month": F.month(ts), f"{c}_dayofweek": F.weekday(ts)}
    return Fitted(lambda df: df.withColumns(names), list(names))


def indicator_feature(train, c):
    n = train.agg(F.count_if(F.col(c).isNull())).first()[0]
    return _add(f"{c}_is_missing", F.col(c).isNull().cast("int")) if n else _skip("nothing is missing")


def binary_encoding(train, c):
    """Bits of the label code, as many as the largest code needs."""
    codes = label_codes(train, c)
    top = codes.agg(F.max("_code")).first()[0]
    if top is None:
        return _skip("no values")
    bits = max(1, int(top).bit_length())
    names = [f"{c}_bit{b}" for b in range(bits)]

    def apply(df):
        coded = _mapped(df, c, codes, "_code", None, out="_bits")
        return coded.withColumns({n: F.shiftright("_bits", b).bitwiseAND(F.lit(1)).cast("int") for b, n in enumerate(names)}).drop("_bits")
    return Fitted(apply, names)


def polynomial_features(train, c):
    return _add(f"{c}_squared", _num(c) * _num(c))


def reciprocal(train, c):
    return _add(f"{c}_reciprocal", 1 / (F.abs(_num(c)) + 1))


def extract_numeric(train, c):
    return _replace(c, F.regexp_extract(F.col(c).cast("string"), r"([\d.]+)", 1).try_cast("double"))


def ordinal_groups(train, c, groups: int = 4):
    """Equal-width bins closed on the right; the lowest edge is pushed out by 0.1 % of the range."""
    s = train.agg(F.min(_num(c)).alias("a"), F.max(_num(c)).alias("b")).first()
    if s["a"] is None or s["a"] == s["b"]:
        return _skip("constant column")
    step = (s["b"] - s["a"]) / groups
    low = s["a"] - 0.001 * (s["b"] - s["a"])
    code = F.when(_num(c) <= low, F.lit(None))
    for g in range(groups):
        edge = s["b"] if g == groups - 1 else s["a"] + step * (g + 1)
        code = code.when(_num(c) <= F.lit(edge), F.lit(g))
    return _replace(c, code.cast("int"))


def count_list_items(train, c):
    return _add(f"{c}_count", F.when(F.col(c).isNotNull(), F.size(F.split(F.col(c).cast("string"), ","))))


def hashing_encoding(train, c, buckets: int = 64):
    return _replace(c, hash_bucket(c, buckets))


def woe_table(train: DataFrame, c: str, target: str) -> DataFrame:
    """Weight of evidence per category and its part of the information value."""
    counts = train.groupBy(F.col(c).cast("string").alias("_v")).agg(
        F.sum(F.when(F.col(target) == 1, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col(target) == 0, 1).otherwise(0)).alias("good"))
    s = counts.agg(F.sum("good"), F.sum("bad")).first()
    good, bad = F.col("good") / F.lit(float(s[0] or 1)), F.col("bad") / F.lit(float(s[1] or 1))
    woe = F.when((F.col("good") > 0) & (F.col("bad") > 0), F.log(good / bad))
    return counts.select("_v", "good", "bad", woe.alias("_woe"), ((good - bad) * woe).alias("iv_part"))


def woe_encoding(train, c, target: str):
    table = woe_table(train, c, target).select("_v", "_woe")
    return Fitted(lambda df: _mapped(df, c, table, "_woe", F.lit(0.0)))


def quantile_bins(train, c, bins: int = 4):
    edges = exact_quantiles(train, [c], [i / bins for i in range(1, bins)])[c]
    if edges[0] is None:
        return _skip("no values")
    return _replace(c, cut(_num(c), edges))


def cut(x: Column, edges: list[float]) -> Column:
    """Number of edges below the value (bins closed on the right)."""
    code = F.lit(0)
    for e in edges:
        code = code + F.when(x > F.lit(e), 1).otherwise(0)
    return F.when(x.isNotNull(), code)


# Published cut points, lower bound of each next class.
CUT_POINTS = {
    "credit_score": ([580, 670, 740, 800], ["poor", "fair", "good", "very_good", "exceptional"]),
    "hba1c": ([5.7, 6.5], ["normal", "prediabetes", "diabetes"]),
    "bmi": ([18.5, 25, 30], ["underweight", "normal", "overweight", "obese"]),
    "systolic": ([120, 130, 140], ["normal", "elevated", "stage_1", "stage_2"]),
    "age": ([18, 35, 50, 65], ["minor", "young", "middle", "mature", "senior"]),
}


def domain_class(x: Column, name: str) -> Column:
    bounds, labels = CUT_POINTS[name]
    out = F.when(x.isNull(), F.lit(None))
    for b, label in zip(bounds, labels):
        out = out.when(x < b, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


TRANSFORMS: dict[str, Callable] = {
    "drop": drop, "consider_dropping": drop, "median_imputation": median_imputation, "mean_imputation": mean_imputation,
    "mode_imputation": mode_imputation, "log_transform": log_transform, "yeo_johnson_transform": yeo_johnson_transform,
    "standard_scaling": standard_scaling, "clip_outliers": clip_outliers, "robust_scaling": robust_scaling,
    "maxabs_scaling": maxabs_scaling, "minmax_scaling": minmax_scaling, "one_hot_encoding": one_hot_encoding, "one_hot_vector": one_hot_vector,
    "label_encoding": label_encoding, "frequency_encoding": frequency_encoding, "target_encoding": target_encoding,
    "extract_dates": extract_dates, "indicator_feature": indicator_feature, "binary_encoding": binary_encoding,
    "polynomial_features": polynomial_features, "reciprocal": reciprocal, "extract_numeric": extract_numeric,
    "ordinal_groups": ordinal_groups, "count_list_items": count_list_items, "hashing_encoding": hashing_encoding,
    "woe_encoding": woe_encoding, "quantile_bins": quantile_bins,
}


def register_transform(name: str, fit: Callable) -> None:
    """fit(train, column) -> Fitted; afterwards usable by name in plans."""
    TRANSFORMS[name] = fit


def fit_apply(train: DataFrame, df: DataFrame, name: str, column: str, **kw) -> DataFrame:
    return TRANSFORMS[name](train, column, **kw).apply(df)


@dataclass
class FittedPlan:
    steps: list[Fitted]
    log: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.apply(df)
        return df


def fit_plan(train: DataFrame, plan: dict[str, list], target: str | None = None, on_error: str = "raise") -> FittedPlan:
    """Fit the named transforms of each column in order. A step that fails raises; on_error="skip" logs it and leaves it out."""
    if on_error not in ("raise", "skip"):
        raise ValueError("on_error must be raise or skip")
    steps, log, current = [], [], train
    for c, names in plan.items():
        for i, name in enumerate(names):
            kw = {"target": target} if name in ("target_encoding", "woe_encoding") else {}
            try:
                if c not in current.columns:
                    log.append((c, i, name, "skipped", "column is gone", ""))
                    continue
                f = TRANSFORMS[name](current, c, **kw)
                if f.reason:
                    log.append((c, i, name, "skipped", f.reason, ""))
                    continue
                current = f.apply(current)
                steps.append(f)
                log.append((c, i, name, "applied", "", ",".join(f.new_columns)))
            except Exception as ex:
                if on_error == "raise":
                    raise
                log.append((c, i, name, "error", type(ex).__name__, ""))
    table = train.sparkSession.createDataFrame(log, "column string, step int, transform string, status string, reason string, new_columns string")
    return FittedPlan(steps, table)


def plan_of(numeric: DataFrame, categorical: DataFrame) -> DataFrame:
    """Transform plan from column summaries by type, nulls, skew, outliers and cardinality."""
    heavy = F.col("null_pct") >= 30
    num = numeric.select("column", F.array_join(F.array_compact(F.array(
        F.when(heavy, "consider_dropping").when(F.col("null_pct") > 0, "median_imputation"),
        F.when(F.abs("skewness") > 1, F.when(F.col("min") > 0, "log_transform").otherwise("yeo_johnson_transform")),
        F.when(F.col("outlier_pct") > 5, "clip_outliers"), F.lit("standard_scaling"))), ",").alias("plan"))
    u = F.col("n_unique")
    cat = categorical.select("column", F.array_join(F.array_compact(F.array(
        F.when(F.col("n_null") > 0, "mode_imputation"),
        F.when(u <= 2, "label_encoding").when(u <= 10, "one_hot_encoding").when(u <= 50, "label_encoding").otherwise("target_encoding"))), ",").alias("plan"))
    return num.unionByName(cat)
