"""Filling missing values across columns, along time and by models."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from sparkloom.operators.leaves import nearest
from sparkloom.operators.neighbours import knn
from sparkloom.operators.ordered import Spec, row_numbers, running
from sparkloom.operators.quantiles import exact_quantiles
from sparkloom.session import cut_lineage


def table_wide(train: DataFrame, df: DataFrame, strategy: dict[str, str]) -> DataFrame:
    """{column: mean | median | mode}: all fitted values as literals."""
    means = [c for c, s in strategy.items() if s == "mean"]
    medians = [c for c, s in strategy.items() if s == "median"]
    fill = {}
    if means:
        fill.update(train.agg(*[F.avg(c).alias(c) for c in means]).first().asDict())
    if medians:
        fill.update({c: q[0] for c, q in exact_quantiles(train, medians, [0.5]).items()})
    for c in (c for c, s in strategy.items() if s == "mode"):
        counts = train.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n"))
        fill[c] = counts.agg(F.min_by(F.col(c), F.struct(-F.col("_n"), F.col(c)))).first()[0]
    return df.fillna({c: v for c, v in fill.items() if v is not None})


def fill_forward(df, keys, order, value, out, **kw) -> DataFrame:
    return running(df, keys, [order], {out: Spec("last", F.col(value))}, **kw)


def fill_backward(df, keys, order, value, out, **kw) -> DataFrame:
    return running(df, keys, [order], {out: Spec("last", F.col(value))}, descending=True, **kw)


def _seconds(c):
    return F.unix_seconds(c.cast("timestamp"))


def _around(df, keys, order, value, **kw):
    """Last and next observed value with their times."""
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("t"), F.col(value).alias("v")))
    fwd = running(df, keys, [order], {"_prev": Spec("last", seen)}, **kw)
    return running(fwd, keys, [order], {"_next": Spec("last", seen)}, descending=True, **kw)


def fill_forward_limited(df, keys, order, value, out, seconds: int, **kw) -> DataFrame:
    """Forward fill no further than a time limit."""
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("t"), F.col(value).alias("v")))
    fwd = running(df, keys, [order], {"_prev": Spec("last", seen)}, **kw)
    age = _seconds(F.col(order)) - _seconds(F.col("_prev.t"))
    return fwd.withColumn(out, F.when(age <= seconds, F.col("_prev.v"))).drop("_prev")


def interpolate(df, keys, order, value, out, max_seconds: int, **kw) -> DataFrame:
    """Straight line between the neighbours of a short gap; long gaps stay empty and are flagged."""
    both = _around(df, keys, order, value, **kw)
    t0, t1, at = _seconds(F.col("_prev.t")), _seconds(F.col("_next.t")), _seconds(F.col(order))
    short = (t1 - t0) <= max_seconds
    line = F.col("_prev.v") + (F.col("_next.v") - F.col("_prev.v")) * (at - t0) / (t1 - t0)
    return both.withColumn(out, F.coalesce(F.col(value), F.when(short, line))).withColumn(
        "long_gap", F.coalesce(F.col(value).isNull() & ~short, F.lit(False))).drop("_prev", "_next")


def knn_impute(df: DataFrame, row_id: str, target: str, features: list[str], k: int = 5) -> DataFrame:
    """Mean target of the k nearest complete rows, exactly: by cells in up to three dimensions (neighbours.knn), by tree leaves in more (leaves.nearest)."""
    if len(features) > 3:
        seen = df.where(F.col(target).isNotNull())
        near = nearest(df.where(F.col(target).isNull()), seen.select(F.col(row_id).alias("_donor"), *features), row_id, "_donor", features, k)
        near = near.join(seen.select(F.col(row_id).cast("long").alias("_donor"), F.col(target).alias("_value")), "_donor")
        filled = near.groupBy(row_id).agg(F.avg("_value").alias("_fill"))
        return df.join(filled, row_id, "left").withColumn(target, F.coalesce(F.col(target), F.col("_fill"))).drop("_fill")
    donors = df.where(F.col(target).isNotNull()).select(F.col(row_id).alias("_donor"), *features, F.col(target).alias("_value"))
    gaps = df.where(F.col(target).isNull()).select(row_id, *features)
    near = knn(gaps, donors, row_id, "_donor", features, k, ["_value"])
    filled = near.groupBy(row_id).agg(F.avg("_value").alias("_fill"))
    return df.join(filled, row_id, "left").withColumn(target, F.coalesce(F.col(target), F.col("_fill"))).drop("_fill")


def iterative_impute(df: DataFrame, row_id: str, columns: list[str], rounds: int = 10, forest: bool = False, tolerance: float = 1e-3) -> DataFrame:
    """Chained equations: start from means, then predict each column from the others, again and again."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    gaps = [c for c in columns if df.where(F.col(c).isNull()).limit(1).count()]
    state = df.select(row_id, *[F.coalesce(F.col(c).cast("double"), F.lit(means[c] or 0.0)).alias(c) for c in columns],
                      *[F.col(c).isNull().alias(f"_gap_{c}") for c in columns])
    for _ in range(rounds):
        moved = []
        for c in gaps:
            others = [o for o in columns if o != c]
            vec = VectorAssembler(inputCols=others, outputCol="_x").transform(state)
            learner = (RandomForestRegressor(featuresCol="_x", labelCol=c, predictionCol="_p", numTrees=10, maxDepth=6, seed=7) if forest
                       else LinearRegression(featuresCol="_x", labelCol=c, predictionCol="_p"))
            model = learner.fit(vec.where(~F.col(f"_gap_{c}")))
            new = F.when(F.col(f"_gap_{c}"), F.col("_p")).otherwise(F.col(c))
            state = cut_lineage(model.transform(vec).withColumn("_old", F.col(c)).withColumn(c, new).drop("_x", "_p"))
            step = state.agg(F.avg(F.abs(F.col(c) - F.col("_old"))) / (F.stddev_samp(c) + F.lit(1e-12))).first()[0]
            moved.append(step or 0.0)
            state = state.drop("_old")
        if not moved or max(moved) < tolerance:
            break
    return df.drop(*columns).join(state.select(row_id, *columns), row_id)


def low_rank_impute(df: DataFrame, row_id: str, columns: list[str], rank: int = 2, rounds: int = 8) -> DataFrame:
    """Matrix completion: scaled cells as (row, column, value) for alternating least squares, which wants 32-bit rows: they get dense codes."""
    codes = row_numbers(df.select(F.col(row_id).alias("_id")).distinct(), [], ["_id"], "_code")
    if codes.count() >= 1 << 31:
        raise ValueError("more rows than 32-bit codes")
    df = df.join(codes.select("_id", F.col("_code").cast("int").alias("_code")), F.col(row_id).eqNullSafe(F.col("_id"))).drop("_id")
    stats = df.agg(*[e for c in columns for e in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]).first()
    cells = F.array(*[F.struct(F.lit(i).alias("j"), ((F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0)).alias("v")) for i, c in enumerate(columns)])
    long = df.select(F.col("_code").alias("_row"), F.inline(cells))
    model = ALS(userCol="_row", itemCol="j", ratingCol="v", rank=rank, maxIter=rounds, regParam=0.05, seed=7).fit(long.where("v IS NOT NULL"))
    guess = model.transform(long.where("v IS NULL").drop("v"))
    wide = guess.groupBy("_row").agg(*[F.max(F.when(F.col("j") == i, F.col("prediction"))).alias(f"_f_{c}") for i, c in enumerate(columns)])
    joined = df.join(wide, F.col("_code") == F.col("_row"), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_f_{c}") * F.lit(stats[f"s_{c}"] or 1.0) + F.lit(stats[f"m_{c}"])) for c in columns}).drop(
        "_row", "_code", *[f"_f_{c}" for c in columns])


def choose_strategy(summary: DataFrame) -> DataFrame:
    """summary: column, null_pct, temporal, mixed."""
    p = F.col("null_pct")
    how = F.when(p == 0, "none").when(F.col("temporal") & (p < 10), "forward_backward_fill").when(F.col("temporal"), "knn_or_indicator").when(
        p > 50, "low_rank").when(F.col("mixed"), "forest").when(p < 30, "mean_or_median").otherwise("knn_or_iterative")
    return summary.select("column", "null_pct", how.alias("strategy"))
