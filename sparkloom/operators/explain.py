"""What a model uses, where it errs, and for whom."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sparkloom.functions.exprs import count_when, hash_bucket, ratio, rnd
from sparkloom.operators.metrics import curve_points


def importances(model, features: list[str], spark, k: int = 20) -> DataFrame:
    """Native importances, or absolute coefficients."""
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
    rows = sorted(((f, float(round(v, 6))) for f, v in zip(features, values)), key=lambda r: (-r[1], r[0]))[:k]
    return spark.createDataFrame(rows, "feature string, importance double")


def linear_contributions(df: DataFrame, coefficients: dict[str, float], k: int = 20) -> DataFrame:
    """Mean absolute contribution coef x (x - mean); exact for linear models."""
    means = df.agg(*[F.avg(c).alias(c) for c in coefficients]).first()
    wide = df.agg(*[F.avg(F.abs(F.lit(w) * (F.col(c) - F.lit(means[c])))).alias(c) for c, w in coefficients.items()])
    out = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), rnd(F.col(c)).alias("mean_abs")) for c in coefficients])))
    return out.orderBy(F.desc("mean_abs"), "feature").limit(k)


def shapley_sample(df: DataFrame, key: str, features: list[str], score: Callable[[DataFrame], DataFrame], background: int = 256, permutations: int = 8) -> DataFrame:
    """Permutation-sampled Shapley values of all rows.

    Each row is paired with one background row per permutation; along the permutation its features replace the background's one
    by one. All perturbed rows are scored in one transform. The background is a hashed sample of at most about `background`
    rows. score: adds a column `score` to rows with the features.
    """
    import random

    rng = random.Random(42)
    chance = min(1.0, background / max(df.count(), 1))
    pick = df.select(key, *features).where(hash_bucket(F.concat(F.col(key).cast("string"), F.lit("s")), 1 << 30) <= int(chance * (1 << 30)))
    back = pick.select(F.row_number().over(W.orderBy(key)).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in features])  # the sample only
    n = back.count()
    orders = []
    for p in range(permutations):
        o = list(range(len(features)))
        rng.shuffle(o)
        orders.append(o)
    steps = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(s).alias("s"), F.array(*[F.lit(f in o[:s]) for f in range(len(features))]).alias("own"), F.lit(o[s - 1] if s else -1).alias("f"))
                      for p, o in enumerate(orders) for s in range(len(features) + 1)])
    grid = df.select(key, *features, F.explode(steps).alias("_s")).withColumn("_b", hash_bucket(F.concat_ws("#", F.col(key).cast("string"), F.col("_s.p").cast("string")), max(n, 1)) + 1)
    mixed = grid.join(F.broadcast(back), "_b").select(key, "_s.p", "_s.s", "_s.f", *[F.when(F.col("_s.own")[i], F.col(c)).otherwise(F.col(f"_b_{c}")).alias(c) for i, c in enumerate(features)])
    scored = score(mixed).select(key, "p", "s", "f", "score")
    w = W.partitionBy(key, "p").orderBy("s")  # features + 1 rows
    gain = scored.withColumn("g", F.col("score") - F.lag("score").over(w)).where("s > 0").groupBy(key, "f").agg(F.avg("g").alias("phi"))
    names = F.array(*[F.lit(c) for c in features])
    return gain.select(key, names[F.col("f")].alias("feature"), "phi")


def permutation_importance(df: DataFrame, key: str, features: list[str], score: Callable[[DataFrame], float]) -> DataFrame:
    """Loss of score when one column is shuffled: rows trade values by rank of two hashes."""
    from sparkloom.operators.ordered import row_numbers

    base = score(df)
    a = row_numbers(df.withColumn("_h", hash_bucket(F.concat(F.col(key).cast("string"), F.lit("a")), 1 << 31)), [], ["_h", key], "_ra").drop("_h")
    rows = []
    for c in features:
        b = row_numbers(df.select(key, F.col(c).alias("_v"), hash_bucket(F.concat(F.col(key).cast("string"), F.lit("b")), 1 << 31).alias("_h")), [], ["_h", key], "_ra").select("_ra", "_v")
        rows.append((c, round(base - score(a.join(b, "_ra").withColumn(c, F.col("_v")).drop("_v", "_ra")), 4)))
    return df.sparkSession.createDataFrame(rows, "feature string, loss double")


def top_overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Share of the k most important features two models agree on."""
    top = lambda d: d.orderBy(F.desc("importance"), "feature").limit(k).select("feature")
    return top(a).intersect(top(b)).agg(F.count("*").alias("shared"), rnd(F.count("*") / F.lit(float(k))).alias("share"))


def error_segments(df: DataFrame, segments: dict[str, Column], wrong: Column) -> DataFrame:
    """Error rate by every single segment and pair of segments."""
    d = df.select(*[e.alias(n) for n, e in segments.items()], wrong.cast("int").alias("_w"))
    g = d.cube(*segments).agg(F.count("*").alias("n"), F.sum("_w").alias("errors"), F.grouping_id().alias("level"))
    return g.withColumn("error_rate", rnd(ratio(F.col("errors"), F.col("n"))))


def disparity(df: DataFrame, group: str) -> DataFrame:
    """Ratio and gap of positive rates, and gap of hit rates, between the extreme groups."""
    g = df.groupBy(group).agg(F.avg(F.col("pred").cast("double")).alias("rate"), F.avg(F.when(F.col("y") == 1, F.col("pred").cast("double"))).alias("tpr"))
    return g.agg(rnd(F.try_divide(F.min("rate"), F.max("rate"))).alias("disparate_impact"), rnd(F.max("rate") - F.min("rate")).alias("parity_gap"), rnd(F.max("tpr") - F.min("tpr")).alias("opportunity_gap"))


def group_thresholds(df: DataFrame, group: str, target_rate: float, **kw) -> DataFrame:
    """Highest score per group from which the hit rate reaches the target."""
    return curve_points(df, [group], **kw).where(F.col("tpr") >= target_rate).groupBy(group).agg(F.max("score").alias("threshold"))


def cluster_profile(df: DataFrame, cluster: str, features: list[str], label: str) -> DataFrame:
    """Size, centre and label share of each cluster."""
    return df.groupBy(cluster).agg(F.count("*").alias("n"), *[rnd(F.avg(c)).alias(f"mean_{c}") for c in features], rnd(F.avg(F.col(label).cast("double"))).alias("label_share"),
                                   count_when(F.col(label) == 1).alias("n_label"))


def ablation(df: DataFrame, features: list[str], fit_score: Callable[[list[str]], float]) -> DataFrame:
    """Score with all features and without each one."""
    base = fit_score(features)
    rows = [("(all)", round(base, 4), 0.0)]
    for c in features:
        s = fit_score([f for f in features if f != c])
        rows.append((c, round(s, 4), round(base - s, 4)))
    return df.sparkSession.createDataFrame(rows, "dropped string, score double, loss double")


def probability(df: DataFrame) -> DataFrame:
    return df.withColumn("score", vector_to_array("probability")[1])
