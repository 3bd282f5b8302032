"""Deterministic splits, folds, weights and resamples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions.exprs import hash_bucket, ladder
from sparkloom.operators.neighbours import knn
from sparkloom.operators.ordered import Spec, row_numbers, running


def hash_split(df: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    return df.withColumn("part", F.when(hash_bucket(key, 1000) < int(share * 1000), "test").otherwise("train"))


def _numbered_in_class(df: DataFrame, key: str, target: str, **kw) -> DataFrame:
    return row_numbers(df.withColumn("_h", hash_bucket(key, 1 << 31)), [target], ["_h", key], "_rn", **kw)


def stratified_split(df: DataFrame, key: str, target: str, share: float = 0.2, **kw) -> DataFrame:
    """Exactly round(share * n) test rows per class."""
    sizes = df.groupBy(target).agg(F.round(F.count("*") * F.lit(share)).alias("_k"))
    out = _numbered_in_class(df, key, target, **kw).join(sizes, target)
    return out.withColumn("part", F.when(F.col("_rn") <= F.col("_k"), "test").otherwise("train")).drop("_h", "_rn", "_k")


def stratified_folds(df: DataFrame, key: str, target: str, k: int = 5, **kw) -> DataFrame:
    return _numbered_in_class(df, key, target, **kw).withColumn("fold", (F.col("_rn") % k).cast("int")).drop("_h", "_rn")


def group_folds(df: DataFrame, entity: str, k: int = 5) -> DataFrame:
    return df.withColumn("fold", hash_bucket(entity, k).cast("int"))


def walk_forward(df: DataFrame, ts: str, cuts: list[str], purge: str) -> DataFrame:
    """One row per (row, step): train before each cut minus the purge gap, test up to the next cut."""
    parts = []
    at = F.col(ts)
    for i, cut in enumerate(cuts[:-1]):
        a, b = F.lit(cut).cast("timestamp_ntz"), F.lit(cuts[i + 1]).cast("timestamp_ntz")
        side = F.when(at < a - F.expr(f"INTERVAL {purge}"), "train").when((at >= a) & (at < b), "test")
        parts.append(F.when(side.isNotNull(), F.struct(F.lit(i).alias("step"), side.alias("part"))))
    return df.select("*", F.explode(F.array_compact(F.array(*parts))).alias("_s")).select("*", "_s.step", "_s.part").drop("_s")


def time_and_user_split(df: DataFrame, ts: str, cut: str, entity: str, k: int = 5) -> DataFrame:
    """Train: early rows of most users; test: late rows of the others; the rest is left out."""
    early = F.col(ts) < F.lit(cut).cast("timestamp_ntz")
    held = hash_bucket(entity, k) == 0
    return df.withColumn("part", F.when(early & ~held, "train").when(~early & held, "test").otherwise("unused"))


def sentinel(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Order-free fingerprint of a held-out set: count and sum of row hashes."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    return df.agg(F.count("*").alias("n_rows"), (F.sum(hash_bucket(text, 1 << 31)) % F.lit(1_000_000_007)).cast("bigint").alias("fingerprint"))


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Rows with a weight that balances the classes. A row per class is counted in one pass and goes to the tasks, the rows themselves are not shuffled by class."""
    counts = df.groupBy(target).agg(F.count("*").alias("_nc"))
    classes = counts.collect()  # as a classifier's model, of the size of the classes
    total = float(sum(r["_nc"] for r in classes))
    weights = df.sparkSession.createDataFrame(classes, counts.schema).select(target, (F.lit(total) / (F.lit(len(classes)) * F.col("_nc"))).alias("weight"))
    return df.join(F.broadcast(weights), target)


def undersample(df: DataFrame, key: str, target: str, ratio: float = 1.0, bag: int = 0) -> DataFrame:
    """All positives and a hashed part of the negatives; another bag draws another part."""
    s = df.agg(F.count_if(F.col(target) == 1), F.count_if(F.col(target) == 0)).first()
    rate = min(1.0, ratio * s[0] / max(s[1], 1))
    drawn = hash_bucket(F.concat(F.col(key).cast("string"), F.lit(f"-{bag}")), 1000) < int(round(rate * 1000))
    return df.where((F.col(target) == 1) | drawn).withColumn("bag", F.lit(bag))


def smote(df: DataFrame, key: str, target: str, coords: list[str], k: int = 5) -> DataFrame:
    """One synthetic minority row per (minority row, neighbour): a hashed step along the line."""
    minority = df.where(F.col(target) == 1).select(key, *coords)
    donors = minority.select(F.col(key).alias("_d"), *coords)
    near = knn(minority, donors, key, "_d", coords, k, skip_self=True)
    ends = donors.select("_d", *[F.col(c).alias(f"_e_{c}") for c in coords])
    step = hash_bucket(F.concat_ws("-", key, "_d"), 1000) / 1000.0
    joined = near.select(key, "_d").join(minority, key).join(ends, "_d").withColumn("_u", step)
    made = joined.select(key, F.col("_d").alias("other"), *[(F.col(c) + F.col("_u") * (F.col(f"_e_{c}") - F.col(c))).alias(c) for c in coords])
    return made.withColumn(target, F.lit(1))


def poisson_steps(mean: float = 1.0) -> list[float]:
    """Distribution function at 0, 1, 2, ... until a double holds no more of it."""
    import math

    out, mass = [], math.exp(-mean)
    while not out or mass > 2.0**-54:
        out.append((out[-1] if out else 0.0) + mass)
        mass *= mean / len(out)
    return out


POISSON = poisson_steps()


def poisson_weight(key: str, rep: int) -> Column:
    """The smallest count whose distribution function lies above a hash with 52 bits, a number between 0 and 1."""
    digits = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{rep}"))), 1, 13)
    u = F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))
    return ladder(u, [(p, i) for i, p in enumerate(POISSON)], len(POISSON))


def bootstrap_means(df: DataFrame, key: str, value: str, reps: int, batch: int = 50) -> DataFrame:
    """Weighted mean per replicate; the weights come from a hash, so no rows are copied."""
    out = None
    for start in range(0, reps, batch):
        ids = range(start, min(start + batch, reps))
        aggs = []
        for r in ids:
            w = poisson_weight(key, r)
            aggs += [F.try_divide(F.sum(w * F.col(value)), F.sum(F.when(F.col(value).isNotNull(), w))).alias(f"m{r}")]
        wide = df.agg(*aggs).select(F.inline(F.array(*[F.struct(F.lit(r).alias("rep"), F.col(f"m{r}").alias("mean")) for r in ids])))
        out = wide if out is None else out.unionByName(wide)
    return out


def negative_pairs(pairs: DataFrame, user: str, item: str, items: DataFrame, per_pair: int = 1, **kw) -> DataFrame:
    """per_pair items of the item table for each positive pair of a user, all different and none with a positive pair of the user.

    Items are numbered in hashed order. The j-th free item of a user is j plus the known items before it, so a draw takes free numbers
    in a row from a hashed start: nothing collides, nothing is drawn again. A user with fewer free items than that gets all of them.
    """
    numbered = row_numbers(items.select(item).distinct().withColumn("_h", F.md5(F.col(item).cast("string"))), [], ["_h", item], "_n", **kw).select(item, (F.col("_n") - 1).alias("_n"))
    n = numbered.count()
    known = pairs.select(user, item).distinct().join(numbered, item).select(user, "_n")
    marks = row_numbers(known, [user], ["_n"], "_i", **kw).select(user, (F.col("_n") - F.col("_i") + 1).alias("_at"), F.lit(0).alias("_draw"))
    sizes = known.groupBy(user).agg((F.count("*") * per_pair).alias("_k"), (F.lit(n) - F.count("*")).alias("_free")).where("_free > 0")
    draws = sizes.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("_k", "_free") - 1)))
    draws = draws.select(user, ((hash_bucket(user, 1 << 31) + F.col("_j")) % F.col("_free")).alias("_at"), F.lit(1).alias("_draw"))
    counted = running(marks.unionByName(draws), [user], ["_at", "_draw"], {"_before": Spec("count", F.when(F.col("_draw") == 0, 1))}, **kw)
    return counted.where("_draw = 1").select(user, (F.col("_at") + F.col("_before")).alias("_n")).join(numbered, "_n").select(user, item)
