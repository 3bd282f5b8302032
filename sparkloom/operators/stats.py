"""Tests and estimates for experiments."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sparkloom.functions.exprs import count_when, hash_bucket, ratio, rnd, safe_corr, skew_g1, two_sided_p
from sparkloom.operators.ordered import Spec, running
from sparkloom.operators.quantiles import exact_quantiles


def arms(df: DataFrame, arm: str, value: str) -> DataFrame:
    aggs = []
    for a in (0, 1):
        x = F.when(F.col(arm) == a, F.col(value).cast("double"))
        aggs += [F.count(x).alias(f"n{a}"), F.avg(x).alias(f"m{a}"), F.var_samp(x).alias(f"v{a}")]
    return df.agg(*aggs)


def welch(df: DataFrame, arm: str, value: str) -> DataFrame:
    a = arms(df, arm, value)
    se = F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))
    diff = F.col("m1") - F.col("m0")
    return a.select(F.lit("welch_t").alias("test"), rnd(diff, 6).alias("difference"), rnd(F.try_divide(diff, se), 5).alias("statistic"), rnd(two_sided_p(F.try_divide(diff, se)), 5).alias("p"),
                    rnd(diff - 1.96 * se, 5).alias("low"), rnd(diff + 1.96 * se, 5).alias("high"))


def proportions_z(df: DataFrame, arm: str, value: str) -> DataFrame:
    a = arms(df, arm, value)
    n1, n0 = F.col("n1"), F.col("n0")
    pool = (F.col("m1") * n1 + F.col("m0") * n0) / (n1 + n0)
    se = F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n0))
    un = F.sqrt(F.col("m1") * (1 - F.col("m1")) / n1 + F.col("m0") * (1 - F.col("m0")) / n0)
    diff = F.col("m1") - F.col("m0")
    return a.select(F.lit("proportion_z").alias("test"), rnd(diff, 6).alias("difference"), rnd(F.try_divide(diff, se), 5).alias("statistic"), rnd(two_sided_p(F.try_divide(diff, se)), 5).alias("p"),
                    rnd(diff - 1.96 * un, 5).alias("low"), rnd(diff + 1.96 * un, 5).alias("high"))


def sample_ratio(df: DataFrame, arm: str, expected: float = 0.5) -> DataFrame:
    c = df.agg(F.count("*").alias("n"), count_when(F.col(arm) == 1).alias("n1"))
    e1 = F.col("n") * expected
    chi = F.pow(F.col("n1") - e1, 2) / e1 + F.pow(F.col("n") - F.col("n1") - (F.col("n") - e1), 2) / (F.col("n") - e1)
    return c.select("n", "n1", rnd(chi).alias("chi_square"), (chi > 10.828).alias("mismatch"))


def power(df: DataFrame, segment: str, value: str, lift: float = 0.1, z: float = 1.96 + 0.8416) -> DataFrame:
    """Rows per arm to see a relative lift, and the smallest effect the given rows can show."""
    g = df.groupBy(segment).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    need = F.ceil(2 * F.pow(F.lit(z), 2) * F.col("v") / F.pow(lift * F.col("m"), 2))
    return g.select(segment, "n", need.cast("bigint").alias("n_per_arm"), rnd(F.lit(z) * F.sqrt(4 * F.col("v") / F.col("n")), 5).alias("mde"))


def adjust_p(df: DataFrame, family: str, test: str, p: str, **kw) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg per family of tests."""
    sizes = df.groupBy(family).agg(F.count("*").alias("_m"))
    r = running(df, [family], [p, test], {"_i": Spec("count", F.lit(1))}, **kw).join(sizes, family)
    one = lambda c: F.least(F.lit(1.0), c)
    r = r.withColumn("_h", (F.col("_m") - F.col("_i") + 1) * F.col(p)).withColumn("_b", F.col("_m") / F.col("_i") * F.col(p))
    r = running(r, [family], [p, test], {"_holm": Spec("max", F.col("_h"))}, **kw)
    r = running(r, [family], [p, test], {"_bh": Spec("min", F.col("_b"))}, descending=True, **kw)
    return r.select(family, test, p, rnd(one(F.col("_m") * F.col(p)), 6).alias("bonferroni"), rnd(one(F.col("_holm")), 6).alias("holm"), rnd(one(F.col("_bh")), 6).alias("bh"))


def effect_sizes(df: DataFrame, arm: str, value: str, outcome: str) -> DataFrame:
    v = arms(df, arm, value)
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    d = v.select(rnd(F.try_divide(F.col("m1") - F.col("m0"), pooled), 5).alias("cohens_d")).first()[0]
    a, y = F.col(arm), F.col(outcome)
    c = df.agg(*[count_when((a == i) & (y == j)).cast("double").alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)])
    return c.select(F.lit(d).alias("cohens_d"), rnd(F.try_divide(F.col("c11") * F.col("c00"), F.col("c10") * F.col("c01")), 5).alias("odds_ratio"),
                    rnd(F.try_divide(F.col("c11") / (F.col("c11") + F.col("c10")), F.col("c01") / (F.col("c01") + F.col("c00"))), 5).alias("relative_risk"))


def jarque_bera(df: DataFrame, columns: list[str]) -> DataFrame:
    from sparkloom.operators.profile import stack

    wide = df.agg(*[e for i, c in enumerate(columns) for e in (F.count(c).alias(f"n{i}"), F.skewness(c).alias(f"s{i}"), F.kurtosis(c).alias(f"k{i}"))])
    rows = []
    for i, c in enumerate(columns):
        jb = F.col(f"n{i}") / 6 * (F.pow(F.col(f"s{i}"), 2) + F.pow(F.col(f"k{i}"), 2) / 4)
        rows.append((c, {"jarque_bera": rnd(jb, 2), "normal": jb < 5.991}))
    return stack(wide, rows)


def mad_outliers(df: DataFrame, column: str, limit: float = 3.5) -> DataFrame:
    med = exact_quantiles(df, [column], [0.5])[column][0]
    off = df.withColumn("_d", F.abs(F.col(column) - F.lit(med)))
    mad = exact_quantiles(off, ["_d"], [0.5])["_d"][0]
    score = F.try_divide(0.6745 * F.col("_d"), F.lit(mad))
    return off.agg(F.lit(med).alias("median"), rnd(F.lit(mad)).alias("mad"), count_when(score > limit).alias("n_outliers"))


def breusch_pagan(df: DataFrame, x: str, y: str) -> DataFrame:
    """Test for uneven residual spread, with classical and HC0 errors of the slope."""
    f = df.agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.avg(x).alias("mx")).first()
    e = F.col(y) - (F.lit(f["a"]) + F.lit(f["b"]) * F.col(x))
    d = F.col(x) - F.lit(f["mx"])
    n = F.count("*")
    sxx = F.sum(d * d)
    r2 = F.pow(safe_corr(e * e, F.col(x)), 2)
    return df.agg(rnd(F.lit(f["b"]), 6).alias("slope"), rnd(n * r2).alias("lm"), (n * r2 > 3.841).alias("uneven"),
                  rnd(F.sqrt(F.sum(e * e) / (n - 2) / sxx), 6).alias("se"), rnd(F.sqrt(F.sum(d * d * e * e) / (sxx * sxx)), 6).alias("se_hc0"))


def diff_in_diff(df: DataFrame, treated: Column, after: Column, value: str) -> DataFrame:
    v = F.col(value)
    m = lambda t, p: F.avg(F.when((treated == t) & (after == p), v))
    return df.agg(rnd(m(True, True) - m(True, False), 5).alias("treated_change"), rnd(m(False, True) - m(False, False), 5).alias("control_change"),
                  rnd((m(True, True) - m(True, False)) - (m(False, True) - m(False, False)), 5).alias("effect"))


def propensity_match(df: DataFrame, key: str, arm: str, covariates: list[str], outcome: str, caliper: float = 0.05, **kw) -> DataFrame:
    """Nearest control by score for each treated row, found as the last control before and the first after it."""
    vec = VectorAssembler(inputCols=covariates, outputCol="_x").transform(df)
    model = LogisticRegression(featuresCol="_x", labelCol=arm, maxIter=50).fit(vec)
    scored = model.transform(vec).select(key, arm, outcome, vector_to_array("probability")[1].alias("score"))
    control = F.when(F.col(arm) == 0, F.struct(F.col("score").alias("s"), F.col(outcome).alias("y"), F.col(key).alias("k")))
    both = running(scored, [], ["score", key], {"_lo": Spec("last", control)}, **kw)
    both = running(both, [], ["score", key], {"_hi": Spec("last", control)}, descending=True, **kw)
    lo, hi = F.col("score") - F.col("_lo.s"), F.col("_hi.s") - F.col("score")
    near = F.when(F.coalesce(lo, F.lit(9.0)) <= F.coalesce(hi, F.lit(9.0)), F.col("_lo")).otherwise(F.col("_hi"))
    pairs = both.where(F.col(arm) == 1).withColumn("_m", near).where(F.abs(F.col("_m.s") - F.col("score")) <= caliper)
    return pairs.agg(F.count("*").alias("n_pairs"), rnd(F.avg(F.col(outcome) - F.col("_m.y"))).alias("effect"))


def permutation_test(df: DataFrame, key: str, arm: str, value: str, reps: int) -> DataFrame:
    """Observed difference of means against hashed reassignments of the arms; one pass for all of them."""
    x = F.col(value).cast("double")
    share = df.agg(F.avg(arm)).first()[0]
    diff = lambda one: F.avg(F.when(one, x)) - F.avg(F.when(~one, x))
    draws = [diff(hash_bucket(F.concat(F.col(key).cast("string"), F.lit(f"/{r}")), 100_000) < int(share * 100_000)).alias(f"d{r}") for r in range(reps)]
    wide = df.agg(diff(F.col(arm) == 1).alias("observed"), *draws)
    extreme = sum((F.when(F.abs(f"d{r}") >= F.abs("observed"), 1).otherwise(0) for r in range(reps)), F.lit(0))
    return wide.select(rnd(F.col("observed"), 5).alias("observed"), rnd((extreme + 1) / (reps + 1), 5).alias("p"))


def inverse_propensity_ctr(df: DataFrame, item: str, clicked: Column, position: str) -> DataFrame:
    """Click rate weighted by the inverse of each position's examination share (relative to the first)."""
    by_pos = df.groupBy(position).agg(F.avg(clicked.cast("double")).alias("_c"))
    top = by_pos.agg(F.max("_c")).first()[0]
    weights = by_pos.select(position, F.try_divide(F.lit(top), F.col("_c")).alias("_w"))
    return df.join(weights, position).groupBy(item).agg(F.count("*").alias("n"), rnd(F.avg(clicked.cast("double")), 5).alias("ctr"), rnd(F.avg(clicked.cast("double") * F.col("_w")), 5).alias("ctr_unbiased"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    ra = cells.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("x"))
    rb = cells.groupBy(F.col("b").alias("c")).agg(F.sum("n").alias("y"))
    expected = ra.join(rb, "c").agg(F.sum(F.col("x").cast("double") * F.col("y"))).first()[0] or 0
    s = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    n, pe = F.col("n").cast("double"), F.lit(float(expected)) / F.pow(F.col("n").cast("double"), 2)
    return s.select("n", rnd(F.col("same") / n, 5).alias("agreement"), rnd(F.try_divide(F.col("same") / n - pe, 1 - pe), 5).alias("kappa"))


def dawid_skene(votes: DataFrame, item: str, rater: str, label: str, rounds: int = 5) -> DataFrame:
    """Most likely class per item and rater accuracies, by expectation-maximisation over grouped counts."""
    from sparkloom.session import cut_lineage

    counts = votes.groupBy(item, label).agg(F.count("*").alias("n"))
    total = votes.groupBy(item).agg(F.count("*").alias("t"))
    belief = counts.join(total, item).select(item, F.col(label).alias("c"), (F.col("n") / F.col("t")).alias("w"))
    for _ in range(rounds):
        seen = votes.join(belief, item)
        acc = seen.groupBy(rater).agg(((F.sum(F.when(F.col(label) == F.col("c"), F.col("w")).otherwise(0.0)) + 1) / (F.sum("w") + 2)).alias("acc"))
        prior = belief.groupBy("c").agg(F.sum("w").alias("prior"))
        k = prior.count()
        like = seen.join(acc, rater).join(prior, "c").groupBy(item, "c").agg(
            (F.sum(F.log(F.when(F.col(label) == F.col("c"), F.col("acc")).otherwise((1 - F.col("acc")) / max(k - 1, 1)))) + F.log(F.max("prior"))).alias("l"))
        w = W.partitionBy(item)  # one row per class
        peak = like.withColumn("e", F.exp(F.col("l") - F.max("l").over(w)))
        belief = cut_lineage(peak.select(item, "c", (F.col("e") / F.sum("e").over(w)).alias("w")))
    return belief.groupBy(item).agg(F.max_by("c", F.struct("w", -F.col("c"))).alias("label"), rnd(F.max("w")).alias("certainty"))
