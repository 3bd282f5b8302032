"""Drift of a current table against a reference table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions.exprs import count_when, ratio, rnd
from sparkloom.operators.ordered import Spec, following, running
from sparkloom.operators.quantiles import exact_quantiles, grouped_quantiles
from sparkloom.operators.transforms import cut


def both_sides(ref: DataFrame, cur: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, n_ref, n_cur): one row per distinct value."""
    def side(df, r, c):
        cells = F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).cast("double").alias("value")) for x in columns])
        return df.select(F.inline(cells)).where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n")).select(
            "feature", "value", (F.col("n") * r).alias("n_ref"), (F.col("n") * c).alias("n_cur"))
    return side(ref, 1, 0).unionByName(side(cur, 0, 1)).groupBy("feature", "value").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))


def _cdfs(groups: DataFrame, **kw) -> DataFrame:
    cum = running(groups, ["feature"], ["value"], {"c_ref": Spec("sum", F.col("n_ref")), "c_cur": Spec("sum", F.col("n_cur"))}, **kw)
    totals = groups.groupBy("feature").agg(F.sum("n_ref").alias("all_ref"), F.sum("n_cur").alias("all_cur"))
    return cum.join(totals, "feature").withColumn("gap", F.abs(ratio(F.col("c_ref"), F.col("all_ref")) - ratio(F.col("c_cur"), F.col("all_cur"))))


def ks_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p of the two-sample statistic."""
    lam = F.sqrt(n * m / (n + m)) * d
    total = sum((((-1) ** (j - 1)) * F.exp(-2.0 * j * j * lam * lam) for j in range(1, 41)), F.lit(0.0))
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * total)))


def ks_test(ref: DataFrame, cur: DataFrame, columns: list[str], **kw) -> DataFrame:
    g = _cdfs(both_sides(ref, cur, columns), **kw).groupBy("feature").agg(
        F.max("gap").alias("ks"), F.max("all_ref").alias("n_ref"), F.max("all_cur").alias("n_cur"))
    return g.select("feature", "n_ref", "n_cur", rnd(F.col("ks"), 6).alias("ks"), rnd(ks_p(F.col("ks"), F.col("n_ref").cast("double"), F.col("n_cur").cast("double")), 6).alias("p"))


def wasserstein(ref: DataFrame, cur: DataFrame, columns: list[str], **kw) -> DataFrame:
    """Area between the two distribution functions."""
    cdf = following(_cdfs(both_sides(ref, cur, columns), **kw), ["feature"], ["value"], {"next": "value"}, **kw)
    return cdf.groupBy("feature").agg(rnd(F.sum(F.col("gap") * (F.col("next") - F.col("value"))), 5).alias("wasserstein"))


def bin_shares(ref: DataFrame, cur: DataFrame, columns: list[str], bins: int = 10, extra: dict[str, Column] | None = None):
    """Shares per reference-quantile bin; `extra` splits the current side further (for example by day)."""
    edges = exact_quantiles(ref, columns, [i / bins for i in range(1, bins)])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), cut(F.col(c).cast("double"), sorted(set(edges[c]))).alias("bin"),
                               F.lit(len(set(edges[c])) + 1).alias("n_bins")) for c in columns])
    a = ref.select(F.inline(cells)).where("bin IS NOT NULL").groupBy("feature", "bin", "n_bins").agg(F.count("*").alias("n_ref"))
    names = list(extra or {})
    b = cur.select(*[e.alias(n) for n, e in (extra or {}).items()], F.inline(cells)).where("bin IS NOT NULL").groupBy(*names, "feature", "bin", "n_bins").agg(F.count("*").alias("n_cur"))
    return a, b, names


def psi_terms(a: Column, b: Column, floor: float = 1e-4) -> Column:
    x, y = F.greatest(a, F.lit(floor)), F.greatest(b, F.lit(floor))
    return (y - x) * F.log(y / x)


def kl_terms(a: Column, b: Column, floor: float = 1e-4) -> Column:
    x, y = F.greatest(a, F.lit(floor)), F.greatest(b, F.lit(floor))
    return y * F.log(y / x)


def _verdict(psi: Column) -> Column:
    return F.when(psi < 0.1, "stable").when(psi <= 0.2, "monitor").otherwise("retrain")


def psi(ref: DataFrame, cur: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    a, b, _ = bin_shares(ref, cur, columns, bins)
    both = a.join(b.drop("n_bins"), ["feature", "bin"], "full").fillna(0, ["n_ref", "n_cur"])
    totals = both.groupBy("feature").agg(F.sum("n_ref").alias("all_ref"), F.sum("n_cur").alias("all_cur"))
    x, y = ratio(F.col("n_ref"), F.col("all_ref")), ratio(F.col("n_cur"), F.col("all_cur"))
    out = both.join(totals, "feature").groupBy("feature").agg(rnd(F.sum(psi_terms(x, y)), 6).alias("psi"), rnd(F.sum(kl_terms(x, y)), 6).alias("kl"))
    return out.select("feature", "psi", "kl", _verdict(F.col("psi")).alias("verdict"))


def psi_by_period(ref: DataFrame, cur: DataFrame, column: str, period: Column, bins: int = 10, name: str = "period") -> DataFrame:
    """PSI of every period against one baseline; a period keeps a row for each bin, even an empty one."""
    a, b, names = bin_shares(ref, cur, [column], bins, {name: period})
    p = names[0]
    total_ref = a.agg(F.sum("n_ref")).first()[0] or 1
    sizes = b.groupBy(p).agg(F.sum("n_cur").alias("all_cur"))
    base = a.agg(F.collect_list(F.struct("bin", "n_ref")).alias("bins"))  # one short list
    listed = base.first()["bins"]
    lit = F.array(*[F.struct(F.lit(r["bin"]).alias("bin"), F.lit(r["n_ref"]).alias("n_ref")) for r in listed])
    grid = sizes.select(p, "all_cur", F.inline(lit))
    both = grid.join(b.select(p, "bin", "n_cur"), [p, "bin"], "left").fillna(0, ["n_cur"])
    x, y = F.col("n_ref") / F.lit(float(total_ref)), ratio(F.col("n_cur"), F.col("all_cur"))
    out = both.groupBy(p).agg(F.max("all_cur").alias("n"), rnd(F.sum(psi_terms(x, y)), 6).alias("psi"))
    return out.withColumn("verdict", _verdict(F.col("psi")))


def category_counts(ref: DataFrame, cur: DataFrame, column: str) -> DataFrame:
    a = ref.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n_ref"))
    b = cur.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n_cur"))
    return a.join(b, "value", "full").fillna(0)


def category_shift(ref: DataFrame, cur: DataFrame, column: str) -> DataFrame:
    """Homogeneity chi-square and PSI of a categorical column."""
    c = category_counts(ref, cur, column)
    s = c.agg(F.sum("n_ref"), F.sum("n_cur")).first()
    nr, nc = float(s[0] or 1), float(s[1] or 1)
    both = F.col("n_ref") + F.col("n_cur")
    er, ec = both * nr / (nr + nc), both * nc / (nr + nc)
    chi = F.sum(F.pow(F.col("n_ref") - er, 2) / er + F.pow(F.col("n_cur") - ec, 2) / ec)
    return c.agg(F.lit(column).alias("feature"), rnd(chi).alias("chi_square"), (F.count("*") - 1).alias("df"),
                 rnd(F.sum(psi_terms(F.col("n_ref") / nr, F.col("n_cur") / nc)), 6).alias("psi"))


def schema_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns added, removed or retyped between two versions of a table."""
    spark = a.sparkSession
    rows = lambda df, n: spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], f"column string, {n} string")
    both = rows(a, "old_type").join(rows(b, "new_type"), "column", "full")
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when(
        F.col("old_type") != F.col("new_type"), "retyped").otherwise("same")
    return both.withColumn("change", change)


def report(parts: DataFrame) -> DataFrame:
    """parts: feature, verdict. Adds the overall recommendation."""
    bad = count_when(F.col("verdict") == "retrain")
    mid = count_when(F.col("verdict") == "monitor")
    whole = parts.agg(F.lit("overall").alias("feature"), F.when(bad > 0, "retrain").when(mid > 0, "monitor").otherwise("stable").alias("verdict"))
    return parts.select("feature", "verdict").unionByName(whole)


def canary(df: DataFrame, arm: Column, period: Column, failed: Column, latency: str, max_error_gap: float = 0.01, max_slowdown: float = 1.2) -> DataFrame:
    """Error rate and p95 latency of the canary against control, per period."""
    d = df.select(arm.alias("arm"), period.alias("period"), failed.cast("double").alias("bad"), F.col(latency).alias("_l"))
    s = d.groupBy("arm", "period").agg(F.count("*").alias("n"), F.avg("bad").alias("err"))
    both = s.join(grouped_quantiles(d, ["arm", "period"], "_l", {"p95": 0.95}), ["arm", "period"])
    side = lambda a, tag: both.where(F.col("arm") == a).select("period", F.col("n").alias(f"n_{tag}"), F.col("err").alias(f"err_{tag}"), F.col("p95").alias(f"p95_{tag}"))
    j = side(1, "canary").join(side(0, "control"), "period", "full")
    bad = ((F.col("err_canary") - F.col("err_control")) > max_error_gap) | (F.col("p95_canary") > max_slowdown * F.col("p95_control"))
    return j.select("period", "n_canary", "n_control", *[rnd(F.col(c), 5).alias(c) for c in ("err_canary", "err_control", "p95_canary", "p95_control")],
                    F.coalesce(bad, F.lit(False)).alias("rollback"))
