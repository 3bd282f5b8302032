"""Customer and campaign analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sparkloom.functions.exprs import count_when, days_between, ladder, micros, ratio, rnd
from sparkloom.operators.ordered import Spec, previous, row_numbers, running, tiles


def rfm(df: DataFrame, customer: str, at: str, amount: str, as_of: Column, **kw) -> DataFrame:
    """Recency, frequency and money per customer with fifths (5 is best)."""
    g = df.groupBy(customer).agg(days_between(as_of, F.max(at)).alias("recency"), F.count("*").alias("frequency"), F.round(F.sum(amount), 2).alias("monetary"))
    g = tiles(g.withColumn("_o", -F.col("recency")), ["_o", customer], 5, "r", **kw).drop("_o")
    g = tiles(g, ["frequency", customer], 5, "f", **kw)
    return tiles(g, ["monetary", customer], 5, "m", **kw)


def lifetime_value(df: DataFrame, customer: str, at: str, amount: str) -> DataFrame:
    """Average order x orders per year x years active (at least one year)."""
    years = F.greatest(days_between(F.max(at), F.min(at)) / 365.0, F.lit(1.0))
    g = df.groupBy(customer).agg(F.avg(amount).alias("aov"), F.count("*").alias("n"), years.alias("years"))
    return g.select(customer, rnd(F.col("aov"), 7).alias("aov"), rnd(F.col("n") / F.col("years")).alias("per_year"), rnd(F.col("years")).alias("years"),
                    rnd(F.col("aov") * (F.col("n") / F.col("years")) * F.col("years"), 2).alias("clv"))


def churn_flags(df: DataFrame, customer: str, at: str, as_of: Column, limits=(30, 60, 90)) -> DataFrame:
    g = df.groupBy(customer).agg(days_between(as_of, F.max(at)).alias("idle"), days_between(as_of, F.min(at)).alias("age"), F.count("*").alias("n"))
    stage = F.when(F.col("idle") > limits[-1], "lost").when(F.col("idle") > limits[0], "at_risk").when(F.col("age") <= limits[0], "new").when(F.col("n") >= 10, "loyal").otherwise("active")
    return g.select(customer, "idle", *[(F.col("idle") > x).alias(f"churned_{x}") for x in limits], stage.alias("stage"))


def cohorts(df: DataFrame, customer: str, period: Column, gap) -> DataFrame:
    """(cohort, size, k, n, share): customers of each first-period cohort seen again k periods later, for every k there is.

    gap(later, first) counts periods.
    """
    seen = df.select(F.col(customer), period.alias("_p")).distinct()
    first = seen.groupBy(customer).agg(F.min("_p").alias("cohort"))
    k = seen.join(first, customer).withColumn("k", gap(F.col("_p"), F.col("cohort")))
    size = first.groupBy("cohort").agg(F.count("*").alias("size"))
    return k.groupBy("cohort", "k").agg(F.count("*").alias("n")).join(size, "cohort").select("cohort", "size", "k", "n", rnd(F.col("n") / F.col("size")).alias("share"))


def funnel(df: DataFrame, customer: str, at: str, kind: str, steps: list[str], within: str) -> DataFrame:
    """Users who reach each step in order, all within a time limit from the first one."""
    start = df.where(F.col(kind) == steps[0]).groupBy(customer).agg(F.min(at).alias("_t0"))
    state = start.withColumn("_t", F.col("_t0"))
    counts = [state.agg(F.count("*").alias("n")).select(F.lit(1).alias("step"), F.lit(steps[0]).alias("name"), "n")]
    for i, s in enumerate(steps[1:], 2):
        nxt = df.where(F.col(kind) == s).select(customer, F.col(at).alias("_a")).join(state, customer)
        state = nxt.where((F.col("_a") > F.col("_t")) & (F.col("_a") <= F.col("_t0") + F.expr(f"INTERVAL {within}"))).groupBy(customer, "_t0").agg(F.min("_a").alias("_t"))
        counts.append(state.agg(F.count("*").alias("n")).select(F.lit(i).alias("step"), F.lit(s).alias("name"), "n"))
    table = counts[0]
    for c in counts[1:]:
        table = table.unionByName(c)
    w = W.orderBy("step")  # one row per step
    return table.select("step", "name", "n", rnd(ratio(F.col("n"), F.first("n").over(w))).alias("of_first"), rnd(1 - ratio(F.col("n"), F.lag("n").over(w))).alias("drop_off"))


def paths(touches: DataFrame, user: str, order: list[str], converts: Column, **kw) -> DataFrame:
    """Touches before each conversion: path number, position, path length, seconds before the conversion."""
    ts = order[0]
    won = F.when(converts, 1).otherwise(0)
    runs = running(touches.withColumn("_won", won), [user], order, {"path": Spec("sum", F.col("_won"))}, before="rows", **kw)
    runs = runs.withColumn("path", F.coalesce("path", F.lit(0)))
    ends = runs.where("_won = 1").select(user, "path", F.col(ts).alias("_end"), F.col("value").alias("revenue"))
    steps = runs.where("_won = 0").join(ends, [user, "path"])
    steps = row_numbers(steps, [user, "path"], order, "position", **kw)
    size = steps.groupBy(user, "path").agg(F.count("*").alias("length"))
    return steps.join(size, [user, "path"]).withColumn("age", (micros("_end") - micros(ts)) / 1e6).drop("_won", "_end")


def attribution(p: DataFrame, user: str, channel: str, half_life_days: float = 7.0) -> DataFrame:
    """Conversions credited to each channel by five rules."""
    n, i = F.col("length"), F.col("position")
    decay = F.pow(F.lit(2.0), -F.col("age") / (half_life_days * 86400))
    d = p.withColumn("_d", decay)
    sums = d.groupBy(user, "path").agg(F.sum("_d").alias("_ds"))
    d = d.join(sums, [user, "path"])
    place = F.when(n == 1, 1.0).when(n == 2, 0.5).when((i == 1) | (i == n), 0.4).otherwise(0.2 / (n - 2))
    return d.groupBy(channel).agg(
        F.sum(F.when(i == 1, 1).otherwise(0)).alias("first"), F.sum(F.when(i == n, 1).otherwise(0)).alias("last"),
        rnd(F.sum(1.0 / n)).alias("linear"), rnd(F.sum(F.col("_d") / F.col("_ds"))).alias("time_decay"), rnd(F.sum(place)).alias("position"))


def markov_removal(touches: DataFrame, user: str, order: list[str], channel: str, converts: Column, **kw) -> DataFrame:
    """Removal effect of each channel: transitions are counted on the cluster, the small chain is solved here."""
    import numpy as np

    state = F.when(converts, "(won)").otherwise(F.col(channel))
    seq = previous(touches.withColumn("_s", state), [user], order, {"_p": "_s"}, **kw)
    source = F.when(F.col("_p").isNull() | (F.col("_p") == "(won)"), "(start)").otherwise(F.col("_p"))
    moves = seq.groupBy(source.alias("a"), F.col("_s").alias("b")).agg(F.count("*").alias("n"))
    last = touches.withColumn("_s", state).groupBy(user).agg(F.max_by("_s", F.struct(*order)).alias("a")).where("a <> '(won)'")
    lost = last.groupBy("a").agg(F.count("*").alias("n")).select("a", F.lit("(lost)").alias("b"), "n")
    rows = moves.unionByName(lost).collect()  # channels squared
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows} - {"(won)", "(lost)"})
    names = [n for n in names if n not in ("(won)", "(lost)")]
    pos = {n: i for i, n in enumerate(names)}
    total = {n: sum(r["n"] for r in rows if r["a"] == n) for n in names}

    def win_rate(gone=None):
        m, w = np.zeros((len(names), len(names))), np.zeros(len(names))
        for r in rows:
            if r["a"] == gone or r["b"] == gone:
                continue
            share = r["n"] / total[r["a"]]
            if r["b"] == "(won)":
                w[pos[r["a"]]] += share
            elif r["b"] != "(lost)":
                m[pos[r["a"]], pos[r["b"]]] += share
        return float(np.linalg.solve(np.eye(len(names)) - m, w)[pos["(start)"]])

    base = win_rate()
    effects = [(n, round(1 - win_rate(n) / base, 4) if base else 0.0) for n in names if n != "(start)"]
    return touches.sparkSession.createDataFrame(effects, "channel string, removal_effect double")


def engagement(df: DataFrame, user: str, kind: str, weights: dict[str, float], responses: dict[str, str]) -> DataFrame:
    """Weighted activity, most used channel (smallest name on ties), and response rates."""
    per = df.groupBy(user, kind).agg(F.count("*").alias("n"))
    points = F.lit(0.0)
    for k, w in weights.items():
        points = F.when(F.col(kind) == k, F.lit(float(w))).otherwise(points)
    count = lambda k: F.sum(F.when(F.col(kind) == k, F.col("n")).otherwise(0))
    return per.groupBy(user).agg(rnd(F.sum(points * F.col("n"))).alias("score"), F.min_by(kind, F.struct(-F.col("n"), F.col(kind))).alias("favourite"),
                                 *[rnd(ratio(count(hit), count(base))).alias(f"{hit}_per_{base}") for hit, base in responses.items()])


def kpis(df: DataFrame, by: Column, kind: str, value: str, unit_cost: float) -> DataFrame:
    n = lambda k: count_when(F.col(kind) == k)
    spend = n("view") * unit_cost
    revenue = F.sum(F.when(F.col(kind) == "purchase", F.col(value)).otherwise(0.0))
    return df.groupBy(by.alias("period")).agg(
        rnd(ratio(n("click"), n("view"))).alias("ctr"), rnd(ratio(n("purchase"), n("click"))).alias("cvr"), rnd(F.try_divide(revenue, spend)).alias("roas"),
        rnd(F.try_divide(spend, n("purchase"))).alias("cpa"), rnd(F.try_divide(spend, n("signup"))).alias("cac"))


def segment_uplift(df: DataFrame, segment: str, arm: str, outcome: str) -> DataFrame:
    rate = lambda a: F.avg(F.when(F.col(arm) == a, F.col(outcome).cast("double")))
    return df.groupBy(segment).agg(count_when(F.col(arm) == 1).alias("n_treated"), count_when(F.col(arm) == 0).alias("n_control"),
                                   rnd(rate(1)).alias("treated"), rnd(rate(0)).alias("control"), rnd(rate(1) - rate(0)).alias("uplift"))


def age_band(days: Column) -> Column:
    return ladder(days, [(30, "0-29"), (60, "30-59"), (90, "60-89")], "90+")
