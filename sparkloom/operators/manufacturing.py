"""Process control and reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sparkloom.functions.exprs import count_when, micros, ratio, rnd, share
from sparkloom.operators.ordered import Spec, previous, running

# Fixed value: expected moving range of two normal values, in standard deviations.
D2 = 1.128


def control_chart(subgroups: DataFrame, machine: str, value: str) -> DataFrame:
    """Three-sigma limits of subgroup means per machine and how many subgroups break them."""
    lim = subgroups.groupBy(machine).agg(F.avg(value).alias("centre"), F.stddev_samp(value).alias("sd"))
    j = subgroups.join(lim, machine)
    out = F.abs(F.col(value) - F.col("centre")) > 3 * F.col("sd")
    return j.groupBy(machine).agg(F.count("*").alias("n"), rnd(F.max("centre"), 8).alias("centre"), rnd(F.max(F.col("centre") - 3 * F.col("sd")), 5).alias("lower"),
                                  rnd(F.max(F.col("centre") + 3 * F.col("sd")), 5).alias("upper"), count_when(out).alias("violations"))


def attribute_charts(subgroups: DataFrame, n: str, bad: str) -> DataFrame:
    """p chart (share of defects, limits by subgroup size) and c chart (count of defects)."""
    s = subgroups.agg(F.sum(bad) / F.sum(n), F.avg(bad)).first()
    p, c = float(s[0] or 0.0), float(s[1] or 0.0)
    x = ratio(F.col(bad), F.col(n))
    band = 3 * F.sqrt(F.lit(p * (1 - p)) / F.col(n))
    return subgroups.select("*", rnd(x, 5).alias("share"), rnd(F.greatest(F.lit(0.0), F.lit(p) - band), 5).alias("p_low"), rnd(F.lit(p) + band, 5).alias("p_high"),
                            (F.abs(x - p) > band).alias("p_out"), (F.abs(F.col(bad) - c) > 3 * c ** 0.5).alias("c_out"))


def nelson_rules(series: DataFrame, machine: str, at: str, value: str) -> DataFrame:
    """The eight run rules on a subgroup series per machine (bounded by its calendar)."""
    lim = series.groupBy(machine).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    w = W.partitionBy(machine).orderBy(at)
    z = series.join(lim, machine).withColumn("z", F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")
    d = z.withColumn("_d", F.col("z") - F.lag("z").over(w))
    d = d.withColumn("_dd", F.col("_d") * F.lag("_d").over(w))

    def run(cond: Column, n: int, need: int | None = None) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).over(w.rowsBetween(-(n - 1), 0)) >= (need or n)

    up, down = F.col("z") > 0, F.col("z") < 0
    rules = {
        "rule_1": F.abs("z") > 3,
        "rule_2": run(up, 9) | run(down, 9),
        "rule_3": run(F.col("_d") > 0, 5) | run(F.col("_d") < 0, 5),
        "rule_4": run(F.col("_dd") < 0, 12),
        "rule_5": run(F.col("z") > 2, 3, 2) | run(F.col("z") < -2, 3, 2),
        "rule_6": run(F.col("z") > 1, 5, 4) | run(F.col("z") < -1, 5, 4),
        "rule_7": run(F.abs("z") < 1, 15),
        "rule_8": run(F.abs("z") > 1, 8),
    }
    return d.select(machine, at, "z", *[F.coalesce(e, F.lit(False)).alias(n) for n, e in rules.items()])


def capability(df: DataFrame, machine: str, order: list[str], value: str, low: float, high: float, **kw) -> DataFrame:
    """Cp and Cpk from moving ranges, Pp and Ppk from the overall deviation."""
    m = previous(df, [machine], order, {"_p": value}, **kw)
    g = m.groupBy(machine).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("so"), (F.avg(F.abs(F.col(value) - F.col("_p"))) / D2).alias("sw"))
    near = F.least(F.lit(high) - F.col("m"), F.col("m") - F.lit(low))
    spread = F.lit(high - low)
    return g.select(machine, *[rnd(F.try_divide(e, F.col(s) * k), 5).alias(n) for n, e, s, k in (
        ("cp", spread, "sw", 6), ("cpk", near, "sw", 3), ("pp", spread, "so", 6), ("ppk", near, "so", 3))])


def oee(df: DataFrame, by: Column, failed: Column, slow: Column, rejected: Column) -> DataFrame:
    """Availability x performance x quality, first-pass yield, defects per million, scrap."""
    a, p, q = 1 - share(failed), 1 - share(slow), 1 - share(rejected)
    return df.groupBy(by.alias("period")).agg(
        rnd(a, 5).alias("availability"), rnd(p, 5).alias("performance"), rnd(q, 5).alias("quality"), rnd(a * p * q, 5).alias("oee"),
        rnd(1 - share(failed | rejected), 5).alias("first_pass_yield"), rnd(1e6 * share(rejected), 2).alias("dpmo"), count_when(failed).alias("downtime_events"))


def reliability(df: DataFrame, machine: str, order: list[str], failed: Column, **kw) -> DataFrame:
    """Hours between failures, and from a failure to the next good reading."""
    ts = order[0]
    d = df.withColumn("_f", failed)
    fail = F.when(F.col("_f"), micros(ts))
    good = F.when(~F.col("_f"), micros(ts))
    d = running(d, [machine], order, {"_next_good": Spec("last", good)}, before="rows", descending=True, **kw)
    d = running(d, [machine], order, {"_last_fail": Spec("last", fail)}, before="rows", **kw)
    hour = 3.6e9
    now = micros(ts)
    return d.where("_f").groupBy(machine).agg(F.count("*").alias("failures"), rnd(F.avg((now - F.col("_last_fail")) / hour), 5).alias("mtbf_hours"),
                                              rnd(F.avg((F.col("_next_good") - now) / hour), 5).alias("mttr_hours"))


def cusum(df: DataFrame, machine: str, order: list[str], value: str, target: float, slack: float, **kw) -> DataFrame:
    """Upper and lower cumulative sums that restart at zero.

    max(0, c + x) recurrences equal the running sum minus its running minimum, so two running values
    replace the row-by-row loop.
    """
    d = df.withColumn("_u", F.col(value) - target - slack).withColumn("_l", target - slack - F.col(value))
    d = running(d, [machine], order, {"_su": Spec("sum", F.col("_u")), "_sl": Spec("sum", F.col("_l"))}, **kw)
    d = running(d, [machine], order, {"_mu": Spec("min", F.col("_su")), "_ml": Spec("min", F.col("_sl"))}, **kw)
    zero = F.lit(0.0)
    return d.withColumn("cusum_high", F.col("_su") - F.least(zero, F.col("_mu"))).withColumn("cusum_low", F.col("_sl") - F.least(zero, F.col("_ml"))).drop(
        "_u", "_l", "_su", "_sl", "_mu", "_ml")


def failure_labels(df: DataFrame, machine: str, order: list[str], failed: Column, hours: int, **kw) -> DataFrame:
    """Whether a later failure comes within some hours, and hours left until it."""
    ts = order[0]
    nxt = running(df, [machine], order, {"_nf": Spec("last", F.when(failed, micros(ts)))}, before="rows", descending=True, **kw)
    left = (F.col("_nf") - micros(ts)) / 3.6e9
    return nxt.withColumn("hours_left", left).withColumn("fails_soon", F.coalesce(left <= hours, F.lit(False)).cast("int")).drop("_nf")


def alarm_quality(df: DataFrame, machine: str, order: list[str], alarm: Column, failed: Column, hours: int, **kw) -> DataFrame:
    """Alarms followed by a failure in time, failures announced in time, false alarms per day."""
    ts = order[0]
    d = df.withColumn("_a", alarm).withColumn("_f", failed)
    d = running(d, [machine], order, {"_nf": Spec("last", F.when(F.col("_f"), micros(ts)))}, before="rows", descending=True, **kw)
    d = running(d, [machine], order, {"_la": Spec("last", F.when(F.col("_a"), micros(ts)))}, before="rows", **kw)
    span = hours * 3_600_000_000
    hit = F.col("_a") & F.coalesce(F.col("_nf") - micros(ts) <= span, F.lit(False))
    told = F.col("_f") & F.coalesce(micros(ts) - F.col("_la") <= span, F.lit(False))
    days = F.count_distinct(F.to_date(ts))
    return d.agg(count_when(F.col("_a")).alias("alarms"), count_when(F.col("_f")).alias("failures"), rnd(ratio(count_when(hit), count_when(F.col("_a"))), 5).alias("precision"),
                 rnd(ratio(count_when(told), count_when(F.col("_f"))), 5).alias("recall"), rnd(ratio(count_when(F.col("_a") & ~hit), days), 5).alias("false_per_day"))

