"""Model metrics over a table of predictions.

Rank metrics group equal scores first and then use the sliced running sums of `ordered`, so no task
ever sorts all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W
from pyspark.sql.functions import pandas_udf

from sparkloom.functions.exprs import count_when, ratio, rnd, sum_when
from sparkloom.operators.ordered import Spec, row_numbers, running, tile_of
from sparkloom.operators.quantiles import grouped_quantiles


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def confusion_counts(y="y", pred="pred") -> dict[str, Column]:
    y, p = F.col(y), F.col(pred)
    return {"tp": count_when((y == 1) & (p == 1)), "fp": count_when((y == 0) & (p == 1)),
            "tn": count_when((y == 0) & (p == 0)), "fn": count_when((y == 1) & (p == 0))}


def classification(df: DataFrame, by: list[str] = ()) -> DataFrame:
    c = df.groupBy(*by).agg(*[e.alias(n) for n, e in confusion_counts().items()])
    tp, fp, tn, fn = (F.col(n) for n in ("tp", "fp", "tn", "fn"))
    return c.select(*by, rnd(_zero(ratio(tp + tn, tp + fp + tn + fn))).alias("accuracy"), rnd(_zero(ratio(tp, tp + fp))).alias("precision"),
                    rnd(_zero(ratio(tp, tp + fn))).alias("recall"), rnd(_zero(ratio(2 * tp, 2 * tp + fp + fn))).alias("f1"))


def per_class(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Hits, predicted and true counts per class, from the contingency table."""
    cells = df.groupBy(F.col(y).cast("string").alias("y"), F.col(pred).cast("string").alias("p")).agg(F.count("*").alias("n"))
    both = cells.select(F.inline(F.array(
        F.struct(F.col("y").alias("class"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0).cast("bigint")).alias("hit"), F.col("n").alias("n_true"), F.lit(0).cast("bigint").alias("n_pred")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("n_true"), F.col("n").alias("n_pred")))))
    return both.groupBy("class").agg(F.sum("hit").alias("hit"), F.sum("n_true").alias("n_true"), F.sum("n_pred").alias("n_pred"))


def multiclass(df: DataFrame, y: str, pred: str) -> DataFrame:
    c = per_class(df, y, pred).withColumns({
        "p": _zero(ratio(F.col("hit"), F.col("n_pred"))), "r": _zero(ratio(F.col("hit"), F.col("n_true"))),
        "f": _zero(ratio(2 * F.col("hit"), F.col("n_true") + F.col("n_pred")))})
    w = lambda x: F.try_divide(F.sum(F.col(x) * F.col("n_true")), F.sum("n_true"))
    return c.agg(rnd(F.try_divide(F.sum("hit"), F.sum("n_true"))).alias("accuracy"), *[rnd(w(x)).alias(f"weighted_{n}") for x, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))],
                 *[rnd(F.avg(x)).alias(f"macro_{n}") for x, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))])


def score_groups(df: DataFrame, by: list[str] = (), **kw) -> DataFrame:
    """Positives and negatives per distinct score, with cumulative counts from the highest score down."""
    g = df.groupBy(*by, "score").agg(count_when(F.col("y") == 1).alias("pos"), count_when(F.col("y") == 0).alias("neg"))
    cum = running(g, list(by), ["score"], {"tp": Spec("sum", F.col("pos")), "fp": Spec("sum", F.col("neg"))}, descending=True, **kw)
    if by:
        return cum.join(g.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")), list(by))
    s = g.agg(F.sum("pos"), F.sum("neg")).first()
    return cum.withColumns({"P": F.lit(s[0] or 0), "N": F.lit(s[1] or 0)})


def auc(df: DataFrame, by: list[str] = (), **kw) -> DataFrame:
    g = score_groups(df, by, **kw)
    area = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2))
    return g.groupBy(*by).agg(F.try_divide(area, F.max("P").cast("double") * F.max("N").cast("double")).alias("auc"))


def auc_one_vs_rest(df: DataFrame, cls: str, score: str, **kw) -> DataFrame:
    """Tie-correct AUC of each class against the others."""
    cells = df.groupBy(F.col(cls).cast("string").alias("class"), F.col(score).alias("score")).agg(F.count("*").alias("n"))
    every = cells.groupBy("score").agg(F.sum("n").alias("all"))
    all_cum = running(every, [], ["score"], {"all_cum": Spec("sum", F.col("all"))}, **kw)
    own = running(cells, ["class"], ["score"], {"own_cum": Spec("sum", F.col("n"))}, **kw).join(all_cum, "score")
    total = cells.agg(F.sum("n")).first()[0] or 0
    below = (F.col("all_cum") - F.col("all")) - (F.col("own_cum") - F.col("n"))
    ties = F.col("all") - F.col("n")
    area = F.sum(F.col("n").cast("double") * (below + ties / 2))
    return own.groupBy("class").agg(F.try_divide(area, F.sum("n").cast("double") * (F.lit(float(total)) - F.sum("n"))).alias("auc"))


def regression(df: DataFrame, y: str, pred: str) -> DataFrame:
    e = F.col(y) - F.col(pred)
    return df.agg(rnd(F.avg(e * e)).alias("mse"), rnd(F.sqrt(F.avg(e * e))).alias("rmse"), rnd(F.avg(F.abs(e))).alias("mae"),
                  rnd(1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"))


def confusion_matrix(df: DataFrame, y: str, pred: str) -> DataFrame:
    """All class pairs, zeros included; the class list is as wide as the matrix."""
    cells = df.groupBy(F.col(y).cast("string").alias("y"), F.col(pred).cast("string").alias("pred")).agg(F.count("*").alias("n"))
    classes = cells.select(F.explode(F.array("y", "pred")).alias("c")).distinct()
    listed = classes.agg(F.collect_set("c").alias("cs"))
    grid = listed.select(F.explode("cs").alias("y"), "cs").select("y", F.explode("cs").alias("pred"))
    return grid.join(cells, ["y", "pred"], "left").fillna(0, ["n"])


def curve_points(df: DataFrame, by: list[str] = (), **kw) -> DataFrame:
    g = score_groups(df, by, **kw)
    return g.select(*by, "score", "pos", "neg", "tp", "fp", "P", "N", ratio(F.col("fp"), F.col("N")).alias("fpr"), ratio(F.col("tp"), F.col("P")).alias("tpr"),
                    ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def average_precision(df: DataFrame, **kw) -> DataFrame:
    return curve_points(df, **kw).agg(F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.max("P")).alias("ap"))


def ks_of_scores(df: DataFrame, **kw) -> DataFrame:
    return curve_points(df, **kw).agg(F.max(F.abs(F.col("tpr") - F.col("fpr"))).alias("ks"))


def residual_bins(df: DataFrame, y: str, pred: str, low: float, high: float, bins: int) -> DataFrame:
    place = F.least(F.greatest(F.floor((F.col(pred) - low) * bins / (high - low)), F.lit(0)), F.lit(bins - 1)).cast("bigint")
    e = F.col(y) - F.col(pred)
    return df.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), rnd(F.avg(y)).alias("actual"), rnd(F.avg(pred)).alias("predicted"),
                                              rnd(F.avg(e)).alias("residual"), rnd(F.stddev_samp(e)).alias("residual_sd"))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    place = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("bigint")
    return df.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), rnd(F.avg("score"), 5).alias("predicted"), rnd(F.avg("y"), 5).alias("observed"))


def brier(df: DataFrame) -> DataFrame:
    return df.agg(rnd(F.avg(F.pow(F.col("score") - F.col("y"), 2)), 6).alias("brier"), rnd(F.regr_slope("y", "score"), 5).alias("slope"),
                  rnd(F.regr_intercept("y", "score"), 5).alias("intercept"))


def gains(df: DataFrame, tiles: int = 10, **kw) -> DataFrame:
    """Positives per score tile from the top, lift and cumulative gain."""
    n = df.count()
    ranked = row_numbers(df.withColumn("_s", -F.col("score")), [], ["_s", "id"], "_rn", **kw)
    g = ranked.groupBy(tile_of(F.col("_rn"), n, tiles).alias("tile")).agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    total = g.agg(F.sum("pos")).first()[0] or 0
    w = W.orderBy("tile").rowsBetween(W.unboundedPreceding, 0)  # one row per tile
    return g.select("tile", "n", "pos", rnd(ratio(F.col("pos"), F.col("n")) / F.lit(total / max(n, 1))).alias("lift"),
                    rnd(ratio(F.sum("pos").over(w), F.lit(total))).alias("gain"))


def weighted_recall(df: DataFrame) -> DataFrame:
    w = F.col("weight")
    hit = (F.col("y") == 1) & (F.col("pred") == 1)
    return df.agg(rnd(sum_when(hit, w), 2).alias("caught"), rnd(sum_when(F.col("y") == 1, w), 2).alias("total"),
                  rnd(F.try_divide(sum_when(hit, w), sum_when(F.col("y") == 1, w))).alias("weighted_recall"))


def best_threshold(df: DataFrame, cost_fp: float, cost_fn: float, **kw) -> DataFrame:
    """Cheapest score to call positive from; ties go to the higher score."""
    cost = F.col("fp") * cost_fp + (F.col("P") - F.col("tp")) * cost_fn
    return curve_points(df, **kw).agg(F.min_by("score", F.struct(cost, -F.col("score"))).alias("threshold"), F.min(cost).alias("cost"))


def recall_at_precision(df: DataFrame, floor: float, **kw) -> DataFrame:
    return curve_points(df, **kw).where(F.col("precision") >= floor).agg(rnd(F.max("tpr")).alias("recall"))


def clinical(df: DataFrame) -> DataFrame:
    c = df.agg(*[e.alias(n) for n, e in confusion_counts().items()])
    tp, fp, tn, fn = (F.col(n) for n in ("tp", "fp", "tn", "fn"))
    risk_hi, risk_lo = ratio(tp, tp + fp), ratio(fn, fn + tn)
    return c.select(rnd(ratio(tp, tp + fn)).alias("sensitivity"), rnd(ratio(tn, tn + fp)).alias("specificity"), rnd(risk_hi).alias("ppv"),
                    rnd(ratio(tn, tn + fn)).alias("npv"), rnd(risk_hi - risk_lo).alias("arr"), rnd(F.try_divide(F.lit(1.0), risk_hi - risk_lo)).alias("nnt"))


def concordance(df: DataFrame, time: str, event: str, risk: str, **kw) -> DataFrame:
    """Share of comparable pairs that the risk orders correctly.

    Times are numbered in order. Two numbers first differ in one binary digit: at that digit's level the earlier row and the later one
    stand on the two sides of one node. So each row takes part once per level, a node's later rows are counted along the risk,
    and no pair is built: rows x log2(times).
    """
    g = df.where(F.col(time).isNotNull() & F.col(risk).isNotNull()).groupBy(time, risk).agg(F.count("*").alias("n"), F.sum(event).alias("d"))
    codes = row_numbers(g.select(F.col(time).alias("_t")).distinct(), [], ["_t"], "_code", **kw)
    levels = max(1, int(codes.count()).bit_length())
    bits = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level")
    placed = g.join(codes, F.col(time) == F.col("_t")).select("_code", F.col(risk).alias("risk"), "n", F.coalesce("d", F.lit(0)).alias("d"), bits)
    later = F.expr("shiftright(_code, _level) & 1")
    node = placed.select("_level", F.expr("shiftright(_code, _level + 1)").alias("_node"), "risk", F.when(later == 1, F.col("n")).otherwise(0).alias("n"), F.when(later == 0, F.col("d")).otherwise(0).alias("d"))
    cells = node.groupBy("_level", "_node", "risk").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    below = running(cells, ["_level", "_node"], ["risk"], {"less": Spec("sum", F.col("n"))}, before="rows", **kw)
    alive = cells.groupBy("_level", "_node").agg(F.sum("n").alias("alive"))
    out = below.join(alive, ["_level", "_node"])
    good = F.sum(F.col("d") * (F.coalesce("less", F.lit(0)) + F.col("n") / 2))
    return out.agg(F.sum(F.col("d") * F.col("alive")).alias("pairs"), rnd(F.try_divide(good, F.sum(F.col("d").cast("double") * F.col("alive")))).alias("c_index"))


def reclassification(df: DataFrame, old: Column, new: Column) -> DataFrame:
    y = F.col("y")
    up, down = new > old, new < old
    event = ratio(count_when((y == 1) & up) - count_when((y == 1) & down), count_when(y == 1))
    non = ratio(count_when((y == 0) & down) - count_when((y == 0) & up), count_when(y == 0))
    return df.agg(rnd(event).alias("nri_events"), rnd(non).alias("nri_nonevents"), rnd(event + non).alias("nri"))


def forecast_errors(df: DataFrame, actual: str, forecast: str, naive: str, by: list[str]) -> DataFrame:
    """naive: the one-step naive forecast whose error scales MASE."""
    a, f = F.col(actual), F.col(forecast)
    e = F.abs(a - f)
    g = df.groupBy(*by).agg(
        F.avg(F.when(a != 0, e / F.abs(a))).alias("mape"), F.try_divide(F.sum(e), F.sum(F.abs(a))).alias("wape"),
        F.avg(F.when(F.abs(a) + F.abs(f) > 0, 2 * e / (F.abs(a) + F.abs(f))).otherwise(0.0)).alias("smape"),
        F.try_divide(F.avg(e), F.avg(F.abs(a - F.col(naive)))).alias("mase"), F.try_divide(F.sum(f - a), F.sum(a)).alias("bias"))
    p90 = grouped_quantiles(df.withColumn("_e", e), by, "_e", {"p90": 0.9})
    out = g.join(p90, by)
    return out.select(*by, *[rnd(F.col(c)).alias(c) for c in ("mape", "wape", "smape", "mase", "bias", "p90")])


def pinball(actual: Column, forecast: Column, q: float) -> Column:
    gap = actual - forecast
    return F.when(gap >= 0, q * gap).otherwise((q - 1) * gap)


def stock_loss(actual: Column, forecast: Column, short: float, over: float) -> Column:
    return F.when(actual > forecast, short * (actual - forecast)).otherwise(over * (forecast - actual))


def ranking(df: DataFrame, query: str, order: list[Column], relevant: Column, k: int) -> DataFrame:
    """Precision, recall, hit rate, MAP, MRR and NDCG at k, averaged over queries."""
    w = W.partitionBy(query).orderBy(*order)
    top = df.withColumn("_rel", relevant.cast("int")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    hits = F.sum("_rel").over(W.partitionBy(query).orderBy("_r"))  # at most k rows per query
    per = top.withColumn("_h", hits).groupBy(query).agg(
        F.sum("_rel").alias("hits"), F.sum(F.when(F.col("_rel") == 1, F.col("_h") / F.col("_r"))).alias("ap"),
        F.min(F.when(F.col("_rel") == 1, F.col("_r"))).alias("first"), F.sum(F.col("_rel") / F.log2(F.col("_r") + 1.0)).alias("dcg"))
    need = df.groupBy(query).agg(count_when(relevant).alias("R"))
    both = per.join(need, query)
    best = F.least(F.col("R"), F.lit(k))
    ideal = F.aggregate(F.when(best > 0, F.sequence(F.lit(1).cast("bigint"), best)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1.0))
    return both.agg(
        F.count("*").alias("n_queries"), rnd(F.avg(F.col("hits") / k)).alias("precision"), rnd(F.avg(_zero(ratio(F.col("hits"), F.col("R"))))).alias("recall"),
        rnd(F.avg((F.col("hits") > 0).cast("double"))).alias("hit_rate"), rnd(F.avg(_zero(F.col("ap") / best))).alias("map"),
        rnd(F.avg(_zero(1 / F.col("first")))).alias("mrr"), rnd(F.avg(_zero(F.try_divide(F.col("dcg"), ideal)))).alias("ndcg"))


def catalogue_spread(lists: DataFrame, item: str, catalogue: DataFrame, popularity: DataFrame) -> DataFrame:
    """Share of the catalogue that is ever recommended, evenness of exposure, and novelty.

    popularity: (item, n). Exposure evenness is 1 minus the sum of squared shares.
    """
    size = catalogue.select(item).distinct().count()
    total = popularity.agg(F.sum("n")).first()[0] or 0
    shown = lists.groupBy(item).agg(F.count("*").alias("shown"))
    n = shown.agg(F.sum("shown")).first()[0] or 1
    both = shown.join(popularity, item, "left")
    bits = -F.log2(F.col("n") / F.lit(float(max(total, 1))))
    return both.agg(rnd(F.count("*") / F.lit(float(max(size, 1)))).alias("coverage"), rnd(1 - F.sum(F.pow(F.col("shown") / F.lit(float(n)), 2)), 6).alias("diversity"),
                    rnd(F.sum(F.col("shown") * bits) / F.lit(float(n))).alias("novelty"))


def average_ranks(df: DataFrame, value: str, out: str, **kw) -> DataFrame:
    g = df.groupBy(value).agg(F.count("*").alias("_n"))
    cum = running(g, [], [value], {"_c": Spec("sum", F.col("_n"))}, **kw)
    return cum.select(value, (F.col("_c") - (F.col("_n") - 1) / 2).alias(out))


def spearman(df: DataFrame, a: str, b: str, **kw) -> DataFrame:
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("_w"))
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = d.join(average_ranks(rows, a, "_ra", **kw), a).join(average_ranks(rows, b, "_rb", **kw), b)
    w, x, y = F.col("_w"), F.col("_ra"), F.col("_rb")
    n = F.sum(w)
    mean = rows.count()
    mid = (mean + 1) / 2
    cov = F.sum(w * (x - mid) * (y - mid))
    return ranked.agg(n.alias("n"), rnd(F.try_divide(cov, F.sqrt(F.sum(w * F.pow(x - mid, 2)) * F.sum(w * F.pow(y - mid, 2))))).alias("rho"))


def latency(df: DataFrame, by: str, value: str, failed: Column, cost: Column) -> DataFrame:
    q = grouped_quantiles(df, [by], value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    s = df.groupBy(by).agg(F.count("*").alias("n"), rnd(F.avg(failed.cast("double"))).alias("error_rate"), rnd(F.avg(cost), 6).alias("cost_per_request"))
    return s.join(q, by).select(by, "n", *[rnd(F.col(c), 5).alias(c) for c in ("p50", "p95", "p99")], "error_rate", "cost_per_request")


def quadratic_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """1 - observed over expected squared distance; both come from sums, no class grid needed."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    expected = F.avg(x * x) + F.avg(y * y) - 2 * F.avg(x) * F.avg(y)
    return df.agg(F.count("*").alias("n"), rnd(1 - F.try_divide(F.avg(F.pow(x - y, 2)), expected)).alias("kappa"))


def qini(df: DataFrame, score: str, key: str, arm: str, outcome: str, tiles: int = 10, **kw) -> DataFrame:
    """Cumulative uplift by score tile (treated minus control scaled to the treated)."""
    n = df.count()
    ranked = row_numbers(df.withColumn("_s", -F.col(score).cast("double")), [], ["_s", key], "_rn", **kw)
    g = ranked.groupBy(tile_of(F.col("_rn"), n, tiles).alias("tile")).agg(
        count_when(F.col(arm) == 1).alias("nt"), count_when(F.col(arm) == 0).alias("nc"),
        F.sum(F.when(F.col(arm) == 1, F.col(outcome)).otherwise(0)).alias("yt"), F.sum(F.when(F.col(arm) == 0, F.col(outcome)).otherwise(0)).alias("yc"))
    w = W.orderBy("tile").rowsBetween(W.unboundedPreceding, 0)  # one row per tile
    c = g.select("tile", *[F.sum(x).over(w).alias(x) for x in ("nt", "nc", "yt", "yc")])
    lift = F.col("yt") - _zero(ratio(F.col("yc") * F.col("nt"), F.col("nc")))
    return c.select("tile", rnd(lift).alias("qini"), rnd(_zero(ratio(F.col("yt"), F.col("nt"))) - _zero(ratio(F.col("yc"), F.col("nc")))).alias("uplift"))


def portfolio(daily: DataFrame, key: str, day: str, value: str, periods: int = 252) -> DataFrame:
    """Risk figures of daily value series (each bounded by its calendar)."""
    w = W.partitionBy(key).orderBy(day)
    r = daily.withColumn("_p", F.lag(value).over(w)).withColumn("r", F.try_divide(F.col(value), F.col("_p")) - 1)
    peak = F.max(value).over(w.rowsBetween(W.unboundedPreceding, 0))
    d = r.withColumn("dd", F.try_divide(F.col(value), peak) - 1)
    g = d.groupBy(key).agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.sqrt(F.avg(F.when(F.col("r") < 0, F.col("r") * F.col("r")).otherwise(F.when(F.col("r").isNotNull(), 0.0)))).alias("ds"),
                           F.min("dd").alias("max_drawdown"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"))
    var = grouped_quantiles(d, [key], "r", {"var_95": 0.05})
    tail = d.join(var, key).where("r <= var_95").groupBy(key).agg(F.avg("r").alias("cvar_95"))
    out = g.join(var, key).join(tail, key)
    ann = periods ** 0.5
    return out.select(key, rnd(F.try_divide(F.col("m"), F.col("s")) * ann).alias("sharpe"), rnd(F.try_divide(F.col("m"), F.col("ds")) * ann).alias("sortino"),
                      *[rnd(F.col(c), 5).alias(c) for c in ("max_drawdown", "var_95", "cvar_95", "win_rate")])


def _gram(column: str, n: int):
    return lambda i: F.concat_ws(" ", F.slice(F.col(column), i, F.lit(n)))


def bleu(pairs: DataFrame, key: list[str], candidate: str, reference: str, order: int = 4) -> DataFrame:
    """Corpus BLEU from clipped n-gram counts per pair; (n-gram, side) counts are grouped, not paired up."""
    toks = lambda c: F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda w: w != "")
    base = pairs.select(*key, F.explode(F.array(F.struct(toks(candidate).alias("c"), toks(reference).alias("r")))).alias("_b")).select(*key, "_b.c", "_b.r")
    grams = None
    for n in range(1, order + 1):
        for side, c in ((1, "c"), (0, "r")):
            spots = F.when(F.size(c) >= n, F.sequence(F.lit(1), F.size(c) - (n - 1))).otherwise(F.array().cast("array<int>"))
            g = base.select(*key, F.lit(n).alias("n"), F.lit(side).alias("side"), F.explode(F.transform(spots, _gram(c, n))).alias("g"))
            grams = g if grams is None else grams.unionByName(g)
    per = grams.groupBy(*key, "n", "g").agg(F.sum("side").alias("a"), F.sum(1 - F.col("side")).alias("b"))
    prec = per.groupBy("n").agg(F.sum(F.least("a", "b")).alias("hit"), F.sum("a").alias("all"))
    lengths = base.agg(F.sum(F.size("c")).alias("lc"), F.sum(F.size("r")).alias("lr")).first()
    penalty = 1.0 if (lengths["lc"] or 0) > (lengths["lr"] or 0) else 2.718281828459045 ** (1 - (lengths["lr"] or 0) / max(lengths["lc"] or 0, 1))
    return prec.agg(rnd(F.lit(penalty) * F.exp(F.avg(F.log(F.greatest(F.col("hit").cast("double"), F.lit(1e-9)) / F.col("all")))), 6).alias("bleu"))


@pandas_udf(T.DoubleType())
def rouge_l(candidate, reference):
    """F score of the longest common subsequence of words, by bit-parallel rows."""
    import pandas as pd

    def one(c, r):
        a, b = (c or "").lower().split(), (r or "").lower().split()
        if not a or not b:
            return 0.0
        where = {}
        for i, w in enumerate(a):
            where[w] = where.get(w, 0) | (1 << i)
        full = (1 << len(a)) - 1
        s = full
        for w in b:
            m = s & where.get(w, 0)
            s = ((s + m) | (s - m)) & full
        lcs = len(a) - bin(s).count("1")
        p, q = lcs / len(a), lcs / len(b)
        return 2 * p * q / (p + q) if p + q else 0.0

    return pd.Series([one(c, r) for c, r in zip(candidate, reference)])


