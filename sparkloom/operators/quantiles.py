"""Exact quantiles without a task that holds all values.

Approximate quantiles, which one scan gives for all columns, set a narrow bracket around every wanted rank; a second scan
counts the rows below and inside the brackets, and a third one fetches what is inside. A bracket with too many rows is narrowed first: each round
counts rows per bucket and keeps the bucket that holds the rank. A scan counts on the map side, so nothing but counts is
shuffled. NaN counts as null; infinities are counted at both ends.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from sparkloom.operators.ordered import running, Spec

BUCKETS = 512
#: Different values that all open brackets together may bring to the driver.
FINISH_AT = 50_000
#: Brackets start this far on both sides of a rank, as a share of all rows; approximate ranks are off by at most 1 / ACCURACY.
MARGIN, ACCURACY = 0.001, 5000


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    buckets: int = BUCKETS, finish_at: int = FINISH_AT) -> dict[str, list[float | None]]:
    """{column: [quantile per prob]} with linear interpolation between order statistics."""
    number = lambda c: F.col(c).cast("double")
    base = df.select(*[F.when(~F.isnan(number(c)), number(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    finite = lambda i: F.when(F.abs(f"c{i}") < float("inf"), F.col(f"c{i}"))
    grid = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-MARGIN, MARGIN)})
    stats = base.agg(*[e for i in range(len(columns)) for e in (
        F.count(f"c{i}").alias(f"n{i}"), F.count_if(F.col(f"c{i}") == float("-inf")).alias(f"neg{i}"), F.count(finite(i)).alias(f"fin{i}"),
        F.min(finite(i)).alias(f"lo{i}"), F.max(finite(i)).alias(f"hi{i}"), F.percentile_approx(finite(i), grid, ACCURACY).alias(f"q{i}"))]).first()
    # wanted order statistics: (column, rank) -> [low, high, rows below low, rows in bracket]
    open_, done = {}, {}
    for i in range(len(columns)):
        n, neg, fin = stats[f"n{i}"], stats[f"neg{i}"], stats[f"fin{i}"]
        for p in probs if n else []:
            spot = p * (n - 1)
            for rank in {math.floor(spot), math.ceil(spot)}:
                if not neg <= rank < neg + fin:
                    done[(i, rank)] = float("-inf") if rank < neg else float("inf")
                    continue
                share = (rank - neg) / max(fin - 1, 1)
                below, above = [q for g, q in zip(grid, stats[f"q{i}"]) if g <= share - MARGIN / 2], [q for g, q in zip(grid, stats[f"q{i}"]) if g >= share + MARGIN / 2]
                open_[(i, rank)] = (max(below, default=stats[f"lo{i}"]), min(above, default=stats[f"hi{i}"]), neg, fin)
    if open_:
        open_ = _placed(base, open_, stats)
    while open_:
        for key, (lo, hi, _, _) in list(open_.items()):
            if lo == hi:
                done[key] = lo
                del open_[key]
        room, small = finish_at, {}
        sizes: dict[tuple, int] = {}
        for key, b in sorted(open_.items(), key=lambda x: x[1][3]):
            place = (key[0], b[0], b[1])
            if place not in sizes:
                if b[3] > room:
                    continue
                sizes[place] = b[3]
                room -= b[3]
            small[key] = b
        if small:
            done.update(_finish(base, small))
            for k in small:
                del open_[k]
        if open_ and not small:
            narrower = _narrow(base, open_, buckets)
            if any(narrower[k] == open_[k] for k in open_):
                raise RuntimeError("a bracket does not get narrower")
            open_ = narrower
    out = {}
    for i, c in enumerate(columns):
        n = stats[f"n{i}"]
        row = []
        for p in probs:
            if not n:
                row.append(None)
                continue
            spot = p * (n - 1)
            a, b, part = done[(i, math.floor(spot))], done[(i, math.ceil(spot))], spot - math.floor(spot)
            row.append(a if a == b or not part else a + (b - a) * part)
        out[c] = row
    return out


def _placed(base: DataFrame, open_: dict, stats) -> dict:
    """The first brackets with their counts; a rank that its bracket misses gets the whole range of its column."""
    ids = _brackets(open_)
    counts = base.agg(*[e for (i, lo, hi), b in ids.items() for e in (
        F.count_if(F.col(f"c{i}") < lo).alias(f"b{b}"), F.count_if((F.col(f"c{i}") >= lo) & (F.col(f"c{i}") <= hi)).alias(f"n{b}"))]).first()
    out = {}
    for (i, rank), (lo, hi, _, _) in open_.items():
        b = ids[(i, lo, hi)]
        below, inside = counts[f"b{b}"], counts[f"n{b}"]
        out[(i, rank)] = (lo, hi, below, inside) if below <= rank < below + inside else (stats[f"lo{i}"], stats[f"hi{i}"], stats[f"neg{i}"], stats[f"fin{i}"])
    return out


def _brackets(open_):
    """Distinct (column, low, high) brackets, numbered."""
    ids = {}
    for (i, _), (lo, hi, _, _) in open_.items():
        ids.setdefault((i, lo, hi), len(ids))
    return ids


def _in_brackets(base: DataFrame, ids, value_of) -> DataFrame:
    cells = [
        F.when((F.col(f"c{i}") >= lo) & (F.col(f"c{i}") <= hi),
               F.struct(F.lit(b).alias("b"), value_of(F.col(f"c{i}"), lo, hi).alias("v")))
        for (i, lo, hi), b in ids.items()
    ]
    return base.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).groupBy("x.b", "x.v")


def _narrow(base, open_, buckets):
    ids = _brackets(open_)
    place = lambda c, lo, hi: F.least(F.lit(buckets - 1), F.floor((c - lo) / F.lit((hi - lo) / buckets))).cast("double")
    rows = _in_brackets(base, ids, lambda c, lo, hi: place(c, lo, hi)).agg(
        F.count("*").alias("n")).select("b", "v", "n").collect()
    counts: dict[int, dict[int, int]] = {}
    for r in rows:
        counts.setdefault(r["b"], {})[int(r["v"])] = r["n"]
    # true value range of each chosen bucket, from the data (bucket edges are subject to rounding)
    chosen = {}
    for (i, rank), (lo, hi, below, _) in open_.items():
        b, seen = ids[(i, lo, hi)], below
        for v in sorted(counts[b]):
            if seen + counts[b][v] > rank:
                chosen[(i, rank)] = (i, lo, hi, v, seen, counts[b][v])
                break
            seen += counts[b][v]
    parts = {c[:4] for c in chosen.values()}
    aggs, names = [], {}
    for j, (i, lo, hi, v) in enumerate(sorted(parts)):
        inside = F.when((F.col(f"c{i}") >= lo) & (F.col(f"c{i}") <= hi) & (place(F.col(f"c{i}"), lo, hi) == v), F.col(f"c{i}"))
        aggs += [F.min(inside).alias(f"l{j}"), F.max(inside).alias(f"h{j}")]
        names[(i, lo, hi, v)] = j
    edge = base.agg(*aggs).first()
    return {k: (edge[f"l{names[c[:4]]}"], edge[f"h{names[c[:4]]}"], c[4], c[5]) for k, c in chosen.items()}


def _finish(base, small):
    ids = _brackets(small)
    rows = _in_brackets(base, ids, lambda c, lo, hi: c).agg(F.count("*").alias("n")).select("b", "v", "n").collect()
    values: dict[int, list] = {}
    for r in rows:
        values.setdefault(r["b"], []).append((r["v"], r["n"]))
    out = {}
    for (i, rank), (lo, hi, below, _) in small.items():
        seen = below
        for v, n in sorted(values[ids[(i, lo, hi)]]):
            seen += n
            if seen > rank:
                out[(i, rank)] = v
                break
    return out


def grouped_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float], **kw) -> DataFrame:
    """Exact quantiles per group by cumulative counts of distinct values (hot groups are sliced)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    cum = running(counts, by, ["_v"], {"_c": Spec("sum", F.col("_n"))}, **kw)
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    placed = cum.join(totals, by) if by else cum.withColumn("_total", F.lit(counts.agg(F.sum("_n")).first()[0]))
    first = F.col("_c") - F.col("_n")

    def at(rank):
        return F.max(F.when((first <= rank) & (rank < F.col("_c")), F.col("_v")))

    aggs = []
    for name, p in probs.items():
        spot = F.lit(p) * (F.col("_total") - 1)
        aggs += [at(F.floor(spot)).alias(f"_a_{name}"), at(F.ceil(spot)).alias(f"_b_{name}"),
                 F.max(spot - F.floor(spot)).alias(f"_f_{name}")]
    out = placed.groupBy(*by).agg(*aggs)
    return out.select(*by, *[
        (F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_f_{n}")).alias(n) for n in probs])
