"""Hyperband: several brackets of successive halving, from many settings on a small budget to few on the whole one."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, functions as F

from sparkloom.functions.exprs import hash_bucket
from sparkloom.operators import models as m

#: Slots that rows are dealt to for samples; a budget of b / most takes the first b / most of them, so larger samples hold the smaller ones.
SLOTS = 1_000_000


def rungs(trials: int, budget: int, most: int, factor: int = 3) -> list[tuple[int, int]]:
    """(trials, budget) of one bracket's rungs: the best 1 / factor go on with factor times the budget, up to `most`."""
    out = []
    while trials >= 1 and budget <= most:
        out.append((trials, budget))
        trials, budget = trials // factor, budget * factor
    return out


def brackets(most: int, factor: int = 3) -> list[list[tuple[int, int]]]:
    """The rungs of all brackets for a budget of `most` units, widest bracket first; each costs about the same."""
    deepest = 0
    while factor ** (deepest + 1) <= most:
        deepest += 1
    return [rungs(math.ceil((deepest + 1) * factor**s / (s + 1)), most // factor**s, most, factor) for s in range(deepest, -1, -1)]


def hyperband(data: DataFrame, name: str, problem: str, most: int = 27, factor: int = 3, resource: str = "rows", tree_param: str = "numTrees", draw: Callable[[int, int], list[dict]] | None = None,
              threads: int = 4, seed: int = m.SEED) -> DataFrame:
    """(bracket, rung, trial, params, budget, n_rows, score, kept, error) of every fit.

    A unit of budget is 1 / most of the training rows, or one tree (`tree_param`) with resource "trees". data is prepared rows (models.prepare); a fifth of them by hash
    of the key judges every fit, the rest are the training rows, both kept in memory for all brackets. Class weights are worked out on the sample of the fit. Brackets run side by side,
    the fits of a rung on `threads` threads; the jobs of a bracket carry its tag, and if one fails all brackets are cancelled. draw(n, seed) gives settings.
    Ties in score go to the smaller trial. A fit that fails (a sample of one class) has a null score and goes no further while others have one.
    """
    spark, context = data.sparkSession, data.sparkSession.sparkContext
    draw = draw or (lambda n, s: m.draw_params(name, n, s))
    train, judge = m.split(data)
    train = train.withColumn("_slot", hash_bucket(F.concat(F.col("key").cast("string"), F.lit("|sample")), SLOTS)).persist()
    judge = judge.persist()
    plan = brackets(most, factor)
    tag = lambda b: f"hyperband-{id(train)}-{b}"
    try:
        train.count(), judge.count()  # once, before fits share them
        with ThreadPoolExecutor(len(plan)) as outer, ThreadPoolExecutor(threads) as fits:

            def fit(b: int, params: dict, budget: int) -> tuple[int, float | None, str | None]:
                context.addJobTag(tag(b))
                try:
                    rows = train if resource == "trees" else train.where(F.col("_slot") < SLOTS * budget // most)
                    own = params | {tree_param: budget} if resource == "trees" else params
                    rows = m.with_weights(rows) if problem in m.CLASSES else rows
                    estimator = m.MODELS[name][1](multiclass=problem == "multiclass")
                    n = rows.count()
                    try:
                        model = estimator.fit(rows, {estimator.getParam(k): v for k, v in own.items()})
                        return n, round(float(m.EVALUATORS[problem][1]().evaluate(model.transform(judge))), 6), None
                    except Exception as ex:  # noqa: BLE001
                        if "cancelled" in str(ex):
                            raise
                        return n, None, type(ex).__name__
                finally:
                    context.removeJobTag(tag(b))

            def bracket(b: int) -> list[tuple]:
                alive, out = list(enumerate(draw(plan[b][0][0], seed + b))), []
                for r, (_, budget) in enumerate(plan[b]):
                    got = list(fits.map(lambda t: fit(b, t[1], budget), alive))  # noqa: B023
                    order = sorted(range(len(alive)), key=lambda i: (got[i][1] is None, -(got[i][1] or 0), alive[i][0]))
                    kept = set(order[: plan[b][r + 1][0]]) if r + 1 < len(plan[b]) else set(order[:1])
                    out += [(b, r, t, str(sorted((k, round(v, 6)) for k, v in p.items())), budget, got[i][0], got[i][1], i in kept, got[i][2]) for i, (t, p) in enumerate(alive)]
                    alive = [alive[i] for i in sorted(kept)]
                return out

            running = [outer.submit(bracket, b) for b in range(len(plan))]
            try:
                table = [row for one in running for row in one.result()]
            except Exception:
                for b in range(len(plan)):
                    context.cancelJobsWithTag(tag(b))
                raise
    finally:
        train.unpersist(), judge.unpersist()
    return spark.createDataFrame(table, "bracket int, rung int, trial int, params string, budget int, n_rows long, score double, kept boolean, error string")
