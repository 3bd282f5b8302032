"""Regressions that MLlib lacks, fitted by sums over the rows: quantile regression and Cox's proportional hazards.

What a step brings to the driver has the size of the coefficients, not of the table; the last step of a quantile regression also
brings a bounded number of rows around the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkloom.functions.exprs import two_sided_p
from sparkloom.operators.ordered import Spec, running

#: Different rows around the fit that the driver solves exactly.
BAND = 20_000


def design(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """y, x0, x1, ... as doubles; rows with a null or NaN in one of them are left out."""
    d = df.select(F.col(target).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    return d.dropna()


@dataclass
class Search:
    """One quantile's place in the search: coefficients, width of the smoothing, and the points the next pass looks at."""

    quantile: float
    beta: np.ndarray
    width: float
    loss: float = np.inf
    points: list[np.ndarray] = field(default_factory=list)
    done: bool = False
    inside: float = np.inf  # rows within the width when it was last narrowed
    flat: bool = False  # narrowing left as many rows inside: they may all lie on one plane
    solved: np.ndarray | None = None


def _standard(table: np.ndarray, means: np.ndarray, scales: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(X with a leading one, y) of rows y, x0, x1, ..."""
    x = (table[:, 1:] - means) / scales
    return np.column_stack([np.ones(len(x)), x]), table[:, 0]


def _summed(rows: DataFrame, numbers, size: int) -> np.ndarray:
    """The sum over all rows of `size` numbers: numbers(batch as a matrix) -> array. Each task adds up its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += numbers(np.column_stack([np.asarray(c) for c in batch.columns]))
        yield pa.record_batch([pa.array(np.arange(size)), pa.array(total)], names=["slot", "value"])

    got = rows.mapInArrow(run, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    for r in got:
        out[r["slot"]] = r["value"]
    return out


def _smooth_pass(rows: DataFrame, searches: list[Search], means, scales, p: int) -> None:
    """Take every search one Newton step on: the pinball loss, its corner rounded by the width, at all its points at once."""
    plans = [(s.quantile, s.width, b) for s in searches for b in s.points]
    one = 2 + p + p * p

    def numbers(table: np.ndarray) -> np.ndarray:
        x, y = _standard(table, means, scales)
        out = []
        for q, width, b in plans:
            r = y - x @ b
            inside = np.abs(r) <= width
            loss = (q - 0.5) * r + np.where(inside, r * r / (4 * width) + width / 4, np.abs(r) / 2)
            slope = q - 0.5 + np.clip(r / (2 * width), -0.5, 0.5)
            near = x[inside]
            out.append(np.concatenate([[loss.sum(), inside.sum()], x.T @ slope, (near.T @ near / (2 * width)).ravel()]))
        return np.concatenate(out)

    got = _summed(rows, numbers, one * len(plans)).reshape(len(plans), one)
    at = 0
    for s in searches:
        own, at = got[at : at + len(s.points)], at + len(s.points)
        best = int(np.argmin(own[:, 0]))
        gained = s.loss - own[best, 0]
        if len(s.points) > 1 and gained <= 1e-6 * abs(s.loss):
            s.done, s.flat = own[best, 1] <= BAND, BAND < own[best, 1] and own[best, 1] > 0.9 * s.inside
            s.inside = own[best, 1]
            s.width, s.loss, s.points = s.width / 4, np.inf, [s.points[best] if gained > 0 else s.beta]
            s.beta = s.points[0]
            continue
        s.beta, s.loss = s.points[best], own[best, 0]
        curve = own[best, 2 + p :].reshape(p, p)
        step = np.linalg.lstsq(curve + 1e-9 * np.trace(curve) * np.eye(p) + 1e-12 * np.eye(p), own[best, 2 : 2 + p], rcond=None)[0]
        s.points = [s.beta + t * step for t in (1.0, 0.5, 0.2, 0.05)]


def _on_plane(rows: DataFrame, s: Search, top: float, means, scales, p: int) -> np.ndarray | None:
    """The exact solution where the rows inside the band, however many, lie on one plane; None where they do not or it is not proved to be the optimum.

    The plane is optimal if no row outside changes sides and the rows on it can take up the others' pull with weights between quantile - 1 and quantile.
    All is found by sums over the rows.
    """
    q, beta, width, tie = s.quantile, s.beta, 4 * s.width, 1e-9 * (1 + top)

    def moments(table: np.ndarray) -> np.ndarray:
        x, y = _standard(table, means, scales)
        r = y - x @ beta
        near = np.abs(r) <= width
        return np.concatenate([(x[near].T @ x[near]).ravel(), x[near].T @ y[near], x[~near].T @ np.where(r[~near] > 0, q, q - 1)])

    got = _summed(rows, moments, p * p + 2 * p)
    square = got[: p * p].reshape(p, p)
    plane = np.linalg.lstsq(square, got[p * p : p * p + p], rcond=None)[0]
    weight = np.linalg.lstsq(square, -got[p * p + p :], rcond=None)[0]
    if np.abs(square @ weight + got[p * p + p :]).max() > 1e-6 * (1 + np.abs(got[p * p + p :]).max()):
        return None

    def wrong(table: np.ndarray) -> np.ndarray:
        x, y = _standard(table, means, scales)
        r, now, share = y - x @ beta, y - x @ plane, x @ weight
        near = np.abs(r) <= width
        bad = np.where(near, (np.abs(now) > tie) | (share > q + 1e-9) | (share < q - 1 - 1e-9), r * now < 0)
        return np.array([bad.sum()])

    return None if _summed(rows, wrong, 1)[0] else plane


def pinball(r: np.ndarray, quantile: float) -> float:
    return float(np.maximum(quantile * r, (quantile - 1) * r).sum())


def _corner(x: np.ndarray, order: np.ndarray) -> list[int]:
    """The first rows in an order that are independent, as many as there are columns."""
    basis, span = [], np.zeros((0, x.shape[1]))
    for i in order:
        rest = x[i] - span.T @ (span @ x[i])
        rest -= span.T @ (span @ rest)
        size = np.linalg.norm(rest)
        if size > 1e-7 * np.linalg.norm(x[i]):
            basis.append(int(i))
            span = np.vstack([span, rest / size])
            if len(basis) == x.shape[1]:
                break
    return basis


def solve_rows(x: np.ndarray, y: np.ndarray, quantile: float, start: np.ndarray | None = None, pivots: int = 100_000) -> np.ndarray:
    """Coefficients of least pinball loss on rows in memory, by walking from corner to corner.

    At a corner as many rows as coefficients lie on the fit. One of them leaves, and the fit moves along the others as long as the loss falls: past every
    row that it meets the slope rises by that row's share, so the row to stop at is found by a sum over the meetings in order. Ties are broken by a
    tiny fixed shift of the targets. Columns that depend on others have coefficient 0.
    """
    free = _corner(x.T @ x, np.arange(x.shape[1]))  # independent columns
    own = x[:, free]
    size = 1e-300 + np.linalg.norm(own, axis=1)
    # a row's shift follows its own size: beside a sum of millions of rows one of them would be moved past others
    shifted = y + 1e-10 * size * (1e-300 + (np.abs(y) / size).max(initial=0)) * np.random.default_rng(1).standard_normal(len(y))
    guess = np.linalg.lstsq(own, y, rcond=None)[0] if start is None else start[free]
    basis = _corner(own, np.argsort(np.abs(shifted - own @ guess) / size, kind="stable"))
    for _ in range(pivots):
        back = np.linalg.inv(own[basis])
        r = shifted - own @ (back @ shifted[basis])
        r[basis] = 0
        slope = -(own.T @ np.where(r > 0, quantile, np.where(r < 0, quantile - 1, 0))) @ back
        both = np.concatenate([slope + 1 - quantile, quantile - slope])
        best = int(np.argmin(both))
        if both[best] >= -1e-9 * (1 + np.abs(slope).max()):
            break
        leaves, sign = best % len(basis), 1.0 if best < len(basis) else -1.0
        moved = own @ (sign * back[:, leaves])
        moved[basis] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            meets = np.where(moved != 0, r / moved, np.inf)
        meets[~(meets > 0)] = np.inf
        order = np.argsort(meets, kind="stable")
        order = order[: int(np.isfinite(meets).sum())]
        stop = np.searchsorted(both[best] + np.cumsum(np.abs(moved[order])), 0)
        if stop >= len(order):
            break
        basis[leaves] = int(order[stop])
    out = np.zeros(x.shape[1])
    out[free] = np.linalg.solve(own[basis], y[basis])
    return out


def _solve_groups(held: list, quantile: float, start: np.ndarray, means, scales) -> np.ndarray:
    """The solution over different rows and their counts."""
    x, y = _standard(np.array([r[:-1] for r in held], dtype=float).reshape(len(held), -1), means, scales)
    weight = np.array([r[-1] for r in held], dtype=float)
    return solve_rows(x * weight[:, None], y * weight, quantile, start)


def _exact(rows: DataFrame, s: Search, n: int, top: float, means, scales, p: int, band: int) -> np.ndarray:
    """The exact solution next to a search's: rows far from the fit count as two sums, as long as they stay on their side of it."""
    beta, tie = s.beta, 1e-9 * (1 + top)  # residuals below this are rounding, such a row is on the fit
    names = [F.col(c) for c in rows.columns]
    unit = lambda b: [F.lit(float(b[0] - (b[1:] * means / scales).sum())), *[F.lit(float(v)) for v in b[1:] / scales]]
    residual = lambda b: names[0] - sum((c * x for c, x in zip(unit(b)[1:], names[1:], strict=True)), unit(b)[0])
    for attempt in range(30):
        r = residual(beta)
        far, most = float("inf"), band << min(attempt, 3)
        if n > most:
            far = max(tie, rows.agg(F.percentile_approx(F.abs(r), most / n, 10_000).alias("r")).first()["r"])
        near = rows.where(F.abs(r) <= far).groupBy(*rows.columns).agg(F.count("*").alias("n"))
        held = near.limit(16 * band + 1).collect()
        if len(held) > 16 * band:  # ties of continuous values do not come in such numbers
            raise RuntimeError("more different rows lie around the fit than the driver may hold; raise band")
        x, y = _standard(np.array([r[:-1] for r in held], dtype=float).reshape(len(held), -1), means, scales)
        weight = np.array([r[-1] for r in held], dtype=float)
        x, y = x * weight[:, None], y * weight
        if far < float("inf"):
            sums = rows.groupBy((r > 0).alias("over")).agg(*[F.sum(F.when(F.abs(r) > far, c)) for c in (F.lit(1), *names)]).collect()
            for _, count, target, *own in sums:
                if count:
                    x, y = np.vstack([x, [count, *((np.array(own) - count * means) / scales)]]), np.append(y, target)
        new = solve_rows(x, y, s.quantile, beta)
        if far == float("inf"):
            return new
        crossed = F.count_if(((r > far) & (residual(new) < -tie)) | ((r < -far) & (residual(new) > tie)))
        wrong = rows.agg(crossed.alias("n")).first()["n"]
        beta = new
        if not wrong:
            return beta
    raise RuntimeError("the fit did not settle; raise band")


def quantile_regression(df: DataFrame, target: str, features: list[str], quantiles: list[float], band: int = BAND, passes: int = 80) -> DataFrame:
    """(quantile, term, coefficient): the linear fits of least pinball loss, all quantiles in one pass over the rows at a time.

    Newton steps on the loss with its corner rounded, ever less, bring the fit so near that at most `band` rows are left whose side is open. Those are
    collected and solved exactly, the others count as two sums; a last pass makes sure that no row has changed sides, so the result is the
    optimum over all rows. Up to `band` different rows are solved at once, and where more than that lie on one plane the plane is proved by sums. Several optima are possible; one of them is returned. Constant features have coefficient 0.
    """
    spark, terms = df.sparkSession, ["(intercept)", *features]
    rows = design(df, target, features).persist()
    try:
        s = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.max(F.abs("y")).alias("top"), *[f(F.col(c)).alias(f"{c}_{k}") for c in rows.columns[1:] for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        n = s["n"]
        if not n:
            return spark.createDataFrame([], "quantile double, term string, coefficient double")
        means, scales = (np.array([s[f"{c}_{k}"] for c in rows.columns[1:]], dtype=float) for k in ("m", "s"))
        scales[scales == 0] = np.inf  # a constant
        p = len(terms)
        squares = _summed(rows, lambda t: (lambda x, y: np.concatenate([(x.T @ x).ravel(), x.T @ y, [y @ y]]))(*_standard(t, means, scales)), p * p + p + 1)
        start = np.linalg.lstsq(squares[: p * p].reshape(p, p), squares[p * p : -1], rcond=None)[0]
        spread = max((max(squares[-1] - start @ squares[p * p : -1], 0) / n) ** 0.5, 1e-9 * (1 + abs(s["y"])))
        searches = [Search(q, start, spread, points=[start]) for q in quantiles]
        groups = rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).limit(band + 1).collect() if n > band else []
        if 0 < len(groups) <= band:  # few different rows, however often they come: nothing to search
            for x in searches:
                x.solved = _solve_groups(groups, x.quantile, start, means, scales)
                x.done = True
        for _ in range(passes):
            open_ = [x for x in searches if not x.done and n > band]
            if not open_:
                break
            _smooth_pass(rows, open_, means, scales, p)
            for x in open_:
                if x.flat:
                    x.flat, x.solved = False, _on_plane(rows, x, s["top"], means, scales, p)
                    x.done = x.solved is not None
        out = []
        for x in searches:
            beta = _exact(rows, x, n, s["top"], means, scales, p, band) if x.solved is None else x.solved
            slopes = beta[1:] / scales
            out += [(x.quantile, t, float(v)) for t, v in zip(terms, [beta[0] - (slopes * means).sum(), *slopes], strict=True)]
        return spark.createDataFrame(out, "quantile double, term string, coefficient double")
    finally:
        rows.unpersist()


def cox_model(df: DataFrame, time: str, event: str, features: list[str], steps: int = 50, tolerance: float = 1e-15, **kw) -> DataFrame:
    """(term, coefficient, hazard_ratio, std_error, z, p_value) of Cox's proportional hazards model, ties as Breslow has them.

    Newton steps on the partial likelihood: rows are summed by time, the risk set of a time is a running sum from the latest time on, so no task holds a
    risk set. Rows with a null are left out. Without events, or with a feature that separates them fully, an error is raised.
    """
    spark, p = df.sparkSession, len(features)
    x = [F.col(f"x{i}") for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    rows = df.select(F.col(time).alias("t"), F.col(event).cast("double").alias("e"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]).dropna().persist()
    try:
        s = rows.agg(F.sum("e").alias("events"), *[f(c).alias(f"{n}{i}") for i, c in enumerate(x) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        if not s["events"]:
            raise ValueError("no event, no hazard")
        means, scales = [s[f"m{i}"] for i in range(p)], [s[f"s{i}"] or 1.0 for i in range(p)]
        unit = [(c - F.lit(m)) / F.lit(d) for c, m, d in zip(x, means, scales, strict=True)]

        def likelihood(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            eta = sum((F.lit(float(b)) * c for b, c in zip(beta, unit, strict=True)), F.lit(0.0))
            risk = F.exp(eta)
            by_time = rows.groupBy("t").agg(
                F.sum("e").alias("d"), F.sum(F.col("e") * eta).alias("de"), *[F.sum(F.col("e") * c).alias(f"d{i}") for i, c in enumerate(unit)],
                F.sum(risk).alias("r"), *[F.sum(risk * c).alias(f"r{i}") for i, c in enumerate(unit)], *[F.sum(risk * unit[i] * unit[j]).alias(f"r{i}_{j}") for i, j in pairs]).persist()
            sums = ["r", *[f"r{i}" for i in range(p)], *[f"r{i}_{j}" for i, j in pairs]]
            at = running(by_time, [], ["t"], {f"s_{c}": Spec("sum", F.col(c)) for c in sums}, descending=True, **kw).where("d > 0")
            mean = [F.col(f"s_r{i}") / F.col("s_r") for i in range(p)]
            got = at.agg(F.sum(F.col("de") - F.col("d") * F.log("s_r")), *[F.sum(F.col(f"d{i}") - F.col("d") * mean[i]) for i in range(p)],
                         *[F.sum(F.col("d") * (F.col(f"s_r{i}_{j}") / F.col("s_r") - mean[i] * mean[j])) for i, j in pairs]).first()
            by_time.unpersist()
            curve = np.zeros((p, p))
            for (i, j), v in zip(pairs, got[1 + p :], strict=True):
                curve[i, j] = curve[j, i] = v
            return got[0], np.array(got[1 : 1 + p]), curve

        beta = np.zeros(p)
        best, slope, curve = likelihood(beta)
        for _ in range(steps):
            step = np.linalg.solve(curve, slope)
            if slope @ step < tolerance * (1 + abs(best)):
                break
            if np.abs(beta + step).max() > 50:
                raise ValueError("a feature separates the events, its hazard ratio has no bound")
            for _ in range(20):  # half the step as long as it overshoots
                found = likelihood(beta + step)
                if found[0] >= best - 1e-12 * abs(best):
                    break
                step = step / 2
            beta, (best, slope, curve) = beta + step, found
        error = np.sqrt(np.diag(np.linalg.inv(curve)))
        table = [(f, float(b / d), float(np.exp(b / d)), float(v / d), float(b / v)) for f, b, v, d in zip(features, beta, error, scales, strict=True)]
        out = spark.createDataFrame(table, "term string, coefficient double, hazard_ratio double, std_error double, z double")
        return out.withColumn("p_value", two_sided_p(F.col("z")))
    finally:
        rows.unpersist()
