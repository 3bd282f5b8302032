"""Multi-step forecasts in which a prediction becomes the next lag."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Window as W, functions as F

LAGS = (1, 2, 7)


@dataclass(frozen=True)
class Trees:
    """A fitted ensemble as arrays, small enough to send to every task: (weight, feature, limit, left, right, value) of each tree."""

    trees: list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for weight, feature, limit, left, right, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[node] >= 0).any():
                at = node[inner]
                node[inner] = np.where(x[inner, feature[at]] <= limit[at], left[at], right[at])
            total += weight * value[node]
        return total


def tree_arrays(model: GBTRegressionModel) -> Trees:
    """The nodes of a boosted model of continuous features."""
    out = []
    for weight, tree in zip(model.treeWeights, model.trees, strict=True):
        rows: list[list] = []

        def walk(node) -> int:
            at = len(rows)
            rows.append([-1, 0.0, 0, 0, node.prediction()])
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                rows[at][:2] = split.featureIndex(), split.threshold()
                rows[at][2], rows[at][3] = walk(node.leftChild()), walk(node.rightChild())
            return at

        walk(tree._java_obj.rootNode())
        columns = list(zip(*rows, strict=True))
        out.append((float(weight), np.array(columns[0], dtype=np.int64), np.array(columns[1], dtype=float), *(np.array(c, dtype=np.int64) for c in columns[2:4]), np.array(columns[4], dtype=float)))
    return Trees(out)


def fit_one_step(series: DataFrame, key: str, day: str, value: str, until: Column, lags: tuple[int, ...] = LAGS, trees: int = 8, depth: int = 4, seed: int = 42) -> Trees:
    """A boosted model of a day's value on earlier values and the day of the week, learned from days up to `until`.

    series has a row for each key and day (see features.densify_days); a window holds one key's calendar.
    """
    w = W.partitionBy(key).orderBy(day)
    rows = series.where(F.col(day) <= until).select(*[F.lag(F.col(value).cast("double"), k).over(w).alias(f"lag{k}") for k in lags], F.weekday(day).cast("double").alias("dow"), F.col(value).cast("double").alias("label")).dropna()
    v = VectorAssembler(inputCols=[f"lag{k}" for k in lags] + ["dow"], outputCol="features").transform(rows)
    return tree_arrays(GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed).fit(v))


def _fold(model: Trees, lags: tuple[int, ...], horizons: int, kind: pa.DataType):
    need = max(lags)
    schema = pa.schema([("key", kind), ("horizon", pa.int32()), ("day", pa.date32()), ("forecast", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            past = np.array(batch.column("past").to_pylist(), dtype=float).reshape(batch.num_rows, need)
            last = np.asarray(batch.column("last").cast(pa.int32())).astype(np.int64)
            for h in range(1, horizons + 1):
                day = last + h
                x = np.column_stack([*[past[:, need - k] for k in lags], (day + 3) % 7])  # day 0 was a Thursday, Monday is 0
                new = model.predict(x)
                past = np.column_stack([past[:, 1:], new])
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.full(len(x), h, dtype=np.int32)), pa.array(day.astype(np.int32)).cast(pa.date32()), pa.array(new)], schema=schema)

    return run


def recursive_forecast(series: DataFrame, key: str, day: str, value: str, horizons: int, until: datetime.date | None = None, lags: tuple[int, ...] = LAGS, model: Trees | None = None, **kw) -> DataFrame:
    """(key, horizon, day, forecast) of the `horizons` days after `until` (the last day): each step's prediction is a lag of the next.

    A series is its last max(lags) values, one row; the model goes to the tasks as arrays, and a task steps all its series on together.
    Series with fewer values up to that day give no rows; a null value counts as 0.
    """
    last = F.lit(until).cast("date") if until is not None else F.lit(series.agg(F.max(day)).first()[0]).cast("date")
    if model is None:
        model = fit_one_step(series, key, day, value, last, lags, **kw)
    need = max(lags)
    newest = W.partitionBy(key).orderBy(F.desc(day))
    state = series.where(F.col(day) <= last).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= need)
    state = state.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(F.struct(F.col(day).alias("d"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")))).alias("_p"), F.max(day).cast("date").alias("last"))
    state = state.where(F.size("_p") == need).select("key", F.col("_p.v").alias("past"), "last")
    name = series.schema[key].dataType.simpleString()
    kind = pa.string() if name == "string" else pa.int32() if name == "int" else pa.int64()
    out = state.mapInArrow(_fold(model, tuple(lags), horizons, kind), f"key {name}, horizon int, day date, forecast double")
    return out.withColumnRenamed("key", key)
