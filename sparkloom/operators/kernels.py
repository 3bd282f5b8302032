"""Random Fourier features: a linear model on them is close to one with a radial kernel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F


def standard_scales(df: DataFrame, features: list[str]) -> list[tuple[float, float]]:
    """(mean, deviation) of each feature; a constant has deviation 1."""
    s = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}_{k}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return [(s[f"{c}_m"] or 0.0, s[f"{c}_s"] or 1.0) for c in features]


def radial_features(df: DataFrame, features: list[str], scales: list[tuple[float, float]], size: int = 200, gamma: float | None = None, seed: int = 42, out: str = "features") -> DataFrame:
    """df with a vector of `size` cosines whose inner products come near exp(-gamma |x - y|²) of the standardised features.

    gamma is 1 / number of features where not given. Directions are drawn from the seed and sent to the tasks, nothing is stored; scales come from
    the training rows (`standard_scales`), so other rows get the same map. A null counts as the mean.
    """
    d = len(features)
    rng = np.random.default_rng(seed)
    w = rng.standard_normal((d, size)) * (2 * (1 / d if gamma is None else gamma)) ** 0.5
    shift = rng.uniform(0, 2 * np.pi, size)
    mean, scale = (np.array(v) for v in zip(*scales, strict=True))

    @F.pandas_udf("array<double>")
    def cosines(rows: pd.DataFrame) -> pd.Series:
        x = (rows.to_numpy(dtype=float, na_value=np.nan) - mean) / scale
        return pd.Series(list(np.cos(np.nan_to_num(x) @ w + shift) * (2 / size) ** 0.5))

    return df.withColumn(out, array_to_vector(cosines(F.struct(*[F.col(c).cast("double").alias(c) for c in features]))))
