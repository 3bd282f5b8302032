"""Mixing sources to target weights by Poisson replication.

A document of source s is wanted r(s) = total * weight(s) / documents(s) times on average. Its count is the smallest k with
u <= P(X <= k), X Poisson with mean r(s), where u comes from the MD5 of seed and doc_id: the count depends on the document
alone, so workers need no common state. Documents are exploded by their counts and shuffled globally by another hash.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.llm.common import stored

SEED = 17
POWER = 0.7
#: Sources whose rates are broadcast; more of them are joined.
MOST_SENT = 100_000
#: Hash digits taken for u: 52 bits, which a double holds exactly.
DIGITS = 13


def unit_hash(seed: int, key: Column, salt: str = "") -> Column:
    """A number strictly between 0 and 1 from the MD5 of `seed|salt|key`."""
    text = F.concat(F.lit(f"{seed}|{salt}|"), F.coalesce(key.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def invert(u: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """The smallest k with u <= P(X <= k). Terms are summed as logs of the mass, so a rate in the thousands is no matter."""
    out = np.zeros(len(u), dtype=np.int64)
    for mean in np.unique(rate[rate > 0]):
        pick = rate == mean
        top = int(mean + 12 * math.sqrt(mean) + 60)  # beyond it lies less than 2**-53 of the mass
        k = np.arange(1, top + 1)
        mass = np.exp(np.concatenate([[-mean], -mean + k * math.log(mean) - np.cumsum(np.log(k))]))
        out[pick] = np.searchsorted(np.cumsum(mass), u[pick], side="left")
    return out


def _copies(u: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series(invert(u.to_numpy(), np.nan_to_num(rate.to_numpy(dtype=float))))


def target_rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, power: float = POWER) -> DataFrame:
    """(source, n_docs, weight, rate): weights sum to one; without a weights table (source, weight) they follow documents ** power.

    total is the number of documents wanted (default: as many as there are). A source that the weights leave out, or with a
    weight that is null, negative or not finite, gets rate zero. A null source is a source like any other.
    """
    counted = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    if weights is None:
        named = counted.withColumn("w", F.pow(F.col("n_docs").cast("double"), F.lit(power)))
    else:
        w = F.col("weight").cast("double")
        fine = weights.select(F.col("source").alias("_s"), F.when((w > 0) & (w < F.lit(float("inf"))), w).otherwise(0.0).alias("w")).groupBy("_s").agg(F.sum("w").alias("w"))
        named = counted.join(fine, counted["source"].eqNullSafe(fine["_s"]), "left").select("source", "n_docs", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = named.agg(F.sum("w").alias("w"), F.sum("n_docs").alias("n")).first()
    whole, wanted = sums["w"] or 0.0, float(total if total is not None else sums["n"] or 0)
    weight = F.col("w") / F.lit(whole) if whole else F.lit(0.0)
    return named.select("source", "n_docs", weight.alias("weight")).withColumn("rate", F.lit(wanted) * F.col("weight") / F.col("n_docs"))


def replicated(docs: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with __llm_copy, one row for each copy (from 0), in no order. Only ids and sources go through Python, not texts.

    Up to MOST_SENT sources, the rates are sent to the documents, which then are not shuffled by source.
    """
    rate = stored(rates.select(F.col("source").alias("__llm_source"), F.col("rate").alias("__llm_rate")), "source-rates")
    if rate.count() <= MOST_SENT:
        rate = F.broadcast(rate)
    joined = docs.join(rate, docs["source"].eqNullSafe(rate["__llm_source"]), "left").drop("__llm_source").withColumn("__llm_u", unit_hash(seed, F.col("doc_id")))
    count = F.pandas_udf(_copies, "long")
    return joined.withColumn("__llm_n", count("__llm_u", "__llm_rate")).where("__llm_n > 0").withColumn("__llm_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__llm_n") - 1))).drop("__llm_u", "__llm_n")


def shuffled(copies: DataFrame, columns: list[str], copy: str | None = None, order: str | None = None, seed: int = SEED) -> DataFrame:
    """Replicated rows in a global random order: a hash of document and copy deals a row to a task and sorts it there.

    `columns` come back, with the copy's number and the order key where names for them are given.
    """
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("__llm_copy"))
    dealt = copies.withColumn("__llm_key", unit_hash(seed, name, "order")).repartition("__llm_key").sortWithinPartitions("__llm_key")
    return dealt.select(*columns, *([F.col("__llm_copy").alias(copy)] if copy else []), *([F.col("__llm_key").alias(order)] if order else []))


def mix(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, power: float = POWER, seed: int = SEED) -> DataFrame:
    """docs with each row repeated by its Poisson count, in a global random order.

    Rows that share a doc_id share their draw (each row counts as a document of its source); rows without doc_id share one too.
    Null and empty texts are copied like others. An empty table stays empty. Columns are those of docs.
    """
    return shuffled(replicated(docs, target_rates(docs, weights, total, power), seed), docs.columns, seed=seed)
