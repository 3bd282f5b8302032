"""Embedding near-duplicates by Euclidean p-stable hashing.

A normalised vector x goes, in each of `tables` tables, to the bucket of its quantised random projections
floor((a.x + b) / width), a from a normal (2-stable) distribution. A cosine of 0.98 is a distance of 0.2, for which one projection agrees with
probability 0.84, ten with 0.18, and at least one of 24 tables with 0.99; nearer pairs agree more often.
Within a bucket cosines are computed exactly, in double precision. Equal vectors are merged first. A hot bucket is cut into pairs
of chunks. A task returns the links of each vector as a number and a forest of them, never the pairs; a pair that meets in
several tables counts in the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.common import block_pairs, forest, linked, record, schema_of, starts_of, stored, whole_runs

THRESHOLD = 0.98
TABLES, PROJECTIONS, WIDTH, SEED = 24, 10, 1.0, 11
BLOCK = 2048


@lru_cache(maxsize=8)
def projections(dim: int, tables: int, count: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([seed, dim]))
    return rng.standard_normal((dim, tables * count)), rng.uniform(0, width, tables * count)


def buckets(unit: np.ndarray, tables: int, count: int, width: float, seed: int) -> np.ndarray:
    """A 64-bit bucket key per vector and table."""
    a, b = projections(unit.shape[1], tables, count, width, seed)
    codes = np.floor((unit @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, count)
    key = np.full((len(unit), tables), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for i in range(count):
        key = (key ^ codes[:, :, i]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, normalised vectors in double precision) of a list column, by dimension."""
    sizes = np.asarray(pa.compute.list_value_length(column))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        x = flat[begin[rows, None] + np.arange(dim)]
        x = x / np.abs(x).max(axis=1, keepdims=True)  # components of any size square without overflow
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(tables: int, count: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("node long, label string, tab long, bucket long")
        for batch in batches:
            node, label = np.asarray(batch.column(0)), batch.column(1)
            for rows, unit in units(batch.column(2)):
                key = buckets(unit, tables, count, width, seed)
                for t in range(tables):
                    yield record(schema, node[rows], label.take(pa.array(rows)), np.full(len(rows), unit.shape[1] * tables + t), key[:, t])
    return run


def _compare(threshold: float, tables: int, count: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("a long, b long, n long")
        for table in whole_runs(batches, ["label", "tab", "bucket", "_i", "_j"], 8192):
            node, copies, chunk = (table.column(k).to_numpy() for k in ("node", "copies", "_c"))
            tab, i_, j_ = (table.column(k).to_numpy() for k in ("tab", "_i", "_j"))
            label = table.column("label").combine_chunks().dictionary_encode()
            code = (label if isinstance(label, pa.DictionaryArray) else label.chunk(0)).indices.to_numpy(zero_copy_only=False)
            at = starts_of(code, tab, table.column("bucket").to_numpy(), i_, j_)
            vectors = table.column("embedding").combine_chunks()
            out: list[list[np.ndarray]] = [[], [], []]
            for s, e in zip(at.tolist(), [*at[1:].tolist(), len(node)], strict=True):
                (_, x), = units(vectors.slice(s, e - s))
                key, t = buckets(x, tables, count, width, seed), int(tab[s]) % tables
                cross = i_[s] != j_[s]
                total = np.zeros(e - s, dtype=np.int64)
                left, right = [], []
                for k in range(0, e - s, 512):
                    near = x[k : k + 512] @ x.T >= threshold
                    p, q = np.nonzero(near)
                    p += k
                    fine = p < q
                    if cross:
                        fine &= chunk[s:e][p] != chunk[s:e][q]
                    p, q = p[fine], q[fine]
                    for m in range(0, len(p), 200_000):  # the links of a slice, their earlier tables looked at in bounded pieces
                        pp, qq = p[m : m + 200_000], q[m : m + 200_000]
                        first = ~(key[pp, :t] == key[qq, :t]).any(axis=1)
                        pp, qq = pp[first], qq[first]
                        np.add.at(total, pp, copies[s:e][qq])
                        np.add.at(total, qq, copies[s:e][pp])
                        left.append(pp)
                        right.append(qq)
                if not total.any():
                    continue
                some = np.flatnonzero(total)
                a, b = forest(node[s:e][np.concatenate(left)], node[s:e][np.concatenate(right)])
                out[0] += [node[s:e][some], a]
                out[1] += [np.full(len(some), -1), b]
                out[2] += [total[some], np.zeros(len(a), dtype=np.int64)]
            if out[0]:
                a, b, n = (np.concatenate(x) for x in out)
                yield record(schema, a, pa.array(b, mask=n > 0), n)
    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, count: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED,
                    block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of vectors (vec_id, embedding, label).

    Vectors link within a label that is not null, and within a dimension. A vector that is null, empty, zero, or holds a null or non-finite
    component links with nothing, nor does a row without vec_id (component_id and kept are null there). Equal vectors are links
    of one another; rows that repeat a vec_id with the same vector count as copies. An empty table gives no rows.
    """
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~F.exists("embedding", odd) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = raw.where(fine)
    classes = stored(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "vector-classes")
    keys = stored(classes.select("node", "label", "embedding").mapInArrow(_keys(tables, count, width, seed), "node long, label string, tab long, bucket long"), "vector-buckets")
    at = ["label", "tab", "bucket"]
    sizes = keys.groupBy(*at).agg(F.count("*").alias("n")).where("n > 1")
    members = block_pairs(keys, at, "node", sizes, block).join(classes, ["node", "label"])
    order = [*at, "_i", "_j"]
    found = stored(members.select("node", *at, "_i", "_j", "_c", "copies", "embedding").repartition(*order).sortWithinPartitions(*order)
                   .mapInArrow(_compare(threshold, tables, count, width, seed), "a long, b long, n long"), "vector-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    group = linked(found.where("b IS NOT NULL"), "vector-forest")
    named = classes.join(counts, "node", "left").join(group.withColumnRenamed("label", "low"), "node", "left").select(
        F.col("label").alias("_l"), F.col("embedding").alias("_e"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "node").alias("component_id"))
    linked_rows = good.join(named, (good["label"] == named["_l"]) & (good["embedding"] == named["_e"])).select("vec_id", "n_links", "component_id")
    alone = raw.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
