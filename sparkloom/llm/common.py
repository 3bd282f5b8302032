"""Helpers that the operators share: stored tables, Arrow batches, runs of a key, and links.

Each operator reads named columns only, so extra columns of any name never clash with its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.operators.graph import components as graph_components
from sparkloom.session import new_scratch_path

#: Rows of an Arrow batch of whole texts, so that a batch of long documents stays small.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Lower the rows of an Arrow batch, never raise them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a written table in the shared folder: lineage ends here, lost executors cost no recomputation."""
    path = new_scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back(run):
    """The task function with the memory that it has freed given back at its end: workers serve later tasks and would keep it."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return whole


def schema_of(text: str) -> pa.Schema:
    """An Arrow schema from `name type, ...` with the types used here."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
             "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary()), "array<float>": pa.list_(pa.float32()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split(" ", 1) for part in text.split(", "))])


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def volumes(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Slices of a list of byte strings with about `limit` bytes each; a longer one stands alone."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > limit:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Positions where a run of equal keys begins."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, dtype=np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], at_least: int = 50_000) -> Iterator[pa.Table]:
    """Tables that hold whole runs of the keys from batches sorted by them; only the last run waits for the next batch."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        table = pa.Table.from_batches(held)
        last = [table.column(k)[rows - 1] for k in keys]
        same = np.ones(rows, dtype=bool)
        for k, v in zip(keys, last, strict=True):
            same &= np.asarray(pa.compute.equal(table.column(k), v))
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            rows -= cut
    if rows:
        yield pa.Table.from_batches(held)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) of the links a-b, without the roots themselves."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a):]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task as a forest, folded batch by batch so that a task holds its nodes and not its links."""
    schema = schema_of("a long, b long")
    a, b, waiting = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []
    def fold():
        if not waiting:
            return a, b
        x, y = np.concatenate([a, *(w[0] for w in waiting)]), np.concatenate([b, *(w[1] for w in waiting)])
        waiting.clear()
        return forest(x, y)
    for batch in batches:
        waiting.append((np.asarray(batch.column("a")), np.asarray(batch.column("b"))))
        if sum(len(w[0]) for w in waiting) > 500_000:
            a, b = fold()
    a, b = fold()
    for i in range(0, len(a), 100_000):
        yield record(schema, np.minimum(a, b)[i : i + 100_000], np.maximum(a, b)[i : i + 100_000])


def linked(links: DataFrame, label: str) -> DataFrame:
    """(node, label): the smallest node that links (a, b) of non-null longs reach; nodes without links are absent."""
    thin = stored(links.select("a", "b").where("a <> b").mapInArrow(_local_forest, "a long, b long").distinct(), label)
    if thin.isEmpty():
        return thin.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return graph_components(thin)


def block_pairs(members: DataFrame, keys: list[str], spread: str, sizes: DataFrame, size: int) -> DataFrame:
    """Members of each key cut into chunks by a hash of `spread`, a copy for every pair of chunks they take part in.

    sizes has the keys and n, their members. A key of up to `size` members is one chunk; a hot one becomes many
    (_i, _j) pairs of chunks of about that size, which any number of tasks can compare: two members always meet.
    """
    chunks = F.ceil(F.col("n") / F.lit(size)).cast("int")
    parts = F.when(F.col("_m") <= 1, F.array(F.struct(F.lit(0).alias("_i"), F.lit(0).alias("_j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("_m") - 1), lambda o: F.struct(F.least(o, F.col("_c")).alias("_i"), F.greatest(o, F.col("_c")).alias("_j"))))
    both = members.join(sizes.select(*keys, chunks.alias("_m")), keys).withColumn("_c", F.pmod(F.xxhash64(F.col(spread)), F.greatest("_m", F.lit(1))).cast("int"))
    return both.withColumn("_p", F.explode(parts)).select(*members.columns, "_c", F.col("_p._i").alias("_i"), F.col("_p._j").alias("_j"))
