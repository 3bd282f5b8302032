"""Approximate nearest vectors by product-quantised residuals in coarse cells, and an exact look at the best of them.

A vector lies in the cell of its nearest centre; what is left of it is cut into parts, and each part is written as the number of the nearest
of 256 points. A query makes a table of its products with all points of all parts, so a candidate's score is the centre's product and
one look-up per part. The index is a stored table of 1 byte a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkloom.operators.retrieval import _top, unit
from sparkloom.session import new_scratch_path

POINTS = 256
#: Rows that centres and points are fitted on, about, and centres at most: both bound what the driver holds.
SAMPLE, MOST_CELLS = 100_000, 2048
#: Queries whose tables are sent to the tasks at a time.
BLOCK = 256
FIT_STEPS = 12


@dataclass(frozen=True)
class Quantiser:
    centres: np.ndarray  # cells x width
    points: np.ndarray  # parts x POINTS x width / parts
    probes: int = 8  # cells that a query looks into

    def cell(self, v: np.ndarray) -> np.ndarray:
        return nearest(v, self.centres)

    def codes(self, v: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = v - self.centres[cell]
        wide = self.points.shape[2]
        return np.stack([nearest(rest[:, p * wide : (p + 1) * wide], own) for p, own in enumerate(self.points)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """[query, part, point] products."""
        parts, _, wide = self.points.shape
        return np.einsum("qpw,ptw->qpt", q.reshape(len(q), parts, wide), self.points)


def nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(v[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(v), 4096)]) if len(v) else np.zeros(0, dtype=np.int64)


def lloyd(v: np.ndarray, k: int, steps: int, seed: int) -> np.ndarray:
    """k means of rows in memory; an empty cell moves to a row of the fullest one."""
    rng = np.random.default_rng(seed)
    centres = v[rng.choice(len(v), size=k, replace=len(v) < k)].copy()
    for _ in range(steps):
        cell = nearest(v, centres)
        count = np.bincount(cell, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, cell, v)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
        for c in np.flatnonzero(count == 0):
            centres[c] = v[rng.choice(np.flatnonzero(cell == count.argmax()))]
    return centres


def cells_apart(v: np.ndarray, centres: np.ndarray, recall: float, seed: int, queries: int = 300, k: int = 10) -> int:
    """Cells to look into so that `recall` of the k nearest rows of the sample are in them: few where cells follow the data, most where nothing does."""
    some = np.random.default_rng(seed).choice(len(v), size=min(queries, len(v)), replace=False)
    near = np.argpartition(-(v[some] @ v.T), min(k, len(v) - 1), axis=1)[:, : k + 1]
    order = np.argsort(-(v[some] @ centres.T - (centres**2).sum(axis=1) / 2), axis=1)
    rank = np.argsort(order, axis=1)
    ranks = np.sort(np.take_along_axis(rank, nearest(v, centres)[near], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1


def fit_quantiser(corpus: DataFrame, key: str, vector: str, cells: int | None = None, parts: int = 16, sample: int = SAMPLE, recall: float = 0.97, seed: int = 7) -> Quantiser:
    """Centres and points from about `sample` unit vectors chosen by a hash of the key, and how many cells a query needs for the recall, measured on them.

    Without `cells` their number follows the square root of the corpus, up to MOST_CELLS.
    """
    n = corpus.count()
    chance = min(1.0, sample / max(n, 1))
    rows = corpus.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(chance * (1 << 30)) + 1)).select(unit(F.col(vector)).alias("v")).where("v[0] IS NOT NULL").collect()
    v = np.array([r["v"] for r in rows], dtype=np.float64)
    if not len(v):
        raise ValueError("no vector to learn from")
    if v.shape[1] % parts:
        raise ValueError(f"{parts} parts do not divide {v.shape[1]} dimensions")
    centres = lloyd(v, cells or min(MOST_CELLS, max(4, round(n**0.5 / 2))), FIT_STEPS, seed)
    rest = (v - centres[nearest(v, centres)]).reshape(len(v), parts, -1)
    return Quantiser(centres, np.stack([lloyd(rest[:, p], POINTS, FIT_STEPS, seed + p) for p in range(parts)]), cells_apart(v, centres, recall, seed))


def build_index(corpus: DataFrame, key: str, vector: str, model: Quantiser) -> DataFrame:
    """(key, cell, codes) of every row with a vector that has a direction, stored, sorted by cell."""
    kind = corpus.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
            if len(v):
                cell = model.cell(v)
                codes = model.codes(v, cell)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], type=pa.binary())], names=["key", "cell", "codes"])

    rows = corpus.select(F.col(key).alias("key"), unit(F.col(vector)).alias("v")).where("v[0] IS NOT NULL")
    path = new_scratch_path(corpus.sparkSession, "vector-index")
    rows.mapInArrow(run, f"key {kind}, cell int, codes binary").sortWithinPartitions("cell").write.parquet(path)
    return corpus.sparkSession.read.schema(f"key {kind}, cell int, codes binary").parquet(path)


def quantised_top_k(corpus: DataFrame, key: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int, model: Quantiser | None = None, index: DataFrame | None = None,
                    probes: int | None = None, look: int = 10, block: int = BLOCK) -> DataFrame:
    """(query, key, score, rank): cosine top k among the `look` * k best by codes of the `probes` nearest cells, these scored exactly.

    The index is scanned once per block of queries, whose tables go to the tasks; a task keeps the best of each query, so what is shuffled follows the
    queries; `probes` is the model's where not given. Of the candidates only keys meet the vectors, in an ordinary join. Vectors without a direction find and are found by nothing.
    """
    spark = corpus.sparkSession
    if model is None:
        model = fit_quantiser(corpus, key, vector)
    if index is None:
        index = build_index(corpus, key, vector, model)
    kind, qkind = corpus.schema[key].dataType.simpleString(), queries.schema[query].dataType.simpleString()
    most = look * k
    asked = queries.select(F.col(query).alias("q"), unit(F.col(query_vector)).alias("v")).where("v[0] IS NOT NULL")
    blocks = max(1, -(-asked.count() // block))
    path = new_scratch_path(spark, "vector-candidates")
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        rows = part.collect()  # about one block
        if not rows:
            continue
        q = np.array([r["v"] for r in rows], dtype=np.float64)
        names, tables, coarse = [r["q"] for r in rows], model.tables(q).astype(np.float32), q @ model.centres.T
        near = np.argsort(-(coarse - (model.centres**2).sum(axis=1) / 2), axis=1)[:, : probes or model.probes]
        by_cell = [np.flatnonzero((near == c).any(axis=1)) for c in range(len(model.centres))]

        def scan(batches: Iterator[pa.RecordBatch], tables=tables, coarse=coarse, by_cell=by_cell, names=names) -> Iterator[pa.RecordBatch]:
            best: list[list] = [[] for _ in names]  # (scores, keys) pieces of each query, cut back as they grow
            size = [0] * len(names)

            def cut(i: int) -> None:
                s, ids = np.concatenate([x for x, _ in best[i]]), np.concatenate([x for _, x in best[i]])
                if len(s) > most:
                    top = np.argpartition(-s, most - 1)[:most]
                    s, ids = s[top], ids[top]
                best[i], size[i] = [(s, ids)], len(s)

            for batch in batches:
                cell, keys = np.asarray(batch.column(1)), np.array(batch.column(0).to_pylist(), dtype=object)
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(len(cell), -1).astype(np.int64)
                for c in np.unique(cell).tolist():
                    own = np.flatnonzero(cell == c)
                    for i in by_cell[c].tolist():
                        s = coarse[i, c] + tables[i][np.arange(codes.shape[1]), codes[own]].sum(axis=1)
                        best[i].append((s, keys[own]))
                        size[i] += len(own)
                        if size[i] > 8 * most:
                            cut(i)
            for i, name in enumerate(names):
                if best[i]:
                    cut(i)
                    s, ids = best[i][0]
                    yield pa.record_batch([pa.array([name] * len(s)), pa.array(list(ids)), pa.array(s.astype(np.float64))], names=["q", "key", "guess"])

        index.mapInArrow(scan, f"q {qkind}, key {kind}, guess double").write.parquet(f"{path}/block={b}")
    empty = spark.createDataFrame([], f"q {qkind}, key {kind}, guess double")
    found = spark.read.schema(f"q {qkind}, key {kind}, guess double, block int").parquet(path).drop("block") if not asked.isEmpty() else empty
    best = _top(found.withColumnRenamed("guess", "score"), "q", most, "key").select("q", "key")
    exact = best.join(corpus.select(F.col(key).alias("key"), unit(F.col(vector)).alias("_v")), "key").join(asked.withColumnRenamed("v", "_q"), "q")
    dot = F.aggregate(F.zip_with("_q", "_v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return _top(exact.select(F.col("q").alias(query), F.col("key").alias(key), F.round(dot, 6).alias("score")), query, k, key)
