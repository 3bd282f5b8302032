"""Hard negatives by Four-Russians scoring.

A candidate is stored as bit planes: for each bit of its whole-number components (two's complement, as many bits as the rows of its
batch need) and each group of eight dimensions, one byte. A task makes, for every anchor of a block and every group, the table of the
256 sums over subsets of the anchor's eight components; a byte looks up its sum, and the sums of a plane count 2^bit, the highest plane
negatively. Added up they are the full inner product, exact in whole numbers; products outside 64 bits wrap as longs do.

Anchors come in blocks of a fixed number, each sent to all tasks and scored against all candidates. A task keeps the best few of every
list, so what is shuffled does not depend on the labels or on how many rows are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sparkloom.llm.common import record, schema_of, stored
from sparkloom.session import new_scratch_path

#: Anchors of a block: with 64 dimensions its tables take 2 MB a hundred anchors.
BLOCK = 1024
#: Candidates scored at once.
ROWS = 1024
GROUP = 8
FOUND = "list long, vec_id long, score long"


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, dims, planes): plane by plane, the bytes of all groups of eight dimensions."""
    schema = schema_of("vec_id long, label long, dims int, planes binary")
    for batch in batches:
        lists = batch.column(2)
        sizes = np.diff(np.asarray(lists.offsets))
        for dims in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == dims)
            flat = np.asarray(lists.take(pa.array(own)).flatten()).reshape(len(own), dims)
            groups = -(-dims // GROUP)
            wide = np.zeros((len(own), groups * GROUP), dtype=np.int64)
            wide[:, :dims] = flat
            bits = 1 + max(int(wide.max(initial=0)).bit_length(), int(~wide.min(initial=0)).bit_length())
            planes = np.stack([np.packbits((wide >> b & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)], axis=1)
            rows = [p.tobytes() for p in planes.reshape(len(own), -1)] if groups else [b""] * len(own)
            at = pa.array(own)
            yield record(schema, batch.column(0).take(at), batch.column(1).take(at), [dims] * len(own), rows)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """[group, byte, anchor]: the sum of the anchor's components of the group whose bit is set in the byte."""
    n, dims = anchors.shape
    groups = -(-dims // GROUP)
    wide = np.zeros((groups * GROUP, n), dtype=anchors.dtype)
    wide[:dims] = anchors.T
    out = np.zeros((groups, 1 << GROUP, n), dtype=anchors.dtype)
    for g in range(groups):
        for bit in range(GROUP):
            np.add(out[g, : 1 << bit], wide[g * GROUP + bit], out=out[g, 1 << bit : 2 << bit])
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """[candidate, anchor] inner products of candidates' planes [candidate, bit, group] with the anchors of the tables."""
    total = np.zeros((len(planes), tables.shape[2]), dtype=tables.dtype)
    looked = np.empty_like(total)
    bits = planes.shape[1]
    for b in range(bits - 1, -1, -1):  # the sum so far is doubled before each lower plane, so all lookups are added alone
        if b < bits - 1:
            np.add(total, total, out=total)
        for g in range(planes.shape[2]):
            np.take(tables[g], planes[:, b, g], axis=0, out=looked, mode="clip")
            (np.subtract if b == bits - 1 else np.add)(total, looked, out=total)
    return total


class Best:
    """The `k` best (score down, id up) of numbered lists, from entries in any order."""

    def __init__(self, lists: int, k: int):
        self.k, self.lists = k, np.zeros(0, dtype=np.int64)
        self.ids, self.scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.least = np.full(lists, np.iinfo(np.int64).min)  # the worst score that a full list holds: lower ones need not come

    def add(self, lists: np.ndarray, ids: np.ndarray, points: np.ndarray) -> None:
        at, who, got = (np.concatenate(x) for x in ((self.lists, lists), (self.ids, ids), (self.scores, points)))
        order = np.lexsort((who, ~got, at))  # ~x falls as x rises
        at, who, got = at[order], who[order], got[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.concatenate([first, [len(at)]])))
        fine = rank < self.k
        self.lists, self.ids, self.scores = at[fine], who[fine], got[fine]
        full = rank == self.k - 1
        self.least[at[full]] = got[full]


def _scan(anchors: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], lows: np.ndarray | None, highs: np.ndarray | None, k: int, rows: int):
    """anchors: by number of dimensions (names, labels, components). Without lows, the best rows of the anchor's label; with them
    [anchor, window], for every window the best rows of other labels whose score lies in it. A list is an anchor's place, times the windows."""
    n = sum(len(x[0]) for x in anchors.values())
    windows = 1 if lows is None else lows.shape[1]
    schema = schema_of(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, tables, start, at = Best(n * windows, k), {}, {}, 0
        for dims, (_, _, parts) in anchors.items():
            start[dims], at = at, at + len(parts)
            tables[dims] = (subset_sums(parts), int(np.abs(parts.astype(np.float64)).sum(axis=1).max(initial=0)))
        narrow = {dims: t.astype(np.int32) for dims, (t, most) in tables.items() if most < 2**31}
        for batch in batches:
            ids, label, size = (np.asarray(batch.column(i)) for i in range(3))
            planes = batch.column(3).to_pylist()
            width = np.fromiter(map(len, planes), dtype=np.int64, count=len(planes))
            for dims in np.unique(size).tolist():
                if dims not in anchors:
                    continue
                names, labels, _ = anchors[dims]
                groups = -(-dims // GROUP)
                for w in np.unique(width[size == dims]).tolist():
                    own = np.flatnonzero((size == dims) & (width == w))
                    own = own[np.argsort(label[own], kind="stable")]
                    bits = w // groups if groups else 1
                    table = narrow[dims] if dims in narrow and tables[dims][1] << (bits - 1) < 2**31 else tables[dims][0]
                    blob = np.frombuffer(b"".join(planes[i] for i in own), dtype=np.uint8).reshape(len(own), bits, groups)
                    for s in range(0, len(own), rows):
                        some = own[s : s + rows]
                        if lows is None:
                            parts = np.unique(label[some]).tolist()
                            cuts = [(some[label[some] == v], blob[s : s + rows][label[some] == v], np.flatnonzero(labels == v)) for v in parts]
                        else:
                            cuts = [(some, blob[s : s + rows], np.arange(len(labels)))]
                        for mine, bytes_, cols in cuts:
                            if not len(cols):
                                continue
                            got = scores(table if len(cols) == table.shape[2] else np.ascontiguousarray(table[:, :, cols]), bytes_)
                            same = ids[mine][:, None] == names[cols][None, :] if lows is None else label[mine][:, None] == labels[cols][None, :]
                            came = []
                            for j in range(windows):
                                of = (start[dims] + cols) * windows + j
                                fine = ~same & (got >= (best.least[of] if lows is None else np.maximum(best.least[of], lows[start[dims] + cols, j])))
                                if highs is not None:
                                    fine &= got <= highs[start[dims] + cols, j]
                                if np.count_nonzero(fine) > 4 * k * len(cols) and len(mine) > k:  # raise the bar first
                                    bar = np.where(fine, got, np.iinfo(got.dtype).min)
                                    fine &= got >= np.partition(bar, len(mine) - k, axis=0)[len(mine) - k]
                                r, c = np.nonzero(fine)
                                came.append((of[c], ids[mine][r], got[r, c].astype(np.int64)))
                            best.add(*(np.concatenate(x) for x in zip(*came, strict=True)))
        for s in range(0, len(best.lists), 50_000):
            yield record(schema, best.lists[s : s + 50_000], best.ids[s : s + 50_000], best.scores[s : s + 50_000])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("list").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def taking_part(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, parts): whole-number components of rows with a name, a label and a vector of finite numbers."""
    parts = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    usable = F.col("vec_id").isNotNull() & label.isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), parts.alias("parts"))


def blocks_of(anchors: DataFrame, size: int) -> Iterator[list]:
    """Anchors in blocks of `size`, read from their stored table a partition at a time; the driver holds one block."""
    held = []
    for row in anchors.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column | None = None, low: int = 80, scale: int = 256, positives: int = 5, negatives: int = 5,
                   block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that `anchor` holds for.

    An anchor's positives are its best `positives` other rows of its label; for each, the best `negatives` rows of another label with
    low % of the positive's score to all of it. Scores are inner products of components floor(scale * x); ties go to the smaller vec_id.
    Rows without vec_id, label or vector, or with a null or non-finite component, take no part. Vectors of different lengths do not meet;
    an empty vector scores 0. Other rows are those with another vec_id; a repeated row counts as often as it is there, as candidate and as anchor.
    A table without anchors gives no rows. One job per block of anchors scores all rows for positives and one for negatives.
    """
    spark = vectors.sparkSession
    own = F.col("label") if label is None else label
    fine = taking_part(vectors, own, scale)
    index = stored(fine.mapInArrow(packed, "vec_id long, label long, dims int, planes binary"), "negatives-index")
    anchors = stored(taking_part(vectors.where(anchor), own, scale), "negatives-anchors")
    path = new_scratch_path(spark, "negatives-found")
    for number, held in enumerate(blocks_of(anchors, block)):
        by_size: dict[int, list] = {}
        for row in held:
            by_size.setdefault(len(row["parts"]), []).append(row)
        sent = {d: (np.array([r["vec_id"] for r in x]), np.array([r["label"] for r in x]), np.array([r["parts"] for r in x], dtype=np.int64).reshape(len(x), d)) for d, x in by_size.items()}
        names = np.concatenate([x[0] for x in sent.values()])
        near = _top(index.mapInArrow(_scan(sent, None, None, positives, rows), FOUND), positives).collect()  # at most `positives` rows an anchor of the block
        lows, highs = np.full((len(names), positives), 1), np.zeros((len(names), positives), dtype=np.int64)  # a window that holds nothing
        for r in near:
            lows[r["list"], r["rank"] - 1], highs[r["list"], r["rank"] - 1] = -(-low * r["score"] // 100), r["score"]
        windows = spark.createDataFrame([(r["list"] * positives + r["rank"] - 1, int(names[r["list"]]), r["vec_id"], r["score"]) for r in near],
                                        "list long, anchor_id long, positive_id long, positive_score long")
        best = _top(index.mapInArrow(_scan(sent, lows, highs, negatives, rows), FOUND), negatives)
        best.join(F.broadcast(windows), "list").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                                                      "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{path}/block={number}")
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if anchors.isEmpty():
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds + ", block long").parquet(path).drop("block")
