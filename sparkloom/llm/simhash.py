"""SimHash near-duplicates by anchor-point covering.

Fingerprint: bit b is 1 where over half of the document's 3-word shingle hashes (XXH64, seed 42) have it.

Candidates: a fingerprint is two halves of 32 bits. Fingerprints within three bits agree in one half up to one bit,
so each half is covered with threshold one. The anchors of a half are the words of the [31, 26] Hamming code
(a perfect code of covering radius one; the last bit is left out, which no more than widens a ball). A half has one
home, the anchor it decodes to, and is replicated to every anchor within the radius plus one that can be the home of a
half one bit away: 16 anchors at most. Two halves within one bit meet at each other's home, and only there fingerprints are
compared, home against guest, by their whole 64 bits. Equal fingerprints are merged first; an anchor with many members is
cut into pairs of chunks, and a task returns a forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from sparkloom.llm.common import as_bytes, block_pairs, forest, give_back, linked, record, schema_of, small_batches, starts_of, stored, whole_runs

WORDS = 3
MAX_BITS = 3
BLOCK = 2048


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included; bytes.lower and bytes.split know ASCII only, as asked."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 42)], dtype=np.uint64)
    line = memoryview(b" ".join(found))
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
    ends = np.cumsum(lengths) - 1
    begins = ends - lengths + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], 42) for s, e in zip(begins[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(found) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits set in over half of the hashes, counted in slices so that long texts need no wide table."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 60_000):
        counts += np.unpackbits(np.ascontiguousarray(hashes[i : i + 60_000], dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("doc_id long, fp long")
        for batch in batches:
            bits = np.array([majority(shingle_hashes(t, words)) for t in as_bytes(batch.column(1))], dtype=np.uint64)
            yield record(schema, batch.column(0), bits.view(np.int64))
    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): one row per input row; null and empty texts have fingerprint zero."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(give_back(_prints(words)), "doc_id long, fp long")


def syndrome(half: np.ndarray) -> np.ndarray:
    """The place of the bit (1 to 31) that decoding flips, 0 for an anchor."""
    out = np.zeros(len(half), dtype=np.uint32)
    for place in range(1, 32):
        out ^= np.where((half >> np.uint32(place - 1)) & np.uint32(1), np.uint32(place), np.uint32(0))
    return out


def unit(place: np.ndarray) -> np.ndarray:
    """The word with one bit at a place, no bit at place 0."""
    return np.where(place > 0, np.uint32(1) << (np.maximum(place, 1) - 1).astype(np.uint32), np.uint32(0))


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) of 64-bit fingerprints; an anchor is numbered by half and code word."""
    rows, keys, homes = [], [], []
    every = np.arange(len(fp), dtype=np.int64)
    bits = fp.view(np.uint64)
    for part in (0, 1):
        half = ((bits >> np.uint64(32 * part)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
        s = syndrome(half)
        for place in range(32):
            # Flipping `place` and decoding flips the place s ^ place too; each such pair is taken once.
            other = s ^ np.uint32(place)
            take = (np.uint32(place) < other) | ((other == place) & (place == 0))
            word = half[take] ^ unit(np.full(int(take.sum()), place, dtype=np.uint32)) ^ unit(other[take])
            rows.append(every[take])
            keys.append(word.astype(np.int64) | (part << 31))
            homes.append(np.full(int(take.sum()), place == 0))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = schema_of("anchor long, fp long, home boolean")
    for batch in batches:
        fp = np.asarray(batch.column(0))
        row, key, home = anchors(fp)
        for i in range(0, len(row), 100_000):
            yield record(schema, key[i : i + 100_000], fp[row[i : i + 100_000]], home[i : i + 100_000])


def _compare(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("a long, b long")
        for table in whole_runs(batches, ["anchor", "_i", "_j"]):
            fp, home = table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy()
            at = starts_of(*(table.column(k).to_numpy() for k in ("anchor", "_i", "_j")))
            left, right = [], []
            for s, e in zip(at.tolist(), [*at[1:].tolist(), len(fp)], strict=True):
                x, y = fp[s:e][home[s:e]], fp[s:e]
                for i in range(0, len(x), 256):
                    near = np.bitwise_count(x[i : i + 256, None] ^ y[None, :]) <= max_bits
                    p, q = np.nonzero(near)
                    a, b = x[i + p], y[q]
                    real = a != b
                    if real.any():
                        node, root = forest(a[real].view(np.int64), b[real].view(np.int64))
                        left.append(node)
                        right.append(root)
            if left:
                yield record(schema, np.concatenate(left), np.concatenate(right))
    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all different fingerprints (column fp, distinct) within max_bits (up to three)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two covered halves with threshold one find up to three bits")
    held = stored(fps.select("fp").mapInArrow(_to_anchors, "anchor long, fp long, home boolean"), "simhash-anchors")
    sizes = held.groupBy("anchor").agg(F.count("*").alias("n"), F.max("home").alias("h")).where("n > 1 AND h")
    pairs = block_pairs(held, ["anchor"], "fp", sizes, block)
    return pairs.select("anchor", "_i", "_j", "fp", "home").repartition("anchor", "_i", "_j").sortWithinPartitions("anchor", "_i", "_j").mapInArrow(_compare(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per input row.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows and equal texts share a fingerprint,
    so a component. A row without doc_id takes part in links; component_id is the smallest doc_id there is, null if none.
    An empty table gives no rows.
    """
    fps = stored(fingerprints(docs, words), "simhash-prints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    group = linked(links(distinct, max_bits), "simhash-links").select(F.col("node").alias("fp"), "label")
    named = distinct.join(group, "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    lows = named.groupBy("label").agg(F.min("low").alias("component_id"))
    return fps.join(named.select("fp", "label").join(lows, "label").select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents of the smallest doc_id of each component, all columns kept."""
    return keep_lowest(docs, near_duplicates(docs, words, max_bits))


def keep_lowest(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents whose doc_id is the component_id that found (doc_id, component_id) gives them, all columns kept.

    Rows that share a doc_id are one document: one row of them stays, that with the smallest text hash. Rows without doc_id
    cannot be told apart and stay.
    """
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    order = W.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).orderBy(F.xxhash64("text"))
    left = docs.join(gone, "doc_id", "left_anti")
    return left.withColumn("__llm_row", F.row_number().over(order)).where("__llm_row = 1").select(*docs.columns)
