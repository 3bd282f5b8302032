"""Content fingerprints of files of any size: hashed split by split, the splits of a file put together in order.

A split's hash is a polynomial in its bytes, modulo a prime, at three fixed points. The hash of two pieces in a row follows from theirs and the
length of the second, so the result does not depend on where a file is cut; no task reads a whole file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

PRIME = (1 << 31) - 1
POINTS = (1_103_515_245, 1_664_525_013, 214_013_777)
#: Bytes that are weighted at a time: their sum fits 64 bits.
STEP = 1 << 16


def _powers() -> list[np.ndarray]:
    out = []
    for point in POINTS:
        powers = np.ones(STEP, dtype=np.uint64)
        filled = 1
        while filled < STEP:  # powers[i] = point^i
            more = min(filled, STEP - filled)
            powers[filled : filled + more] = powers[:more] * np.uint64(pow(point, filled, PRIME)) % np.uint64(PRIME)
            filled += more
        out.append(powers[::-1].copy())
    return out


def extend(hashes: list[int], data: bytes, powers: list[np.ndarray]) -> list[int]:
    """The hashes after `data`; a byte counts as itself plus one, so leading zeros count."""
    flat = np.frombuffer(data, dtype=np.uint8)
    for s in range(0, len(flat), STEP):
        part = flat[s : s + STEP].astype(np.uint64) + np.uint64(1)
        hashes = [(h * pow(point, len(part), PRIME) + int((part * own[STEP - len(part) :]).sum())) % PRIME for h, point, own in zip(hashes, POINTS, powers, strict=True)]
    return hashes


def joined(left: tuple[int, list[int]], right: tuple[int, list[int]]) -> tuple[int, list[int]]:
    """(length, hashes) of two pieces in a row."""
    return left[0] + right[0], [(a * pow(point, right[0], PRIME) + b) % PRIME for a, b, point in zip(left[1], right[1], POINTS, strict=True)]


_PIECE = pa.schema([("path", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("hashes", pa.list_(pa.int64()))])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = _powers()
    at, n, hashes = None, 0, [0] * len(POINTS)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((*at, n, hashes), _PIECE, strict=True)], schema=_PIECE)

    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        lines = batch.column(3).to_pylist()
        i = 0
        while i < len(keys):
            j = i
            while j < len(keys) and keys[j] == keys[i]:
                j += 1
            if keys[i] != at:
                if at is not None:
                    yield row()
                at, n, hashes = keys[i], 0, [0] * len(POINTS)
            data = b"\n".join(lines[i:j]) + b"\n"
            n, hashes = n + len(data), extend(hashes, data, powers)
            i = j
    if at is not None:
        yield row()


_FILE = pa.schema([("path", pa.string()), ("length", pa.int64()), ("fingerprint", pa.string())])


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list = []

    def row() -> pa.RecordBatch:
        path, size, (n, hashes) = held
        digest = hashlib.sha256(f"{size}:{n}:{':'.join(map(str, hashes))}".encode()).hexdigest()[:16]
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((path, size, digest), _FILE, strict=True)], schema=_FILE)

    for batch in batches:
        for r in batch.to_pylist():
            piece = (r["n"], r["hashes"])
            if held and held[0] == r["path"]:
                held[2] = joined(held[2], piece)
                continue
            if held:
                yield row()
            held = [r["path"], r["size"], piece]
    if held:
        yield row()


def content_fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, fingerprint) of every file under a path: 16 hex digits over its length and all its bytes, the same for any size of splits.

    Files are read as lines of raw bytes, so a file may be cut anywhere a line begins; 2 GB without a line break are more than a row can
    hold. Compressed files (.gz and the like) count by what they hold. Spark's readers pass over
    empty files, which give no row.
    """
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    lines = reader.option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    rows = lines.select(meta["file_path"].alias("path"), meta["file_size"].alias("size"), meta["file_block_start"].alias("start"), F.col("value").cast("binary").alias("value"))
    pieces = rows.mapInArrow(_pieces, "path string, size long, start long, n long, hashes array<long>")
    return pieces.repartition("path").sortWithinPartitions("path", "start").mapInArrow(_files, "path string, length long, fingerprint string")


def tree_fingerprint(files: DataFrame) -> DataFrame:
    """(n_files, n_bytes, fingerprint) of a set of files by what they hold, whatever they are called."""
    value = F.conv(F.col("fingerprint"), 16, 10).cast("decimal(38,0)")
    return files.agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"), F.sum(value).cast("string").alias("fingerprint"))
