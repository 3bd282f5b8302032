"""Deterministic sharded WARC writer and reader.

Records are cut into shards by ranges of page_id, sorted within a shard and written as gzip members; a file is closed when its
compressed size reaches the roll size. Headers and digests are made anew from the payload. A file is written under a temporary
name and moved when it is whole, so a lost or repeated task leaves nothing half; the manifest is written last, and the folder
of the archives gets its name only then. Shard bounds come from a hash sample of the ids, so equal tables give equal files.
Tasks write through pyarrow's file systems, so the folder may be in any store they know.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm.common import record, schema_of, small_batches

SHARD_BYTES, ROLL_BYTES, LEVEL = 64 << 20, 16 << 20, 6
MIN_BYTES = 0
#: Ids that shard bounds are taken from, about.
BOUND_SAMPLE = 20_000
#: Tasks that write at most; a task writes several shards, one after another, where there are more.
TASKS = 20_000
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "file string, shard long, records long, bytes long, sha256 string"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode("ascii")


def record_id(page_id, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}')}>"


def clean(url: str | None, page_id) -> str:
    """A URL that stays on its header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"


def gzip_record(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def page_record(page_id, url, payload: bytes | None, n_bytes: int, sha: str, level: int, date: str, first_id=None, first_url=None) -> bytes:
    """A response with its payload, or a revisit of the first page with the same payload."""
    kind = "response" if first_id is None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, kind)), ("WARC-Date", date), ("WARC-Target-URI", clean(url, page_id)),
               ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Payload-Length", str(n_bytes)), ("X-Page-ID", "" if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response")]
    block = HTTP + b"Content-Length: %d\r\n\r\n" % n_bytes
    if first_id is None:
        block += payload
    else:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first_id, "response")),
                    ("WARC-Refers-To-Target-URI", clean(first_url, first_id)), ("X-Refers-To-Page-ID", str(first_id))]
    return gzip_record([*headers, ("WARC-Block-Digest", f"sha1:{digest(block)}")], block, level)


class Roll:
    """The files of one shard, each written under a temporary name and moved when it is whole."""

    def __init__(self, folder: str, shard: int, roll: int, level: int, date: str):
        from pyarrow import fs

        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.level, self.date, self.number, self.out = shard, roll, level, date, 0, None

    def add(self, data: bytes) -> tuple | None:
        if self.out is None:
            self.name = f"part-{self.shard:07d}-{self.number:05d}.warc.gz"
            self.hidden = f"{self.folder}/.{self.name}-{uuid.uuid4().hex}"
            self.out, self.records, self.size, self.hash = self.store.open_output_stream(self.hidden, compression=None), 0, 0, hashlib.sha256()
            info = b"format: WARC File Format 1.1\r\n"
            self._write(gzip_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(self.name, "warcinfo")), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info, self.level))
        self._write(data)
        self.records += 1
        return self.close() if self.size >= self.roll else None

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> tuple | None:
        if self.out is None:
            return None
        self.out.close()
        self.store.move(self.hidden, f"{self.folder}/{self.name}")
        self.out, self.number = None, self.number + 1
        return self.name, self.shard, self.records, self.size, self.hash.hexdigest()


def _members(level: int, date: str):
    """Each page as a response record. Records are compressed before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(MEMBER)
        for batch in batches:
            members_ = [page_record(page, url, payload, n, digest(payload), level, date) for page, url, payload, n, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield record(schema, batch.column("page_id"), batch.column("url"), members_, batch.column("n"), batch.column("sha"))
    return run


MEMBER = "page_id long, url string, member binary, n long, sha string"


def _write(folder: str, roll: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, files, now, known = schema_of(MANIFEST), [], None, None
        for batch in batches:
            for shard, page, url, member, n, sha, first, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if member is None:  # the response that the next pages of this id and digest refer to
                    known = (page, sha, first, first_url)
                    continue
                again = known is not None and known[:2] == (page, sha)
                if now is None or now.shard != shard:
                    files.append(now.close() if now else None)
                    now = Roll(folder, shard, roll, level, date)
                files.append(now.add(page_record(page, url, None, n, hex_to_base32(sha), level, date, *known[2:]) if again else member))
        files.append(now.close() if now else None)
        rows = [f for f in files if f]
        yield record(schema, *([r[i] for r in rows] for i in range(5)))
    return run


def hex_to_base32(sha: str) -> str:
    return base64.b32encode(bytes.fromhex(sha)).decode("ascii")


def bounds(pages: DataFrame, count: int, shards: int) -> np.ndarray:
    """Ids at which shards begin, from about BOUND_SAMPLE ids chosen by their hash."""
    if shards < 2:
        return np.zeros(0, dtype=np.int64)
    chance = min(1.0, BOUND_SAMPLE / count)
    rows = pages.select("page_id").where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int(chance * (1 << 30)))).toPandas()
    ids = np.sort(rows["page_id"].to_numpy(dtype=np.int64))
    return np.unique(ids[(np.arange(1, shards) * len(ids)) // shards]) if len(ids) else ids


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """Write pages (page_id, url, html) as `folder`/archives and return the manifest, one row per file.

    A null html is an empty payload; a null url becomes urn:page:ID. Of equal payloads of at least min_bytes the smallest
    page_id is the response, and so is each row that repeats this id; rows without page_id are responses. Revisits are written without payload. An empty table gives an empty folder and manifest.
    """
    spark = pages.sparkSession
    small_batches(spark)
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    thin = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.length(payload).cast("long").alias("n"), F.sha1(payload).alias("sha"))
    sums = thin.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    shards = max(1, math.ceil((sums["n"] or 0) / shard_bytes))
    first = thin.where(F.col("n") >= min_bytes).groupBy(F.col("sha").alias("_sha")).agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"))
    again = F.col("page_id").isNotNull() & F.col("first").isNotNull() & (F.col("page_id") != F.col("first")) & (F.col("n") >= min_bytes)
    cuts = bounds(thin, sums["rows"], shards) if sums["rows"] else np.zeros(0, dtype=np.int64)
    place = F.pandas_udf(lambda ids: pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right")), "long")
    # Which pages are revisits is worked out without their payloads and meets the records in their shard, so these are shuffled once.
    shard = place(F.coalesce("page_id", F.lit(-(1 << 63)))).alias("shard")
    revisits = thin.select("page_id", "n", "sha").join(first, thin["sha"] == first["_sha"]).where(again).select("page_id", "sha", "first", "first_url").distinct()
    records = thin.mapInArrow(_members(level, date), MEMBER).select(shard, "page_id", "url", "member", "n", "sha", F.lit(None).cast("long").alias("first"), F.lit(None).cast("string").alias("first_url"))
    hints = revisits.select(shard, "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("member"), F.lit(0).cast("long").alias("n"), "sha", "first", "first_url")
    both = records.unionByName(hints)
    staging = _made(spark, f"{folder.rstrip('/')}/_staging-{uuid.uuid4().hex}")
    tasks = min(len(cuts) + 1, TASKS)
    ordered = both.repartitionById(tasks, F.floor(F.col("shard") * tasks / (len(cuts) + 1)).cast("int")).sortWithinPartitions("shard", "page_id", "sha", F.col("member").isNotNull(), "url")
    files = ordered.mapInArrow(_write(staging, roll_bytes, level, date), MANIFEST)
    files.write.parquet(f"{staging}/_manifest")
    _rename(spark, staging, f"{folder.rstrip('/')}/archives")
    return spark.read.parquet(f"{folder.rstrip('/')}/archives/_manifest")


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _made(spark: SparkSession, path: str) -> str:
    """A new folder, by its full URI."""
    store, where = _store(spark, path)
    store.mkdirs(where)
    return re.sub(r"^file:/(?!/)", "file:///", store.makeQualified(where).toString())


def _rename(spark: SparkSession, old: str, new: str) -> None:
    store, where = _store(spark, old)
    if not store.rename(where, _store(spark, new)[1]):
        raise OSError(f"{new} exists or can't be written")


def members(data: bytes, step: int = 1 << 15) -> Iterator[bytes]:
    """The gzip members of an archive, one at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            piece = view[at : at + step]
            if not len(piece):
                raise ValueError("an archive ends within a record")
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(headers["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return headers, rest[:size]


PAGES = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, file string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = schema_of(PAGES)
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows, held = [], 0
            for raw in members(data):
                headers, block = parse(raw)
                if headers["WARC-Type"] == "warcinfo":
                    continue
                if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
                    raise ValueError(f"a record's block differs from its digest in {path}")
                payload, sha, size = None, headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                if headers["WARC-Type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if digest(payload) != sha or len(payload) != size:
                        raise ValueError(f"a payload differs from its digest in {path}")
                page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                rows.append((int(page) if page else None, headers["WARC-Target-URI"], headers["WARC-Type"], payload, size, sha, int(refers) if refers else None, path.rsplit("/", 1)[-1]))
                held += size
                if len(rows) >= 500 or held > 16 << 20:
                    yield record(schema, *([r[i] for r in rows] for i in range(8)))
                    rows, held = [], 0
            if rows:
                yield record(schema, *([r[i] for r in rows] for i in range(8)))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page record of the archives under `folder`; every digest is checked. Spark leaves out hidden files; a task holds archives of spark.sql.files.maxPartitionBytes at most.

    The files are held against the manifest first: a missing, foreign or cut file is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{folder.rstrip('/')}/archives")
    there = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("there"))
    wanted = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/archives/_manifest").select("file", "bytes")
    wrong = wanted.join(there, "file", "full").where(~F.col("bytes").eqNullSafe(F.col("there"))).select("file").limit(5).collect()
    if wrong:
        raise ValueError(f"archives differ from their manifest: {', '.join(sorted(r['file'] for r in wrong))}")
    return files.select("path", "content").mapInArrow(_read, PAGES)
