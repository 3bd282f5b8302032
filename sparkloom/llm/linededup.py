"""Line deduplication over levelled sorted runs of line hashes.

`SortedRuns` keeps runs of (key, n_docs, last_doc), bucketed and sorted by key, in the shared folder; a key is in one run. A batch of
documents is counted by key and merge-anti-joined with the runs: keys in none of them become a new run of level 0, the counts of known ones
are kept beside as updates, so no old key is written again. The runs lie in the buckets that the batch is dealt to, so only the batch is shuffled.
`fanout` runs of a level are compacted into one of the next, updates likewise; a key is rewritten a logarithmic number of times.
A line's key is the line stripped of ASCII white space with A-Z lower-cased; its hash is the MD5 of the UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm.common import as_bytes, give_back, record, schema_of, small_batches, stored
from sparkloom.session import new_scratch_path

MIN_CHARS = 20
MIN_DOCS = 3
#: Keys of a batch, and batches at most: batches grow in number and then in size with the input.
BATCH_KEYS, BATCHES = 1_000_000, 64
FANOUT = 4
RUN = "key binary, n_docs long, last_doc long"


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The hash of each line's key, None for keys under min_chars code points. Bytes methods know ASCII only, as asked."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip()
        # Continuation bytes are 10xxxxxx: the others count code points; a key short in bytes is short in them too.
        if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8")) < min_chars):
            out.append(None)
        else:
            out.append(hashlib.md5(key.lower(), usedforsecurity=False).digest())
    return out


class SortedRuns:
    """Levelled sorted runs of line keys in a folder of the shared scratch space; use as a context, which forgets the tables at its end."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.fanout, self.path, self.tables = spark, fanout, new_scratch_path(spark, "line-runs"), []
        self.levels: list[list[str]] = []
        self.updates: list[list[str]] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def __enter__(self) -> SortedRuns:
        return self

    def __exit__(self, *_) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _write(self, rows: DataFrame) -> str:
        """A run: one sorted file per bucket of the key."""
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.select("key", "n_docs", "last_doc").repartition(self.buckets, "key")
        dealt.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.path}/{name}").saveAsTable(name)
        self.tables.append(name)
        return name

    def _rows(self, names: list[str]) -> DataFrame:
        """The rows of runs as plain files: a union of bucketed scans is not grouped rightly by this version of Spark."""
        return self.spark.read.schema(RUN).parquet(*(f"{self.path}/{n}" for n in names)) if names else self.spark.createDataFrame([], RUN)

    def _summed(self, names: list[str]) -> DataFrame:
        return self._rows(names).groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def _push(self, levels: list[list[str]], run: str, merge) -> None:
        if not levels:
            levels.append([])
        levels[0].append(run)
        for level in range(len(levels)):
            if len(levels[level]) < self.fanout:
                break
            if level + 1 == len(levels):
                levels.append([])
            levels[level + 1].append(self._write(merge(levels[level])))
            levels[level] = []

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def totals(self) -> DataFrame:
        """(key, n_docs, last_doc) over all batches so far."""
        return self._summed(self.runs() + [run for level in self.updates for run in level])

    def unseen(self, batch: DataFrame, runs: list[str] | None = None) -> DataFrame:
        """Rows of a batch whose key is in no run: a merge-anti-join with each."""
        return reduce(lambda left, run: left.join(self.spark.table(run).select("key").hint("merge"), "key", "left_anti"), self.runs() if runs is None else runs, batch)

    def add(self, batch: DataFrame) -> None:
        """Add a batch of distinct (key, doc_id): new keys as a run of their own, counts of known ones as updates."""
        own = self._write(batch.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")))
        if self.runs():
            counted = self.spark.table(own)
            new = self._write(self.unseen(counted))
            self._push(self.updates, self._write(self.unseen(counted, [new])), self._summed)
        else:
            new = own
        self._push(self.levels, new, self._rows)  # a key is in one run, so compacting needs no grouping


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("doc_id long, key binary")
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                found = {k for k in line_keys(text, min_chars) if k is not None}
                ids += [doc] * len(found)
                keys += found
            yield record(schema, ids, keys)
    return run


def _kept(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("text string, n_lines long, n_dropped long, kept string, row long")
        for batch in batches:
            out: list[list] = [[], [], [], []]
            raw = batch.column("text")
            for text, null, drop in zip(as_bytes(raw), raw.is_null().to_pylist(), batch.column("drop").to_pylist(), strict=True):
                lines = text.split(b"\n")
                gone = set(drop or ())
                kept = [line for line, key in zip(lines, line_keys(text, min_chars), strict=True) if key not in gone] if gone else lines
                out[0].append(None if null else text.decode("utf-8"))
                out[1].append(len(lines))
                out[2].append(len(lines) - len(kept))
                out[3].append(b"\n".join(kept).decode("utf-8"))
            yield record(schema, *out, batch.column("row"))
    return run


def repeated_keys(keys: DataFrame, batches: int | None = None, fanout: int = FANOUT, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, last_doc), stored, of keys in at least min_docs documents, by adding batch after batch to the runs.

    keys has (key, doc_id), each pair once, and is stored; there is a batch per BATCH_KEYS of them, BATCHES at most, where batches is not given. Batches are
    cut by a hash of the document, so that none depends on the order of the input; a hot line is one row per task and batch before it is shuffled.
    """
    if batches is None:
        batches = max(1, min(BATCHES, -(-keys.count() // BATCH_KEYS)))
    with SortedRuns(keys.sparkSession, fanout) as runs:
        for i in range(batches):
            runs.add(keys.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i))
        return stored(runs.totals().where(F.col("n_docs") >= min_docs).select("key", "last_doc"), "line-repeated")


def _drops(docs: DataFrame, min_chars: int, min_docs: int, batches: int | None, fanout: int) -> DataFrame:
    """(doc_id, drop): keys that each document loses."""
    small_batches(docs.sparkSession)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    keys = stored(thin.mapInArrow(give_back(_keys(min_chars)), "doc_id long, key binary"), "line-keys")
    once = keys.distinct() if docs.groupBy("doc_id").count().where("count > 1").limit(1).count() else keys
    found = repeated_keys(once, batches, fanout, min_docs)
    return once.join(found, "key").where("doc_id <> last_doc").groupBy("doc_id").agg(F.collect_list("key").alias("drop"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, kept) per row: lines with a key of at least min_chars code points found in at least
    min_docs documents stay in the largest doc_id that holds them and go elsewhere.

    A null or empty text is one empty line and kept is empty. Rows that share a doc_id are one document: its keys count once and
    all rows lose the same keys. Rows without doc_id count for nothing and lose nothing. An empty table gives no rows.
    """
    drops = _drops(docs, min_chars, min_docs, batches, fanout)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = thin.join(drops, "doc_id", "left").select("text", "drop", F.col("doc_id").alias("row"))
    out = joined.mapInArrow(give_back(_kept(min_chars)), "text string, n_lines long, n_dropped long, kept string, row long")
    return out.select(F.col("row").alias("doc_id"), "text", "n_lines", "n_dropped", "kept")


def clean_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """docs with the repeated lines taken out of text and n_chars, where there is one, counted anew; a null text stays null."""
    drops = _drops(docs, min_chars, min_docs, batches, fanout)
    joined = docs.join(drops.withColumnRenamed("drop", "__llm_drop"), "doc_id", "left")
    cut = F.udf(lambda text, drop: text if text is None or not drop else _cut(text, drop, min_chars), "string", useArrow=True)
    kept = joined.withColumn("text", F.when(F.col("__llm_drop").isNull(), F.col("text")).otherwise(cut("text", "__llm_drop")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def _cut(text: str, drop: list, min_chars: int) -> str:
    gone = {bytes(k) for k in drop}
    raw = text.encode("utf-8")
    return b"\n".join(line for line, key in zip(raw.split(b"\n"), line_keys(raw, min_chars), strict=True) if key not in gone).decode("utf-8")
