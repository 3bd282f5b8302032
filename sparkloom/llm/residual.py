"""Best-fit packing by hierarchical residuals.

Documents become pieces of at most a sequence each. Pieces are dealt evenly over parts; each part packs its own by best fit, longest
first. Bins that are nearly full are done. The other ones are items of the next round, as one item each: parts meet in a tree, FANIN at a
time, and pack the items they are left with by best fit again, until one part is left.

What a part hands on is bounded without losing anything. After best fit no two of its bins fit together, so at most one is filled to
half or less; only such small items can ever be placed again, at most FANIN of them in a round. A part therefore needs to hand on, of
the bins of one fill, only as many as the rounds above can use, FANIN a round: the others are done as they are.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.common import as_bytes, give_back, record, schema_of, small_batches, stored, volumes, whole_runs
from sparkloom.llm.packing import Words

CAPACITY = 4096
END = 1
#: A bin is nearly full, and done, where no more than this share of it is empty.
SLACK = 1 / 256
#: Pieces of a part, and parts that meet in a round.
PART = 50_000
FANIN = 8
#: Tasks that parts are dealt to at most; where there are more parts, a task has several, one after another.
TASKS = 10_000
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "bin long, used long, part long, done boolean, members array<long>, shifts array<long>"


def _pieces(path: str, capacity: int, end: int):
    schema = schema_of(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = Words(path), np.array([end], dtype="<u4")
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for s, e in volumes(texts, 2 << 20):
                rows = []
                for doc, ids in zip(docs[s:e], words.encode(texts[s:e]), strict=True):
                    ids = np.concatenate([ids.astype("<u4", copy=False), last])
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((uid, doc, piece, start, len(part), zlib.crc32(part.tobytes())))
                        uid += 1
                yield record(schema, *(list(c) for c in zip(*rows, strict=True)))

    return run


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin: the longest first, each into the fullest bin that has room.

    Bins are kept by the room they have; bit r of a number tells whether there is one with room r, so the fullest fit is its lowest bit.
    """
    place, offset, fill = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64), []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        place[i], offset[i] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            if not by_room[room]:
                rooms |= 1 << room
            by_room[room].append(b)
    return place, offset, np.array(fill, dtype=np.int64)


def _first_round(capacity: int):
    """Pieces of one part, with their bin and their offset in it."""
    schema = schema_of(PIECES + ", bin long, offset long, part long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["part"]):
            part = np.asarray(table.column("part"))
            for p in np.unique(part).tolist():
                own = table.filter(pa.array(part == p))
                place, offset, _ = best_fit(np.asarray(own.column("length")), capacity)
                out = [own.column(f.name).combine_chunks() for f in schema_of(PIECES)]
                yield from pa.Table.from_arrays([*out, pa.array((p << 32) + place), pa.array(offset), own.column("part").combine_chunks()], schema=schema).to_batches(20_000)

    return run


def _round(capacity: int, slack: int, use: int):
    """Items of one part packed again: one row per new bin, done or handed on. `use`: the bins of one fill that the rounds above can use."""
    schema = schema_of(BINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["part"]):
            part = np.asarray(table.column("part"))
            for p in np.unique(part).tolist():
                own = table.filter(pa.array(part == p))
                used = np.asarray(own.column("used"))
                place, offset, fill = best_fit(used, capacity)
                ids, members, shifts = (own.column(c).to_pylist() for c in ("bin", "members", "shifts"))
                held, moved, name = [[] for _ in fill], [[] for _ in fill], [None] * len(fill)
                for i, (b, o) in enumerate(zip(place.tolist(), offset.tolist(), strict=True)):
                    name[b] = ids[i] if name[b] is None else min(name[b], ids[i])
                    held[b] += members[i]
                    moved[b] += [s + o for s in shifts[i]]
                rank: dict[int, int] = defaultdict(int)
                done = []
                for f in fill.tolist():
                    rank[f] += 1
                    done.append(capacity - f <= slack or rank[f] > use)
                yield record(schema, name, fill, [p] * len(fill), done, held, moved)

    return run


def _by_part(df: DataFrame, parts: int, *order: str) -> DataFrame:
    tasks = min(parts, TASKS)
    return df.repartitionById(tasks, F.floor(F.col("part") * tasks / parts).cast("int")).sortWithinPartitions("part", *order)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, part: int = PART, fanin: int = FANIN, slack: float = SLACK) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer is the path of a tokenizers file that drops white space, the same on every node. A document is its ids and the id `end`; a null or
    empty text is `end` alone. Only documents of more than `capacity` ids are cut, every capacity ids. Repeated rows are packed each for itself,
    rows without doc_id too. An empty table gives no rows. Ties go to the earlier piece in the order of the stored pieces.
    """
    small_batches(docs.sparkSession)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(thin.mapInArrow(give_back(_pieces(tokenizer, capacity, end)), PIECES), "residual-pieces")
    return packed(pieces, capacity, part, fanin, slack).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packed(pieces: DataFrame, capacity: int = CAPACITY, part: int = PART, fanin: int = FANIN, slack: float = SLACK) -> DataFrame:
    """Stored pieces (uid, doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    parts = max(1, -(-pieces.where(F.col("length") < capacity).count() // part))
    room = int(slack * capacity)
    whole = pieces.where(F.col("length") >= capacity).select("*", (-F.col("uid") - 1).alias("bin"), F.lit(0).cast("long").alias("offset"))
    dealt = pieces.where(F.col("length") < capacity).withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)))
    placed = stored(_by_part(dealt, parts, "uid").mapInArrow(_first_round(capacity), PIECES + ", bin long, offset long, part long"), "residual-placed")
    left, rounds = parts, 0
    while left > 1:
        left, rounds = -(-left // fanin), rounds + 1
    own = F.array(F.col("bin"))
    items = placed.groupBy("bin").agg(F.sum("length").alias("used"), F.min("part").alias("part")).where(capacity - F.col("used") > room)
    items = items.select("bin", "used", "part", own.alias("members"), F.array(F.lit(0).cast("long")).alias("shifts"))
    moved = None
    left = parts
    for r in range(rounds):
        left = -(-left // fanin)
        items = items.withColumn("part", F.floor(F.col("part") / fanin).cast("long"))
        bins = stored(_by_part(items, left, "bin").mapInArrow(_round(capacity, room, fanin * (rounds - r - 1)), BINS), "residual-round")
        ended = bins.where("done").select("bin", "members", "shifts")
        moved = ended if moved is None else moved.unionByName(ended)
        items = bins.where("not done").drop("done")
    out = placed.drop("part")
    if moved is not None:
        places = moved.where(F.size("members") > 1).select(F.col("bin").alias("into"), F.explode(F.arrays_zip("members", "shifts")).alias("m"))
        places = places.select("into", F.col("m.members").alias("bin"), F.col("m.shifts").alias("shift"))
        out = out.join(places, "bin", "left").withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0))).withColumn("bin", F.coalesce("into", "bin")).drop("into", "shift")
    return whole.unionByName(out).withColumnRenamed("bin", "sequence_id")
