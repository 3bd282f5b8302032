"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if its least inner s-mer (by hash) is its first or its last one. That depends on the
k-mer alone, so an edit moves no anchor but those it touches. The n-th time a syncmer stands in a document is an anchor of its
own, so repetitive texts have anchors all along. The fingerprint keeps the `size` anchors with the least hashes and their places:
8 hex digits of hash, 8 of place. Short texts take shorter k-mers (LEVELS), so that they have several anchors. A text of up to
REACH times a limit has the anchors of the levels below it too, `size` of each, their places marked by level (MARKS). So
two texts on the two sides of a limit meet, unless one is over REACH times as long as the other; the likeness of such a pair,
which is 0, could be 2 / (REACH + 1) at most.

A k-mer's anchor does not depend on what stands around it, so the edited text needs no hashing of its own: its anchors are those of the text
that end before the cut, those of the next text that end within what is taken of it, and those of the few windows over the seam.

Two fingerprints are compared at the longest k-mers that both have, by position: of the least `size` hashes of either, those in both whose places are shifted
by as much as the middle one of them (within a tolerance) match. With the matching share j, the likeness 2 j / (1 + j)
is the share of either text's anchors that the other has, about the share of text that is kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.common import give_back, record, schema_of, small_batches, starts_of, volumes

SIZE = 128
#: (code points from which on it is used, k, s)
LEVELS = ((64, 16, 5), (16, 4, 2), (0, 2, 1))
#: What is added to the places of a level; places of long texts stay under 2^31, marked ones are those of texts under REACH times a limit.
MARKS = (0, 0xE0000000, 0xF0000000)
REACH = 32
#: Places may differ from the common shift by this share of the longer span, or this many code points.
SLACK, LEAST_SLACK = 0.05, 32
ALIKE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Bytes of text that one task walks through in order, about.
PART_BYTES = 32 << 20
#: Tasks at most; a task walks through several parts where there are more.
TASKS = 20_000
#: Code points that are hashed at a time, and those of the texts that are worked on together.
VOLUME = 1 << 15
TOGETHER = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def windows(points: np.ndarray, width: int, mixed: np.ndarray | None = None) -> np.ndarray:
    """A hash of every `width` code points in a row."""
    single = mix(points + np.uint64(1)) if mixed is None else mixed
    out = np.zeros(max(0, len(points) - width + 1), dtype=np.uint64)
    for i in range(width):
        out *= np.uint64(0x100000001B3)
        out += single[i : i + len(out)]
    return mix(out)


def levels_of(n: int) -> list[int]:
    """The levels that a text of n code points has anchors of: its own one, and those below a limit that n is less than REACH times of."""
    own = next(i for i, (least, _, _) in enumerate(LEVELS) if n >= least)
    return [own, *(i + 1 for i in range(own, len(LEVELS) - 1) if n < REACH * LEVELS[i][0])]


def closed(points: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, 64-bit hashes) of the closed syncmers of code points."""
    places, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for begin in range(0, len(points) - k + 1, VOLUME):
        part = points[begin : begin + VOLUME + k - 1]
        single = mix(part + np.uint64(1))
        inner, count = windows(part, s, single), k - s + 1
        least, span = inner, 1
        while span < count:  # the least of ever wider spans
            step = min(span, count - span)
            least = np.minimum(least[: len(least) - step], least[step:])
            span += step
        at = np.flatnonzero((least == inner[: len(least)]) | (least == inner[count - 1 :]))
        whole = np.zeros(len(at), dtype=np.uint64)
        for i in range(k):
            whole *= np.uint64(0x100000001B3)
            whole += single[at + i]
        places.append(at + begin)
        hashes.append(mix(whole))
    return np.concatenate(places), np.concatenate(hashes)


def syncmers(points: np.ndarray, level: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, 64-bit hashes) of the anchors of one text; a text under k code points is one anchor as a whole."""
    return anchors([points], [levels_of(len(points))[0] if level is None else level])[0]


def anchors(texts: list[np.ndarray], levels: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, 64-bit hashes) of each text's anchors of its level; texts of one level are worked on as one array."""
    out: list = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))] * len(texts)
    for level, (_, k, s) in enumerate(LEVELS):
        own = [i for i, x in enumerate(levels) if x == level and len(texts[i]) >= k]
        for i in (i for i, x in enumerate(levels) if x == level and 0 < len(texts[i]) < k):
            out[i] = np.zeros(1, dtype=np.int64), windows(texts[i], len(texts[i]))
        if not own:
            continue
        ends = np.cumsum([len(texts[i]) for i in own])
        at, value = closed(np.concatenate([texts[i] for i in own]), k, s)
        of = np.searchsorted(ends, at, side="right")
        inside = at + k <= ends[of]
        at, value, of = at[inside], value[inside], of[inside]
        cuts = np.searchsorted(of, np.arange(len(own) + 1))
        for j, (i, end) in enumerate(zip(own, ends.tolist(), strict=True)):
            out[i] = at[cuts[j] : cuts[j + 1]] - (end - len(texts[i])), value[cuts[j] : cuts[j + 1]]
    return out


def least(found: list[tuple[np.ndarray, np.ndarray]], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(32-bit hashes, places) of the least anchors of each text, in order; of two anchors with one hash the first place."""
    count = np.array([len(x[0]) for x in found], dtype=np.int64)
    of = np.repeat(np.arange(len(found)), count)
    at, value = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, dtype=kind) for i, kind in ((0, np.int64), (1, np.uint64)))
    same = value + of.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(same, kind="stable")
    first = starts_of(same[order])
    nth = np.empty(len(at), dtype=np.uint64)
    nth[order] = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    value = (mix(value + nth * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.int64)
    bar = np.where(count > 4 * size, (1 << 32) * 3 * size // np.maximum(count, 1), 1 << 32)  # the least are below, but for rare texts
    fine = value < bar[of]
    fine |= (np.bincount(of[fine], minlength=len(found)) < 2 * size)[of]
    at, value, of = at[fine], value[fine], of[fine]
    key = of << 32 | value
    order = np.argsort(key, kind="stable")
    order = order[starts_of(key[order])]
    at, value, of = at[order], value[order], of[order]
    cuts = np.searchsorted(of, np.arange(len(found) + 1)).tolist()
    return [(value[s : min(s + size, e)], at[s : min(s + size, e)]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def marked(parts: list[tuple[int, tuple[np.ndarray, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hashes, marked places) of a text's least anchors of each level."""
    return np.concatenate([value for _, (value, _) in parts]), np.concatenate([at + MARKS[level] for level, (_, at) in parts])


def sketch(points: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    return sketches([points], size)[0]


def sketches(texts: list[np.ndarray], size: int = SIZE) -> list[tuple[np.ndarray, np.ndarray]]:
    """The marked least anchors of each text."""
    wanted = [(i, level) for i, text in enumerate(texts) for level in levels_of(len(text))]
    found = least(anchors([texts[i] for i, _ in wanted], [level for _, level in wanted]), size)
    out: list[list] = [[] for _ in texts]
    for (i, level), own in zip(wanted, found, strict=True):
        out[i].append((level, own))
    return [marked(x) for x in out]


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def written(marks: tuple[np.ndarray, np.ndarray]) -> str:
    return np.column_stack(marks).astype(">u4").tobytes().hex()


def read(text: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(bytes.fromhex(text), dtype=">u4").astype(np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int = SIZE) -> float:
    """0 to 1; two empty fingerprints are alike, an empty one is like no other."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    levels = [np.searchsorted(MARKS, x[1], side="right") - 1 for x in (a, b)]
    shared = np.intersect1d(*levels)
    if not len(shared):
        return 0.0
    a, b = ((x[0][of == shared[0]], x[1][of == shared[0]]) for x, of in zip((a, b), levels, strict=True))
    least = np.union1d(a[0], b[0])[:size]
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    i, j = i[both <= least[-1]], j[both <= least[-1]]
    if not len(i):
        return 0.0
    shift = b[1][j] - a[1][i]
    slack = max(LEAST_SLACK, SLACK * max(np.ptp(a[1]), np.ptp(b[1])))
    share = float((np.abs(shift - np.median(shift)) <= slack).sum()) / len(least)
    return 2 * share / (1 + share)


def edited_text(text: str, other: str) -> str:
    """The last third replaced by the first as many code points of another text, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


class Text:
    """Code points of a text and its anchors by level."""

    def __init__(self, text: str):
        self.text, self.points, self.anchors = text, points_of(text), {}

    def __len__(self) -> int:
        return len(self.points)


def fill(texts: list[Text], levels: list[set[int]]) -> None:
    """Work out the anchors of the levels that a text still lacks."""
    lacking = [(t, level) for t, own in zip(texts, levels, strict=True) for level in sorted(own) if level not in t.anchors]
    for (t, level), found in zip(lacking, anchors([t.points for t, _ in lacking], [level for _, level in lacking]), strict=True):
        t.anchors[level] = found


def pair_sketches(texts: list[Text], size: int) -> tuple[list, list]:
    """The marks of each text, and those of each but the last one edited with the text after it."""
    cuts = [(len(t) - len(t) // 3, min(len(t) // 3, len(other))) for t, other in zip(texts, texts[1:], strict=False)]
    wanted = [set(levels_of(len(t))) for t in texts]
    long = [cut + taken >= LEVELS[0][0] for cut, taken in cuts]
    for i, (cut, taken) in enumerate(cuts):
        if long[i]:
            for x in (wanted[i], wanted[i + 1]):
                x.update(levels_of(cut + taken))
    fill(texts, wanted)
    parts = [(i, level, texts[i].anchors[level]) for i in range(len(texts)) for level in levels_of(len(texts[i]))]
    seams = [(i, level, cut, taken) for i, (cut, taken) in enumerate(cuts) if long[i] for level in levels_of(cut + taken)]
    over = anchors([np.concatenate([texts[i].points[cut - LEVELS[level][1] + 1 : cut], texts[i + 1].points[: min(taken, LEVELS[level][1] - 1)]]) for i, level, cut, taken in seams],
                   [level for _, level, _, _ in seams])
    for (i, level, cut, taken), (at, value) in zip(seams, over, strict=True):
        k = LEVELS[level][1]
        (at0, value0), (at1, value1) = texts[i].anchors[level], texts[i + 1].anchors[level]
        n0, n1 = np.searchsorted(at0, cut - k, side="right"), np.searchsorted(at1, taken - k, side="right")
        whole = np.ones(len(at), dtype=bool) if taken else np.zeros(len(at), dtype=bool)
        joined = np.concatenate([at0[:n0], at[whole] + cut - k + 1, at1[:n1] + cut]), np.concatenate([value0[:n0], value[whole], value1[:n1]])
        parts.append((len(texts) + i, level, joined))
    found = least([x for _, _, x in parts], size)
    out: list[list] = [[] for _ in range(2 * len(texts))]
    for (i, level, _), own in zip(parts, found, strict=True):
        out[i].append((level, own))
    short = [i for i in range(len(cuts)) if not long[i]]
    direct = dict(zip(short, sketches([np.concatenate([texts[i].points[: cuts[i][0]], texts[i + 1].points[: cuts[i][1]]]) for i in short], size), strict=True))
    edited = [direct[i] if i in direct else marked(out[len(texts) + i]) for i in range(len(cuts))]
    return [marked(x) for x in out[: len(texts)]], edited


def _walk(size: int):
    """Rows (part, doc_id, text, tail) sorted by part, doc_id descending: each with the row after it in its part. A tail row only ends its part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(ALIKE)
        held: list[tuple] = []  # rows of one part in order
        points = 0

        def rows() -> pa.RecordBatch:
            own, edited = pair_sketches([r[2] for r in held], size)
            out = []
            for i, mark in enumerate(edited):
                text = edited_text(held[i][2].text, held[i + 1][2].text)
                out.append((held[i][1], len(held[i][2]), hashlib.sha256(text.encode("utf-8")).hexdigest(), written(own[i]), written(mark), likeness(own[i], mark, size), likeness(own[i], own[i + 1], size)))
            return record(schema, *([r[i] for r in out] for i in range(7)))

        for batch in batches:
            for part, doc, text, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != part:
                    if len(held) > 1:
                        yield rows()
                    held, points = [], 0
                held.append((part, doc, Text(text)))
                points += len(text) + 16
                if tail or points >= TOGETHER and len(held) > 1:
                    yield rows()
                    held, points = [] if tail else held[-1:], 0
        if len(held) > 1:
            yield rows()
    return run


def fingerprints(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, fingerprint) of every whole text; null and empty texts have the empty fingerprint."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [points_of(t or "") for t in batch.column(1).to_pylist()]
            for s, e in volumes(texts, TOGETHER):
                yield record(schema_of("doc_id long, fingerprint string"), batch.column(0).slice(s, e - s), [written(x) for x in sketches(texts[s:e], size)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited_likeness(docs: DataFrame, size: int = SIZE, part_bytes: int = PART_BYTES, sample: int = 20_000) -> DataFrame:
    """Each document against its edited text and against the next document, in descending doc_id, after the last the first.

    Documents are cut into parts by ranges of doc_id, so a text is shuffled once; the first document of a part also ends the
    part before. Rows that repeat a doc_id follow each other by their text; rows without doc_id come last. A null text is
    empty. A single row is its own next; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    thin = docs.select(doc.alias("doc_id"), text.alias("text"))
    sums = thin.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("n"), F.max("doc_id").alias("top")).first()
    if not sums["rows"]:
        return spark.createDataFrame([], ALIKE)
    parts = max(1, math.ceil(sums["n"] / part_bytes))
    chance = min(1.0, max(sample, 5 * parts) / sums["rows"])
    ids = docs.select(doc.alias("doc_id")).where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(chance * (1 << 30)))).toPandas()["doc_id"].to_numpy(dtype=np.int64)
    ids = np.sort(ids)
    cuts = np.unique(ids[(np.arange(1, parts) * len(ids)) // parts]) if len(ids) else ids
    place = F.pandas_udf(lambda x: pd.Series(np.searchsorted(cuts, x.to_numpy(), side="right")), "long")
    placed = thin.withColumn("part", place(F.coalesce("doc_id", F.lit(-(1 << 63)))))
    # One row per part: the largest id, which is the first in descending order, and the part that the next one to come ends.
    tops = sorted(((r["part"], r["top"]) for r in placed.groupBy("part").agg(F.max("doc_id").alias("top")).collect()), reverse=True)
    ends = spark.createDataFrame([(p, top, tops[i - 1][0]) for i, (p, top) in enumerate(tops)], "part long, top long, ends long")
    one = placed.join(F.broadcast(ends), "part").where(F.col("doc_id").eqNullSafe(F.col("top")))
    # Rows that share the top id are repeated rows of one id; the one that sorts first is taken.
    head = one.groupBy("ends").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"), F.max("doc_id").alias("doc_id"))
    tails = head.select(F.col("ends").alias("part"), "doc_id", "text", F.lit(True).alias("tail"))
    rows = placed.select("part", "doc_id", "text", F.lit(False).alias("tail")).unionByName(tails)
    sort = ["part", "tail", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text"]
    tasks = min(parts, TASKS)
    return rows.repartitionById(tasks, F.floor(F.col("part") * tasks / parts).cast("int")).sortWithinPartitions(*sort).mapInArrow(give_back(_walk(size)), ALIKE)
