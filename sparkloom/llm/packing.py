"""Harmonic packing of tokenised documents.

A piece of length l in (C / (j + 1), C / j] belongs to class j; a bin of class j takes exactly j pieces. A bin wastes most
when its pieces are far below C / j, so a document's rest is cut until it fits its class well: a piece of exactly C / (j + 1),
then the same for what is left. Pieces of C / `classes` or less go to one class whose bins are filled by cutting.
Each worker fills its own bins, none waits for another; at its end what lies in open bins is cut together, so a task leaves at
most one sequence that is not nearly full.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.common import as_bytes, give_back, record, schema_of, small_batches, volumes

CAPACITY = 4096
END = 2
#: A rest stays whole where it fills this share of its class's slot.
FILL = 0.96
CLASSES = 32
#: Different words, and parts of words, whose ids a task remembers; the memory is given back at its end.
REMEMBER = 400_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: A word that ends in a letter and marks: tokenizers of words split there, so each part has ids of its own. An apostrophe may belong to the letters.
ENDING = re.compile(rb"([a-z\x80-\xff]*[a-z])([!-&(-/:-@\[-`{-~]+)")

#: A word of letters a to z and the lower-case ones of Latin-1, each a letter to every tokenizer.
SIMPLE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


class Ids:
    """Arrays of ids by number, in one growing array."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.begin, self.size = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def add(self, names: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        first, n = len(self.number), len(names)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + n > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + n] = sizes
        self.number.update(zip(names, range(first, first + n), strict=True))
        self.used += len(flat)

    def numbers(self, names: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, names), dtype=np.int64, count=len(names))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered names one after another, and how many each has."""
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.begin[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], sizes


@lru_cache(maxsize=2)
def tokenizer_of(path: str):
    """A tokenizer, and which of its ids end a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    last = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
    last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
    return tokenizer, last


class Words:
    """Token ids of white-space separated words, remembered: a tokenizer that drops white space gives a text the ids of its words."""

    def __init__(self, path: str):
        self.tokenizer, self.last = tokenizer_of(path)
        self.words, self.parts = Ids(), Ids()

    def add_each(self, names: list[bytes]) -> None:
        for i in range(0, len(names), 20_000):
            part = names[i : i + 20_000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in part], add_special_tokens=False)]
            self.parts.add(part, np.array(list(chain.from_iterable(ids)), dtype=np.uint32), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))

    def add_together(self, names: list[bytes], group: int = 200) -> None:
        """Simple words in groups, which takes half the time: a vocabulary that marks ends of words tells them apart again."""
        groups = [names[i : i + group] for i in range(0, len(names), group)]
        coded = self.tokenizer.encode_batch_fast([b" ".join(g).decode("utf-8") for g in groups], add_special_tokens=False)
        ids = np.array(list(chain.from_iterable(e.ids for e in coded)), dtype=np.uint32)
        sizes = np.diff(np.concatenate([[-1], np.flatnonzero(self.last[ids])]))
        if len(sizes) == len(names) and sizes.sum() == len(ids):
            self.parts.add(names, ids, sizes)

    def learn(self, words: list[bytes], plain: bool) -> None:
        """plain: the words are in lower case and hold no string of a special token, so endings can be taken off."""
        split = [(w,) if w.isalpha() or not plain or not (m := ENDING.fullmatch(w)) else m.groups() for w in words]
        pieces = [p for parts in split for p in parts]
        missing = [p for p in set(pieces) if p not in self.parts.number]
        if len(self.parts.number) + len(missing) > REMEMBER:
            self.parts, missing = Ids(), list(set(pieces))
        plain_words = [w for w in missing if w.isalpha() and w.islower() or SIMPLE.fullmatch(w)]
        for i in range(0, len(plain_words), 20_000):
            self.add_together(plain_words[i : i + 20_000])
        self.add_each([w for w in missing if w not in self.parts.number])
        flat, sizes = self.parts.take(self.parts.numbers(pieces))
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, split), dtype=np.int64, count=len(split)))
        self.words.add(words, flat, np.bincount(owner, weights=sizes, minlength=len(words)).astype(np.int64))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text. The tokenizer lower-cases, so words are remembered in lower case, but where a text may hold
        the string of a special token, which is matched before that."""
        special = [b"<|" in t for t in texts]
        joined = b"\n".join(t if own else t.lower() for t, own in zip(texts, special, strict=True))
        begin, end, names, kind = different_words(joined)
        missing = [w for w in names if w not in self.words.number]
        if len(self.words.number) + len(missing) > REMEMBER:
            self.words, missing = Ids(), names
        if missing:
            self.learn(missing, not any(special))
        ids, sizes = self.words.take(self.words.numbers(names)[kind])
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        stops = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(begin, starts)]
        return [ids[s:e] for s, e in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The lowest 0 to 8 bytes of a number.
LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def different_words(joined: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(begins, ends, different words, which of them each is) of the words between ASCII white space.

    Words are told apart by a hash of their bytes, and then compared with the first of their kind: up to 16 bytes as two numbers, longer ones as they are.
    """
    n = len(joined)
    flat = np.frombuffer(joined + bytes(24), dtype=np.uint8)
    inside = np.zeros(n + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[flat[:n]]
    edges = np.flatnonzero(np.diff(inside))
    begin, end = edges[::2], edges[1::2]
    size = end - begin
    eights = np.ndarray((n + 17,), dtype="<u8", buffer=flat, strides=(1,))
    low, high = eights[begin] & LOW_BYTES[np.minimum(size, 8)], eights[begin + np.minimum(size, 8)] & LOW_BYTES[np.clip(size - 8, 0, 8)]
    key = (low ^ (high + size.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(29)
    long = np.flatnonzero(size > 16).tolist()
    for i in long:
        key[i] = xxhash.xxh64_intdigest(joined[begin[i] : end[i]])
    order = np.argsort(key)
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    kind = np.empty(len(key), dtype=np.int64)
    kind[order] = np.cumsum(new) - 1
    first = order[new]
    model = first[kind]
    same = bool(((low == low[model]) & (high == high[model]) & (size == size[model])).all())
    if not (same and all(joined[begin[i] : end[i]] == joined[begin[model[i]] : end[model[i]]] for i in long)):
        words = [joined[s:e] for s, e in zip(begin.tolist(), end.tolist(), strict=True)]  # two words have one hash
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        return begin, end, list(number), np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    return begin, end, [joined[s:e] for s, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)], kind


def cuts(length: int, capacity: int = CAPACITY, fill: float = FILL, classes: int = CLASSES) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document in order; class 0 is for pieces of capacity / classes or less."""
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        j = capacity // rest
        if j >= classes:
            out.append((rest, 0))
            break
        if rest >= fill * (capacity // j):
            out.append((rest, j))
            break
        piece = min(rest, capacity // (j + 1))
        out.append((piece, min(j + 1, capacity // piece)))
        rest -= piece
    return out


class Bins:
    """The open bins of one worker. Rows come out when a bin is closed."""

    def __init__(self, worker: int, capacity: int, fill: float, classes: int):
        self.capacity, self.fill, self.classes = capacity, fill, classes
        self.next, self.open, self.rows = worker << 40, {}, []

    def add(self, doc, ids: np.ndarray) -> None:
        start = 0
        for length, j in cuts(len(ids), self.capacity, self.fill, self.classes):
            piece = (doc, start, ids[start : start + length], len(ids))
            start += length
            if not j:
                self.pour(piece)
                continue
            held = self.open.setdefault(j, [])
            held.append(piece)
            if len(held) == j:
                self.close(j)

    def pour(self, piece) -> None:
        """Into the bin of class 0, cut where it is full."""
        doc, start, ids, total = piece
        while len(ids):
            held = self.open.setdefault(0, [])
            room = self.capacity - sum(len(p[2]) for p in held)
            held.append((doc, start, ids[:room], total))
            if len(ids) >= room:
                self.close(0)
            start, ids = start + room, ids[room:]

    def close(self, j: int) -> None:
        offset = 0
        for doc, start, ids, total in self.open.pop(j):
            self.rows.append((doc, start, ids, total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def end(self) -> None:
        left = [p for j in sorted(k for k in self.open if k) for p in self.open.pop(j)]
        for piece in left:
            self.pour(piece)
        if 0 in self.open:
            self.close(0)


def _pack(path: str, capacity: int, end: int, fill: float, classes: int, with_ids: bool):
    schema = schema_of(PIECES + (", ids array<int>" if with_ids else ""))

    def rows(bins: Bins) -> pa.RecordBatch:
        found, bins.rows = bins.rows, []
        crc = [zlib.crc32(np.ascontiguousarray(r[2], dtype="<u4").tobytes()) for r in found]
        cols = [[r[0] for r in found], [r[1] for r in found], [len(r[2]) for r in found], crc, [r[3] for r in found], [r[4] for r in found], [r[5] for r in found]]
        return record(schema, *cols, *([[r[2].astype(np.int32) for r in found]] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(path)
        bins = Bins(TaskContext.get().partitionId(), capacity, fill, classes)
        last = np.array([end], dtype=np.uint32)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for s, e in volumes(texts, 2 << 20):
                for doc, ids in zip(docs[s:e], words.encode(texts[s:e]), strict=True):
                    bins.add(doc, np.concatenate([ids, last]))
                if len(bins.rows) >= 5000 or with_ids:
                    yield rows(bins)
        bins.end()
        yield rows(bins)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, fill: float = FILL, classes: int = CLASSES, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    tokenizer is the path of a tokenizers file that drops white space, the same on every node. A document is its ids and the id `end`; a null or empty text is `end`
    alone. Repeated rows are packed each for itself, rows without doc_id too. An empty table gives no rows. There is no
    shuffle: a sequence belongs to one task, its id holds the task's number, and a lost task packs the same again.
    """
    small_batches(docs.sparkSession)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(give_back(_pack(tokenizer, capacity, end, fill, classes, with_ids)), PIECES + (", ids array<int>" if with_ids else ""))
