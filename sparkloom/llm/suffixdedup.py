"""Removal of repeated byte strings by distributed suffix sorting (deep-shallow sorting).

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id.

1. Anchors. Every window of `length` bytes has a minimizer: of its 16-byte grams the one of least hash, the leftmost of equals. Equal
   windows have equal minimizers at equal places, so suffixes need to meet only where a minimizer's gram occurs in two documents. Anchors
   (hash of the gram, hash of the text of all windows it is the minimizer of, doc_id, place; one per some 17 bytes) are shuffled by
   the first hash and sorted. Of equal texts (96 bits) all but that of the smallest document go; single grams drop out.
2. Contexts. Of the different texts of a gram the bytes (the suffixes to be sorted) go to the task of the gram.
3. Deep-shallow sort. The suffixes of the different contexts of a gram are sorted by multikey quicksort, characters of eight bytes, to the shallow depth
   of 16 bytes; each group that is still together is ordered by a blind trie, which looks only at the byte where its members first differ. Suffixes
   that share all `length` bytes end in one leaf: all but those of the leaf's smallest document go.
4. The covered bytes are merged per document and cut from its text.

Everything is streamed in sorted order: a hot gram costs a task no memory. A gram with more different contexts than `MOST`
is sorted by Spark instead, window by window. The whole is one plan, in which texts are shuffled once and read twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.common import as_bytes, record, schema_of, small_batches, starts_of

LENGTH, GRAM, SHALLOW = 50, 16, 16
#: Different contexts of one gram that a task sorts in memory, and suffixes that it sorts at a time.
MOST, SLICE = 200_000, 300_000
#: Bytes that are hashed at a time; places in such a chunk take the low bits of the numbers that are compared.
PLACE_BITS = 20
CHUNK = 1 << PLACE_BITS


def mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(flat: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each place on."""
    words = np.ndarray((max(0, len(flat) - 7),), dtype="<u8", buffer=flat, strides=(1,))
    half = mix(words.astype(np.uint64))
    return mix(half[:-8] + np.uint64(3) * (half[8:] ^ (half[8:] >> np.uint64(17))))


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def segments(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, place, bytes) pieces by chunks; a long text is cut so that each of its windows lies in one piece."""
    held, total, step = [], 0, CHUNK // 2
    for i, text in enumerate(texts):
        for begin in range(0, max(1, len(text) - length + 1), step):
            piece = text[begin : begin + step + length - 1]
            if len(piece) < length:
                continue
            if total + len(piece) > CHUNK - 64 and held:
                yield held
                held, total = [], 0
            held.append((i, begin, piece))
            total += len(piece)
    if held:
        yield held


def minimizers(pieces: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """For a chunk (bytes, hashes, window places, minimizer places, piece of each window); places count from the chunk's start."""
    flat = np.frombuffer(b"".join(p[2] for p in pieces) + bytes(32), dtype=np.uint8)
    hashes = gram_hashes(flat)
    places = np.arange(len(hashes), dtype=np.uint64)
    packed = (hashes & ~np.uint64(CHUNK - 1)) | places
    least = window_least(packed, length - GRAM + 1)
    sizes = np.array([len(p[2]) for p in pieces])
    begin = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(pieces)), count)
    window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[owner]
    return flat, hashes, window, (least[window] & np.uint64(CHUNK - 1)).astype(np.int64), owner


def key_of(hashes: np.ndarray) -> np.ndarray:
    """48 bits of a hash: what collides is told apart by its bytes later."""
    return (hashes >> np.uint64(16)).view(np.int64)


def context_hashes(hashes: np.ndarray, low: np.ndarray, stop: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """48 bits of a hash of the bytes from low to stop and of the anchor's place in them, from grams that cover them all."""
    out = mix(((anchor - low).astype(np.uint64) << np.uint64(32)) | (stop - low).astype(np.uint64))
    for i in range(0, 2 * length - GRAM, GRAM):
        out = mix(out ^ hashes[np.minimum(low + i, stop - GRAM)])
    return key_of(out)


ANCHOR = "k1 long, k2 long, doc long"


def anchors_of(pieces: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """Of a chunk (bytes, hashes, anchor, its first and last window, its text, its place in the text), places from the chunk's start."""
    flat, hashes, window, anchor, owner = minimizers(pieces, length)
    first = starts_of(anchor, owner)
    last = np.append(first[1:], len(anchor)) - 1
    sizes = np.array([len(p[2]) for p in pieces])
    shift = np.array([p[1] for p in pieces]) - (np.cumsum(sizes) - sizes)
    who, anchor = owner[first], anchor[first]
    return flat, hashes, anchor, window[first], window[last], np.array([p[0] for p in pieces])[who], anchor + shift[who]


def joined_keys(h: np.ndarray, c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48 bits of h, 48 of c and 32 of the place in two longs, in this order: a shuffled row has no idle bytes and sorts by h, then c."""
    h, c, at = (x.astype(np.int64).view(np.uint64) for x in (h, c, at))
    return ((h << np.uint64(16)) | (c >> np.uint64(32))).view(np.int64), ((c << np.uint64(32)) | at).view(np.int64)


def split_keys(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k1, k2 = k1.view(np.uint64), k2.view(np.uint64)
    return (k1 >> np.uint64(16)).view(np.int64), (((k1 & np.uint64(0xFFFF)) << np.uint64(32)) | (k2 >> np.uint64(32))).view(np.int64), (k2 & np.uint64(0xFFFFFFFF)).view(np.int64)


def _anchors(length: int):
    """h: the gram's hash; c: a hash of the text of all windows that the anchor is the minimizer of."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(ANCHOR)
        for batch in batches:
            docs, texts = np.asarray(batch.column(0)), as_bytes(batch.column(1))
            for pieces in segments(texts, length):
                _, hashes, anchor, low, high, source, at = anchors_of(pieces, length)
                yield record(schema, *joined_keys(key_of(hashes[anchor]), context_hashes(hashes, low, high + length, anchor, length), at), docs[source])
    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of anchors sorted by (h, c, doc): twice the place, plus one if a smaller document has the same context.

    Of contexts without that, those are marked whose h has several of them, in several documents. What is held is the first document of
    one context, or contexts of one document.
    """
    schema = schema_of("doc long, mark long")
    held = [np.zeros(0, dtype=np.int64)] * 4
    last_h = last_c = last_doc = known = None  # known: the last h, if its contexts are marked
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, doc = (np.asarray(x) for x in batch.columns)
        h, c, at = split_keys(k1, k2)
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        new[0] = last_h is None or h[0] != last_h or c[0] != last_c
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(h)))
        low = np.concatenate([np.full(len(h) - size.sum(), last_doc if last_doc is not None else 0), np.repeat(doc[start], size)])
        last_h, last_c, last_doc = h[-1], c[-1], low[-1]
        later = doc > low
        marks = [(doc[later], 2 * at[later] + 1)]
        h, c, doc, at = (np.concatenate([x, y[~later]]) for x, y in zip(held, (h, c, doc, at), strict=True))
        if len(h):
            start = starts_of(h)
            size = np.diff(np.append(start, len(h)))
            several = (np.minimum.reduceat(c, start) != np.maximum.reduceat(c, start)) & (np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start))
            several |= h[start] == known if known is not None else False
            keep = np.repeat(several, size)
            marks.append((doc[keep], 2 * at[keep]))
            open_ = h[-1] == last_h
            known = last_h if open_ and (several[-1] or known == last_h) else known if known == last_h else None
            tail = start[-1] if open_ and not several[-1] else len(h)
            held = [x[tail:] for x in (h, c, doc, at)]
        elif known != last_h:
            known = None
        doc, mark = (np.concatenate(x) for x in zip(*marks, strict=True))
        if len(doc):
            yield record(schema, doc, mark)


CONTEXT = "h long, ctx binary, least int, doc long, at int"


def _contexts(length: int):
    """ctx: a byte with the bytes before the anchor, then the text of the anchor's windows; least: bytes before it in the last window.

    Marks that are answered already become rows without ctx, merged to spans from at to least.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(CONTEXT)
        for batch in batches:
            docs, texts, marks = batch.column("doc_id").to_numpy(), unpacked(batch.column("z")), batch.column("marks")
            sizes = np.asarray(pc.list_value_length(marks))
            marked = marks.flatten().to_numpy()
            ends = np.cumsum(sizes)
            for pieces in segments(texts, length):
                flat, hashes, a, low, high, source, at = anchors_of(pieces, length)
                # Marks as (text, place, answered) numbers, looked up in those of this chunk's texts.
                own = np.sort(np.concatenate([(i << 40) + marked[ends[i] - sizes[i] : ends[i]] for i in np.unique(source).tolist()]))
                number = (source.astype(np.int64) << 40) + 2 * at
                done = np.isin(number + 1, own)
                if done.any():
                    wide = int(at.max()) + 4 * length
                    begin, stop = merged(source[done] * wide + (low - a + at)[done], source[done] * wide + (high - a + at)[done] + length)
                    who = begin // wide
                    yield record(schema, mix(docs[who].astype(np.uint64)).view(np.int64), pa.nulls(len(who), pa.binary()), (stop - who * wide).astype(np.int32), docs[who], (begin - who * wide).astype(np.int32))
                fine = np.isin(number, own)
                if not fine.any():
                    continue
                low, high, a, at, source = low[fine], high[fine], a[fine], at[fine], source[fine]
                n = high + length - low + 1
                out = np.cumsum(n)
                inner = np.arange(out[-1]) - np.repeat(out - n, n)
                data = flat[np.maximum(np.repeat(low - 1, n) + inner, 0)]
                data[out - n] = a - low
                ctx = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, out).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                yield record(schema, key_of(hashes[a]), ctx, (a - high).astype(np.int32), docs[source], at.astype(np.int32))
    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one: they are shuffled, and a shuffle file compresses worse."""
    import zstandard

    press, schema = zstandard.ZstdCompressor(level=3), schema_of("doc_id long, z binary")
    for batch in batches:
        yield record(schema, batch.column(0), [press.compress(t) for t in as_bytes(batch.column(1))])


def unpacked(column: pa.Array) -> list[bytes]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    return [press.decompress(z) for z in column.to_pylist()]


def multikey_sort(group: np.ndarray, text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order rows by group and their first `depth` bytes, a character of eight bytes at a time; only runs of equals go on to the next.

    Returns the order and, for each row of it, the number of its run.
    """
    order = np.argsort(group, kind="stable")
    run = np.cumsum(np.append(False, group[order][1:] != group[order][:-1]))
    for begin in range(0, depth, 8):
        size = np.bincount(run)
        open_ = np.flatnonzero(size[run] > 1)
        if not len(open_):
            break
        char = np.ascontiguousarray(text[order[open_], begin : begin + 8]).view(">u8").ravel().astype(np.uint64)
        moved = open_[np.lexsort((char, run[open_]))]
        char_of = np.zeros(len(order), dtype=np.uint64)
        char_of[open_] = char
        order[open_], char_of[open_] = order[moved], char_of[moved]
        # A run keeps its places, so runs of the moved rows are unchanged.
        run = np.cumsum(np.append(False, (run[1:] != run[:-1]) | (char_of[1:] != char_of[:-1])))
    return order, run


def blind_tries(text: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order the rows of each run (numbers that do not fall) by the trie of its members.

    All tries grow a level at a time. A node skips to the first byte in which a member differs from the node's first, branches on that
    byte alone, and is a leaf when none differs. Returns the rows that share a leaf and the number of their leaf.
    """
    rows = np.arange(len(run))
    leaves: list[np.ndarray] = []
    while len(rows):
        start = starts_of(run)
        size = np.diff(np.append(start, len(rows)))
        pair = np.repeat(size > 1, size)
        rows, run = rows[pair], run[pair]
        if not len(rows):
            break
        start = starts_of(run)
        size = np.diff(np.append(start, len(rows)))
        node = np.repeat(np.arange(len(start)), size)
        differs = text[rows] != text[rows[start]][node]
        skip = np.where(differs.any(axis=1), differs.argmax(axis=1), text.shape[1])
        depth = np.minimum.reduceat(skip, start)
        leaf = depth[node] == text.shape[1]
        if leaf.any():
            leaves.append(np.stack([rows[leaf], rows[start][node][leaf]]))
        rows, node = rows[~leaf], node[~leaf]
        branch = text[rows, depth[node]].astype(np.int64) + 256 * node
        order = np.argsort(branch, kind="stable")
        rows, run = rows[order], branch[order]
    if not leaves:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    found = np.concatenate(leaves, axis=1)
    return found[0], found[1]


def repeated_suffixes(group: np.ndarray, text: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which suffixes (rows of `length` bytes) also stand in a smaller document of their group."""
    out = np.zeros(len(group), dtype=bool)
    order, run = multikey_sort(group, text, SHALLOW)
    row, leaf = blind_tries(text[order], run)
    if len(row):
        low = np.full(len(group), np.iinfo(np.int64).max)
        np.minimum.at(low, leaf, doc[order[row]])
        out[order[row]] = doc[order[row]] > low[leaf]
    return out


class Contexts:
    """Contexts as arrays: gram key, document, place of the anchor, least and most bytes before it, and the bytes."""

    def __init__(self, h, doc, at, least, most, ctx):
        self.h, self.doc, self.at, self.least, self.most, self.ctx = h, doc, at, least, most, ctx

    def take(self, rows: np.ndarray) -> Contexts:
        return Contexts(self.h[rows], self.doc[rows], self.at[rows], self.least[rows], self.most[rows], self.ctx.take(pa.array(rows)))

    @staticmethod
    def of(parts: list[Contexts]) -> Contexts:
        return Contexts(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("h", "doc", "at", "least", "most")), pa.concat_arrays([p.ctx for p in parts]))

    def aligned(self, length: int) -> np.ndarray:
        """The texts as rows, the anchor of each at column length - GRAM."""
        before = length - GRAM
        ends = np.frombuffer(self.ctx.buffers()[1], dtype=np.int32)[self.ctx.offset : self.ctx.offset + len(self.ctx) + 1].astype(np.int64)
        data = np.frombuffer(self.ctx.buffers()[2], dtype=np.uint8)
        out = np.zeros((len(self.h), before + length), dtype=np.uint8)
        n = np.diff(ends) - 1
        row = np.repeat(np.arange(len(n)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[row, np.repeat(before - self.most, n) + inner] = data[np.repeat(ends[:-1] + 1, n) + inner]
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(context, bytes before the anchor) of every window."""
        n = (self.most - self.least + 1).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.least[row]


SPAN = "key long, win binary, doc long, begin int, stop int"


def _spans(schema: pa.Schema, doc, begin, stop) -> pa.RecordBatch:
    return record(schema, doc, pa.nulls(len(doc), pa.binary()), doc, begin.astype(np.int32), stop.astype(np.int32))


def sorted_spans(found: Contexts, length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Spans of contexts whose windows also stand in a smaller document with the same gram."""
    start = starts_of(found.h)
    several = np.repeat(np.diff(np.append(start, len(found.h))) > 1, np.diff(np.append(start, len(found.h))))
    found = found.take(np.flatnonzero(several))
    if not len(found.h):
        return
    begin = 0
    edges = np.append(starts_of(found.h), len(found.h))
    weight = np.cumsum((found.most - found.least + 1).astype(np.int64))
    while begin < len(found.h):
        # Whole grams up to about SLICE suffixes.
        done = weight[begin - 1] if begin else 0
        stop = int(edges[max(np.searchsorted(edges, begin, side="right"), np.searchsorted(edges, np.searchsorted(weight, done + SLICE), side="right") - 1)])
        part = found.take(np.arange(begin, stop))
        begin = stop
        text = part.aligned(length)
        row, before = part.windows()
        gram = np.cumsum(np.append(False, part.h[1:] != part.h[:-1]))
        views = np.lib.stride_tricks.sliding_window_view(text, length, axis=1)
        gone = np.zeros(len(row), dtype=bool)
        # Suffixes with their anchor at different places never equal, so those of a very large gram are sorted place by place.
        for some in [np.flatnonzero(before == x) for x in np.unique(before)] if len(row) > SLICE else [np.arange(len(row))]:
            gone[some] = repeated_suffixes(gram[row[some]] * length + before[some], views[row[some], (length - GRAM) - before[some]], part.doc[row[some]])
        if not gone.any():
            continue
        row, before = row[gone], before[gone]
        new = np.append(True, (row[1:] != row[:-1]) | (before[1:] != before[:-1] + 1))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1
        at = part.at[row[first]]
        yield _spans(schema, part.doc[row[first]], at - before[last], at - before[first] + length)


def window_rows(found: Contexts, length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Every window of the contexts as a row of its own, for Spark to sort."""
    for i in range(0, len(found.h), 10_000):
        part = found.take(np.arange(i, min(i + 10_000, len(found.h))))
        text = part.aligned(length)
        row, before = part.windows()
        suffix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, length, axis=1)[row, (length - GRAM) - before])
        win = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((np.arange(len(row) + 1) * length).astype(np.int32).tobytes()), pa.py_buffer(suffix.tobytes())])
        key = mix(mix(suffix[:, :8].copy().view("<u8").ravel().astype(np.uint64)) ^ suffix[:, length - 8 :].copy().view("<u8").ravel()).view(np.int64)
        begin = part.at[row] - before
        yield record(schema, key, win, part.doc[row], begin.astype(np.int32), (begin + length).astype(np.int32))


def _sort_contexts(length: int, most: int):
    """Contexts sorted by (h, ctx, doc) to spans, or to rows of windows for a gram with too many different contexts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(SPAN)
        held: list[Contexts] = []
        last_h = last_ctx = last_doc = crowded = None
        for batch in batches:
            if not batch.num_rows:
                continue
            answered = batch.column("ctx").is_null()
            if answered.true_count:
                spans = batch.filter(answered)
                yield _spans(schema, np.asarray(spans.column("doc")), np.asarray(spans.column("at")), np.asarray(spans.column("least")))
                batch = batch.filter(pc.invert(answered))
                if not batch.num_rows:
                    continue
            h, ctx, least, doc, at = batch.columns
            h, least, doc, at = (np.asarray(x) for x in (h, least, doc, at))
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | ~np.asarray(pc.equal(ctx.slice(1), ctx.slice(0, len(h) - 1)))
            new[0] = last_h is None or h[0] != last_h or ctx[0].as_py() != last_ctx
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(h)))
            low = np.concatenate([np.full(len(h) - size.sum(), last_doc if last_doc is not None else 0), np.repeat(doc[start], size)]).astype(np.int64)
            last_h, last_ctx, last_doc = h[-1], ctx[len(h) - 1].as_py(), int(low[-1])
            ends = np.frombuffer(ctx.buffers()[1], dtype=np.int32)[ctx.offset : ctx.offset + len(ctx)]
            before = np.frombuffer(ctx.buffers()[2], dtype=np.uint8)[ends].astype(np.int32)
            later = doc > low
            if later.any():
                yield _spans(schema, doc[later], at[later] - before[later], at[later] - least[later] + length)
            own = Contexts(h, doc, at, least, before, ctx).take(np.flatnonzero(~later))
            if crowded is not None:
                more = own.h == crowded
                yield from window_rows(own.take(np.flatnonzero(more)), length, schema)
                own = own.take(np.flatnonzero(~more))
                crowded = crowded if last_h == crowded else None
            held.append(own)
            if sum(len(x.h) for x in held) > 20_000:
                every = Contexts.of(held)
                open_ = every.h == last_h
                yield from sorted_spans(every.take(np.flatnonzero(~open_)), length, schema)
                held = [every.take(np.flatnonzero(open_))]
                if len(held[0].h) > most:
                    crowded = last_h
                    yield from window_rows(held[0], length, schema)
                    held = []
        if held:
            yield from sorted_spans(Contexts.of(held), length, schema)
    return run


def merged(begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans as maximal runs."""
    order = np.argsort(begin, kind="stable")
    begin, stop = begin[order], np.maximum.accumulate(stop[order])
    first = np.flatnonzero(np.append(True, begin[1:] > stop[:-1]))
    return begin[first], stop[np.append(first[1:], len(begin)) - 1]


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, win, doc): spans are merged by document; of equal windows all but those of the first document are spans."""
    schema = schema_of("doc long, begin array<int>, stop array<int>")
    last_win, last_doc = None, None
    waiting: list[np.ndarray] = []

    def flush():
        nonlocal waiting
        if not waiting:
            return
        doc, begin, stop = np.concatenate(waiting, axis=1)
        order = np.lexsort((begin, doc))
        doc, begin, stop = doc[order], begin[order], stop[order]
        # One document after another on one axis, so that merging takes all at once.
        run = np.cumsum(np.append(False, doc[1:] != doc[:-1]))
        wide = int(stop.max()) + 2
        b, s = merged(begin + run * wide, stop + run * wide)
        who = b // wide
        names = doc[starts_of(doc)]
        edge = np.append(starts_of(who), len(who)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array((x - who * wide).astype(np.int32))) for x in (b, s)]
        waiting = []
        yield record(schema, names[who[edge[:-1]]], *lists)

    for batch in batches:
        key, win, doc, begin, stop = batch.columns
        doc, begin, stop = (np.asarray(x).astype(np.int64) for x in (doc, begin, stop))
        plain = np.asarray(win.is_null())
        keep = plain.copy()
        for i in np.flatnonzero(~plain).tolist():
            now = win[i].as_py()
            if now != last_win:
                last_win, last_doc = now, doc[i]
            keep[i] = doc[i] > last_doc
        if keep.any():
            waiting.append(np.stack([doc[keep], begin[keep], stop[keep]]))
        if sum(x.shape[1] for x in waiting) > 300_000:
            yield from flush()
    yield from flush()


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc, text, begin, stop in zip(batch.column(0).to_pylist(), unpacked(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                kept, spans = text, 0
                if begin:
                    b, s = merged(np.array([x for part in begin for x in part]), np.array([x for part in stop for x in part]))
                    spans = len(b)
                    kept = b"".join(text[x:y] for x, y in zip([0, *s.tolist()], [*b.tolist(), len(text)], strict=True))
                for column, value in zip(out, (doc, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    column.append(value)
            yield record(schema, *out)
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): one row per input row.

    A null text is empty. Texts under `length` bytes lose nothing. Rows that share a doc_id are one document: what they share with each
    other stays, and all lose the same places, so they should be equal. Rows without doc_id are neither compared nor cut. An empty table gives
    no rows.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    named = texts.where("doc_id IS NOT NULL")
    # Both joins with the texts need the same exchange of them, so it is made once.
    packed = named.mapInArrow(_packed, "doc_id long, z binary").where("doc_id IS NOT NULL")
    anchors = named.mapInArrow(_anchors(length), ANCHOR)
    marks = anchors.repartition(F.shiftrightunsigned("k1", 16)).sortWithinPartitions("k1", F.shiftrightunsigned("k2", 32), "doc").mapInArrow(_repeated, "doc long, mark long").groupBy("doc").agg(F.collect_list("mark").alias("marks"))
    contexts = packed.join(marks, packed["doc_id"] == marks["doc"]).select("doc_id", "z", "marks").mapInArrow(_contexts(length), CONTEXT)
    spans = contexts.repartition("h").sortWithinPartitions("h", "ctx", "doc").mapInArrow(_sort_contexts(length, most), SPAN)
    covered = spans.repartition("key").sortWithinPartitions("key", "win", "doc").mapInArrow(_per_document, "doc long, begin array<int>, stop array<int>")
    cuts = covered.groupBy("doc").agg(F.collect_list("begin").alias("begin"), F.collect_list("stop").alias("stop"))
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    cut = packed.join(cuts, packed["doc_id"] == cuts["doc"], "left").select("doc_id", "z", "begin", "stop").mapInArrow(_cut(with_text), result)
    nothing = F.lit(None).cast("array<array<int>>")
    unnamed = texts.where("doc_id IS NULL").mapInArrow(_packed, "doc_id long, z binary").select("doc_id", "z", nothing.alias("begin"), nothing.alias("stop"))
    return cut.unionByName(unnamed.mapInArrow(_cut(with_text), result))
