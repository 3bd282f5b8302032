"""Repair of conversation structure by the cheapest edits, with an audit of them.

A conversation's rows in order are edited to roles of the form (s?(ua)+)?: Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert
3, and a row that stays truncated 3 more. Blank rows and duplicates have to go. The audit is the string of the edits' initials, the
ASCII-least of the cheapest ones; it determines the roles of all rows that stay.

A dynamic programme goes over the rows with one state for what is still allowed (nothing yet, after system, user, assistant). The best
audit of a state is a node that shares its prefix with other audits: a linked list with binary-lifting ancestors and a rolling hash at
every node. Two audits of equal cost are compared at the end of their longest common prefix, found by jumping as long as the hashes
differ; prefixes of equal hash are then compared edit by edit up to a node that both share, so a collision can't decide.

Rows lie in ranges of (conversation, turn, role, text), so a conversation may span ranges; texts are shuffled into them once, and what is known of equal
rows (how often, seen before) comes by their digests. Of the conversations at the edges of a range the programme is run from every state to
every state, the ranges of a conversation are chained by a small table, and the rows of these conversations, which the first pass puts
aside, give the repaired text in chunks that are hashed one after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.llm.common import give_back, record, schema_of, small_batches, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: White space, and what ends a whole sentence.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: What has been put out last: nothing, then the initials.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = {"s": [(NOTHING, SYSTEM)], "u": [(NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
NEXT = [(NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)]
#: Rows of a range, and bytes of a chunk of repaired text.
ROWS = 200_000
CHUNK = 1 << 20

_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E681


class Node:
    """The last edit of an audit; ups[k] is the node 2^k edits before it."""

    __slots__ = ("edit", "depth", "hash", "ups")

    def __init__(self, before: Node | None, edit: str):
        self.edit = edit
        if before is None:
            self.depth, self.hash, self.ups = 0, 0, []
            return
        self.depth, self.hash = before.depth + 1, (before.hash * _BASE + ord(edit)) % _PRIME
        ups, at, k = [before], before, 0
        while len(at.ups) > k:
            at = at.ups[k]
            ups.append(at)
            k += 1
        self.ups = ups

    def at(self, depth: int) -> Node:
        node, left = self, self.depth - depth
        while left:
            k = left.bit_length() - 1
            node, left = node.ups[k], left - (1 << k)
        return node

    def text(self) -> str:
        out, node = [], self
        while node.depth:
            out.append(node.edit)
            node = node.ups[0]
        return "".join(reversed(out))


def compare(a: Node, b: Node) -> int:
    """-1, 0 or 1 as the audit of a is ASCII-less than, equal to or greater than that of b."""
    x, y = a.at(min(a.depth, b.depth)), b.at(min(a.depth, b.depth))
    first = None  # the earliest known place where they differ
    if x.hash != y.hash:
        for k in range(len(x.ups) - 1, -1, -1):
            if k < len(x.ups) and x.ups[k].hash != y.ups[k].hash:
                x, y = x.ups[k], y.ups[k]
        first = (x, y)
        x, y = x.ups[0], y.ups[0]
    while x is not y:  # equal hashes: verified edit by edit up to a shared node
        if x.edit != y.edit:
            first = (x, y)
        x, y = x.ups[0], y.ups[0]
    if first is None:
        return (a.depth > b.depth) - (a.depth < b.depth)
    return -1 if first[0].edit < first[1].edit else 1


def _better(held: tuple | None, cost: int, before: Node, edit: str) -> tuple:
    """(cost, node) of the better one of what is held and a new edit after `before`."""
    if held is not None and cost >= held[0]:
        if cost > held[0]:
            return held
        node = Node(before, edit)
        return (cost, node) if compare(node, held[1]) < 0 else held
    return cost, Node(before, edit)


class Programme:
    """The best audits from one state to every state over the rows so far."""

    def __init__(self, state: int):
        self.best: list[tuple | None] = [None] * 4
        self.best[state] = (0, Node(None, ""))
        self._insert()

    def _insert(self) -> None:
        """Inserted rows: a user row, then an assistant row after it. More would come back to a state at a cost."""
        best = self.best
        for p, q in NEXT:
            if best[p] is not None and (best[q] is None or best[p][0] + INSERT <= best[q][0]):
                best[q] = _better(best[q], best[p][0] + INSERT, best[p][1], "I")

    def row(self, initial: str, goes: bool, truncated: bool) -> None:
        old, new = self.best, [None if x is None else (x[0] + DELETE, Node(x[1], "D")) for x in self.best]
        if not goes:
            extra = TRUNCATED * truncated
            for edits, edit, cost in ((KEEPS.get(initial, ()), "K", KEEP + extra), (NEXT, "R", REROLE + extra)):
                for p, q in edits:
                    if old[p] is not None and (new[q] is None or old[p][0] + cost <= new[q][0]):
                        new[q] = _better(new[q], old[p][0] + cost, old[p][1], edit)
        self.best = new
        self._insert()


def whole_audit(best: list[tuple | None]) -> tuple:
    """(cost, node) of the best audit that may end a conversation: nothing stays, or an assistant has the last word."""
    a, b = best[NOTHING], best[ASSISTANT]
    if a is None or b is None or a[0] != b[0]:
        return min((x for x in (a, b) if x is not None), key=lambda x: x[0])
    return a if compare(a[1], b[1]) < 0 else b


@dataclass
class Part:
    """What is known of a conversation's rows of one range."""

    rows: list[tuple[str, bool, bool]] = field(default_factory=list)
    texts: list[tuple[str, str]] = field(default_factory=list)
    raw: list[tuple] = field(default_factory=list)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    low: int | None = None
    high: int | None = None
    turns: int = 0

    def add(self, turn, role, text, copies, new, blank, truncated) -> None:
        self.raw.append((turn, role, text, copies, new, blank, truncated))
        initial = role[:1]
        for i in range(copies):
            fresh = new and not i
            self.blank += blank
            self.duplicate += not blank and not fresh
            cut = not blank and fresh and truncated
            self.truncated += cut
            self.rows.append((initial, blank or not fresh, cut))
            self.texts.append((role, text))
            if self.first is None:
                self.first = initial
            else:
                self.illegal += self.last + initial not in ("su", "ua", "au")
            self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn

    def audits(self, states) -> dict[int, list[tuple | None]]:
        out = {}
        for state in states:
            run = Programme(state)
            for row in self.rows:
                run.row(*row)
            out[state] = run.best
        return out


def repaired(part: Part, audit: str, state: int = NOTHING) -> Iterator[bytes]:
    """`role:text` of each row that stays, in UTF-8; `state` is what came before."""
    rows = iter(part.texts)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
        else:
            state = ASSISTANT if state == USER else USER
            role = "assistant" if state == ASSISTANT else "user"
        yield f"{role}:{text}".encode()


SUMMARY = "conv_id long, part long, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, first string, last string, low long, high long, turns long, costs array<long>, audits array<string>"
ROW = "r_turn long, r_role string, r_text string, r_copies long, r_fresh boolean, r_blank boolean, r_cut boolean"
FOUND = f"{SUMMARY}, seq long, {ROW}"


def _kinds(text: str) -> pa.Schema:
    return pa.schema([pa.field(n, pa.list_(pa.string())) if k == "array<string>" else schema_of(f"{n} {k}").field(0) for n, k in (x.split(" ") for x in text.split(", "))])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Part]]:
    """One conversation of a range after another. A mark, with what is known of equal rows, comes before their text; only the first of equal texts counts."""
    conv, part, mark = None, None, None
    for batch in batches:
        for c, turn, role, text, copies, fresh, blank, cut in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "copies", "fresh", "blank", "truncated")), strict=True):
            if part is None or c != conv:
                if part is not None:
                    yield conv, part
                conv, part, mark = c, Part(), None
            if text is None:
                mark = (copies, fresh) if copies else None
            elif mark is not None:
                part.add(turn, role, text, *mark, blank, cut)
                mark = None
    if part is not None:
        yield conv, part


def _filled(schema: pa.Schema, n: int, columns: dict[str, list]) -> pa.RecordBatch:
    """A batch of n rows with these columns, the other ones null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation: final ones of those inside the range, and of those at its edges what chaining needs, then their rows (whole is null)."""
    schema, number = _kinds(FOUND), TaskContext.get().partitionId()
    names = [f.name for f in _kinds(SUMMARY)]
    raw = [f.name for f in _kinds(ROW)]

    def row(conv, part: Part, edge: bool) -> tuple:
        gaps = part.high - part.low + 1 - part.turns if part.turns else 0
        known = (gaps, part.blank, part.duplicate, part.truncated, part.illegal)
        if not edge:
            cost, node = whole_audit(part.audits([NOTHING])[NOTHING])
            audit = node.text()
            return conv, number, True, *known, cost, audit, hashlib.sha256(b"\n".join(repaired(part, audit))).hexdigest(), None, None, None, None, None, None, None
        runs = part.audits(range(4))
        ends = [runs[p][q] for p in range(4) for q in range(4)]
        return (conv, number, False, *known, None, None, None, part.first, part.last, part.low, part.high, part.turns,
                [None if x is None else x[0] for x in ends], [None if x is None else x[1].text() for x in ends])

    def put_aside(conv, part: Part) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(part.raw), 1000):
            some = part.raw[s : s + 1000]
            columns = {n: [r[i] for r in some] for i, n in enumerate(raw)}
            yield _filled(schema, len(some), columns | {"conv_id": [conv] * len(some), "part": [number] * len(some), "seq": list(range(s, s + len(some)))})

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return _filled(schema, len(rows), dict(zip(names, (list(c) for c in zip(*rows, strict=True)), strict=True)))

    held, rows, first = None, [], True
    for conv, part in _conversations(batches):
        if held is not None:
            rows.append(row(*held, first))
            if first:
                yield from put_aside(*held)
            first = False
        held = (conv, part)
        if len(rows) >= 500:
            yield rows_of(rows)
            rows = []
    if held is not None:
        rows.append(row(*held, True))
        yield from put_aside(*held)
    if rows:
        yield rows_of(rows)


def chain(parts: list[dict]) -> tuple[tuple, list[tuple[int, int, int]]]:
    """The conversation's row but for its hash, and (range, state before it, state after it) of each of its ranges in order."""
    best: list[tuple | None] = [(0, "", ()), None, None, None]
    for p in parts:
        new: list[tuple | None] = [None] * 4
        for i in range(4):
            for j in range(4):
                cost = p["costs"][4 * i + j]
                if best[i] is not None and cost is not None:
                    found = (best[i][0] + cost, best[i][1] + p["audits"][4 * i + j], (*best[i][2], (p["part"], i, j)))
                    if new[j] is None or found[:2] < new[j][:2]:
                        new[j] = found
        best = new
    cost, audit, steps = min((x for x in (best[NOTHING], best[ASSISTANT]) if x is not None), key=lambda x: x[:2])
    sums = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    last = high = None
    for p in parts:
        if p["first"] is not None:
            sums["illegal"] += last is not None and last + p["first"] not in ("su", "ua", "au")
            last = p["last"]
        if p["turns"]:
            sums["turns"] -= p["low"] == high
            high = p["high"]
    lows = [p["low"] for p in parts if p["turns"]]
    gaps = high - lows[0] + 1 - sums["turns"] if lows else 0
    return (parts[0]["conv_id"], gaps, sums["blank"], sums["duplicate"], sums["truncated"], sums["illegal"], cost, audit), list(steps)


STEPS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, part long, before int, after int"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _kinds(STEPS)

    def rows(held: list[dict]) -> pa.RecordBatch:
        known, steps = chain(held)
        out = [(*known, *step) if not i else (*known[:7], None, *step) for i, step in enumerate(steps)]
        return record(schema, *(list(c) for c in zip(*out, strict=True)))

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["conv_id"] != held[0]["conv_id"]:
                yield rows(held)
                held = []
            held.append(row)
    if held:
        yield rows(held)


def _texts(chunk: int):
    """Chunks of the repaired text of each (conversation, range), which has the states before and after it."""
    schema = schema_of("conv_id long, part long, chunk long, bytes binary")

    def chunks(key: tuple, part: Part) -> Iterator[pa.RecordBatch]:
        conv, number, before, after = key
        audit = part.audits([before])[before][after][1].text()
        lines, size, at = [], 0, 0
        for line in repaired(part, audit, before):
            lines.append(line)
            size += len(line) + 1
            if size >= chunk:
                yield record(schema, [conv], [number], [at], [b"\n".join(lines)])
                lines, size, at = [], 0, at + 1
        if lines:
            yield record(schema, [conv], [number], [at], [b"\n".join(lines)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part = None, None
        names = [f.name for f in _kinds(ROW)]
        for batch in batches:
            own = zip(*(batch.column(n).to_pylist() for n in ("conv_id", "part", "before", "after")), strict=True)
            for k, r in zip(own, zip(*(batch.column(n).to_pylist() for n in names), strict=True), strict=True):
                if k != key:
                    if part is not None:
                        yield from chunks(key, part)
                    key, part = k, Part()
                part.add(*r)
        if part is not None:
            yield from chunks(key, part)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's chunks in order, newline-joined; only the running hash is held."""
    schema = schema_of("conv_id long, repaired_sha256 string")
    conv, sha = None, None
    for batch in batches:
        for c, piece in zip(batch.column("conv_id").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            if sha is not None and c == conv:
                sha.update(b"\n")
            else:
                if sha is not None:
                    yield record(schema, [conv], [sha.hexdigest()])
                conv, sha = c, hashlib.sha256()
            sha.update(piece)
    if sha is not None:
        yield record(schema, [conv], [sha.hexdigest()])


def turn_key() -> Column:
    """`conv_id:turn`, a null as one space."""
    return F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))


def damaged(rows: DataFrame, modulus: int = 20) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by the crc32 of `conv_id:turn`; null role and text become one space. A dropped row has no
    copies, one that is repeated has two."""
    r = F.crc32(turn_key()) % modulus
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    here = lambda value, gone: F.when(r == 0, gone).otherwise(value)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), here(F.col("turn").cast("long"), F.lit(None).cast("long")).alias("turn"),
        here(F.when(r == 4, F.lit("user")).otherwise(role), F.lit("")).alias("role"),
        here(F.when(r == 1, F.lit("")).when(r == 2, F.translate(text, ENDS, "")).otherwise(text), F.lit("")).alias("text"),
        F.when(r == 0, 0).when(r == 3, 2).otherwise(1).cast("long").alias("copies"))


def undamaged(rows: DataFrame) -> DataFrame:
    """The rows as they are, in the form that `repair` takes."""
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(
        F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).cast("long").alias("copies"))


def ordered_rows(rows: DataFrame, per_range: int) -> DataFrame:
    """Texts with their own faults and, before them, marks of equal rows (copies, fresh: not seen earlier), in sorted ranges of (conv_id, turn, role, digest)."""
    same = ["conv_id", "turn", "role", "digest"]
    own = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    merged = own.groupBy(*same).agg(F.sum("copies").alias("copies"))
    often = merged.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    often = often.select(F.col("conv_id").alias("conv"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("first"), F.lit(True).alias("again"))
    known = merged.join(often, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    no = F.lit(None)
    marks = known.select(*same, no.cast("string").alias("text"), "copies", (F.col("again").isNull() | F.col("turn").eqNullSafe(F.col("first"))).alias("fresh"),
                         no.cast("boolean").alias("blank"), no.cast("boolean").alias("truncated"))
    core = F.btrim(F.col("text"), F.lit(BLANKS))
    texts = own.where("copies > 0").select(*same, "text", no.cast("long").alias("copies"), no.cast("boolean").alias("fresh"), (core == "").alias("blank"),
                                           (F.instr(F.lit(ENDS), F.substring(core, -1, 1)) == 0).alias("truncated"))
    ranges = max(1, -(-rows.count() // per_range))
    order = [F.col(c).asc_nulls_first() for c in same]
    return marks.unionByName(texts).repartitionByRange(ranges, *order).sortWithinPartitions(*order, F.col("text").isNotNull())


def repair(rows: DataFrame, per_range: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows has conv_id, turn, role, text and copies (see `damaged`, `undamaged`). Rows go by turn, nulls first, then role and the SHA-256 of the text; equal
    rows are one row several times. Blank rows have only white space; duplicates have a role and text seen earlier in the
    conversation; truncated ones don't end in one of .!? before white space. A row counts for its first fault. A null conv_id is a conversation of its own.
    Roles are told by their first character; an empty role has none and can't be kept. A conversation without rows has zeros, an
    empty audit and the hash of nothing. An empty table gives no rows.

    The audit holds a character per row and the hash takes the text in order, so a conversation's result is as long as its rows and its
    hash is one stream; all else is done range by range.
    """
    small_batches(rows.sparkSession)
    found = stored(ordered_rows(rows, per_range).mapInArrow(give_back(_summaries), FOUND), "dialogue-found")
    by_conv = lambda df, *order: df.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)
    steps = stored(by_conv(found.where("NOT whole"), "part").mapInArrow(_chained, STEPS), "dialogue-steps")
    at = steps.select(F.col("conv_id").alias("conv"), F.col("part").alias("p"), "before", "after")
    edges = found.where("whole IS NULL").select("conv_id", "part", "seq", *[f.name for f in _kinds(ROW)])
    edges = edges.join(at, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("p"))).drop("conv", "p")
    edges = edges.repartition("conv_id", "part").sortWithinPartitions("part", F.col("conv_id").asc_nulls_first(), "seq")
    hashes = by_conv(edges.mapInArrow(_texts(chunk), "conv_id long, part long, chunk long, bytes binary"), "part", "chunk").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    hashes = hashes.withColumnRenamed("conv_id", "conv")
    chained = steps.where("audit is not null").join(hashes, F.col("conv_id").eqNullSafe(F.col("conv")), "left").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())))
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return found.where("whole").select(columns).unionByName(chained.select(columns))
