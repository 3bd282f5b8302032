"""Conversation repair, best-fit packing and hard negatives against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import dialogue, negatives, residual
from sparkloom.llm.queries import tokenizer_path

CONV = "conv_id long, turn long, role string, text string"
LEGAL = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
BLANK = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """Cheapest edits over (cost, audit, repaired) kept whole for every state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, marked = set(), []
    for turn, role, text in rows:
        core = text.strip(BLANK)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    best = {0: (0, "", ())}

    def spread(best):
        out = dict(best)
        for _ in range(4):
            for (p, i), q in LEGAL.items():
                if i != "s" and p in out:
                    c, a, t = out[p]
                    new = (c + 3, a + "I", (*t, ("user:" if i == "u" else "assistant:")))
                    if q not in out or new[:2] < out[q][:2]:
                        out[q] = new
        return out

    best = spread(best)
    for role, text, fault in marked:
        found = defaultdict(list)
        for p, (c, a, t) in best.items():
            found[p].append((c + 4, a + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 * (fault == "truncated")
            for (s, i), q in LEGAL.items():
                if s == p and role[:1] == i:
                    found[q].append((c + extra, a + "K", (*t, f"{role}:{text}")))
                if s == p and i != "s":
                    found[q].append((c + 3 + extra, a + "R", (*t, f"{'user' if i == 'u' else 'assistant'}:{text}")))
        best = spread({q: min(x, key=lambda y: y[:2]) for q, x in found.items()})
    cost, audit, lines = min((best[q] for q in (0, 3) if q in best), key=lambda x: x[:2])
    turns = [r[0] for r in rows if r[0] is not None]
    count = Counter(f for _, _, f in marked)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        r = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = out[conv]
        if r == 0:
            continue
        text = "" if r == 1 else text.translate({ord(c): None for c in ".!?"}) if r == 2 else text
        kept += [(turn, "user" if r == 4 else role, text)] * (2 if r == 3 else 1)
    return out


def conversations():
    rng = random.Random(5)
    rows = []
    for conv in range(60):
        for turn in range(rng.choice([1, 2, 5, 9, 30])):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", "u"]) if rng.random() < 0.3 else "system" if not turn and rng.random() < 0.3 else "ua"[turn % 2]
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, rng.choice(["Yes.", "No!", "cut off", "a text of its own %d." % turn, " \n", "Ü \t. "])))
    rows += [(100, i, rng.choice(["user", "assistant"]), rng.choice(["One.", "Two", f"{i}?"])) for i in range(400)]  # a third of all rows
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (101, None, None, None), (102, 7, "user", "x" * 300_000 + "."), (102, 7, "user", "x" * 300_000 + ".")]
    return rows + [r for r in rows if r[0] == 3] * 2


@pytest.mark.parametrize("per_range", [13, 1_000_000])
def test_repair(spark, per_range):
    rows = conversations()
    df = spark.createDataFrame(rows, CONV).repartition(5).withColumn("part", F.lit("clash")).withColumn("copies", F.lit("clash")).withColumn("fresh", F.lit("clash"))
    out = dialogue.repair(dialogue.damaged(df), per_range=per_range, chunk=500)
    got = {r["conv_id"]: tuple(r)[1:] for r in out.collect()}
    want = {conv: plain_repair(own) for conv, own in plain_damage(rows).items()}
    assert got == want and len(got) == out.count()
    assert dialogue.repair(dialogue.damaged(df.limit(0))).collect() == []
    asis = {r["conv_id"]: tuple(r)[1:] for r in dialogue.repair(dialogue.undamaged(df), per_range=per_range).where("conv_id < 20").collect()}
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn, " " if role is None else role, " " if text is None else text))
    assert asis == {c: plain_repair(own[c]) for c in asis} and len(asis) == 20


def test_dropped_conversation(spark):
    gone = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = dialogue.repair(dialogue.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], CONV))).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


@settings(max_examples=200, deadline=None)
@given(st.text("DIKR", max_size=12), st.text("DIKR", max_size=40), st.text("DIKR", max_size=40), st.booleans())
def test_audits_compare(shared, left, right, collide):
    root = dialogue.Node(None, "")
    def grow(node, text):
        for c in text:
            node = dialogue.Node(node, c)
            if collide:
                node.hash = node.depth  # every pair of equal length collides
        return node
    trunk = grow(root, shared)
    a, b = grow(trunk, left), grow(trunk, right)
    x, y = shared + left, shared + right
    assert a.text() == x and dialogue.compare(a, b) == (x > y) - (x < y)


def packed_rows(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_best_fit_of_documents(spark, edge, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    out = residual.pack(edge, tokenizer_path(), part=6, fanin=2).collect()
    want = Counter()
    for r in edge.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            want[r["doc_id"], piece, start, len(ids[start : start + 4096]), zlib.crc32(ids[start : start + 4096].tobytes())] += 1
    assert Counter(tuple(r[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in out) == want
    assert packed_rows(out, 4096) == math.ceil(sum(r["length"] for r in out) / 4096)
    assert residual.pack(none, tokenizer_path()).collect() == []


@pytest.mark.parametrize("kind", ["mixed", "halves", "apart"])
def test_best_fit_rounds(spark, kind):
    rng = np.random.default_rng(3)
    sizes = {"mixed": rng.integers(1, 101, 3000), "halves": rng.integers(51, 70, 3000), "apart": np.concatenate([rng.integers(60, 65, 1500), rng.integers(30, 40, 1500)])}[kind]
    rows = [(i, i, 0, 0, int(s), 0) for i, s in enumerate(sizes)]
    pieces = spark.createDataFrame(rows, residual.PIECES)
    out = residual.packed(pieces, capacity=100, part=400, fanin=3, slack=0.02).collect()
    assert Counter(r["uid"] for r in out) == Counter(range(len(rows)))
    bins = packed_rows(out, 100)
    alone = len(residual.best_fit(sizes, 100)[2])  # all in one part
    assert bins <= alone * 1.03 + 1
    if kind == "halves":
        assert bins == 3000


def test_best_fit_takes_the_fullest():
    place, offset, fill = residual.best_fit(np.array([60, 70, 30, 40, 10]), 100)
    assert place.tolist() == [1, 0, 0, 1, 2] and offset.tolist() == [0, 0, 70, 60, 0] and fill.tolist() == [100, 100, 10]


def plain_negatives(rows):
    fine = [(v, (l + 1) % 10 if v % 7 == 0 else l, [math.floor(256 * float(np.float32(x))) for x in e]) for v, e, l in rows
            if v is not None and l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for v, l, e in fine:
        if v % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), w, m) for w, m, f in fine if w != v and len(f) == len(e))
        for score, w, _ in [s for s in scored if s[2] == l][:5]:
            near = [s for s in scored if s[2] != l and 80 * -score <= 100 * -s[0] <= 100 * -score][:5]
            out += [(v, w, i + 1, s[1], -score, -s[0]) for i, s in enumerate(near)]
    return Counter(out)


@pytest.mark.parametrize("block,step", [(2, 7), (1024, 1024)])
def test_hard_negatives(spark, block, step):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((9, 20))
    rows = [(i, [float(x) for x in (base[i % 9] + 0.3 * rng.standard_normal(20)).astype(np.float32)], int(rng.choice([0, 0, 0, 1, 2]))) for i in range(700)]
    rows += [(1000 + i, rows[100][1], i % 3) for i in range(40)] + [rows[100], rows[200], rows[333]]  # copies and repeated rows
    rows += [(800, [0.0] * 20, 1), (801, [0.0] * 20, 2), (900, [], 1), (901, [], 2), (902, [], 1), (903, [1.0, 2.0], 1), (1100, [-3.0, 1e6], 1), (1101, [-2.5, 9e5], 1), (1102, [1.0, 9e5], 2)]
    rows += [(1200, None, 1), (1300, [float("nan")] * 20, 1), (1400, [None] + [1.0] * 19, 2), (1500, [float("inf")] * 20, 1), (1600, rows[0][1], None), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(6).withColumn("rank", F.lit("clash")).withColumn("parts", F.lit("clash"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, label, block=block, rows=step)
    assert Counter(tuple(r) for r in out.collect()) == plain_negatives(rows)
    assert negatives.hard_negatives(df.where("vec_id = 5"), F.col("vec_id") % 100 == 0, label).collect() == []
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0, label).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 19), st.sampled_from([1, 200, 2**20]))
def test_table_scores_are_products(seed, dims, most):
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    a, c = rng.integers(-most, most, (5, dims)), rng.integers(-most, most, (7, dims))
    batch = pa.record_batch([pa.array(range(7)), pa.array([0] * 7), pa.array(c.tolist(), type=pa.list_(pa.int64()))], names=["vec_id", "label", "parts"])
    (out,) = negatives.packed(iter([batch]))
    planes = np.frombuffer(b"".join(out.column("planes").to_pylist()), dtype=np.uint8).reshape(7, -1, -(-dims // 8))
    assert (negatives.scores(negatives.subset_sums(a), planes) == c @ a.T).all()
