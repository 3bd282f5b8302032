"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of about `PASSAGE` bytes and only the bag has a label. Every passage is encoded by a learned layer
over its features, gated attention weighs the passages, and the weighted mean of the encodings is scored:

    h = tanh(x W + b);  a = softmax over the passages of w . (tanh(h V) * sigmoid(h U));  score = sigmoid(c . sum(a h) + d)

Features of a passage are shares of kinds of characters, repeats of characters and words, and word lengths. The model is
fitted by Adam on a sample of at most about `SAMPLE` labelled documents; every document is scored from its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.common import as_bytes, schema_of, small_batches, volumes

PASSAGE = 256
SAMPLE = 6000
HIDDEN, GATE, STEPS, RATE, DECAY, SEED = 24, 12, 300, 0.02, 1e-4, 5
THRESHOLD = 0.3
#: Characters that are a kind of their own; others are lower, upper, digit, space, other control or beyond ASCII.
MARKS = b"\n.,;:!?|#$%&*@/\\<>()[]{}=+-_'\"~^"
KINDS = 6 + len(MARKS)
WIDTH = KINDS + 8


def kinds() -> np.ndarray:
    """The kind of each byte."""
    out = np.full(256, 4, dtype=np.int64)
    out[128:] = 5
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1], out[32] = 0, 1, 2, 3
    out[list(MARKS)] = 6 + np.arange(len(MARKS))
    return out


KIND = kinds()


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, passages of every text); a text is cut evenly, an empty one is one empty passage."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    count = np.maximum(1, np.rint(sizes / PASSAGE).astype(np.int64))
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    n, m = np.repeat(sizes, count), np.repeat(count, count)
    base = np.repeat(np.cumsum(sizes) - sizes, count)
    begin, end = base + n * inner // m, base + n * (inner + 1) // m
    joined = b"".join(texts)
    flat = np.frombuffer(joined, dtype=np.uint8)
    owner = np.repeat(np.arange(len(begin)), end - begin)
    length = np.maximum(end - begin, 1).astype(np.float64)
    out = np.zeros((len(begin), WIDTH))
    out[:, :KINDS] = np.bincount(owner * KINDS + KIND[flat], minlength=len(begin) * KINDS).reshape(-1, KINDS) / length[:, None]
    if len(flat) > 1:
        same = (flat[1:] == flat[:-1]) & (owner[1:] == owner[:-1])
        kind = KIND[flat]
        for i, event in enumerate((same & (kind[1:] >= 6), same & (kind[1:] < 3), (kind[1:] == 1) & (kind[:-1] == 1) & (owner[1:] == owner[:-1]))):
            out[:, KINDS + i] = np.bincount(owner[1:][event], minlength=len(begin)) / length
    before: set[bytes] = set()
    for i, (s, e, first) in enumerate(zip(begin.tolist(), end.tolist(), (inner == 0).tolist(), strict=True)):
        words = joined[s:e].split()
        now = set(words)
        if words:
            out[i, KINDS + 3] = len(now) / len(words)
            out[i, KINDS + 4] = sum(map(bytes.__eq__, words[1:], words[:-1])) / len(words)
            out[i, KINDS + 5] = len(joined[s:e]) / len(words) / 10
            out[i, KINDS + 6] = 0.0 if first else len(now & before) / len(now)
        before = now
    out[:, KINDS + 7] = np.log1p(n) / 10
    return out, count


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return forward(self.weights, (x - self.mean) / self.scale, count)["p"]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def forward(w: dict[str, np.ndarray], x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    at, bag = np.cumsum(count) - count, np.repeat(np.arange(len(count)), count)
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
    e = (t * g) @ w["w"]
    e = np.exp(e - np.maximum.reduceat(e, at)[bag])
    a = e / np.add.reduceat(e, at)[bag]
    z = np.add.reduceat(a[:, None] * h, at, axis=0)
    return {"at": at, "bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "p": sigmoid(z @ w["c"] + w["d"])}


def gradients(w: dict[str, np.ndarray], x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss over the bags."""
    s = forward(w, x, count)
    dl = (s["p"] - y) / len(y)
    dz = dl[:, None] * w["c"]
    up = dz[s["bag"]]
    da = (up * s["h"]).sum(axis=1)
    de = s["a"] * (da - np.add.reduceat(s["a"] * da, s["at"])[s["bag"]])
    dt, dg = de[:, None] * w["w"] * s["g"] * (1 - s["t"] ** 2), de[:, None] * w["w"] * s["t"] * s["g"] * (1 - s["g"])
    dh = (s["a"][:, None] * up + dt @ w["V"].T + dg @ w["U"].T) * (1 - s["h"] ** 2)
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": s["h"].T @ dt, "U": s["h"].T @ dg, "w": (s["t"] * s["g"]).T @ de, "c": s["z"].T @ dl, "d": dl.sum()}


def start(width: int, hidden: int, gate: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
    return {"W": draw(width, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "d": np.zeros(())}


def fit_bags(x: np.ndarray, count: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, gate: int = GATE, steps: int = STEPS, rate: float = RATE, decay: float = DECAY, seed: int = SEED) -> Model:
    """Adam over all bags at once. Without bags every score is 0.5; with one class scores follow its share."""
    if not len(count):
        w = start(WIDTH, hidden, gate, seed)
        w["c"] = np.zeros(hidden)
        return Model(np.zeros(WIDTH), np.ones(WIDTH), w)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    x = (x - mean) / scale
    w = start(x.shape[1], hidden, gate, seed)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for i in range(1, steps + 1):
        g = gradients(w, x, count, y)
        for k in w:
            step = g[k] + decay * w[k]
            first[k] = 0.9 * first[k] + 0.1 * step
            second[k] = 0.999 * second[k] + 0.001 * step**2
            w[k] = w[k] - rate * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.999**i)) + 1e-8)
    return Model(mean, scale, w)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Model:
    """Learn from docs (doc_id, text) with labels (doc_id, label 0 or 1; nulls are left out, of repeated labels the largest counts).

    At most about `sample` documents are taken, by a hash of doc_id; their labels are few, so they are sent to the documents, which are not shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("double").alias("label"))
    n = known.count()
    chance = int(min(1.0, sample / max(n, 1)) * (1 << 30))
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < chance)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("doc_id long, label double, count long, x binary")
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for s, e in volumes(texts, 1 << 18):
                x, count = features(texts[s:e])
                ends = np.cumsum(count)
                parts = [x[q - c : q].astype(np.float32).tobytes() for q, c in zip(ends, count, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s, e - s), batch.column("label").slice(s, e - s), pa.array(count), pa.array(parts, type=pa.binary())], schema=schema)

    found = sorted(rows.mapInArrow(run, "doc_id long, label double, count long, x binary").collect(), key=lambda r: (r["doc_id"], r["count"], bytes(r["x"])))
    x = np.concatenate([np.frombuffer(r["x"], dtype=np.float32).reshape(-1, WIDTH) for r in found]).astype(np.float64) if found else np.zeros((0, WIDTH))
    return fit_bags(x, np.array([r["count"] for r in found], dtype=np.int64), np.array([r["label"] for r in found]), **options)


def score(docs: DataFrame, model: Model, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Columns `keep` with score (0 to 1) and predicted (1 from the threshold on), from the whole text alone.

    Null and empty texts are one empty passage and get the score of it; equal texts get equal scores. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(c) for c in keep], F.col("text").cast("string").alias("__llm_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores = as_bytes(batch.column("__llm_text")), []
            for s, e in volumes(texts, 1 << 18):
                scores.append(model.score(*features(texts[s:e])))
            p = np.round(np.concatenate(scores), 9) if scores else np.zeros(0)
            own = [i for i, f in enumerate(batch.schema) if f.name != "__llm_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*(batch.schema[i].name for i in own), "score", "predicted"])

    return rows.mapInArrow(run, f"{schema}, score double, predicted int")
