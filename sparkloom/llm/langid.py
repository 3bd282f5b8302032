"""Language identification by hyperdimensional profiles.

A letter is a random vector of +1 and -1. An n-gram of letters binds its letters, each permuted by its place: for a trigram
abc the vector rot2(a) * rot1(b) * c. A document bundles (adds) the vectors of its n-grams; a language prototype bundles the
unit vectors of its documents. The prediction is the prototype of greatest cosine.

Bundling is linear, so a document's n-grams are counted first and the counts are multiplied with the n-gram vectors in
blocks: time follows the text and memory stays bounded. Letters are what Unicode calls letters, in lower case; any run of
other characters is one space, and a document has a space at either end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.llm.common import give_back, record, schema_of, small_batches

SIZE = 2048
SEED = 7
#: Documents per language that the prototypes are learned from, about; chosen by a hash of doc_id.
SAMPLE = 5000
#: Code points that are counted at a time, and n-grams that are multiplied at a time.
VOLUME, GRAMS = 1 << 19, 2048
#: Unit vectors are rounded to this many steps, so that sums do not depend on their order.
STEPS = 4096
#: Documents whose best cosine is not above this are rejected by the filter: two deviations of the cosine of vectors that have nothing in common.
MIN_SCORE = 2 / SIZE**0.5


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter, 32 (a space) where it is none."""
    out = np.full(0x110000, 32, dtype=np.int32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            out[point] = ord(low[0])
    return out


@lru_cache(maxsize=200_000)
def letter_vector(point: int, size: int, seed: int) -> np.ndarray:
    return (np.random.Generator(np.random.PCG64([seed, point])).integers(0, 2, size, dtype=np.int8) * 2 - 1).astype(np.int8)


def gram_vectors(a: np.ndarray, b: np.ndarray, c: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Bound trigrams of code points, one row each."""
    points = np.unique(np.concatenate([a, b, c]))
    base = np.stack([letter_vector(int(p), size, seed) for p in points])
    place = {2: np.roll(base, 2, axis=1), 1: np.roll(base, 1, axis=1)}
    return place[2][np.searchsorted(points, a)] * place[1][np.searchsorted(points, b)] * base[np.searchsorted(points, c)]


def trigrams(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(text, a, b, c, count) of the distinct trigrams of each text, and which texts hold a letter."""
    table = letters()
    parts, owners = [], []
    for i, text in enumerate(texts):
        points = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        parts += [np.array([32], dtype=np.int32), points, np.array([32, 32], dtype=np.int32)]
        owners.append(len(points) + 3)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    owner = np.repeat(np.arange(len(texts)), owners)
    keep = np.ones(len(flat), dtype=bool)
    keep[1:] = (flat[1:] != 32) | (flat[:-1] != 32) | (owner[1:] != owner[:-1])
    flat, owner = flat[keep], owner[keep]
    if len(flat) < 3:
        return (np.zeros(0, dtype=np.int64),) * 5
    inside = (owner[2:] == owner[:-2]) & (flat[1:-1] != 32)
    alphabet, code = np.unique(flat, return_inverse=True)
    n = len(alphabet)
    # Texts are few and a slice holds few different letters, so the key fits 63 bits.
    key = ((owner[2:][inside] * n + code[:-2][inside]) * n + code[1:-1][inside]) * n + code[2:][inside]
    key, count = np.unique(key, return_counts=True)
    c, rest = key % n, key // n
    b, rest = rest % n, rest // n
    a, who = rest % n, rest // n
    return who, alphabet[a], alphabet[b], alphabet[c], count


def bundles(texts: list[str], size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text, and whether it has a letter (a text without is the zero vector)."""
    out = np.zeros((len(texts), size), dtype=np.float32)
    has = np.zeros(len(texts), dtype=bool)
    who, a, b, c, count = trigrams(texts)
    if len(who):
        has[np.unique(who)] = True
        gram = (a.astype(np.int64) << 42) | (b.astype(np.int64) << 21) | c
        names, place = np.unique(gram, return_inverse=True)
        mask = (1 << 21) - 1
        for i in range(0, len(names), GRAMS):
            part = names[i : i + GRAMS]
            vectors = gram_vectors(part >> 42, (part >> 21) & mask, part & mask, size, seed).astype(np.float32)
            pick = (place >= i) & (place < i + GRAMS)
            counts = np.zeros((len(texts), len(part)), dtype=np.float32)
            counts[who[pick], place[pick] - i] = count[pick]
            out += counts @ vectors
    return out, has


def slices(texts: list[str], volume: int = VOLUME, most: int = 256) -> Iterator[list[str]]:
    """Texts by about `volume` code points and at most `most` texts."""
    held, total = [], 0
    for text in texts:
        if held and (total + len(text) > volume or len(held) >= most):
            yield held
            held, total = [], 0
        held.append(text)
        total += len(text)
    if held:
        yield held


def vectors_of(texts: list[str], size: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bundles of slices of texts; a text longer than a slice is bundled piece by piece."""
    for group in slices(texts):
        if len(group) == 1 and len(group[0]) > VOLUME:
            total, any_letter = np.zeros((1, size), dtype=np.float64), np.zeros(1, dtype=bool)
            step = VOLUME
            for i in range(0, len(group[0]), step):
                # Two characters of overlap carry the n-grams over the cut; a cut adds no more than a few n-grams of a million.
                v, h = bundles([group[0][max(0, i - 2) : i + step]], size, seed)
                total += v
                any_letter |= h
            yield total.astype(np.float32), any_letter
        else:
            yield bundles(group, size, seed)


def _sums(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("lang string, at int, part long")
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts, done = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], 0
            for v, has in vectors_of(texts, size, seed):
                norm = np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
                unit = np.rint(np.divide(v * float(STEPS), norm, out=np.zeros(v.shape), where=norm > 0)).astype(np.int64)
                for i in np.flatnonzero(has):
                    total[langs[done + i]] = total.get(langs[done + i], 0) + unit[i]
                done += len(has)
        for lang, value in total.items():
            yield record(schema, [lang] * size, np.arange(size, dtype=np.int32), value)
    return run


def prototypes(labelled: DataFrame, size: int = SIZE, seed: int = SEED, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """A prototype per language from rows (doc_id, lang, text) with a lang, about `sample` documents of each.

    A document is in the sample by a hash of its doc_id and text length, so the choice does not depend on partitions. What comes back to the
    driver is one vector per language.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return {}
    limit = F.create_map(*[F.lit(x) for lang, count in n.items() for x in (lang, min(1.0, sample / count))])
    chance = F.pmod(F.xxhash64("doc_id", F.length("text"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    parts = rows.where(chance < limit[F.col("lang")]).select("lang", "text").mapInArrow(give_back(_sums(size, seed)), "lang string, at int, part long")
    out: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "at").agg(F.sum("part").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("v")).collect():
        value = np.array([x["v"] for x in r["v"]], dtype=np.float64)
        if np.linalg.norm(value) > 0:
            out[r["lang"]] = value / np.linalg.norm(value)
    return out


def _predict(profiles: dict[str, np.ndarray], size: int, seed: int):
    names = sorted(profiles)
    matrix = np.stack([profiles[x] for x in names]).T if names else np.zeros((size, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for v, has in vectors_of([t or "" for t in batch.column("__llm_text").to_pylist()], size, seed):
                norm = np.linalg.norm(v.astype(np.float64), axis=1)
                cos = v.astype(np.float64) @ matrix / np.maximum(norm, 1e-12)[:, None]
                best = cos.argmax(axis=1) if names else np.zeros(len(has), dtype=int)
                for i, ok in enumerate(has):
                    langs.append(names[best[i]] if ok and names else "und")
                    scores.append(float(min(1.0, max(0.0, cos[i, best[i]]))) if ok and names else 0.0)
            keep = [i for i, f in enumerate(batch.schema) if f.name != "__llm_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64())],
                                             names=[*(batch.schema[i].name for i in keep), "lang_pred", "score"])
    return run


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], keep: list[str], size: int = SIZE, seed: int = SEED) -> DataFrame:
    """Columns `keep` with lang_pred and score (the cosine, 0 to 1) from the whole text alone.

    `und` with score 0 for a text that is null, empty or without a letter, and where no language was learned. Equal cosines go
    to the first language by name; equal texts get equal rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(c) for c in keep], F.col("text").cast("string").alias("__llm_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(give_back(_predict(profiles, size, seed)), f"{kinds}, lang_pred string, score double")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into a fold; a null id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE, size: int = SIZE, seed: int = SEED, sample: int = SAMPLE) -> DataFrame:
    """docs without those whose language cannot be told: `und`, or a best cosine that is not above min_score. Columns are those of docs.

    Where no row has a lang to learn from, an error is raised rather than all rows dropped; an empty table stays empty.
    """
    profiles = prototypes(docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")), size, seed, sample)
    if not profiles and not docs.isEmpty():
        raise ValueError("no document has a language to learn from")
    names = {c: f"__llm_{i}" for i, c in enumerate(docs.columns)}  # a column of docs may have any name
    other = docs.select(*[F.col(c).alias(n) for c, n in names.items()], "text")
    found = predict(other, profiles, list(names.values()), size, seed).where((F.col("lang_pred") != "und") & (F.col("score") > min_score))
    return found.select(*[F.col(n).alias(c) for c, n in names.items()])
