"""Operators on texts against plain Python, on a table of awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import langid, linededup, mixing, packing, quality, simhash, suffixdedup, syncmers


def rows(df):
    return [tuple(r) for r in df.collect()]


def texts_of(edge):
    return [(r["doc_id"], r["text"] or "") for r in edge.collect()]


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = Counter(xxhash.xxh64_intdigest(g.encode(), 42) for g in grams)
    return sum(1 << b for b in range(64) if 2 * sum(n for h, n in hashes.items() if h >> b & 1) > len(grams)) if grams else 0


def test_simhash(edge, none):
    docs = texts_of(edge)
    prints = [fingerprint(t) for _, t in docs]
    label = list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            for j in range(len(docs)):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    low = {x: min((docs[i][0] for i in range(len(docs)) if label[i] == x and docs[i][0] is not None), default=None) for x in label}
    want = Counter((docs[i][0], f"{prints[i]:016x}", low[label[i]]) for i in range(len(docs)))
    assert Counter(rows(simhash.near_duplicates(edge))) == want
    assert rows(simhash.near_duplicates(none)) == []
    kept = simhash.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    found = Counter(r["doc_id"] for r in kept.collect())
    assert found == Counter({d for d, _, c in want if d == c and d is not None}) + Counter({None: 2})


def test_anchors_cover_every_change_of_three_bits():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**64, 300, dtype=np.uint64)
    other = fp.copy()
    for i, n in enumerate(rng.integers(0, 4, 300)):
        for b in rng.choice(64, n, replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    guests, homes = defaultdict(set), defaultdict(set)
    row, key, home = simhash.anchors(other.view(np.int64))
    for r, k in zip(row, key):
        guests[r].add(k)
    row, key, home = simhash.anchors(fp.view(np.int64))
    for r, k, h in zip(row, key, home):
        if h:
            homes[r].add(k)
    assert all(guests[i] & homes[i] for i in range(300))
    assert max(len(g) for g in guests.values()) <= 32


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_simhash_links_of_a_hot_anchor(spark, block):
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(0, 20, 2) for b in range(40, 60, 3)} | {0})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r["node"]: r["label"] for r in simhash.linked(simhash.links(df, block=block), "t").collect()}
    assert len(got) == len(fps) - 1 and len(set(got.values())) == 1


def test_line_dedup(spark, edge, none):
    docs = texts_of(edge)
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    seen = defaultdict(set)
    for d, t in docs:
        for line in t.split("\n"):
            if d is not None and len(key(line)) >= 20:
                seen[key(line)].add(d)
    want = Counter()
    for d, t in docs:
        lines = t.split("\n")
        kept = [x for x in lines if d is None or len(seen[key(x)]) < 3 or max(seen[key(x)]) == d]
        want[(d, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    for batches, fanout in ((1, 2), (4, 2), (5, 3)):
        got = linededup.drop_repeated_lines(edge, batches=batches, fanout=fanout).select("doc_id", "n_lines", "n_dropped", "kept")
        assert Counter(rows(got)) == want
    assert sum(n for (_, _, n, _) in want) >= 2
    clean = linededup.clean_lines(edge)
    assert clean.columns == edge.columns and clean.count() == edge.count()
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect() if r["text"] is not None)
    assert rows(linededup.drop_repeated_lines(none)) == [] and rows(linededup.clean_lines(none)) == []


def test_sorted_runs_know_what_is_new(spark):
    batch = lambda pairs: spark.createDataFrame([(k.encode(), d) for k, d in pairs], "key binary, doc_id long")
    of = lambda names: sorted(bytes(r["key"]).decode() for t in names for r in spark.table(t).collect())
    files = lambda name: spark.table(name).inputFiles()
    with linededup.SortedRuns(spark, fanout=2) as runs:
        runs.add(batch([("a", 1), ("b", 1), ("a", 2)]))
        first = files(runs.runs()[0])
        second = batch([("a", 3), ("c", 3)])
        assert [bytes(r["key"]) for r in runs.unseen(second).collect()] == [b"c"]
        plan = runs.unseen(second)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan
        runs.add(second)  # two runs of level 0 are compacted into one
        assert of(runs.runs()) == ["a", "b", "c"] and [len(x) for x in runs.levels] == [0, 1]
        held = files(runs.runs()[0])
        runs.add(batch([("c", 9), ("d", 9), ("a", 9)]))
        assert files(runs.runs()[1]) == held and of(runs.runs()[:1]) == ["d"]  # the batch has rewritten no old key
        assert of([t for level in runs.updates for t in level]) == ["a", "c"]
        assert first != held and {(bytes(r["key"]), r["n_docs"], r["last_doc"]) for r in runs.totals().collect()} == {(b"a", 4, 9), (b"b", 1, 1), (b"c", 2, 9), (b"d", 1, 9)}
        names = list(runs.tables)
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_batches_follow_the_input(spark, monkeypatch):
    keys = spark.range(1000).select(F.col("id").cast("string").cast("binary").alias("key"), F.explode(F.sequence(F.lit(0), F.col("id") % 4)).alias("doc_id"))
    held = []
    monkeypatch.setattr(linededup, "BATCH_KEYS", 700)
    monkeypatch.setattr(linededup.SortedRuns, "add", lambda self, batch, add=linededup.SortedRuns.add: (held.append(batch), add(self, batch)))
    found = {(bytes(r["key"]), r["last_doc"]) for r in linededup.repeated_keys(keys).collect()}
    assert len(held) == 4 and found == {(str(i).encode(), i % 4) for i in range(1000) if i % 4 >= 2}


def brute_removed(docs, length=50):
    least = {}
    for d, t in docs:
        b = t.encode()
        for p in range(len(b) - length + 1):
            if d is not None:
                w = b[p : p + length]
                least[w] = min(least.get(w, d), d)
    for d, t in docs:
        b, gone = t.encode(), set()
        for p in range(len(b) - length + 1):
            if d is not None and least[b[p : p + length]] < d:
                gone.update(range(p, p + length))
        kept = bytes(x for i, x in enumerate(b) if i not in gone)
        yield d, len(b), len(gone), sum(1 for i in gone if i - 1 not in gone), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("most", [suffixdedup.MOST, 2])
def test_suffix_dedup(spark, edge, none, most):
    assert Counter(rows(suffixdedup.remove_repeats(edge, most=most))) == Counter(brute_removed(texts_of(edge)))
    assert rows(suffixdedup.remove_repeats(none)) == []
    rng = np.random.default_rng(1)
    words = ["ab", "ba", "aab", "bab "]
    docs = [(i, "".join(rng.choice(words, rng.integers(5, 90)))) for i in range(60)]
    docs += [(100 + i, docs[i][1][: 40 + i] + "zz" + docs[59 - i][1]) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = Counter(brute_removed(docs))
    assert Counter(rows(suffixdedup.remove_repeats(df, most=most))) == want and sum(x[2] for x in want) > 1000


def test_deep_shallow_sort_orders_suffixes():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, (500, 50)).astype(np.uint8)
    text[:, :20] = text[0, :20]
    text[250:] = text[rng.integers(0, 60, 250)]
    group = rng.integers(0, 3, 500)
    order, run = suffixdedup.multikey_sort(group, text, 16)
    keys = [(group[i], text[i, :16].tobytes()) for i in order]
    assert keys == sorted(keys) and all((a == b) == (r == s) for a, b, r, s in zip(keys, keys[1:], run, run[1:]))
    row, leaf = suffixdedup.blind_tries(text[order], run)
    found = defaultdict(list)
    for r, x in zip(row, leaf):
        found[x].append((group[order][r], text[order][r].tobytes()))
    assert all(len(set(x)) == 1 and len(x) > 1 for x in found.values())
    every = Counter((g, t.tobytes()) for g, t in zip(group, text))
    assert Counter({k: n for k, n in every.items() if n > 1}) == Counter(x for xs in found.values() for x in xs)


def test_long_texts_are_cut_without_losing_windows(monkeypatch):
    monkeypatch.setattr(suffixdedup, "CHUNK", 512)
    text = bytes(np.random.default_rng(0).integers(97, 101, 3000).astype(np.uint8))
    seen = [(place + i) for pieces in suffixdedup.segments([b"short", text], 50) for _, place, piece in pieces for i in range(len(piece) - 49)]
    assert sorted(set(seen)) == list(range(len(text) - 49)) and len(seen) == len(set(seen))


def test_language(edge, none):
    docs = edge.where("doc_id IS NULL OR doc_id < 1000")
    profiles = langid.prototypes(docs.select("doc_id", "lang", "text"))
    assert sorted(profiles) == ["de", "en"]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(docs, profiles, ["doc_id"]).collect()]
    assert len(got) == docs.count()
    by = {d: (x, s) for d, x, s in got if d is not None}
    assert by[4] == by[5] == by[6] == ("und", 0.0)
    assert by[13][0] == "de" and by[14][0] == "en" and by[7] == by[8] and by[7][0] == "de"
    assert all(0 <= s <= 1 for _, _, s in got)
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns
    assert not {4, 5, 6} & {r["doc_id"] for r in kept.collect()} and {1, 7, 9, 13, 14} <= {r["doc_id"] for r in kept.collect()}
    assert langid.prototypes(none.select("doc_id", "lang", "text")) == {}
    assert rows(langid.predict(none, {}, ["doc_id"])) == [] and langid.keep_known(none).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, {}, ["doc_id"]).collect()} == {"und"}


def test_bundles_are_bound_and_permuted_letters():
    v, has = langid.bundles(["Ab", "", "!!"], 64, 7)
    letter = lambda c: langid.letter_vector(ord(c), 64, 7).astype(int)
    bind = lambda a, b, c: np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    assert (v[0] == bind(" ", "a", "b") + bind("a", "b", " ")).all()
    assert has.tolist() == [True, False, False] and not v[1:].any()


def test_mixing(spark, edge, none):
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), (None, 1.0), ("c", float("nan")), ("a", 1.0)], "source string, weight double")
    rates = {r["source"]: r for r in mixing.target_rates(edge, weights, total=120.0).collect()}
    assert rates["c"]["rate"] == 0 and abs(sum(r["rate"] * r["n_docs"] for r in rates.values()) - 120) < 1e-9
    assert abs(rates["b"]["weight"] - 0.5) < 1e-12
    out = mixing.mix(edge, weights, total=120.0)
    assert out.columns == edge.columns
    first = Counter(rows(out.select("doc_id", "source")))
    assert first == Counter(rows(mixing.mix(edge.repartition(7), weights, total=120.0).select("doc_id", "source")))
    assert not any(s == "c" for _, s in first) and 80 <= sum(first.values()) <= 160
    assert mixing.mix(none).count() == 0
    u = (np.arange(100_000) + 0.5) / 100_000
    for mean in (0.05, 1.0, 30.0, 900.0):
        n = mixing.invert(u, np.full(len(u), mean))
        assert abs(n.mean() - mean) < 0.01 * mean + 0.001 and abs(n.var() - mean) < 0.02 * mean + 0.001
    assert mixing.invert(np.array([0.5]), np.array([0.0])).tolist() == [0]


def test_packing(edge, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(edge.where("doc_id IS NOT NULL AND doc_id <> 12").coalesce(2), path, with_ids=True).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for d, t in texts_of(edge):
        if d in (None, 12):
            continue
        want = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        found = sorted(pieces[d], key=lambda r: r["start"])
        assert [x for r in found for x in r["ids"]] == want
        assert all(r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) for r in found)
        assert [r["start"] for r in found] == np.cumsum([0, *(r["length"] for r in found[:-1])]).tolist()
    for b in bins.values():
        b = sorted(b, key=lambda r: r["offset"])
        assert [r["offset"] for r in b] == np.cumsum([0, *(r["length"] for r in b[:-1])]).tolist() and sum(r["length"] for r in b) <= 4096
    assert rows(packing.pack(none, path)) == []
    assert packing.pack(edge, path).where("doc_id = 12").count() == 2


def test_words_give_the_ids_of_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Don't  STOP, it's 12.5% of\x1cthat", "<|endoftext|> and <|ENDOFTEXT|>x", "é É ́ Σας ΣΑΣ", "", " \n\t", "日本語 テキスト ﬁ"]
    whole = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in packing.Words(path).encode([t.encode() for t in texts])] == whole


def test_different_words(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [b"", b" ", b"one", b"a bb a\x0bccc\x0ca", b"x" * 16 + b" " + b"x" * 17 + b" " + b"x" * 17 + b" " + b"x" * 18, bytes(rng.choice(list(b"ab \n"), 5000).astype(np.uint8)), b"a\x00 a a\x00\x00"]
    for text in texts:
        begin, end, names, kind = packing.different_words(text)
        assert [names[k] for k in kind] == text.split() == [text[b:e] for b, e in zip(begin, end)]
        assert len(names) == len(set(names))
    monkeypatch.setattr(packing.xxhash, "xxh64_intdigest", lambda x: 7)
    long = [b"y" * 20, b"z" * 20, b"y" * 20]
    _, _, names, kind = packing.different_words(b" ".join(long))
    assert [names[k] for k in kind] == long and len(names) == 2


def test_cuts_fill_their_classes():
    for n in (1, 2, 127, 128, 129, 1000, 2047, 2049, 3000, 4095, 4096, 4097, 100_000):
        found = packing.cuts(n)
        assert sum(x for x, _ in found) == n
        assert all(x * max(j, 1) <= 4096 and (j == 0 or x >= packing.FILL * (4096 // j) - 1) for x, j in found)


def test_fingerprints(spark, edge, none):
    docs = sorted(((d, t) for d, t in texts_of(edge) if d is not None and d != 12), key=lambda x: -x[0])
    df = edge.where("doc_id IS NOT NULL AND doc_id <> 12")
    for part in (64 << 20, 200):
        got = {r["doc_id"]: r for r in syncmers.edited_likeness(df, part_bytes=part).collect()}
        assert len(got) == len(docs)
        for i, (d, t) in enumerate(docs):
            after = docs[(i + 1) % len(docs)][1]
            edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
            r = got[d]
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            mine = syncmers.sketch(syncmers.points_of(t))
            assert r["fingerprint"] == syncmers.written(mine) and r["near_next"] == syncmers.likeness(mine, syncmers.sketch(syncmers.points_of(after)))
            assert 0 <= r["near_edited"] <= 1 and (len(t) < 60 or r["near_edited"] > 0.35)
    assert got[7]["fingerprint"] == got[8]["fingerprint"] and got[8]["near_next"] == 1.0
    assert syncmers.edited_likeness(edge).count() == edge.count()
    assert rows(syncmers.edited_likeness(none)) == [] and rows(syncmers.fingerprints(none)) == []
    one = syncmers.edited_likeness(spark.createDataFrame([(1, "alone in this table of one row")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_syncmers_are_free_of_context():
    text = "".join(np.random.default_rng(4).choice(list("abcdefgh "), 600))
    k, s = syncmers.LEVELS[0][1:]
    value = lambda part: syncmers.windows(syncmers.points_of(part), s)
    want = [i for i in range(len(text) - k + 1) if (v := value(text[i : i + k])).argmin() == 0 or v.min() == v[-1]]
    places, hashes = syncmers.syncmers(syncmers.points_of(text))
    assert places.tolist() == want
    moved, same = syncmers.syncmers(syncmers.points_of("xyz" + text))
    assert set(zip((places + 3).tolist(), hashes.tolist())) <= set(zip(moved.tolist(), same.tolist()))
    assert syncmers.read(syncmers.written(syncmers.sketch(syncmers.points_of(text))))[0].tolist() == syncmers.sketch(syncmers.points_of(text))[0].tolist()


def test_quality(spark, edge, none):
    good = [f"The {w} house stands near a river, and its people are calm. They read books in the evening. " * 4 for w in "old new red blue tall small wide long".split()]
    bad = [f"BUY {w} NOW!!! $$$ %%% CLICK HERE ### " * 9 for w in "GOLD CARS PILLS LOANS SHOES BAGS RINGS FAME".split()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(50, None), (51, ""), (None, "x"), (0, good[0])], "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("label", F.lit(2))
    labels = spark.createDataFrame([(i, 1) for i in range(8)] + [(8 + i, 0) for i in range(8)] + [(None, 1), (3, None), (4, 1)], "doc_id long, label int")
    model = quality.fit(docs, labels, steps=150)
    got = {r["doc_id"]: r for r in quality.score(docs, model, ["doc_id"]).collect()}
    assert all(got[i]["score"] > 0.9 and got[i]["predicted"] == 1 for i in range(8)) and all(got[8 + i]["score"] < 0.1 and got[8 + i]["predicted"] == 0 for i in range(8))
    assert got[50]["score"] == got[51]["score"] and 0 <= got[50]["score"] <= 1
    empty = quality.fit(none, labels.limit(0))
    assert rows(quality.score(none, empty, ["doc_id"])) == []
    assert {r["score"] for r in quality.score(edge.select("doc_id", "text"), empty, ["doc_id"]).collect()} == {0.5}


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(6)
    x, count, y = rng.standard_normal((9, 5)), np.array([2, 4, 1, 2]), np.array([1.0, 0, 1, 0])
    w = quality.start(5, 4, 3, 1)
    loss = lambda: float(-np.mean(y * np.log(p := quality.forward(w, x, count)["p"]) + (1 - y) * np.log(1 - p)))
    g = quality.gradients(w, x, count, y)
    for k, v in w.items():
        flat = v.reshape(-1) if v.ndim else v[None]
        i = int(rng.integers(flat.size))
        old = flat[i]
        sides = []
        for d in (1e-5, -1e-5):
            flat[i] = old + d
            if not v.ndim:
                w[k] = flat[0].reshape(())
            sides.append(loss())
        flat[i] = old
        if not v.ndim:
            w[k] = flat[0].reshape(())
        assert abs((sides[0] - sides[1]) / 2e-5 - np.asarray(g[k]).reshape(-1)[i]) < 1e-6
