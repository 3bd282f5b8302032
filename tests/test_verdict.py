"""Edges that small, clean, time-ordered tables cannot show: nulls, infinities, hot keys, ties, slices, late files."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from sparkloom.operators import explore, graph, healthcare, marketing, metrics, models, ordered, quantiles, retrieval, splits, transforms
from sparkloom.session import new_scratch_path
from sparkloom.sources import readers
from sparkloom.streaming import streams


@pytest.fixture(scope="module")
def hot(spark):
    """One key with most rows, ties and nulls in the order column, text as second order."""
    rows = [(0, None if i % 11 == 0 else i % 7, f"t{i:03d}", i, float(i % 5)) for i in range(150)]
    rows += [(1 + i % 3, None if i % 5 == 0 else i, f"u{i:03d}", 1000 + i, float(i)) for i in range(30)]
    return spark.createDataFrame(rows, "k int, o int, s string, id int, v double")


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("before", ["through", "rows", "range"])
def test_slices_change_nothing(hot, descending, before):
    specs = {"n": ordered.Spec("count", F.col("v")), "t": ordered.Spec("sum", F.col("v")), "hi": ordered.Spec("max", F.col("v"))}
    if before != "range":
        specs["z"] = ordered.Spec("last", F.when(F.col("v") > 1, F.col("v")))
    run = lambda size: sorted(map(tuple, ordered.running(hot, ["k"], ["o", "s", "id"], specs, before=before, descending=descending, rows_per_slice=size).select("id", *specs).collect()))
    assert run(7) == run(10_000)


def test_slices_grow_and_cut_ties_and_text(spark):
    df = spark.range(3000).select(F.lit("same").alias("a"), F.format_string("key-%05d", "id").alias("b"))
    sliced = ordered.add_slice(df, ["a", "b"], ordered.slice_count(df, 1))
    sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
    assert len(sizes) > 2000 and max(sizes) < 50
    numbers = ordered.row_numbers(df, [], ["a", "b"], rows_per_slice=500)
    assert numbers.where("rn - 1 <> cast(substr(b, 5) as int)").count() == 0


def test_ranges_of_large_integers(spark):
    big = 2**53
    df = spark.createDataFrame([(big,), (big + 1,), (big + 2,)], "x long")
    for size in (2, 100):
        got = ordered.running(df, [], ["x"], {"n": ordered.Spec("count", F.lit(1))}, before="range", rows_per_slice=size)
        assert [r["n"] for r in got.orderBy("x").collect()] == [0, 1, 2]


def test_quantiles_end_on_infinity_and_nan(spark):
    values = [float("nan"), float("inf"), float("-inf"), None] + [float(i) for i in range(1000)]
    df = spark.createDataFrame([(v, 1.0 if v is None else v) for v in values], "a double, b double")
    got = quantiles.exact_quantiles(df, ["a", "b"], [0.0, 0.25, 0.5, 1.0], buckets=8, finish_at=5)
    finite = [float("-inf"), *map(float, range(1000)), float("inf")]
    at = lambda xs, p: xs[math.floor(p * (len(xs) - 1))] + ((xs[math.ceil(p * (len(xs) - 1))] - xs[math.floor(p * (len(xs) - 1))]) * (p * (len(xs) - 1) % 1) if p * (len(xs) - 1) % 1 else 0)
    assert got["a"] == [at(finite, p) for p in (0.0, 0.25, 0.5, 1.0)]
    assert got["b"] == [at(sorted([1.0, *finite]), p) for p in (0.0, 0.25, 0.5, 1.0)]
    assert quantiles.exact_quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}
    ties = spark.range(5000).select(F.when(F.col("id") < 4000, 7.0).otherwise(F.col("id").cast("double")).alias("a"))
    assert quantiles.exact_quantiles(ties, ["a"], [0.1, 0.5, 0.9], finish_at=2)["a"] == [7.0, 7.0, 4499.1]


def test_code_groups_of_different_length(spark):
    codes = spark.createDataFrame([(1, "I21"), (1, "I22"), (1, "C50"), (2, "X1")], "p int, c string")
    assert [tuple(r) for r in healthcare.comorbidity_index(codes, "p", "c", {"I": 1, "C50": 3}).collect()] == [(1, 4)]


def test_wide_categories_become_a_vector(spark):
    df = spark.range(300).select(F.format_string("c%03d", F.col("id") % 250).alias("c"))
    with pytest.raises(ValueError):
        transforms.one_hot_encoding(df, "c")
    narrow = transforms.one_hot_vector(df.limit(3), "c").apply(df.limit(3))
    assert narrow.columns == ["c_onehot"] and {r[0].size for r in narrow.collect()} == {2}  # the same column for few categories
    out = transforms.one_hot_vector(df, "c").apply(df.unionByName(spark.createDataFrame([(None,), ("new",)], "c string")))
    assert out.columns == ["c_onehot"] and out.count() == 302
    sums = out.select(F.expr("1")).count(), sum(int(r[0].values.sum()) for r in out.collect())
    assert sums[1] == 300 - 2  # the first category, twice in the table, is all zeros


def test_plan_raises_unless_told_to_skip(spark):
    df = spark.range(3).select(F.col("id").cast("double").alias("x"))
    with pytest.raises(KeyError):
        transforms.fit_plan(df, {"x": ["nothing_here"]})
    assert transforms.fit_plan(df, {"x": ["nothing_here"]}, on_error="skip").log.first()["status"] == "error"


def test_negative_pairs_are_enough_new_and_known(spark):
    pairs = spark.createDataFrame([(u, 10 * i) for u in range(6) for i in range(u + 1)] + [(9, 10 * i) for i in range(8)], "u int, i int")
    items = spark.createDataFrame([(10 * i,) for i in range(8)], "i int")
    for size in (3, 1000):
        got = [tuple(r) for r in splits.negative_pairs(pairs, "u", "i", items, rows_per_slice=size).collect()]
        assert len(got) == len(set(got)) and not set(got) & {tuple(r) for r in pairs.collect()}
        assert {u: sum(1 for x, _ in got if x == u) for u in range(6)} == {u: min(u + 1, 8 - u - 1) for u in range(6)}
        assert not [u for u, _ in got if u == 9] and all(i in range(0, 80, 10) for _, i in got)


def test_poisson_steps_reach_the_end():
    assert abs(splits.POISSON[0] - math.exp(-1)) < 1e-15 and len(splits.POISSON) > 15 and splits.POISSON[-1] > 1 - 1e-15


def test_cohorts_have_every_period(spark):
    df = spark.createDataFrame([(1, 2000), (1, 2009), (2, 2000), (2, 2001)], "c int, y int")
    got = {tuple(r) for r in marketing.cohorts(df, "c", F.col("y"), lambda a, b: a - b).collect()}
    assert got == {(2000, 2, 0, 2, 1.0), (2000, 2, 1, 1, 0.5), (2000, 2, 9, 1, 0.5)}


@pytest.mark.parametrize("size", [5, 1000])
def test_concordance_by_levels(spark, size):
    rows = [(i * 7 % 23, int(i % 3 > 0), i * 5 % 11) for i in range(60)] + [(None, 1, 3), (4, None, 2)]
    pairs = [(a, b) for a in rows for b in rows if a[1] == 1 and None not in (a[0], b[0]) and a[0] < b[0]]
    want = sum(1.0 if a[2] > b[2] else 0.5 if a[2] == b[2] else 0.0 for a, b in pairs)
    got = metrics.concordance(spark.createDataFrame(rows, "t int, e int, r int"), "t", "e", "r", rows_per_slice=size).first()
    assert got["pairs"] == len(pairs) and got["c_index"] == round(want / len(pairs), 4)


def test_vif_is_infinite_for_a_determined_column(spark):
    df = spark.range(200).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("d")).withColumn("c", F.col("a") + F.col("b"))
    got = {r["column"]: r["vif"] for r in explore.vif(df, ["a", "b", "c", "d"]).collect()}
    assert math.isinf(got["a"]) and math.isinf(got["b"]) and math.isinf(got["c"]) and got["d"] < 1.2


def test_keyword_search_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_CELLS", 4)
    monkeypatch.setattr(retrieval, "TASK_CELLS", 40)
    docs = [(i, " ".join(["the"] * (i % 4 + 1) + [f"w{i % 5}", f"x{i % 3}"])) for i in range(40)] + [(100, None), (101, "")]
    queries = [(1, "the w1"), (2, "x2 x2 the w3"), (3, "nothing known"), (4, ""), (5, "w0")]
    d, q = spark.createDataFrame(docs, "id int, t string"), spark.createDataFrame(queries, "q int, qt string")
    got = {(r["q"], r["id"]): r["score"] for r in retrieval.bm25(d, "id", "t", q, "q", "qt", 100).collect()}
    split = {i: (t or "").split() for i, t in docs}
    n, avg = len(docs), sum(map(len, (t for t in split.values()))) / len(docs)
    counted = retrieval.tokens(F.col("t"))
    stats = d.select(F.size(counted).alias("n")).agg(F.avg("n")).first()[0]
    df = lambda w: sum(w in t for t in split.values())
    for qid, text in queries:
        for i, t in split.items():
            s = sum(math.log(1 + (n - df(w) + 0.5) / (df(w) + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / stats)) for w in set(text.split()) if w in t)
            assert abs(got.get((qid, i), 0.0) - s) < 1e-5
    top = retrieval.bm25(d, "id", "t", q, "q", "qt", 3).groupBy("q").count().collect()
    assert {r["q"]: r["count"] for r in top} == {1: 3, 2: 3, 5: 3}
    cos = {(r["q"], r["id"]): r["score"] for r in retrieval.tfidf_similarity(d, "id", "t", q, "q", "qt", 100).collect()}
    idf = lambda w: math.log(n / df(w))
    vector = lambda t: {w: t.count(w) * idf(w) for w in set(t) if df(w)}
    for qid, text in queries:
        a = vector(text.split())
        for i, t in split.items():
            b = vector(t)
            size = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
            assert abs(cos.get((qid, i), 0.0) - (sum(a[w] * b.get(w, 0) for w in a) / size if size else 0)) < 1e-5


def test_census_rules(spark):
    def track(names):
        r = readers.census(spark.createDataFrame([(f"/d/{x}",) for x in names], "path string")).first()
        return r["track"], r["subtype"], r["confidence"], r["ambiguous"]

    assert track(["a.txt"] * 7 + ["b.pdf"] + ["c.csv"] * 2) == ("rag", "text-rag", 0.85, False)
    assert track(["a.markdown"] * 7 + ["train.csv"]) == ("dl", "nlp-classification", 0.75, False)
    assert track(["a.png"] * 6 + ["a.md"] * 4) == ("dl", "multimodal", 0.7, True)
    assert track(["a.xls"] * 6 + ["a.webm"] * 4) == ("tabular", None, 0.85, False)
    assert track(["a.aac"] * 2 + ["a.xls"]) == ("dl", "audio", 0.85, False)
    assert track(["a.csv", "a.png", "a.wav", "a.zip"]) == ("tabular", None, 0.4, True)


def events(spark, parts):
    """Files that arrive one after another."""
    import time

    path = new_scratch_path(spark, "arrivals")
    for rows in parts:
        df = spark.createDataFrame([(i, u, f"2024-01-01 00:{m:02d}:00", v) for i, u, m, v in rows], "id int, u int, t string, v double")
        df.withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return streams.file_stream(spark, path, files_per_trigger=1)


def test_gate_counts_repeats_across_batches(spark):
    e = events(spark, [[(1, 1, 0, 1.0), (1, 1, 0, 1.0), (2, 1, 1, 9.0)], [(2, 1, 1, 9.0), (3, 1, 2, 9.0)]])
    r = streams.gate_batches(e, "ts", "id", "10 minutes", {"large": F.col("v") > 5}).agg(F.sum("n_rows"), F.sum("duplicates"), F.sum("large")).first()
    assert tuple(r) == (5, 2, 2)


def test_running_anomalies_with_shuffled_frames(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(i, 1, i, float(i * i % 17)) for i in range(50)]
        e = events(spark, [rows[::-1][::2] + rows[::-1][1::2]])
        got = {r["id"]: r["z"] for r in streams.drain(streams.running_anomalies(e, "u", "ts", "id", "v"))[0].collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for i in range(2, 50):
        seen = [v for *_, v in rows[:i]]
        mean = sum(seen) / i
        sd = math.sqrt(sum((x - mean) ** 2 for x in seen) / (i - 1))
        assert (got[i] is None) == (sd <= 1e-6) and (sd <= 1e-6 or abs(got[i] - (rows[i][3] - mean) / sd) < 1e-6)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from sparkloom.session import scratch_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError):
        scratch_dir(Cluster())


def test_isolation_takes_its_sample_and_scores_all(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") == 7, 50.0).otherwise(F.randn(3)).alias("a"), F.when(F.col("id") % 100 == 1, None).otherwise(F.randn(4)).alias("b"))
    got = models.isolation_scores(df, "id", ["a", "b"], trees=20, sample=1000)
    assert got.count() == 2000 and 7 in [r["id"] for r in got.orderBy(F.desc("score")).limit(60).collect()]


def test_cores_of_any_depth(spark):
    """A path of 300 nodes peels from its ends, one pair a round; core numbers against plain peeling."""
    path = spark.range(149).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.k_core(path.limit(30), 2).collect() == []
    rng = random.Random(4)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(120)} | {(50, 51), (51, 52), (50, 52), (0, 99)})
    left, core = set(edges), {}
    for k in range(1, 40):
        while True:
            degree = Counter(x for e in left for x in e)
            low = {x for x, d in degree.items() if d < k}
            if not low:
                break
            left = {e for e in left if not low & set(e)}
        for x in Counter(x for e in left for x in e):
            core[x] = k
    got = {r["node"]: r["core"] for r in graph.core_numbers(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == core


def test_density_with_an_outlier(spark):
    """Cells follow the bandwidth, so one far value does not flatten the rest."""
    df = spark.range(2000).select(((F.col("id") % 100) / 100).alias("v")).unionByName(spark.createDataFrame([(500.0,)], "v double"))
    rows = explore.density_curve(df, "v", grid=2000).collect()
    values = np.array([r["v"] for r in df.collect()])
    band = values.std(ddof=1) * len(values) ** -0.2
    for r in rows[:: 97]:
        want = np.exp(-0.5 * ((r["x"] - values) / band) ** 2).sum() / band / len(values) / (2 * np.pi) ** 0.5
        assert abs(r["density"] - want) < 0.02 * want + 2e-6
