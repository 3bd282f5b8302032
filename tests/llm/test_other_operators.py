"""Vectors, archives, shared helpers, the pipeline and the registered SQL."""

import base64
import hashlib
import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import common, neardup, warc
from sparkloom.session import new_scratch_path

DATA = "/root/testdata/sf0.001"
VECTOR = "vec_id long, embedding array<float>, label int"


def brute_links(rows):
    fine = [i for i, (v, e, l) in enumerate(rows) if v is not None and l is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    links = {i: set() for i in range(len(rows))}
    for i in fine:
        for j in fine:
            a, b = (np.array(rows[k][1], dtype=np.float32).astype(np.float64) for k in (i, j))
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                links[i].add(j)
    low = [r[0] for r in rows]
    for _ in rows:
        for i in links:
            for j in links[i]:
                low[i] = min(low[i], low[j])
    return Counter((v, len(links[i]), low[i], None if v is None else v == low[i]) for i, (v, _, _) in enumerate(rows))


@pytest.mark.parametrize("block", [7, 2048])
def test_vectors(spark, block):
    rng = np.random.default_rng(8)
    rows, base = [], rng.standard_normal((6, 16))
    for i in range(120):
        near = base[i % 6] + rng.standard_normal(16) * rng.choice([0.02, 0.04, 0.08])
        rows.append((i, [float(x) for x in near.astype(np.float32)], i % 2))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, [x * 3 for x in rows[0][1]], 0)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [None, 1.0], 0), (303, [float("nan"), 1.0], 0), (304, [float("inf"), 1.0], 0), (305, [], 0), (306, rows[0][1], None), (None, rows[0][1], 0), (307, [1.0, 2.0], 0), (308, [1e-30, 2e-30], 0)]
    df = spark.createDataFrame(rows, VECTOR).withColumn("node", F.lit("clash")).withColumn("n", F.lit("clash"))
    out = neardup.near_duplicates(df, block=block)
    assert Counter(tuple(r) for r in out.collect()) == brute_links(rows)
    assert neardup.near_duplicates(df.limit(0)).collect() == []


def test_archives(spark):
    pages = [(i, f"http://example.com/{i}", f"<html>{'page ' * (i % 7 + 1)}{'ä' * (i % 3)}</html>" * (1 if i else 20_000)) for i in range(60)]
    pages += [(100, None, None), (101, "http://a b\r\nX: y", ""), (102, "http://c", "x"), (102, "http://c", "x"), (None, "http://d", "x"), (None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("first", F.lit("clash")).withColumn("shard", F.lit("clash"))
    folders = [new_scratch_path(spark, "warc-test") for _ in range(2)]
    sums = []
    for folder, part in zip(folders, (df, df.repartition(5))):
        manifest = warc.write_archives(part, folder, shard_bytes=100_000, roll_bytes=2_000).collect()
        assert sum(r["records"] for r in manifest) == len(pages) and len({r["shard"] for r in manifest}) > 3 and len(manifest) > len({r["shard"] for r in manifest})
        for r in manifest:
            with open(os.path.join(folder.removeprefix("file:"), "archives", r["file"]), "rb") as f:
                assert hashlib.sha256(f.read()).hexdigest() == r["sha256"]
        sums.append(sorted((r["file"], r["sha256"]) for r in manifest))
        assert not [x for x in os.listdir(folder.removeprefix("file:")) if x.startswith("_staging")]
    assert sums[0] == sums[1]
    back = warc.read_archives(spark, folders[0]).collect()
    first = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = Counter()
    for p, _, h in pages:
        raw = (h or "").encode()
        low = first.get(h or "")
        response = p is None or p == low
        want[(p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else low)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back) == want
    text = {p: (h or "").encode() for p, _, h in pages}
    assert all(bytes(r["payload"]) == text[r["page_id"]] for r in back if r["record_type"] == "response" and r["page_id"] is not None)
    ids = [r["page_id"] for f in sorted({r["file"] for r in back}) for r in back if r["file"] == f and r["page_id"] is not None]
    assert ids == sorted(ids)
    large = new_scratch_path(spark, "warc-test")
    warc.write_archives(df, large, min_bytes=10_000)
    assert {r["record_type"] for r in warc.read_archives(spark, large).collect()} == {"response"}
    empty = new_scratch_path(spark, "warc-test")
    assert warc.write_archives(df.limit(0), empty).count() == 0 and warc.read_archives(spark, empty).count() == 0


def test_runs_stay_whole():
    batches = [pa.RecordBatch.from_pydict({"k": k, "v": list(range(len(k)))}) for k in ([1, 1, 2], [2, 2], [], [2, 3, 4, 4], [4])]
    for least in (1, 3, 100):
        tables = list(common.whole_runs(iter(batches), ["k"], least))
        keys = [t.column("k").to_pylist() for t in tables]
        assert sum(keys, []) == [1, 1, 2, 2, 2, 2, 3, 4, 4, 4]
        assert all(not set(a) & set(b) for a, b in zip(keys, keys[1:]))


def test_forest():
    node, root = common.forest(np.array([5, 9, 7, 1, 20]), np.array([9, 7, 3, 2, 20]))
    assert dict(zip(node.tolist(), root.tolist())) == {5: 3, 9: 3, 7: 3, 2: 1}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_queries_and_pipeline(spark):
    """SQL of the registered queries, and the pipeline stage by stage against what each got."""
    import duckdb

    import __spark_entry__ as entry
    import corpus_pipeline
    from tools.check_oracle import TABLES, rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for key in ("op3_embedding_dedup", "op4_warc", "op9_line_dedup", "op10_mixing", "op11_conversation_repair", "op13_hard_negatives"):
        df = entry.queries()[key](spark, DATA)
        rel = con.execute(entry.oracle_sql()[key])
        want, names = rows_of([d[0] for d in rel.description], rel.fetchall())
        got, columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
        assert columns == names and got == want
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, DATA), "pipeline-test")
        if name != "packing":
            assert docs.columns == columns
        if name in ("language_id", "line_dedup"):
            assert docs.count() == before  # every document of this table has a language
        if name == "simhash":
            assert 0.7 * before < docs.count() < before
    assert docs.agg(F.sum("length").alias("n")).first()["n"] > 10_000
    held = {x for x in entry.queries() if x.startswith("op") and x[2].isdigit()}
    assert len(held) == 13 and "pipeline" in entry.queries()


def test_pipeline_on_awkward_and_empty_tables(spark, edge, none):
    """Every stage on what the stage before kept; SimHash against the fingerprints of all pairs."""
    import corpus_pipeline
    from sparkloom.llm import simhash

    for docs in (edge, none):
        kept = {}
        for name, stage in corpus_pipeline.STAGES:
            if name == "simhash":
                prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in simhash.near_duplicates(docs).collect()}
            docs = common.stored(stage(spark, docs, ""), "pipeline-edge")
            kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if not kept["line_dedup"]:
            assert kept["packing"] == []
            continue
        assert 6 not in kept["language_id"] and None in kept["language_id"]  # no letter
        left = set(kept["simhash"])
        for d, p in prints.items():
            near = [e for e, q in prints.items() if None not in (d, e) and (p ^ q).bit_count() <= 3]
            assert d is None or d in left or any(e < d for e in near)
            assert d not in left or all(e >= d for e in near if e in left)
        assert set(kept["packing"]) <= set(kept["mixing"]) and kept["packing"]


def test_archives_are_held_against_their_manifest(spark):
    folder = new_scratch_path(spark, "warc-lost")
    warc.write_archives(spark.createDataFrame([(i, "http://a", f"page {i} " * 300) for i in range(50)], "page_id long, url string, html string"), folder, shard_bytes=30_000, roll_bytes=500)
    assert warc.read_archives(spark, folder).count() == 50
    path = folder.removeprefix("file://") + "/archives"
    lost = sorted(f for f in os.listdir(path) if f.endswith(".warc.gz"))[1]
    os.rename(f"{path}/{lost}", f"{path}/{lost}.gone")
    with pytest.raises(ValueError, match=lost):
        warc.read_archives(spark, folder)


def test_languages_need_labels(spark, none):
    from sparkloom.llm import langid

    docs = spark.createDataFrame([(1, "some words", None), (2, "more words", None)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.keep_known(docs)
    assert langid.keep_known(none).collect() == []
    learned = spark.createDataFrame([(i, "the river runs past the old mill and the people read their books in the evening " * 3, "en") for i in range(20)] + [(50, "Это русский текст о погоде и о людях", None), (51, "the old mill", None)], "doc_id long, text string, lang string")
    assert 50 not in {r["doc_id"] for r in langid.keep_known(learned).collect()} >= {0, 19, 51}
