"""Source, sink and landing queries; files are written from the tables and read back."""


from pyspark.sql import functions as F, types as T

from sparkloom.functions.exprs import hash_bucket
from sparkloom.operators import drift
from sparkloom.session import new_scratch_path
from sparkloom.sources import readers as r
from sparkloom.plans.catalog import query
from sparkloom.plans.views import H

ORD = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


@query("src_01", "SELECT 'csv' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'jsonl', count(*) FROM orders UNION ALL SELECT 'parquet', count(*) FROM orders")
def src_01(t):
    out = None
    for kind in ("csv", "jsonl", "parquet"):
        path = new_scratch_path(t.spark, "any") + "." + kind
        w = t.orders.select(*COLS).write
        w.csv(path, header=True) if kind == "csv" else w.json(path) if kind == "jsonl" else w.parquet(path)
        n = r.read_any(t.spark, path).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = n if out is None else out.unionByName(n)
    return out


NULLED = f"SELECT event_id, CASE WHEN {H('event_id', 7)} <> 0 THEN value END AS value, CASE WHEN {H('event_id', 11)} <> 0 THEN event_type END AS event_type, lpad(CAST(user_id AS VARCHAR), 6, '0') AS code FROM events"


def _delimited(t, sep, suffix):
    path = new_scratch_path(t.spark, "text") + suffix
    d = t.events.select("event_id", F.when(hash_bucket("event_id", 7) != 0, F.col("value").cast("string")).otherwise("NA").alias("value"),
                        F.when(hash_bucket("event_id", 11) != 0, F.col("event_type")).otherwise("null").alias("event_type"), F.lpad(F.col("user_id").cast("string"), 6, "0").alias("code"))
    d.write.csv(path, header=True, sep=sep)
    return r.read_any(t.spark, path)


@query("src_02", NULLED)
def src_02(t):
    return _delimited(t, ",", ".csv")


@query("src_03", NULLED)
def src_03(t):
    return _delimited(t, "\t", ".tsv")


@query("src_04", ORD)
def src_04(t):
    """Documents of up to 1000 records each, one file per document."""
    path = new_scratch_path(t.spark, "doc") + ".json"
    docs = t.orders.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("doc")).agg(F.to_json(F.collect_list(F.struct(*COLS))).alias("value"))
    docs.write.partitionBy("doc").text(path)
    return r.read_any(t.spark, path).select(*COLS)


@query("src_05", ORD)
def src_05(t):
    path = new_scratch_path(t.spark, "lines") + ".jsonl"
    t.orders.select(*COLS).write.json(path)
    return r.read_any(t.spark, path).select(*COLS)


@query("src_06", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def src_06(t):
    return r.read_any(t.spark, t.path("lineitem")).where("l_quantity > 45").select("l_orderkey", "l_quantity")


@query("src_08", ORD)
def src_08(t):
    path = new_scratch_path(t.spark, "raw")
    r.land(t.orders.select(*COLS), path)
    return t.spark.read.parquet(path)


@query("src_09")
def src_09(t):
    a = r.table_fingerprint(t.orders)
    return a.withColumn("same_in_any_order", F.lit(a.first() == r.table_fingerprint(t.orders.repartition(7, "o_custkey")).first()))


CENSUS = [".csv", ".parquet", ".feather", ".xls", "/train.csv", ".png", ".markdown", ".pdf", ".aac", ".bin"]


@query("src_09_files", """SELECT true AS same_for_any_split, true AS all_differ, count(*) AS n_tables FROM (SELECT count(*) AS n FROM events UNION ALL SELECT count(*) FROM documents UNION ALL SELECT count(*) FROM lineitem)""")
def src_09_files(t):
    """Fingerprints of the files of three tables, read in splits of two sizes."""
    from sparkloom.sources.content import content_fingerprints, tree_fingerprint

    key, found = "spark.sql.files.maxPartitionBytes", []
    old = t.spark.conf.get(key)
    try:
        for size in ("64m", "1m"):
            t.spark.conf.set(key, size)
            found.append([tree_fingerprint(content_fingerprints(t.spark, t.path(n))).first()["fingerprint"] for n in ("events", "documents", "lineitem")])
    finally:
        t.spark.conf.set(key, old)
    return t.spark.createDataFrame([(found[0] == found[1], len(set(found[0])) == 3, 3)], "same_for_any_split boolean, all_differ boolean, n_tables long")


@query("src_10", f"""WITH f AS (SELECT event_type AS folder, {H('event_id', 10)} AS k FROM events), c AS (SELECT folder, count(*) AS total, count(*) FILTER (k < 5) AS tabular, count(*) FILTER (k = 5) AS image, count(*) FILTER (k = 8) AS audio,
    count(*) FILTER (k IN (6, 7)) AS text_doc, count(*) FILTER (k = 7) AS heavy_doc, count(*) FILTER (k = 4) AS label_file FROM f WHERE (folder <> 'view' OR k = 5 OR k = 6) AND (folder <> 'click' OR k > 5) AND (folder <> 'error' OR k = 6 OR k = 4) GROUP BY 1)
  SELECT folder, total, tabular, image, audio, text_doc, heavy_doc, label_file,
    CASE WHEN image / total >= 0.6 THEN 'dl' WHEN audio / total >= 0.6 THEN 'dl' WHEN heavy_doc / total >= 0.4 OR (text_doc / total >= 0.6 AND heavy_doc > 0) THEN 'rag' WHEN text_doc / total >= 0.6 THEN CASE WHEN label_file > 0 THEN 'dl' ELSE 'rag' END
      WHEN tabular / total >= 0.6 THEN 'tabular' WHEN tabular = greatest(tabular, image, audio, text_doc) THEN 'tabular' WHEN greatest(image, audio) = greatest(tabular, image, audio, text_doc) THEN 'dl' ELSE 'rag' END AS track,
    CASE WHEN image / total >= 0.6 THEN CASE WHEN text_doc / total >= 0.2 THEN 0.7 ELSE 0.85 END WHEN audio / total >= 0.6 OR heavy_doc / total >= 0.4 OR (text_doc / total >= 0.6 AND heavy_doc > 0) THEN 0.85
      WHEN text_doc / total >= 0.6 THEN CASE WHEN label_file > 0 THEN 0.75 ELSE 0.6 END WHEN tabular / total >= 0.6 THEN 0.85 ELSE 0.4 END::DOUBLE AS confidence FROM c""")
def src_10(t):
    """One file tree per event type, each with its own mix of files."""
    k, kind = hash_bucket("event_id", 10), F.col("event_type")
    kept = ((kind != "view") | k.isin(5, 6)) & ((kind != "click") | (k > 5)) & ((kind != "error") | k.isin(4, 6))
    tail = F.array(*[F.lit(x) for x in CENSUS])[k.cast("int")]
    names = t.events.where(kept).select("event_type", F.concat(F.lit("/data/f"), F.col("event_id").cast("string"), tail).alias("path"))
    out = r.census(names.withColumnRenamed("event_type", "folder"), ["folder"])
    return out.select("folder", "total", "tabular", "image", "audio", "text_doc", "heavy_doc", "label_file", "track", "confidence")


@query("src_11", "SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, count(*) AS n FROM events GROUP BY 1, 2, 3")
def src_11(t):
    path = new_scratch_path(t.spark, "days")
    r.land_by_day(t.events, path, "ts")
    return t.spark.read.parquet(path).groupBy("year", "month", "day").agg(F.count("*").alias("n"))


@query("src_12", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def src_12(t):
    """Two arrivals of files, one call after each; nothing is read twice."""
    src, dst, cp = (new_scratch_path(t.spark, x) for x in ("in", "out", "cp"))
    mid = F.lit("2024-01-16").cast("timestamp_ntz")
    for part in (t.events.where(F.col("ts") < mid), t.events.where(F.col("ts") >= mid)):
        part.write.mode("append").parquet(src)
        r.ingest_new(t.spark, src, dst, cp, t.events.schema)
    return t.spark.read.parquet(dst).groupBy("event_type").agg(F.count("*").alias("n"))


@query("src_13", "SELECT o_orderstatus, count(*) AS n, count(*) AS with_file FROM orders GROUP BY 1")
def src_13(t):
    return r.with_lineage(t.spark.read.parquet(t.path("orders"))).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count(F.when(F.col("_source_file").contains("orders") & F.col("_ingest_ts").isNotNull(), 1)).alias("with_file"))


@query("src_14", "SELECT count(*) AS n_rows, CAST(1 AS BIGINT) AS n_files FROM events")
def src_14(t):
    a, b = new_scratch_path(t.spark, "small"), new_scratch_path(t.spark, "large")
    t.events.repartition(16).write.parquet(a)
    r.compact(t.spark, a, b)
    return t.spark.read.parquet(b).select("event_id", F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n_rows"), F.count_distinct("f").alias("n_files"))


@query("src_15", f"SELECT o_orderkey, CASE WHEN {H('o_orderkey', 4)} = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN {H('o_orderkey', 4)} = 0 THEN 2 ELSE 1 END AS version FROM orders")
def src_15(t):
    cur = t.orders.select("o_orderkey", "o_orderstatus", F.lit(1).alias("version"))
    batch = t.orders.where(hash_bucket("o_orderkey", 4) == 0).select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(2).alias("version"))
    once = r.upsert(cur, batch, ["o_orderkey"], "version")
    return r.upsert(once, batch, ["o_orderkey"], "version")


@query("src_16", """SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '[ \\t\\n]+', ' ', 'g')) AS title, len(regexp_extract_all(html, '(?i)<a[^>]*href="([^"]*)"', 1)) AS n_links FROM pages""")
def src_16(t):
    return r.html_blocks(t.pages, "page_id", "html").select("page_id", "title", F.size("links").cast("bigint").alias("n_links"))


@query("src_16_blocks")
def src_16_blocks(t):
    """Blocks of every page in order."""
    from sparkloom.sources.markup import page_blocks

    blocks = page_blocks(t.pages, "page_id", "html").select("page_id", F.posexplode("blocks").alias("block", "b"))
    return blocks.select("page_id", "block", "b.kind", "b.text")


@query("src_16_sections", """SELECT c_custkey, s::INT AS section, s::INT + 1 AS level, CASE s WHEN 0 THEN c_name ELSE c_mktsegment END AS heading,
  CASE s WHEN 0 THEN 'Balance ' || c_nationkey || chr(10) || '```' || chr(10) || '# in a fence' || chr(10) || '```' ELSE 'end' END AS body FROM customer, (SELECT unnest([0, 1]) AS s)""")
def src_16_sections(t):
    """A card in Markdown of every customer, cut into its sections; the fence holds no heading."""
    from sparkloom.sources.markup import text_sections

    card = F.concat(F.lit("# "), "c_name", F.lit(" #\nBalance "), F.col("c_nationkey").cast("string"), F.lit("\n```\n# in a fence\n```\n\n"), "c_mktsegment", F.lit("\n---\nend\n"))
    return text_sections(t.customer.withColumn("card", card), "c_custkey", "card")


@query("src_17", """SELECT 'event_type' AS "column", 'mistyped' AS problem, count(*) FILTER (TRY_CAST(event_type AS BIGINT) IS NULL AND event_type IS NOT NULL) AS cast_failures, 'HARD_STOP' AS status FROM events
  UNION ALL SELECT 'user_id', 'mistyped', count(*) FILTER (TRY_CAST(user_id AS INTEGER) IS NULL), 'WARNING' FROM events UNION ALL SELECT 'country', 'missing', NULL, 'HARD_STOP' FROM (SELECT count(*) FROM events) UNION ALL SELECT 'props', 'extra', NULL, 'WARNING' FROM (SELECT count(*) FROM events)""")
def src_17(t):
    want = T.StructType([T.StructField("event_id", T.LongType()), t.events.schema["ts"], T.StructField("user_id", T.IntegerType()), T.StructField("event_type", T.LongType()),
                         T.StructField("value", T.DoubleType()), T.StructField("country", T.StringType())])
    return r.contract(t.events, want)


@query("src_18", """SELECT column_name AS "column", change, n FROM (SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props', 'score']) AS column_name, unnest(['same', 'same', 'retyped', 'same', 'same', 'removed', 'added']) AS change), (SELECT count(*) AS n FROM events)""")
def src_18(t):
    new = t.events.drop("props").withColumn("user_id", F.col("user_id").cast("string")).withColumn("score", F.col("value") * 2)
    return drift.schema_drift(t.events, new).select("column", "change").withColumn("n", F.lit(new.count()).cast("bigint"))


@query("src_19", """SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN k IS NULL THEN n ELSE 0 END) AS BIGINT) AS null_keys, round(100.0 * sum(n - 1) / sum(n), 4) AS duplicate_pct, 'HARD_STOP' AS status FROM (SELECT value AS k, count(*) AS n FROM events_null GROUP BY 1)""", "events_null")
def src_19(t):
    return r.key_gate(t.events_null, ["value"])


@query("src_20", f"""SELECT round(100 * (count(event_type) + count(value)) / (2.0 * count(*)), 4) AS completeness, round(100 * avg((coalesce(value, 0) >= 5)::INT), 4) AS validity, round(100 * avg((user_id >= 10)::INT), 4) AS consistency,
  round(100 * avg((date_diff('day', ts, DATE '2024-01-31') <= 10)::INT), 4) AS timeliness, round(100.0 * count(DISTINCT event_id) / count(*), 4) AS uniqueness, round(100 * (1 - count(*) FILTER (event_type IS NULL) / count(*)), 4) AS accuracy FROM events_null""", "events_null")
def src_20(t):
    return r.scorecard(t.events_null, "event_id", ["event_type", "value"], F.coalesce("value", F.lit(0.0)) >= 5, F.col("user_id") >= 10, "ts", "2024-01-31", 10, t.events.select("event_id", "event_type"))


