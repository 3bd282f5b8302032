"""Reading files, tables and streams; landing them; watching them for change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


# Suffixes and the texts that mean "no value".
FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet", ".pq": "parquet"}
NO_VALUE = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "<NA>", "#N/A"]


def format_of(path: str) -> str:
    low = path.lower().rstrip("/")
    for suffix, name in FORMATS.items():
        if low.endswith(suffix):
            return name
    if low.startswith("jdbc:"):
        return "jdbc"
    raise ValueError(f"no reader for {path}")


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reader by suffix; a user reader registered for the suffix wins."""
    for suffix, reader in READERS.items():
        if path.lower().endswith(suffix):
            return reader(spark, path, **options)
    kind = format_of(path)
    if kind in ("csv", "tsv"):
        return read_delimited(spark, path, "\t" if kind == "tsv" else ",", **options)
    if kind == "json":
        return spark.read.json(path, multiLine=True, **options)
    if kind == "jsonl":
        return spark.read.json(path, mode="PERMISSIVE", **options)
    if kind == "jdbc":
        return spark.read.format("jdbc").options(**jdbc_options(path, **options)).load()
    return nan_to_null(spark.read.parquet(path))


READERS: dict[str, object] = {}


def register_reader(suffix: str, reader) -> None:
    READERS[suffix.lower()] = reader


def read_delimited(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | None = None) -> DataFrame:
    """Header, no-value texts as null, types inferred after that; texts with leading zeros stay text."""
    raw = spark.read.csv(path, header=True, sep=sep, inferSchema=False)
    clean = raw.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(NO_VALUE), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if schema is not None:
        return clean.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    checks = []
    for i, c in enumerate(clean.columns):
        x = F.trim(F.col(f"`{c}`"))
        padded = x.rlike(r"^-?0[0-9]")
        checks += [F.count(f"`{c}`").alias(f"n{i}"), F.count(F.when(~padded, x.try_cast("bigint"))).alias(f"l{i}"), F.count(F.when(~padded, x.try_cast("double"))).alias(f"d{i}"),
                   F.count(F.when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), x.try_cast("timestamp"))).alias(f"t{i}"), F.count(F.when(F.lower(x).isin("true", "false"), 1)).alias(f"b{i}")]
    s = clean.agg(*checks).first()
    out = []
    for i, c in enumerate(clean.columns):
        n, x = s[f"n{i}"], F.trim(F.col(f"`{c}`"))
        kind = next((k for k, tag in (("boolean", "b"), ("bigint", "l"), ("double", "d"), ("timestamp", "t")) if n and s[f"{tag}{i}"] == n), None)
        out.append((x.try_cast(kind) if kind else F.col(f"`{c}`")).alias(c))
    return clean.select(*out)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def jdbc_options(url: str, table: str | None = None, column: str | None = None, low=None, high=None, parts: int | None = None, **more) -> dict[str, str]:
    """Options of a parallel database read; ?table= in the address names the table."""
    if "?table=" in url:
        url, table = url.split("?table=", 1)
    if not table:
        raise ValueError("name a table")
    out = {"url": url, "dbtable": table, **{k: str(v) for k, v in more.items()}}
    if column:
        out |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts or 8)}
    return out


def stream_options(servers: str, topic: str, start: str = "latest", per_trigger: int | None = None) -> dict[str, str]:
    """Options of a message-topic source or sink for readStream / writeStream.format('kafka')."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start, "failOnDataLoss": "true"}
    if per_trigger:
        out["maxOffsetsPerTrigger"] = str(per_trigger)
    return out


def land(df: DataFrame, path: str) -> None:
    """Raw data is written once and never replaced."""
    df.write.mode("errorifexists").parquet(path)


def land_by_day(df: DataFrame, path: str, ts: str) -> None:
    df.withColumns({"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)}).write.mode("append").partitionBy("year", "month", "day").parquet(path)


def with_lineage(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("_source_file"), F.current_timestamp().alias("_ingest_ts"))


def file_fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Sixteen hex digits of sha256 per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.substring(F.sha2("content", 256), 1, 16).alias("fingerprint"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free: count and two combinations of row hashes."""
    h = F.xxhash64(*[F.col(c) if not isinstance(df.schema[c].dataType, T.MapType) else F.to_json(c) for c in df.columns])
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(h).alias("xor_hash"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum_hash"))


# File families by suffix, documents that point to retrieval, and names of label files.
FAMILIES = {
    "tabular": ["csv", "parquet", "pq", "xlsx", "xls", "feather", "tsv", "json", "jsonl"],
    "image": ["png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff", "gif"],
    "audio": ["wav", "mp3", "flac", "ogg", "m4a", "aac"],
    "video": ["mp4", "mov", "avi", "mkv", "webm"],
    "text_doc": ["pdf", "md", "markdown", "html", "htm", "docx", "rst", "txt", "epub"],
}
HEAVY_DOCS = ["pdf", "docx", "epub", "html", "htm"]
LABEL_FILES = ["labels.csv", "labels.json", "train.csv", "metadata.csv", "annotations.json", "annotations.csv"]


def census(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """files: path. Family counts of a file tree (of each tree, told apart by the columns `by`), and the kind of project they point to with a subtype and confidence.

    The first rule that holds decides; without one it is the largest family, with a flag that this is a guess.
    """
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    ext = F.regexp_extract(name, r".\.([a-z0-9]+)$", 1)
    counts = {family: F.count_if(ext.isin(suffixes)) for family, suffixes in FAMILIES.items()}
    counts |= {"heavy_doc": F.count_if(ext.isin(HEAVY_DOCS)), "label_file": F.count_if(name.isin(LABEL_FILES))}
    by = by or []
    g = files.groupBy(*by).agg(F.count("*").alias("total"), *[e.alias(n) for n, e in counts.items()])
    part = lambda n: F.col(n) / F.col("total")
    guess = F.element_at(F.array_sort(F.array(*[F.struct((-F.col(n)).alias("n"), F.lit(i).alias("i"), F.lit(track).alias("track"), F.lit(sub).alias("subtype"))
                                                for i, (n, track, sub) in enumerate([("tabular", "tabular", None), ("image", "dl", "cv-classification"), ("audio", "dl", "audio"), ("text_doc", "rag", "text-rag")])])), 1)
    rules = [  # condition, track, subtype, confidence, ambiguous
        (F.col("total") == 0, "tabular", None, 0.0, True),
        ((part("image") >= 0.6) & (part("text_doc") >= 0.2), "dl", "multimodal", 0.7, True),
        (part("image") >= 0.6, "dl", "cv-classification", 0.85, False),
        (part("audio") >= 0.6, "dl", "audio", 0.85, False),
        ((part("heavy_doc") >= 0.4) | ((part("text_doc") >= 0.6) & (F.col("heavy_doc") > 0)), "rag", "text-rag", 0.85, False),
        ((part("text_doc") >= 0.6) & (F.col("label_file") > 0), "dl", "nlp-classification", 0.75, False),
        (part("text_doc") >= 0.6, "rag", "text-rag", 0.6, True),
        (part("tabular") >= 0.6, "tabular", None, 0.85, False),
    ]
    found = F.struct(guess["track"].alias("track"), guess["subtype"].alias("subtype"), F.lit(0.4).alias("confidence"), F.lit(True).alias("ambiguous"))
    for holds, track, sub, confidence, ambiguous in reversed(rules):
        found = F.when(holds, F.struct(F.lit(track).alias("track"), F.lit(sub).cast("string").alias("subtype"), F.lit(confidence).alias("confidence"), F.lit(ambiguous).alias("ambiguous"))).otherwise(found)
    return g.withColumn("_f", found).select(*by, "total", *counts, "_f.track", "_f.subtype", "_f.confidence", "_f.ambiguous")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """All files of a tree; contents are not read (the column is pruned)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def only_new(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that are new, or whose fingerprint changed."""
    return files.join(ledger.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti")


def ingest_new(spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType) -> None:
    """Files that came since the last call, exactly once (file stream with a checkpoint)."""
    q = (spark.readStream.schema(schema).parquet(source).writeStream.format("parquet").option("path", target)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def compact(spark: SparkSession, source: str, target: str, file_bytes: int = 256 << 20) -> int:
    """Rewrite many small files as few large ones; returns the number asked for."""
    total = list_files(spark, source).agg(F.sum("length")).first()[0] or 0
    n = max(1, -(-total // file_bytes))
    spark.read.parquet(source).repartition(n).write.mode("errorifexists").parquet(target)
    return n


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest version of each key; applying a batch twice changes nothing. The batch wins ties."""
    both = current.withColumn("_b", F.lit(0)).unionByName(batch.withColumn("_b", F.lit(1)))
    rest = [c for c in current.columns if c not in keys]
    picked = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_b")).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*current.columns)


def contract(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Missing, extra and mistyped columns, and how many values would not cast."""
    have = {f.name: f.dataType for f in df.schema.fields}
    rows, aggs = [], []
    for f in expected.fields:
        if f.name not in have:
            rows.append((f.name, "missing", F.lit(None).cast("bigint")))
        elif have[f.name] != f.dataType:
            aggs.append(F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f"_{f.name}"))
            rows.append((f.name, "mistyped", F.col(f"_{f.name}")))
    rows += [(c, "extra", F.lit(None).cast("bigint")) for c in have if c not in {f.name for f in expected.fields}]
    one = df.agg(F.count("*").alias("_n"), *aggs)
    status = lambda p, n: F.when(F.lit(p) == "extra", "WARNING").when((F.lit(p) == "mistyped") & (n == 0), "WARNING").otherwise("HARD_STOP")
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(p).alias("problem"), n.alias("cast_failures"), status(p, n).alias("status")) for c, p, n in rows])))


def key_gate(df: DataFrame, key: list[str], limit: float = 0.1) -> DataFrame:
    """Null keys, and share of rows (in %) beyond the first of their key."""
    gone = F.lit(False)
    for k in key:
        gone = gone | F.col(k).isNull()
    g = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(gone).alias("nulls"))
    pct = F.try_divide(100.0 * F.sum(F.col("n") - 1), F.sum("n"))
    return g.agg(F.sum("n").alias("n_rows"), F.sum("nulls").alias("null_keys"), F.round(pct, 4).alias("duplicate_pct"),
                 F.when((F.sum("nulls") > 0) | (pct >= limit), "HARD_STOP").otherwise("PASS").alias("status"))


def scorecard(df: DataFrame, key: str, required: list[str], valid, consistent, ts: str, as_of: str, fresh_days: int, truth: DataFrame) -> DataFrame:
    """Six quality dimensions in percent."""
    full = sum((F.count(c) for c in required), F.lit(0)) / (F.count("*") * len(required))
    base = df.agg(full.alias("completeness"), F.avg(valid.cast("double")).alias("validity"), F.avg(consistent.cast("double")).alias("consistency"),
                  F.avg((F.datediff(F.lit(as_of).cast("date"), ts) <= fresh_days).cast("double")).alias("timeliness"), F.count("*").alias("n"))
    distinct = df.select(key).distinct().count()
    wrong = df.select(*truth.columns).join(truth, truth.columns, "left_anti").count()
    pct = lambda c: F.round(100 * c, 4)
    return base.select(*[pct(F.col(c)).alias(c) for c in ("completeness", "validity", "consistency", "timeliness")],
                       pct(F.lit(float(distinct)) / F.col("n")).alias("uniqueness"), pct(1 - F.lit(float(wrong)) / F.col("n")).alias("accuracy"))


def html_blocks(df: DataFrame, key: str, html: str) -> DataFrame:
    """Title, links and visible text of pages; see markup.page_blocks for the blocks. A page without a title has an empty one."""
    from sparkloom.sources.markup import page_blocks

    return page_blocks(df, key, html).select(key, F.when(F.col("text").isNotNull(), F.coalesce("title", F.lit(""))).alias("title"), "links", "text")


def markdown_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sections of a markdown text by their headings."""
    from sparkloom.sources.markup import text_sections

    return text_sections(df, key, text)
