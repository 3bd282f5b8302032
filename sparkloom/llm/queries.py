"""The registered queries of the operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from sparkloom.llm import langid

    docs = table(spark, folder, "documents").withColumn("held_out", langid.held_out(F.col("doc_id"), 4, 2))
    profiles = langid.prototypes(docs.where(~F.col("held_out")).select("doc_id", "lang", "text"))
    return langid.predict(docs, profiles, ["doc_id", "held_out"])


@query("op5_simhash")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from sparkloom.llm import simhash

    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op7_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from sparkloom.llm import packing

    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, u.i, string_split(coalesce(text, ''), chr(10))[u.i] AS line,
         translate(trim(string_split(coalesce(text, ''), chr(10))[u.i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i) u
), often AS (
  SELECT k, max(doc_id) AS last_doc FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, o.k IS NOT NULL AND l.doc_id <> o.last_doc AS gone FROM lines l LEFT JOIN often o ON l.k = o.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op9_line_dedup", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from sparkloom.llm import linededup

    out = linededup.drop_repeated_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = """
WITH counted AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
rates AS (
  SELECT source, n_docs, (SELECT sum(n_docs) FROM counted)::DOUBLE
         * (pow(n_docs::DOUBLE, 0.7) / (SELECT sum(pow(n_docs::DOUBLE, 0.7)) FROM counted)) / n_docs AS rate FROM counted
),
mass AS (
  SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
  FROM rates, LATERAL (SELECT unnest(range(0, (rate + 12 * sqrt(rate) + 61)::BIGINT)) AS k) r
),
cdf AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS hi FROM mass
),
steps AS (SELECT source, k, lag(hi, 1, 0.0) OVER (PARTITION BY source ORDER BY k) AS lo, hi FROM cdf),
drawn AS (
  SELECT d.*, (('0x' || substr(md5('17||' || d.doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents d
),
copies AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, s.k AS n
  FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND d.u > s.lo AND d.u <= s.hi
)
SELECT doc_id, text, lang, source, n_chars, c.copy,
       (('0x' || substr(md5('17|order|' || doc_id || '|' || c.copy), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS order_key
FROM copies, LATERAL (SELECT unnest(range(0, n)) AS copy) c
"""


@query("op10_mixing", OP10_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from sparkloom.llm import mixing

    docs = table(spark, folder, "documents")
    return mixing.shuffled(mixing.replicated(docs, mixing.target_rates(docs)), docs.columns, "copy", "order_key")


OP3_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT a AS origin, a AS place FROM links UNION SELECT r.origin, l.b FROM reach r JOIN links l ON l.a = r.place
), low AS (SELECT origin, min(place) AS component_id FROM reach GROUP BY origin),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(l.component_id, v.vec_id) AS component_id, v.vec_id = coalesce(l.component_id, v.vec_id) AS kept
FROM embeddings v LEFT JOIN low l ON l.origin = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


@query("op3_embedding_dedup", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from sparkloom.llm import neardup

    return neardup.near_duplicates(table(spark, folder, "embeddings"))


OP4_SQL = """
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS n, upper(sha1(payload)) AS hex, min(page_id) OVER (PARTITION BY sha1(payload)) AS low FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> low THEN low END AS refers_to
FROM d
"""


@query("op4_warc", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from sparkloom.llm import warc
    from sparkloom.session import new_scratch_path

    path = new_scratch_path(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_fingerprints")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from sparkloom.llm import syncmers

    return syncmers.edited_likeness(table(spark, folder, "documents"))


@query("op6_quality")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from sparkloom.llm import langid, quality

    docs = table(spark, folder, "documents").withColumn("held_out", langid.held_out(F.col("doc_id"), 5, 0))
    labels = table(spark, folder, "labels").where(~langid.held_out(F.col("doc_id"), 5, 0)).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs.where(~F.col("held_out")), labels)
    return quality.score(docs, model, ["doc_id", "held_out"])


@query("op2_suffix_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from sparkloom.llm import suffixdedup

    return suffixdedup.remove_repeats(table(spark, folder, "documents"))


@query("op12_best_fit")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from sparkloom.llm import residual

    return residual.pack(table(spark, folder, "documents"), tokenizer_path())


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS rank,
         n.other_id AS negative_id, p.positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from sparkloom.llm import negatives

    vec = F.col("vec_id")
    label = F.when(vec % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings"), vec % 100 == 0, label)


OP11_SQL = """
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(0, 256) r(i)
), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) % 20 AS r
  FROM conversations, bits
), damaged AS (
  SELECT conv_id, turn, CASE WHEN r = 4 THEN 'user' ELSE role END AS role, CASE r WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM hashed, LATERAL (SELECT unnest(range(0, CASE r WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy) c
), told AS (
  SELECT *, row_number() OVER w AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         lag(left(role, 1)) OVER w || left(role, 1) AS pair, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)
), marked AS (
  SELECT *, core = '' AS blank, core <> '' AND again AS dup, core <> '' AND NOT again AND right(core, 1) NOT IN ('.', '!', '?') AS cut FROM told
), sums AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0::BIGINT AS n, {'c': 0::BIGINT, 'a': '', 't': NULL::VARCHAR} AS e, {'c': 9999999::BIGINT, 'a': '', 't': NULL::VARCHAR} AS s,
         {'c': 3::BIGINT, 'a': 'I', 't': 'user:'} AS u, {'c': 6::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, e, s, u2, CASE WHEN a1 < {'c': u2.c + 3, 'a': u2.a || 'I', 't': concat_ws(chr(10), u2.t, 'assistant:')} THEN a1
                                    ELSE {'c': u2.c + 3, 'a': u2.a || 'I', 't': concat_ws(chr(10), u2.t, 'assistant:')} END
  FROM (
    SELECT conv_id, n, e, s, a1, list_min([u1, {'c': e.c + 3, 'a': e.a || 'I', 't': concat_ws(chr(10), e.t, 'user:')}, {'c': s.c + 3, 'a': s.a || 'I', 't': concat_ws(chr(10), s.t, 'user:')},
                                    {'c': a1.c + 3, 'a': a1.a || 'I', 't': concat_ws(chr(10), a1.t, 'user:')}]) AS u2
    FROM (
      SELECT w.conv_id, m.n, {'c': w.e.c + 4, 'a': w.e.a || 'D', 't': w.e.t} AS e,
        list_min([{'c': w.s.c + 4, 'a': w.s.a || 'D', 't': w.s.t}, {'c': w.e.c + k + CASE WHEN i = 's' THEN 0 ELSE 9999999 END, 'a': w.e.a || 'K', 't': concat_ws(chr(10), w.e.t, own)}]) AS s,
        list_min([{'c': w.u.c + 4, 'a': w.u.a || 'D', 't': w.u.t},
          {'c': w.e.c + ku, 'a': w.e.a || 'K', 't': concat_ws(chr(10), w.e.t, own)}, {'c': w.e.c + 3 + k, 'a': w.e.a || 'R', 't': concat_ws(chr(10), w.e.t, 'user:' || text)},
          {'c': w.s.c + ku, 'a': w.s.a || 'K', 't': concat_ws(chr(10), w.s.t, own)}, {'c': w.s.c + 3 + k, 'a': w.s.a || 'R', 't': concat_ws(chr(10), w.s.t, 'user:' || text)},
          {'c': w.a.c + ku, 'a': w.a.a || 'K', 't': concat_ws(chr(10), w.a.t, own)}, {'c': w.a.c + 3 + k, 'a': w.a.a || 'R', 't': concat_ws(chr(10), w.a.t, 'user:' || text)}]) AS u1,
        list_min([{'c': w.a.c + 4, 'a': w.a.a || 'D', 't': w.a.t}, {'c': w.u.c + k + CASE WHEN i = 'a' THEN 0 ELSE 9999999 END, 'a': w.u.a || 'K', 't': concat_ws(chr(10), w.u.t, own)},
          {'c': w.u.c + 3 + k, 'a': w.u.a || 'R', 't': concat_ws(chr(10), w.u.t, 'assistant:' || text)}]) AS a1
      FROM walk w JOIN (
        SELECT *, left(role, 1) AS i, role || ':' || text AS own, CASE WHEN blank OR dup THEN 9999999 WHEN cut THEN 3 ELSE 0 END AS k,
               CASE WHEN blank OR dup OR left(role, 1) <> 'u' THEN 9999999 WHEN cut THEN 3 ELSE 0 END AS ku
        FROM marked
      ) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.n + 1
    )
  )
), ended AS (
  SELECT w.conv_id, coalesce(t.gaps, 0) AS gaps, coalesce(t.blank, 0) AS blank, coalesce(t.duplicate, 0) AS duplicate, coalesce(t.truncated, 0) AS truncated,
         coalesce(t.illegal, 0) AS illegal, list_min([w.e, w.a]) AS best
  FROM walk w LEFT JOIN sums t ON t.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.n = coalesce(t.rows, 0)
)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, best.c AS cost, best.a AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256 FROM ended
"""


@query("op11_conversation_repair", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from sparkloom.llm import dialogue

    return dialogue.repair(dialogue.damaged(table(spark, folder, "conversations")))
