"""Knowledge table queries; entries are derived from documents (see views.kb)."""

from pyspark.sql import functions as F

from sparkloom.functions.exprs import hash_bucket
from sparkloom.operators import catalogue as c
from sparkloom.plans.catalog import query
from sparkloom.plans.views import H

IDS = "ids AS (SELECT * REPLACE (coalesce(id, sha1(concat_ws('|', area, title))) AS id) FROM kb)"
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY added_date DESC, seq) AS rn FROM ids) WHERE rn = 1)"


@query("knt_01", f"""SELECT doc_id, CAST(0 AS INTEGER) AS block, substr(md5(text), 1, 8) AS title, {H('doc_id', 7)} = 0 AS rejected FROM documents""")
def knt_01(t):
    record = F.to_json(F.struct(F.substring(F.md5("text"), 1, 8).alias("title"), F.lit("technique").alias("kind"), F.col("lang").alias("area")))
    broken = F.when(hash_bucket("doc_id", 7) == 0, F.concat(record, F.lit(" oops {"))).otherwise(record)
    texts = t.documents.select("doc_id", "text", F.concat(F.lit("---\ntitle: x\n---\n"), F.regexp_replace("text", "`", "'"), F.lit("\n```json\n"), F.when(hash_bucket("doc_id", 7) == 0, F.lit("{not json")).otherwise(broken), F.lit("\n```\n")).alias("page"))
    out = c.fenced_records(texts, "doc_id", "page")
    return out.join(t.documents.select("doc_id", F.substring(F.md5("text"), 1, 8).alias("title")), "doc_id").select("doc_id", "block", "title", "rejected")


@query("knt_02", f"WITH {IDS}, {LATEST} SELECT id, title, area, strftime(added_date, '%Y-%m-%d') AS added, seq FROM latest", "kb")
def knt_02(t):
    return c.latest(c.with_ids(t.kb), "id", "added_date", "seq").select("id", "title", "area", F.date_format("added_date", "yyyy-MM-dd").alias("added"), "seq")


@query("knt_03", "SELECT seq, kind FROM kb WHERE kind IN ('deprecation', 'pitfall') OR list_contains(tags, 'cross-cutting')", "kb")
def knt_03(t):
    return c.cross_cutting(t.kb).select("seq", "kind")


@query("knt_04", "SELECT category, area, count(*) AS n, count(*) FILTER (tier = 1) AS n_first_tier, max(added_date) AS newest FROM kb GROUP BY 1, 2", "kb")
def knt_04(t):
    return c.index_counts(t.kb)


@query("knt_05", "SELECT seq FROM kb WHERE contains(lower(concat_ws(' ', title, body, category, area)), 'there')", "kb")
def knt_05(t):
    return c.keyword_search(t.kb, "seq", ["title", "body", "category", "area"], "There")


TOPICS = f"""topics AS (SELECT user_id AS topic, CASE WHEN {H('user_id', 9)} = 0 THEN NULL ELSE max(ts) END AS last, CASE {H('user_id', 3)} WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS ttl, count(*) FILTER (event_type = 'click') % 3 AS n_sources, {H('user_id', 5)} = 0 AS forced FROM events GROUP BY 1),
  fresh AS (SELECT *, CASE WHEN last IS NULL OR TIMESTAMP '2024-02-01' - last >= ttl * INTERVAL 1 DAY THEN 'stale' ELSE 'fresh' END AS status FROM topics)"""


def fresh(t):
    g = t.events.groupBy(F.col("user_id").alias("topic")).agg(F.max("ts").alias("m"), (F.count_if(F.col("event_type") == "click") % 3).alias("n_sources"))
    d = g.select("topic", F.when(hash_bucket("topic", 9) != 0, F.col("m")).alias("last"), F.when(hash_bucket("topic", 3) == 0, 1).when(hash_bucket("topic", 3) == 1, 2).otherwise(4).alias("ttl"), "n_sources", (hash_bucket("topic", 5) == 0).alias("forced"))
    return c.freshness(d, "last", F.col("ttl"), F.lit("2024-02-01 00:00:00"))


@query("knt_06", f"WITH {TOPICS} SELECT topic, status FROM fresh")
def knt_06(t):
    return fresh(t).select("topic", "status")


@query("knt_07", f"""WITH {TOPICS} SELECT topic, CASE WHEN last IS NULL THEN 'never_fetched' WHEN forced THEN 'forced' ELSE 'expired' END AS reason, CAST((row_number() OVER (ORDER BY coalesce(epoch(last)::BIGINT, 0), topic) - 1) // 10 AS BIGINT) AS wave
  FROM (SELECT * REPLACE (date_trunc('second', last) AS last) FROM fresh) WHERE status = 'stale' AND (n_sources > 0 OR forced)""")
def knt_07(t):
    return c.work_list(fresh(t), "topic").select("topic", "reason", "wave")


@query("knt_08", """SELECT coalesce(a.k, b.k) AS k, coalesce(b.name, a.name) AS name, a.fetched FROM (SELECT c_custkey AS k, c_name AS name, round(c_acctbal) AS fetched FROM customer WHERE c_custkey % 3 > 0) a
  FULL JOIN (SELECT c_custkey AS k, upper(c_name) AS name FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k""")
def knt_08(t):
    cur = t.customer.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.round("c_acctbal").alias("fetched"))
    seeds = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("name"))
    return c.merge_sources(cur, seeds, "k", ["name"], ["fetched"])


@query("knt_09", """WITH l AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 3 = 0 THEN role || turn END AS head FROM conversations)
  SELECT conv_id, turn, last_value(head IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section, 'https://example.com/' || conv_id || '/' || turn AS url FROM l""")
def knt_09(t):
    line = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("## "), "role", F.col("turn").cast("string"), F.lit(" "))).otherwise(F.lit("- see "))
    url = F.concat(F.lit("(https://example.com/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(")"))
    lines = t.conversations.select("conv_id", "turn", F.concat(line, url).alias("line"))
    out = c.listed_urls(lines, "conv_id", "turn", "line")
    return out.withColumn("section", F.regexp_replace("section", r" .*$", ""))


@query("knt_10", """SELECT coalesce(p.k, l.k, s.k) AS k, coalesce(p.v, l.v, s.v) AS v, CASE WHEN p.k IS NOT NULL THEN 0 WHEN l.k IS NOT NULL THEN 1 ELSE 2 END AS layer FROM (SELECT o_orderkey AS k, 'project' AS v FROM orders WHERE o_orderkey % 5 = 0) p
  FULL JOIN (SELECT o_orderkey AS k, 'live' AS v FROM orders WHERE o_orderkey % 2 = 0) l ON p.k = l.k FULL JOIN (SELECT o_orderkey AS k, 'seed' AS v FROM orders) s ON s.k = coalesce(p.k, l.k)""")
def knt_10(t):
    layer = lambda cond, v: t.orders.where(cond).select(F.col("o_orderkey").alias("k"), F.lit(v).alias("v"))
    return c.layered([layer("o_orderkey % 5 = 0", "project"), layer("o_orderkey % 2 = 0", "live"), layer("true", "seed")], "k")


WORDS = ", ".join(f"('{d}', '{w}')" for d, ws in c.DOMAIN_WORDS.items() for w in ws)


@query("knt_11", f"""WITH w(domain, word) AS (VALUES {WORDS}), h AS (SELECT dataset, domain, count(DISTINCT word) AS hits FROM catalog_columns JOIN w ON contains(lower(replace("column", ' ', '_')), word) GROUP BY 1, 2),
  f AS (SELECT dataset, {H('dataset', 2)} = 0 AS named, {H('dataset', 10)} / 10.0 AS v, 0.5 AS t FROM (SELECT DISTINCT dataset FROM catalog_columns)),
  s AS (SELECT h.dataset, domain, round((least(hits / 5, 1) * 0.4 + CASE WHEN named AND domain = 'retail' THEN 0.2 ELSE 0 END + v * 0.3 + t * 0.1)::DOUBLE, 6) AS score FROM h JOIN f USING (dataset)),
  b AS (SELECT dataset, arg_max(domain, (score, domain)) AS d, max(score) AS score FROM s GROUP BY 1)
  SELECT f.dataset, CASE WHEN b.score >= 0.5 THEN d ELSE 'general' END AS domain, round(coalesce(b.score, 0), 4) AS score FROM f LEFT JOIN b USING (dataset)""", "catalog_columns")
def knt_11(t):
    k = hash_bucket("dataset", 2)
    cols = t.catalog_columns.withColumns({"dataset_name": F.when(k == 0, "retail_tables").otherwise("tables"), "value_share": hash_bucket("dataset", 10) / 10.0, "type_share": F.lit(0.5)})
    return c.tag_domains(cols)
