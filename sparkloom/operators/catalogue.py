"""Knowledge entries, freshness and dataset catalogues as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions.exprs import count_when, rnd
from sparkloom.operators.ordered import Spec, row_numbers, running

ENTRY = "id string, title string, summary string, kind string, tier int, area string, added_date string, tags array<string>"


def fenced_records(df: DataFrame, key: str, text: str, schema: str = ENTRY) -> DataFrame:
    """JSON records in fenced blocks of whole texts; what does not parse is kept as rejected."""
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?s)```json\s*(.*?)```"), F.lit(1))
    d = df.select(key, F.posexplode(blocks).alias("block", "raw"))
    parsed = F.from_json("raw", schema)
    return d.select(key, "block", "raw", parsed.alias("entry")).withColumn("rejected", F.coalesce(F.col("entry.title").isNull(), F.lit(True)))


def with_ids(df: DataFrame) -> DataFrame:
    """Entries without an id get the whole digest of area and title: part of it would collide in large tables."""
    made = F.sha1(F.concat_ws("|", "area", "title"))
    return df.withColumn("id", F.coalesce("id", made))


def latest(df: DataFrame, key: str, date: str, seq: str) -> DataFrame:
    """Newest entry per id; among equal dates the first one read."""
    rest = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(date), -F.col(seq))).alias("_r"))
    return g.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def cross_cutting(df: DataFrame, kinds=("deprecation", "pitfall"), tag: str = "cross-cutting") -> DataFrame:
    return df.where(F.col("kind").isin(*kinds) | F.array_contains("tags", tag))


def index_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("category", "area").agg(F.count("*").alias("n"), count_when(F.col("tier") == 1).alias("n_first_tier"), F.max("added_date").alias("newest"))


def keyword_search(df: DataFrame, key: str, fields: list[str], word: str) -> DataFrame:
    """Rows whose joined fields contain a word, whatever its case."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(word.lower()))).select(key)


def freshness(df: DataFrame, last: str, ttl_days: Column, as_of: Column) -> DataFrame:
    """Stale when never fetched, or when the time to live has passed."""
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col(last).cast("timestamp"))
    return df.withColumn("status", F.when(F.col(last).isNull() | (age >= ttl_days * 86400), "stale").otherwise("fresh"))


def work_list(df: DataFrame, key: str, wave: int = 10, **kw) -> DataFrame:
    """Stale topics with sources or a forced flag, in waves, oldest first."""
    due = df.where((F.col("status") == "stale") & ((F.col("n_sources") > 0) | F.col("forced")))
    due = due.withColumn("reason", F.when(F.col("last").isNull(), "never_fetched").when(F.col("forced"), "forced").otherwise("expired"))
    due = due.withColumn("_o", F.coalesce(F.unix_seconds(F.col("last").cast("timestamp")), F.lit(0)))
    return row_numbers(due, [], ["_o", key], "_rn", **kw).withColumn("wave", F.floor((F.col("_rn") - 1) / wave).cast("bigint")).drop("_o", "_rn")


def merge_sources(current: DataFrame, seeds: DataFrame, key: str, attributes: list[str], state: list[str]) -> DataFrame:
    """New ids come in, attributes follow the seeds, run-time state stays as it is."""
    a = current.select(key, *[F.col(c).alias(f"_a_{c}") for c in attributes + state])
    b = seeds.select(key, *[F.col(c).alias(f"_b_{c}") for c in attributes])
    return a.join(b, key, "full").select(key, *[F.coalesce(f"_b_{c}", f"_a_{c}").alias(c) for c in attributes], *[F.col(f"_a_{c}").alias(c) for c in state])


def listed_urls(lines: DataFrame, file: str, number: str, text: str, **kw) -> DataFrame:
    """Addresses in a text table, each with the latest heading above it."""
    head = F.when(F.col(text).rlike(r"^#+ "), F.regexp_replace(text, r"^#+ +", ""))
    d = running(lines, [file], [number], {"section": Spec("last", head)}, **kw)
    return d.select(file, number, "section", F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(https?://[^\s)\"<>]+)"), F.lit(1))).alias("url"))


def layered(layers: list[DataFrame], key: str) -> DataFrame:
    """First layer that has a key wins."""
    both = None
    for i, d in enumerate(layers):
        x = d.withColumn("_p", F.lit(i))
        both = x if both is None else both.unionByName(x)
    rest = [c for c in layers[0].columns if c != key]
    return both.groupBy(key).agg(F.min_by(F.struct(*rest, "_p"), "_p").alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest], F.col("_r._p").alias("layer"))


# Words in column names that hint at a subject.
DOMAIN_WORDS = {
    "real_estate": ["property", "price", "bedroom", "bathroom", "balcony", "area", "sqft", "location", "address", "floor", "listing", "sale", "rent", "lease", "tenant",
                    "mortgage", "interest_rate", "building", "apartment", "house", "villa", "parking"],
    "healthcare": ["patient", "diagnosis", "icd", "cpt", "hba1c", "bmi", "blood_pressure", "vitals", "dosage", "prescription", "admission", "discharge", "lab_result", "glucose", "heart_rate",
                   "symptom", "treatment", "clinical", "medical", "hospital", "medication", "mortality"],
    "finance": ["balance", "credit", "debit", "transaction", "loan", "interest_rate", "apr", "risk_score", "default", "fraud", "revenue", "portfolio", "yield", "collateral", "mortgage",
                "equity", "dividend", "stock", "asset", "liability", "income", "account"],
    "marketing": ["campaign", "click", "impression", "ctr", "conversion", "bounce", "session", "channel", "clv", "ltv", "churn", "cohort", "attribution", "acquisition", "retention",
                  "engagement", "lead", "funnel", "landing_page", "segment", "referral", "ad_spend"],
    "retail": ["product", "sku", "price", "quantity", "order", "cart", "category", "inventory", "discount", "shipping", "return", "basket", "store", "supplier", "warehouse",
               "delivery", "purchase", "sale", "promotion", "stock", "demand", "customer_id"],
    "social": ["post", "like", "share", "comment", "follower", "engagement", "sentiment", "hashtag", "mention", "reach", "impression", "view", "subscriber", "content", "video",
               "influencer", "audience", "viral", "reaction", "thread", "message", "username"],
    "manufacturing": ["sensor", "temperature", "pressure", "vibration", "rpm", "cycle_time", "defect", "yield", "batch", "tolerance", "control_chart", "oee", "downtime", "maintenance", "failure",
                      "calibration", "inspection", "quality", "scrap", "machine", "humidity", "torque"],
    "logistics": ["shipment", "carrier", "warehouse", "delivery", "route", "lead_time"],
}

# What the name of a dataset of a subject holds.
DOMAIN_NAMES = {
    "real_estate": r"(property|realestate|real_estate|housing|apartment|flat|house|price|rental|estate)",
    "healthcare": r"(patient|clinical|medical|hospital|health|diagnosis|pharma|drug)",
    "finance": r"(transaction|credit|loan|fraud|bank|financ|stock|portfolio|risk)",
    "marketing": r"(campaign|market|churn|customer|lead|email|ad_|advertis|crm)",
    "retail": r"(product|order|sales|store|inventory|retail|ecommerce|shop|basket)",
    "social": r"(social|tweet|post|comment|sentiment|engag|content|influenc|reddit)",
    "manufacturing": r"(sensor|manufactur|factory|machine|quality|defect|mainten|iot)",
}
#: Words of a table that is given, at most.
MOST_WORDS = 1_000_000


def word_hits(columns: DataFrame, words: list[tuple[str, str]]) -> DataFrame:
    """(dataset, domain, word) of the words (domain, word) that stand anywhere in a column name of the dataset, each once.

    All words are looked for at once by an automaton that every task gets; names are in lower case, spaces are underscores.
    """
    import ahocorasick

    domains: dict[str, list[str]] = {}
    for domain, word in words:
        domains.setdefault(word.lower(), []).append(domain)
    kind = columns.schema["dataset"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for word, own in domains.items():
            automaton.add_word(word, (word, own))
        automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, name in enumerate(batch.column(1).to_pylist()):
                hits = {hit for _, hit in ((e, w) for e, (w, _) in automaton.iter(name))} if len(automaton) and name else ()
                for word in sorted(hits):
                    for domain in domains[word]:
                        at.append(i)
                        found.append((domain, word))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, type=pa.int64())), pa.array([d for d, _ in found], type=pa.string()), pa.array([w for _, w in found], type=pa.string())], names=["dataset", "domain", "word"])

    names = columns.select("dataset", F.replace(F.lower("column"), F.lit(" "), F.lit("_")).alias("name"))
    return names.mapInArrow(run, f"dataset {kind}, domain string, word string").distinct()


def tag_domains(columns: DataFrame, floor: float = 0.5, words: DataFrame | None = None) -> DataFrame:
    """columns: dataset, column, dataset_name, value_share, type_share. Best subject per dataset, general below the floor.

    The words of a subject that stand in its column names count up to five (weight .4), the dataset name .2, value patterns .3, types .1.
    `words` (domain, word) replaces the list above, which has the commonest words; a longer one is a table of up to MOST_WORDS rows.
    """
    listed = [(d, w) for d, ws in DOMAIN_WORDS.items() for w in ws]
    if words is not None:
        listed = [(r["domain"], r["word"]) for r in words.select("domain", "word").distinct().limit(MOST_WORDS + 1).collect()]
        if len(listed) > MOST_WORDS:
            raise ValueError(f"more than {MOST_WORDS} words")
    hits = word_hits(columns, listed).groupBy("dataset", "domain").agg(F.count("*").alias("hits"))
    facts = columns.groupBy("dataset").agg(F.max("dataset_name").alias("name"), F.max("value_share").alias("v"), F.max("type_share").alias("t"))
    named = F.lit(False)
    for domain in sorted({d for d, _ in listed}):
        named = named | ((F.col("domain") == domain) & F.lower("name").rlike(DOMAIN_NAMES.get(domain, domain)))
    s = hits.join(facts, "dataset")
    score = F.least(F.col("hits") / 5, F.lit(1.0)) * 0.4 + F.when(named, 0.2).otherwise(0.0) + F.col("v") * 0.3 + F.col("t") * 0.1
    best = s.withColumn("score", score).groupBy("dataset").agg(F.max_by("domain", F.struct(F.round("score", 6), "domain")).alias("d"), F.max("score").alias("score"))
    every = facts.select("dataset").join(best, "dataset", "left")
    return every.select("dataset", F.when(F.col("score") >= floor, F.col("d")).otherwise("general").alias("domain"), rnd(F.coalesce("score", F.lit(0.0))).alias("score"))
