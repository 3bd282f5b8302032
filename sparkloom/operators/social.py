"""Activity, text and ranking signals of social data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sparkloom.functions.exprs import count_when, micros, ratio, rnd
from sparkloom.operators.ordered import Spec, previous, running


def engagement_rates(df: DataFrame, period: Column, kind: str) -> DataFrame:
    n = lambda k: count_when(F.col(kind) == k)
    g = df.groupBy(period.alias("period")).agg(n("view").alias("v"), n("click").alias("c"), n("purchase").alias("p"), n("signup").alias("s"))
    w = W.orderBy("period")  # one row per period
    return g.select("period", rnd(ratio(F.col("c") + F.col("p"), F.col("v")), 5).alias("engagement"), rnd(ratio(F.col("c"), F.col("p")), 5).alias("click_to_purchase"),
                    F.col("s").alias("new_followers"), rnd(F.try_divide((F.col("s") - F.lag("s").over(w)).cast("double"), F.lag("s").over(w).cast("double")), 5).alias("growth"))


def response_time(df: DataFrame, user: str, order: list[str], asks: Column, answers: Column, **kw) -> DataFrame:
    """Seconds from each ask to the next answer of the user, averaged."""
    d = running(df.withColumn("_q", asks), [user], order, {"_n": Spec("last", F.when(answers, micros(order[0])))}, before="rows", descending=True, **kw)
    return d.where("_q").groupBy(user).agg(F.count("*").alias("asks"), rnd(F.avg((F.col("_n") - micros(order[0])) / 1e6), 3).alias("response_seconds"))


# Token shapes of social text.
SHAPES = {"hashtags": r"#[A-Za-z0-9_]+", "mentions": r"@[A-Za-z0-9_]+", "urls": r"https?://[^ ]+", "exclamations": r"!", "digits": r"[0-9]"}


def text_features(text: str) -> dict[str, Column]:
    c = F.col(text)
    return {"n_chars": F.length(c), "n_words": F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")),
            **{n: F.regexp_count(c, F.lit(rx)) for n, rx in SHAPES.items()}}


def bot_scores(df: DataFrame, user: str, order: list[str], **kw) -> DataFrame:
    """Regular intervals (low variation) and many posts make an account look automatic."""
    p = previous(df, [user], order, {"_t": order[0]}, **kw)
    gap = (micros(order[0]) - micros("_t")) / 1e6
    g = p.groupBy(user).agg(F.count("*").alias("n"), F.avg(gap).alias("m"), F.stddev_samp(gap).alias("s"), ((micros(F.max(order[0])) - micros(F.min(order[0]))) / 8.64e10).alias("age_days"))
    cv = F.try_divide(F.col("s"), F.col("m"))
    return g.select(user, "n", rnd(cv, 5).alias("interval_cv"), rnd(F.try_divide(F.col("n").cast("double"), F.col("age_days")), 5).alias("posts_per_day"), (F.coalesce(cv, F.lit(9.0)) < 0.8).alias("regular"))


def early_velocity(df: DataFrame, item: str, at: str, hours: list[int]) -> DataFrame:
    first = df.groupBy(item).agg(F.min(at).alias("_t0"))
    age = (micros(at) - micros("_t0")) / 3.6e9
    return df.join(first, item).groupBy(item).agg(*[count_when(age <= h).alias(f"first_{h}h") for h in hours])


def sentiment(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """lexicon: word, weight. Share of positive and negative words, compound score, and flag words."""
    words = df.select(key, F.explode(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}]+"), lambda w: w != "")).alias("word"))
    per = words.groupBy(key, "word").agg(F.count("*").alias("n")).join(lexicon, "word", "left")
    g = per.groupBy(key).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("n"))), F.lit(0)).alias("p"), F.coalesce(F.sum(F.when(F.col("weight") < 0, F.col("n"))), F.lit(0)).alias("q"),
                             F.coalesce(F.sum(F.col("weight") * F.col("n")), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.when(F.col("flag"), F.col("n"))), F.lit(0)).alias("toxic_words"))
    return g.select(key, rnd(F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15), 5).alias("compound"), rnd(ratio(F.col("p"), F.col("n")), 5).alias("positive"), rnd(ratio(F.col("q"), F.col("n")), 5).alias("negative"), "toxic_words")


def position_ctr(df: DataFrame, position: Column, clicked: Column) -> DataFrame:
    return df.groupBy(position.alias("position")).agg(F.count("*").alias("n"), F.sum(clicked.cast("int")).alias("clicks"), rnd(F.avg(clicked.cast("double")), 5).alias("ctr"))


