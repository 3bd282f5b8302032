import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    line = "A line that many documents share, with some words in it."
    passage = "this passage of well over fifty bytes stands in several of the documents, word for word"
    rows = [
        (1, f"First text here.\n{line}\nother words follow {passage} and an end", "en", "a", 10),
        (2, f"  {line.upper()}\t\nSecond text\n{passage}", "en", "a", 10),
        (3, f"{line}\n{line}\nThird text {passage}", "en", "b", None),
        (4, None, "en", "b", 0),
        (5, "", "de", None, 0),
        (6, "12345 --- 6789 !!! ...", None, "c", 3),
        (7, "äöü ß größe über straße und noch ein satz mit umlauten", "de", "c", 5),
        (8, "äöü ß größe über straße und noch ein satz mit umlauten", "de", "c", 5),
        (9, "wort " * 60_000 + passage, "de", "c", 300_000),
        (10, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 3),
        (11, "the quick brown fox jumps over the lazy dog and runs far away from here today!", "en", "a", 3),
        (12, "x", "en", "a", 1),
        (12, "x", "en", "a", 1),
        (None, "a text without an id that is long enough to share nothing with any other text", "en", "a", 1),
        (None, None, None, None, None),
        (13, "der die das und ein " * 30, "de", "b", 1),
        (14, "the and of to in a is " * 30, "en", "b", 1),
    ]
    df = spark.createDataFrame(rows, DOC)
    for name in ("fp", "key", "score", "lang_pred", "n", "h", "drop", "row", "weight", "label", "node", "part", "_i"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
