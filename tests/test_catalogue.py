"""Domain tags of table schemas."""

import pytest

from sparkloom.operators import catalogue as c

COLUMNS = "dataset string, column string, dataset_name string, value_share double, type_share double"


def rows(name, columns, v=0.6, t=0.3, title=None):
    return [(name, x, title or name, v, t) for x in columns]


def test_subjects(spark):
    data = rows("houses", ["house_price", "Bedroom Count", "sqft", "floorNum", "Balcony"], title="housing_2024")
    data += rows("wards", ["blood_pressure_mmHg", "patientid", "heart rate", "glucose", "bmi"], title="hospital")
    data += rows("lines", ["lead_time_days", "carrier", "route", "warehouse_id", "shipment", "delivery"], v=1.0)
    data += rows("other", ["a", "b", None], v=0.9) + rows("one", ["house_price"], v=0.0)
    df = spark.createDataFrame(data, COLUMNS).repartition(3)
    got = {r["dataset"]: (r["domain"], r["score"]) for r in c.tag_domains(df).collect()}
    assert got == {"houses": ("real_estate", pytest.approx(0.4 + 0.2 + 0.18 + 0.03)), "wards": ("healthcare", pytest.approx(0.81)), "lines": ("logistics", pytest.approx(0.4 + 0.3 + 0.03)),
                   "other": ("general", 0.0), "one": ("general", pytest.approx(0.19))}
    assert c.tag_domains(df.where("dataset = 'one'"), floor=0.1).first()["domain"] == "real_estate"  # price is retail's too, house is not


def test_hits_are_those_of_contains(spark):
    df = spark.createDataFrame(rows("x", ["lead_time", "interest_rate_pct", "reorder", "lead_time"]) + rows("y", ["", "misleading"]), COLUMNS)
    listed = [(d, w) for d, ws in c.DOMAIN_WORDS.items() for w in ws]
    want = {(r["dataset"], d, w) for r in df.collect() for d, w in listed if w in r["column"].lower().replace(" ", "_")}
    got = [tuple(r) for r in c.word_hits(df, listed).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("x", "logistics", "lead_time") in want and ("y", "marketing", "lead") in want


def test_words_may_come_from_a_table(spark):
    df = spark.createDataFrame(rows("soil", ["ph_value", "moisture", "crop_type"], v=0.5), COLUMNS)
    words = spark.createDataFrame([("farming", "moisture"), ("farming", "crop"), ("farming", "ph_"), ("farming", "crop")], "domain string, word string")
    assert tuple(c.tag_domains(df, 0.4, words).first()) == ("soil", "farming", pytest.approx(0.24 + 0.15 + 0.03))
