import hashlib

import pytest
from pyspark.sql import functions as F

from plotmerge.functions import json_values as J
from plotmerge.functions import text as X

NBSP = " "


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, value",
    [
        (f"415{NBSP}000 €", 415000),
        ("275.000,00 €", 27500000),
        ("€ 325.000", 325000),
        ("EUR 1.250.000 of 999 €", 1250000),
        ("999 € dan 2 500 €", 2500),
        ("gratis", None),
        ("€", None),
        ("  " * 50 + "12 345€", 12345),
    ],
)
def test_price(spark, text, value):
    assert one(spark, X.price(F.col("t")), t=text) == value


@pytest.mark.parametrize(
    "text, value",
    [("11500 m2", 1500), ("1.234 m²", 234), ("19 m2 en 2001 m2", None), ("80 m², tuin 300m2", 300)],
)
def test_surface(spark, text, value):
    assert one(spark, X.surface(F.col("t")), t=text) == value


@pytest.mark.parametrize(
    "text, value", [("EPC: A+ goed", "A"), ("EPC waarde B", "B"), ("epc B", None), ("EPC: G", None)]
)
def test_epc_label_in(spark, text, value):
    assert one(spark, X.epc_label_in(F.col("t")), t=text) == value


@pytest.mark.parametrize(
    "text, exact, lenient",
    [("a+ ", "A+", "A+"), (" d", "D", "D"), ("B 120", None, "B"), ("G", None, None), ("", None, None)],
)
def test_labels(spark, text, exact, lenient):
    assert one(spark, X.epc_exact(F.col("t")), t=text) == exact
    assert one(spark, X.epc_lenient(F.col("t")), t=text) == lenient


@pytest.mark.parametrize(
    "text, kind",
    [("Mooi appartement naast huis", "appartement"), ("VILLA", "huis"), ("bouwgrond", "grond"), ("x", "other")],
)
def test_type(spark, text, kind):
    assert one(spark, X.property_type(F.col("t")), t=text) == kind


def test_condition_order(spark):
    assert one(spark, X.condition(F.col("t")), t="Nieuwbouw, instapklaar") == "nieuwbouw"
    assert one(spark, X.condition(F.col("t")), t="instapklaar na renovatie") == "te-renoveren"
    assert one(spark, X.condition(F.col("t")), t="gezellig") is None


@pytest.mark.parametrize(
    "text, value",
    [
        ("a &amp;lt; b", "a &lt; b"),
        ("&eacute;&#233;&#xE9;", "ééé"),
        ("&#38;amp; &unknown;", "&amp; &unknown;"),
        ("&#xD800;&#1114112;", "��"),
        ("geen", "geen"),
    ],
)
def test_unescape(spark, text, value):
    assert one(spark, X.unescape(F.col("t")), t=text) == value


def test_address_key(spark):
    key = X.address_key("t")
    assert one(spark, key, t="Sint-Jansstraat 12 bus é½ﬁ") == "sintjansstraat12buse12fi"
    assert one(spark, key, t=None) == ""


def test_fingerprint(spark):
    md5 = one(spark, X.fingerprint(F.col("s"), F.col("i")), s="immoweb", i="1")
    assert md5 == hashlib.md5(b"immoweb:1").hexdigest()
    blake = one(spark, X.fingerprint(F.col("s"), F.col("i"), "blake2b"), s="immoweb", i="1")
    assert blake == hashlib.blake2b(b"immoweb:1", digest_size=16).hexdigest()


def test_floats(spark):
    assert one(spark, X.float_comma(F.col("t")), t="50,85") == 50.85
    assert one(spark, X.float_plain(F.col("t")), t="50,85") is None
    assert one(spark, X.float_plain(F.col("t")), t="1d") is None


def test_strip_takes_unicode_space(spark):
    assert one(spark, X.strip(F.col("t")), t=f" {NBSP}\t a b  \n") == "a b"


@pytest.mark.parametrize(
    "doc, value",
    [
        ('{"v": 140.9}', 140),
        ('{"v": "275.000"}', 275000),
        ('{"v": -5}', None),
        ('{"v": true}', None),
        ('{"v": null}', None),
        ('{"v": [1]}', None),
        ('{"v": 1} trailing', None),
        ('{"v": 1, "v": 2}', 2),
        ('{"v": ', None),
    ],
)
def test_as_int(spark, doc, value):
    assert one(spark, J.as_int(J.child(J.parse_strict(F.col("t")), "v")), t=doc) == value
