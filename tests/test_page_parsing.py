"""What a page costs to parse: objects are opened once, whatever is read of them."""

from pyspark.sql import functions as F

from plotmerge.functions import json_values as J
from plotmerge.functions import text as X
from plotmerge.schemas import RAW_PAGE, empty
from plotmerge.sources import layouts


def test_an_object_is_opened_at_all_paths_in_one_pass(spark):
    rows = [('{"a": 1, "b": {"c": "x", "d": 2}, "n": null}',), ('{"b": 5}',), ("[1]",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(F.try_parse_json("t").alias("v"))
    at = J.opened(F.col("v"), ("a",), ("b", "c"), ("b", "z"), ("n",))
    found = df.select(
        J.int_of(at["a"]).alias("a"), J.string_of(at["b"]["c"]).alias("c"), at["b"]["z"].isNull().alias("no_z"),
        at["n"].isNotNull().alias("has_n"), at.isNull().alias("no_object"), J.is_object(F.col("v")).alias("object"),
    ).collect()
    assert [tuple(r) for r in found] == [
        (1, "x", True, True, False, True), (None, None, True, False, False, True),
        (None, None, True, False, True, False), (None, None, True, False, True, False),
    ]


def test_layouts_read_fields_with_few_interpreted_steps(spark):
    plan = layouts.extract_candidates(empty(spark, RAW_PAGE))._jdf.queryExecution().analyzed().toString()
    # Lambdas are not compiled: 295 when each field opened its objects itself.
    assert plan.count("lambdafunction(") < 150


def test_a_text_with_plain_ends_is_left_and_others_are_stripped(spark):
    texts = ["a", "", " a", "a\u00a0", "\u2003é b\t", "é", None, " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(X.strip_of(F.col("t")).alias("s")).collect()] == [
        "a", "", "a", "a", "é b", "é", None, "",
    ]
