"""Text filter by trigrams against the plain filter."""

import pytest
from pyspark.sql import functions as F

from plotmerge.operators import listing_query as Q
from plotmerge.operators import text_index
from plotmerge.operators.text_index import TextIndex

TEXTS = [
    (1, "Ruime WONING met tuin", "bij het station"), (2, "woning", None), (3, None, None), (4, "", "x"),
    (5, "ab", "100% af_werking"), (6, "aaaa", "b\nc wonen"), (7, "Élan vital \U0001f600\U0001f601", "ö"),
    (8, "won", "ing"), (9, "de kat", "a.*b"), (10, "WONING woning", "woning"),
]
PATTERNS = ["woning", "WON", "won", "ing", "ab", "a", "x", "", "%", "0% a", "_", "aaa", "aaaaa", "b\nc", "élan",
            "\U0001f600\U0001f601", "ö", ".*", "niets hiervan", "won\n", "g"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame(TEXTS * 2, "id long, titel string, korte_beschrijving string").repartition(3)
    return TextIndex(spark, str(tmp_path_factory.mktemp("index"))).build(df, ["titel", "korte_beschrijving"])


@pytest.mark.parametrize("listed", [10_000, 1])
def test_same_rows_for_every_pattern(index, monkeypatch, listed):
    monkeypatch.setattr(text_index, "LISTED", listed)
    for pattern in PATTERNS if listed > 1 else PATTERNS[:4]:
        want = sorted(r["id"] for r in index.rows().where(Q.listing_filter(text=pattern)).collect())
        assert sorted(r["id"] for r in index.search(pattern).collect()) == want, pattern


def test_only_candidates_are_read(index):
    rows = {r["_row"]: r["id"] for r in index.rows().collect()}

    def candidates(pattern):
        return sorted(rows[r["row"]] for r in index.candidates(pattern).collect())

    assert candidates("woning") == [1, 1, 2, 2, 10, 10]
    assert candidates("niets hiervan") == []
    assert candidates("ab") == [5, 5]  # a text shorter than a trigram
    plan = index.search("woning")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(_row" in plan or "PushedFilters: [Or(" in plan or "_row" in plan.split("PushedFilters")[1]


def test_texts_are_cut_once(spark, tmp_path, monkeypatch):
    cuts = spark.sparkContext.accumulator(0)

    def counted(s):
        cuts.add(1)
        return [s[k : k + 3] for k in range(len(s) - 2)]

    monkeypatch.setattr(text_index, "grams", F.udf(counted, "array<string>"))
    rows = spark.createDataFrame([(k, f"tekst {k}") for k in range(5)], "id long, titel string")
    TextIndex(spark, str(tmp_path)).build(rows, ["titel"])
    assert cuts.value == 5
