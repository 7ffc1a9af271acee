from datetime import datetime

from pyspark.sql import functions as F

from plotmerge.operators import consolidate as C

RUN = datetime(2024, 6, 1)
OBS = "fingerprint string, ord bigint, id string, prijs_eur bigint, titel string, straat string, created_at timestamp"


def obs(spark, *rows):
    return spark.createDataFrame([(fp, o, f"id{o}", p, t, s, datetime(2024, 1, 1)) for fp, o, p, t, s in rows], OBS)


def result(df):
    return {r["fingerprint"]: r for r in df.collect()}


def test_fill_null_first_wins(spark):
    rows = obs(spark, ("a", 2, 5, "later", "s2"), ("a", 1, None, "", None), ("a", 3, 9, "x", ""), ("b", 4, 0, "", ""), ("b", 5, 8, "", None))
    got = result(C.consolidate(rows, F.lit(RUN)))
    a, b = got["a"], got["b"]
    assert (a["id"], a["prijs_eur"], a["titel"], a["straat"]) == ("id1", 5, "later", "s2")
    # 0 is a value; '' stays '' where nothing better comes.
    assert (b["id"], b["prijs_eur"], b["titel"], b["straat"]) == ("id4", 0, "", "")
    assert a["updated_at"] == RUN


def test_single_row_is_not_touched(spark):
    got = result(C.consolidate(obs(spark, ("a", 1, 1, "t", None)), F.lit(RUN)))["a"]
    assert got["updated_at"] == datetime(2024, 1, 1) and got["straat"] is None


def test_any_split_gives_the_same(spark):
    rows = obs(spark, *[(f"k{i % 7}", i, i if i % 3 else None, "" if i % 4 else f"t{i}", None) for i in range(1, 200)])
    whole = C.consolidate(rows, F.lit(RUN))
    for parts in (2, 5):
        states = None
        for p in range(parts):
            state = C.fold(C.lift(rows.where(F.col("ord") % parts == p), "ord"))
            states = state if states is None else states.unionByName(state)
        assert result(C.finish(C.fold(states), F.lit(RUN))) == result(whole)


def test_merge_into_store(spark):
    first = C.consolidate(obs(spark, ("a", 1, None, "t", None), ("c", 2, 1, "c", None)), F.lit(RUN)).drop("n_new", "n_stored")
    again = C.consolidate(obs(spark, ("a", 1, 7, "other", "s"), ("b", 2, 1, "b", None)), F.lit(RUN), first)
    got = result(again)
    assert (got["a"]["prijs_eur"], got["a"]["titel"], got["a"]["straat"]) == (7, "t", "s")
    assert got["c"]["updated_at"] == datetime(2024, 1, 1) and got["a"]["updated_at"] == RUN
    assert sorted(got) == ["a", "b", "c"]


def test_sources_keep_their_first_entry(spark):
    schema = "fingerprint string, source_name string, source_id string, ord bigint, source_url string, status string"
    new = spark.createDataFrame([("a", "x", "1", 2, "u2", "gone"), ("a", "x", "1", 1, "u1", "active"), ("a", "y", "1", 3, "u3", "active")], schema)
    stored = spark.createDataFrame([("a", "y", "1", "old", "gone")], "fingerprint string, source_name string, source_id string, source_url string, status string")
    got = {(r["source_name"], r["source_id"]): (r["source_url"], r["status"]) for r in C.merge_sources(new, stored).collect()}
    assert got == {("x", "1"): ("u1", "active"), ("y", "1"): ("old", "gone")}


def test_classify(spark):
    new = obs(spark, ("a", 1, 1, "", ""), ("b", 2, 1, "", ""), ("b", 3, 1, "", ""))
    stored = spark.createDataFrame([("a",)], "fingerprint string")
    got = {r["ord"]: r["outcome"] for r in C.classify(new, stored).collect()}
    assert got == {1: "merged", 2: "inserted", 3: "merged"}


def test_user_status_ignores_unknown(spark):
    listings = spark.createDataFrame([("1", "nieuw", datetime(2024, 1, 1))], "id string, user_status string, updated_at timestamp")
    updates = spark.createDataFrame(
        [("1", "bekeken", datetime(2024, 2, 1)), ("1", "weg", datetime(2024, 3, 1))], "id string, user_status string, at timestamp"
    )
    row = C.set_user_status(listings, updates).first()
    assert (row["user_status"], row["updated_at"]) == ("bekeken", datetime(2024, 2, 1))


def test_mark_gone_keeps_rows(spark):
    s = spark.createDataFrame([("x", "1", "active"), ("x", "2", "active")], "source_name string, source_id string, status string")
    gone = spark.createDataFrame([("x", "2"), ("x", "2")], "source_name string, source_id string")
    assert sorted(map(tuple, C.mark_gone(s, gone).collect())) == [("x", "1", "active"), ("x", "2", "gone")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_is_one_shuffle_with_partial_aggregation(spark):
    text = plan(C.consolidate(obs(spark, ("a", 1, 1, "t", None)), F.lit(RUN)))
    assert text.count("Exchange") == 1 and "partial_min" in text
