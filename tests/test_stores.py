"""Bucketed stores, the known-URL index and the refresh into stores."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plotmerge.operators import consolidate as C
from plotmerge.operators import frontier as Fr
from plotmerge.operators import known as K
from plotmerge.operators import refresh as R
from plotmerge.plans import inputs as I
from plotmerge.plans.catalog import Tables
from plotmerge.schemas import LISTING, LISTING_SOURCE, META
from plotmerge.sources import tables

SF_DIR = "/root/testdata/sf0.001"
AT = datetime(2024, 6, 1)


@pytest.fixture(autouse=True)
def few_tasks(spark):
    """Small tables: one task a stage."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def bucketed(spark, tmp_path, buckets=32, name="meta_rows"):
    return tables.BucketedTable(spark, str(tmp_path), name, META, "key", buckets)


def numbered(spark, low, high, value):
    return spark.range(low, high, numPartitions=1).select(
        F.col("id").cast("string").alias("key"), F.lit(value).alias("value"), F.lit(AT).alias("at"))


def files(tmp_path, name="meta_rows"):
    return {str(f): f.stat().st_mtime_ns for f in (tmp_path / name).rglob("*.parquet")}


def test_a_write_of_few_keys_leaves_the_other_buckets_in_place(spark, tmp_path):
    t = bucketed(spark, tmp_path)
    assert t.version() == 0 and t.read().count() == 0 and t.manifest() == {}
    assert t.upsert(numbered(spark, 0, 1000, "a"), AT) == 1
    before, first = files(tmp_path), t.manifest()
    assert len(first) == 32
    changed = numbered(spark, 0, 10, "b").unionByName(numbered(spark, 5000, 5001, "new"))
    touched = t.touched(changed)
    assert 0 < len(touched) <= 11
    assert t.upsert(changed, AT) == 2
    second, after = t.manifest(), files(tmp_path)
    assert {b for b in second if second[b] != first[b]} == set(touched)
    assert {f: m for f, m in after.items() if f in before} == before
    assert len(after) - len(before) == len(touched)
    want = {str(k): "b" if k < 10 else "a" for k in range(1000)} | {"5000": "new"}
    assert {r["key"]: r["value"] for r in t.read().collect()} == want
    # Reading for keys opens the files of their buckets alone, all of the current version.
    part = t.read_for(numbered(spark, 3, 4, ""))
    assert len(part.inputFiles()) == 1 and "b" in {r["value"] for r in part.collect()}


def test_buckets_may_empty_and_the_number_of_buckets_stays(spark, tmp_path):
    t = bucketed(spark, tmp_path, 8)
    t.upsert(numbered(spark, 0, 50, "a"), AT)
    again = bucketed(spark, tmp_path, 3)
    assert again.read().count() == 50
    again.update(numbered(spark, 0, 50, ""), lambda stored, _: stored.where("key = '7'"), AT)
    assert rows(t.read(), "key") == [("7",)] and len(t.manifest()) == 1
    again.update(numbered(spark, 0, 50, ""), lambda stored, _: stored.limit(0), AT)
    assert t.read().count() == 0 and t.version() == 3
    assert t.upsert(numbered(spark, 0, 0, ""), AT) == 3  # nothing to do
    t.upsert(numbered(spark, 1, 3, "z"), AT)
    assert rows(again.read(), "key", "value") == [("1", "z"), ("2", "z")] and again._buckets == 8


def test_rows_of_other_buckets_are_refused(spark, tmp_path):
    t = bucketed(spark, tmp_path)
    with pytest.raises(ValueError):
        t.update(numbered(spark, 0, 1, "a"), lambda stored, _: numbered(spark, 0, 500, "a"), AT)
    assert t.version() == 0


def test_two_writers_conflict(spark, tmp_path):
    one, two = bucketed(spark, tmp_path), bucketed(spark, tmp_path)
    one.upsert(numbered(spark, 0, 5, "a"), AT)

    def merge(stored, new):
        one.upsert(numbered(spark, 5, 9, "b"), AT)
        return stored

    with pytest.raises(tables.WriteConflict):
        two.update(numbered(spark, 0, 1, "c"), merge, AT)
    assert two.version() == 2 and two.read().count() == 9


def test_refresh_into_stores_equals_refresh_of_tables(spark, tmp_path):
    t = Tables(spark, SF_DIR)
    pages = I.landed_pages(t)
    first = pages.where(F.xxhash64("source_url") % 3 == 0)
    listings = tables.BucketedTable(spark, str(tmp_path), "listings", LISTING, "fingerprint", 16)
    sources = tables.BucketedTable(spark, str(tmp_path), "sources", LISTING_SOURCE, "listing_id", 16)
    R.refresh_store(first, listings, sources, F.lit(datetime(2024, 5, 1)), AT)
    old_listings, old_sources = listings.read(), sources.read()
    want = R.refresh(pages, old_listings, old_sources, F.lit(AT))
    outcomes = R.refresh_store(pages, listings, sources, F.lit(AT), AT)
    names = [f.name for f in LISTING]
    assert rows(listings.read(), *names) == rows(want.listings, *names)
    names = [f.name for f in LISTING_SOURCE]
    assert rows(sources.read(), *names) == rows(want.sources, *names)
    names = ["source_name", "ref_url", "stage", "message"]
    assert rows(outcomes, *names) == rows(want.outcomes, *names)
    # Nothing new: nothing is written.
    version = listings.version()
    known = pages.join(listings.read().limit(0), F.lit(False), "left_semi")
    R.refresh_store(known, listings, sources, F.lit(AT), AT)
    assert listings.version() == version


def urls(spark, low, high, source="x"):
    return spark.range(low, high, numPartitions=1).select(
        F.lit(source).alias("source_name"), F.concat(F.lit("https://h/"), "id").alias("url"))


def test_known_index_reads_keys_of_hits_only_over_50_batches(spark, tmp_path):
    index = K.KnownUrls(spark, str(tmp_path / "known"))
    assert rows(index.flag(urls(spark, 0, 3)), "known") == [(False,)] * 3
    for k in range(50):
        index.add(urls(spark, 40 * k, 40 * k + 40), f"batch={k}")
        if k % 10 != 9:
            continue
        # Of a batch, 20 URLs that batch 3 has stored and 20 new ones.
        landed = urls(spark, 130, 150).unionByName(urls(spark, 10**6 + 20 * k, 10**6 + 20 * k + 20))
        hits = index.hits(landed.select(K.key_hash().alias("h")))
        read = {r["folder"] for r in hits.select("folder").distinct().collect()}
        assert "batch=3" in read and len(read) <= 3
        opened = index.look_up(hits).inputFiles()
        assert {f.split("/keys/")[1].split("/")[0].replace("%3D", "=") for f in opened} == read
        got = {r["url"]: r["known"] for r in index.flag(landed).collect()}
        assert sum(got.values()) == 20 and all(got[f"https://h/{n}"] for n in range(130, 150))
    assert not any(r["known"] for r in index.flag(urls(spark, 130, 150), but="batch=3").collect())
    assert not any(r["known"] for r in index.flag(urls(spark, 130, 150, "y")).collect())


def test_many_hits_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "LISTED_HITS", 5)
    index = K.KnownUrls(spark, str(tmp_path / "known"))
    index.add(urls(spark, 0, 100), "batch=0")
    assert index.flag(urls(spark, 50, 150)).where("known").count() == 50


def test_the_filter_lets_all_members_and_few_others_pass(spark):
    keys = urls(spark, 0, 20_000).select(K.key_hash().alias("h"))
    words = K.word_count(20_000)
    bloom = K.build_filter(keys, words)

    def passed(low, high):
        asked = urls(spark, low, high).select(K.key_hash().alias("h"))
        found = asked.join(bloom, F.pmod("h", F.lit(words)) == F.col("word"))
        return found.where(K.passes(F.col("h"), F.col("bits"))).count()

    assert passed(0, 20_000) == 20_000
    assert passed(100_000, 200_000) < 300
    assert [K.word_count(n) for n in (0, 1, 2, 3, 6, 8, 9, 10)] == [1, 1, 1, 1, 4, 4, 4, 8]


def test_flags_by_filter_equal_flags_by_join(spark):
    frontier = urls(spark, 0, 300).unionByName(urls(spark, 0, 50, None)).withColumn("ord", F.lit(1))
    known = urls(spark, 250, 900).select(
        "source_name", F.col("url").alias("source_url"),
        F.when(F.col("url").endswith("7"), F.lit("https://h/3")).alias("ref_url"))
    want = rows(Fr.flag_known(frontier, known), "source_name", "url", "known")
    got = K.flag_known_filtered(frontier, known)
    assert rows(got, "source_name", "url", "known") == want
    assert rows(K.flag_known_filtered(frontier, known.limit(0)), "known") == [(False,)] * 350


def test_several_tasks_write_a_bucket(spark, tmp_path):
    confs = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        t = bucketed(spark, tmp_path, 1)
        t.upsert(numbered(spark, 0, 200, "a"), AT)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files(tmp_path)) > 1
    assert rows(t.read(), "key") == sorted([(str(n),) for n in range(200)], key=repr)
