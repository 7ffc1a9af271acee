from datetime import datetime

from pyspark.sql import functions as F

from plotmerge.operators import consolidate as C
from plotmerge.operators import refresh as R
from plotmerge.plans import inputs as I
from plotmerge.plans.catalog import Tables
from plotmerge.schemas import LISTING, LISTING_SOURCE, RAW_PAGE, empty
from plotmerge.streaming import refresh as S

RUN = datetime(2024, 6, 1)
SF_DIR = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def observations(spark, tmp_path, files=6):
    obs = I.obs(Tables(spark, SF_DIR)).withColumn("created_at", F.col("fetched_at"))
    obs.repartition(files, "ord").write.parquet(str(tmp_path / "obs"))
    return spark.read.parquet(str(tmp_path / "obs"))


def test_micro_batches_equal_one_batch(spark, tmp_path):
    obs = observations(spark, tmp_path)
    stream = S.read_pages(spark, str(tmp_path / "obs"), obs.schema, files_per_batch=1)
    S.fold_stream(stream, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    batches = [p for p in (tmp_path / "log").iterdir() if p.name.startswith("batch=")]
    assert len(batches) > 1
    names = ["fingerprint", "postcode", "prijs_eur", "titel", "straat", "updated_at"]
    whole = rows(C.consolidate(obs, F.lit(RUN)), *names)
    assert rows(S.current(spark, str(tmp_path / "log"), F.lit(RUN)), *names) == whole
    # Running again finds nothing new; compaction changes nothing.
    S.fold_stream(stream, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    S.compact(spark, str(tmp_path / "log"), str(tmp_path / "log2"))
    assert rows(S.current(spark, str(tmp_path / "log2"), F.lit(RUN)), *names) == whole


def test_continuous_state(spark, tmp_path):
    obs = observations(spark, tmp_path, 3)
    stream = S.read_pages(spark, str(tmp_path / "obs"), obs.schema, files_per_batch=1)
    q = S.continuous_state(stream).writeStream.format("memory").queryName("fold_state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = rows(C.finish(spark.table("fold_state"), F.lit(RUN)), "fingerprint", "prijs_eur", "titel")
    assert got == rows(C.consolidate(obs, F.lit(RUN)), "fingerprint", "prijs_eur", "titel")


def test_new_urls(spark, tmp_path):
    df = spark.createDataFrame([("x", "a"), ("x", "a"), ("x", "b"), ("y", "a")], "source_name string, url string")
    df.repartition(3).write.parquet(str(tmp_path / "u"))
    stream = S.read_pages(spark, str(tmp_path / "u"), df.schema, files_per_batch=1)
    q = S.new_urls(stream).writeStream.format("memory").queryName("urls").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("urls"), "source_name", "url") == [("x", "a"), ("x", "b"), ("y", "a")]


def test_page_stream_equals_batch_refresh(spark, tmp_path):
    pages = I.landed_pages(Tables(spark, SF_DIR))
    pages.repartition(3, "source_url").write.parquet(str(tmp_path / "pages"))
    landed = spark.read.parquet(str(tmp_path / "pages"))
    base = str(tmp_path / "out")
    stream = S.read_pages(spark, str(tmp_path / "pages"), RAW_PAGE, files_per_batch=1)
    S.refresh_stream(stream, base, str(tmp_path / "ck"), F.lit(RUN)).awaitTermination()
    whole = R.refresh(landed, empty(spark, LISTING), empty(spark, LISTING_SOURCE), F.lit(RUN))
    names = ["fingerprint", "id", "postcode", "gemeente", "prijs_eur", "titel"]
    assert rows(S.current(spark, f"{base}/listings", F.lit(RUN)), *names) == rows(whole.listings, *names)
    source = ["source_name", "source_id", "source_url"]
    assert rows(S.current_sources(spark, base), *source) == rows(whole.sources, *source)
    bad = whole.outcomes.where(F.col("message").isNotNull())
    assert rows(spark.read.parquet(f"{base}/failures"), "ref_url", "message") == rows(bad, "ref_url", "message")


def test_page_stream_restarts_and_skips_what_is_stored(spark, tmp_path):
    """A new checkpoint on the same base writes beside the old folders and parses nothing again."""
    pages = I.landed_pages(Tables(spark, SF_DIR))
    pages.repartition(2, "source_url").write.parquet(str(tmp_path / "pages"))
    base, names = str(tmp_path / "out"), ["fingerprint", "id", "prijs_eur", "titel"]

    def run(checkpoint, into=base, **more):
        stream = S.read_pages(spark, str(tmp_path / "pages"), RAW_PAGE, files_per_batch=1)
        S.refresh_stream(stream, into, str(tmp_path / checkpoint), F.lit(RUN), **more).awaitTermination()

    run("ck1")
    before = rows(S.current(spark, f"{base}/listings", F.lit(RUN)), *names)
    parsed = spark.read.parquet(f"{base}/checked").where("reject IS NULL and size(reasons) = 0").count()
    run("ck2")
    assert rows(S.current(spark, f"{base}/listings", F.lit(RUN)), *names) == before
    assert len([p for p in (tmp_path / "out" / "listings").iterdir() if p.name.startswith("batch=")]) == 4
    again = spark.read.parquet(f"{base}/checked").where("reject IS NULL and size(reasons) = 0").count()
    assert again == parsed
    S.compact_refresh(spark, base, str(tmp_path / "small"))
    assert rows(S.current(spark, f"{tmp_path}/small/listings", F.lit(RUN)), *names) == before
    # A store from before the stream: its pages are left alone, the others come in.
    known = spark.read.parquet(f"{base}/sources").where("source_name = 'zimmo'").selectExpr("source_name", "ord.ref_url AS source_url")
    run("ck3", into=str(tmp_path / "new"), known=known, fingerprint_mode="blake2b")
    got = spark.read.parquet(f"{tmp_path}/new/sources")
    assert "zimmo" not in {r["source_name"] for r in got.select("source_name").distinct().collect()}
    assert got.count() > 0


def test_new_urls_are_written_once_over_restarts(spark, tmp_path):
    one = spark.createDataFrame([("x", "a"), ("x", "b")], "source_name string, url string").coalesce(1)
    one.write.parquet(str(tmp_path / "u"))

    def run():
        stream = S.read_pages(spark, str(tmp_path / "u"), one.schema, files_per_batch=1)
        S.write_new_urls(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        return rows(spark.read.parquet(str(tmp_path / "out")), "source_name", "url")

    assert run() == [("x", "a"), ("x", "b")]
    more = spark.createDataFrame([("x", "a"), ("y", "a")], one.schema).coalesce(1)
    more.write.mode("append").parquet(str(tmp_path / "u"))
    assert run() == [("x", "a"), ("x", "b"), ("y", "a")]


def test_a_single_file_is_a_stream(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "d"))
    file = next((tmp_path / "d").glob("part-*.parquet"))
    stream = S.read_pages(spark, str(file), spark.range(5).schema)
    stream.writeStream.format("memory").queryName("single").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("single").count() == 5
