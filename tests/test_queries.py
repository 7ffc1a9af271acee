"""Every registered query against its SQL on the smallest data."""

import pytest
from oracle_check import compare, connection

from plotmerge.plans import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    q = QUERIES[name]
    if q.sql is None:
        assert q.run(spark, SF_DIR).count() > 0
    else:
        assert compare(spark, con, q, SF_DIR) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_tasks_grow_with_the_table(spark, monkeypatch, con):
    from plotmerge.plans import catalog
    from plotmerge.plans import inputs as I

    monkeypatch.setattr(catalog, "ROWS_A_TASK", 100)
    t = catalog.Tables(spark, SF_DIR)
    tasks = -(-t.lineitem.count() // 100)
    assert I.sources(t).rdd.getNumPartitions() == tasks
    assert QUERIES["duplicate_source_keys"].run(spark, SF_DIR).rdd.getNumPartitions() == tasks
    assert compare(spark, con, QUERIES["duplicate_source_keys"], SF_DIR) is None


def test_stream_batches_have_a_file_for_every_core(spark, monkeypatch):
    from plotmerge.streaming import refresh as stream

    seen, real = [], stream.read_pages

    def watched(spark, path, schema, files_per_batch):
        seen.append(files_per_batch)
        return real(spark, path, schema, files_per_batch=files_per_batch)

    monkeypatch.setattr(stream, "read_pages", watched)
    QUERIES["page_stream_refresh"].run(spark, SF_DIR)
    assert seen == [spark.sparkContext.defaultParallelism]


def test_sitemap_documents_reach_a_worker_a_hundred_at_a_time():
    from pyspark.util import PythonEvalType

    from plotmerge.sources.sitemaps import locs

    assert locs.evalType == PythonEvalType.SQL_BATCHED_UDF


def _tasks_of(monkeypatch, module, function):
    """The partitions of the frames handed to a function from here on."""
    seen, real = [], getattr(module, function)

    def watched(df, *args, **kwargs):
        seen.append(df.rdd.getNumPartitions())
        return real(df, *args, **kwargs)

    monkeypatch.setattr(module, function, watched)
    return seen


def test_json_documents_are_parsed_on_all_cores(spark, monkeypatch):
    from plotmerge.operators import quality

    seen = _tasks_of(monkeypatch, quality, "json_key_profile")
    QUERIES["json_geo_keys"].run(spark, SF_DIR)
    assert seen[0] >= spark.sparkContext.defaultParallelism


def test_error_samples_find_the_errors_once(spark):
    from plotmerge.operators import quality

    rows = spark.createDataFrame([("a", k, f"m{k}") for k in range(7)], "source_name string, k long, message string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    (got,) = quality.error_samples(rows.mapInArrow(counted, rows.schema), "k").collect()
    assert (got["errors"], got["messages"], got["suppressed"]) == (7, [f"m{k}" for k in range(5)], 2)
    assert read.value == 7


def test_tasks_of_nested_sources_grow_with_the_table(spark, monkeypatch, con):
    from plotmerge.plans import catalog

    monkeypatch.setattr(catalog, "ROWS_A_TASK", 100)
    tasks = -(-catalog.Tables(spark, SF_DIR).lineitem.count() // 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for it
    try:
        assert QUERIES["listing_with_sources"].run(spark, SF_DIR).rdd.getNumPartitions() == tasks
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert compare(spark, con, QUERIES["listing_with_sources"], SF_DIR) is None
