import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plotmerge.operators import frontier as Fr
from plotmerge.operators import geo, quality
from plotmerge.operators import listing_query as Q
from plotmerge.operators import validate as V
from plotmerge.operators.ranking import row_numbers
from plotmerge.sources import registry, sitemaps, tables
from plotmerge.schemas import LISTING


@pytest.mark.parametrize("pc, inside", [(8000, True), (8500, True), (9000, True), (9999, True), (1000, False), (2000, False), (7000, False)])
def test_scope(spark, pc, inside):
    assert spark.range(1).select(Fr.in_scope(F.lit(pc))).first()[0] is inside


def test_row_numbers_match_a_plain_window(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", None]), rng.randrange(500), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o bigint, i bigint")
    want, seen = {}, {}
    for k, o, i in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    for width in (1, 7, 10_000):
        got = {r["i"]: r["rn"] for r in row_numbers(df, ["k"], "o", width=width, ties=("i",)).collect()}
        assert got == want
        few = row_numbers(df, ["k"], "o", width=width, at_most=40, ties=("i",))
        assert {r["i"] for r in few.collect()} == {i for i, n in want.items() if n <= 40}


@pytest.mark.parametrize("spread", [0, 1, 10**6])
def test_row_numbers_of_crowded_orders(spark, monkeypatch, spread):
    """A group of ties, dense orders and orders in microseconds, in buckets too large for a task."""
    from plotmerge.operators import ranking

    rng = random.Random(2)
    rows = [("hot" if i % 3 else "b", 1_700_000_000_000_000 + rng.randrange(1 + 900 * spread), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o bigint, i bigint").repartition(6)
    want, seen = {}, {}
    for k, o, i in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    parts = []
    real = ranking.materialize

    def placed(found, name):
        out = real(found, name)
        parts.extend(r["n"] for r in out.groupBy(F.shiftright("_at", 33)).agg(F.count("*").alias("n")).collect())
        return out

    monkeypatch.setattr(ranking, "materialize", placed)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = row_numbers(df, ["k"], "o", width=2_000_000_000, ties=("i",), most=400)
    assert {r["i"]: r["rn"] for r in got.collect()} == want
    few = row_numbers(df, ["k"], "o", width=2_000_000_000, ties=("i",), most=400, at_most=70)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r["i"] for r in few.collect()} == {i for i, n in want.items() if n <= 70}
    assert len(parts) == 16 and max(parts) <= 2 * 3000 / 8  # eight tasks each time, none above twice the mean


def test_cap_and_skips_match_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xxxy"), f"u{i}", i, rng.random() < 0.4) for i in range(300)]
    df = spark.createDataFrame(rows, "source_name string, url string, ord bigint, known boolean")
    for limit in (None, 1, 50, 1000):
        want, kept = {}, set()
        for s, u, _, known in rows:
            taken, skipped = want.get(s, (0, 0))
            if limit is not None and taken >= limit:
                continue
            if known:
                want[s] = (taken, skipped + 1)
            else:
                want[s] = (taken + 1, skipped)
                kept.add(u)
        got = Fr.skipped_counts(df, limit, width=16).collect()
        assert {r["source_name"]: (r["discovered"], r["skipped_known"]) for r in got} == want
        assert {r["url"] for r in Fr.cap_per_source(df, limit, width=16).collect()} == kept


def test_known_urls_by_either_name(spark):
    df = spark.createDataFrame([("x", "a", 1), ("x", "b", 2), ("y", "a", 3)], "source_name string, url string, ord bigint")
    known = spark.createDataFrame([("x", "canonical", "a")], "source_name string, source_url string, ref_url string")
    assert sorted(r["ord"] for r in Fr.drop_known(df, known).collect()) == [2, 3]
    assert Fr.drop_known(df, known, skip_known=False).count() == 3


def test_schedule_spacing(spark):
    df = spark.createDataFrame([(f"https://{h}/p{i}", i) for i, h in enumerate(["a", "b", "a", "a"])], "url string, ord bigint")
    got = {r["ord"]: r["request_at"] for r in Fr.schedule(df, F.lit(datetime(2024, 1, 1)), overrides={"b": 0}, width=2).collect()}
    assert (got[2] - got[0]).total_seconds() == pytest.approx(1 / 3, abs=1e-5)
    assert got[1] == got[0] == datetime(2024, 1, 1)


def test_admission_fails_open(spark):
    df = spark.createDataFrame([("https://a/x/1",), ("https://a/y",), ("https://b/x",), ("geen url",)], "url string")
    rules = spark.createDataFrame([("a", 2, False, "/x"), ("a", 1, True, "/x/1")], "host string, ord int, allow boolean, prefix string")
    assert [r["allowed"] for r in Fr.admit(df, rules).orderBy("url").collect()] == [True, True, True, True]
    strict = spark.createDataFrame([("a", 1, False, "/x")], "host string, ord int, allow boolean, prefix string")
    assert [r["allowed"] for r in Fr.admit(df, strict).orderBy("url").collect()] == [True, False, True, True]


GOOD = dict(
    fingerprint="f" * 32, postcode=8500, gemeente="Kortrijk", lat=50.8, lng=3.2, prijs_eur=1, type="huis", epc_label="A+",
    staat=None, titel="", korte_beschrijving="", hoofd_foto_url=None, user_status="nieuw", n_sources=1,
)
SCHEMA = (
    "fingerprint string, postcode int, gemeente string, lat double, lng double, prijs_eur bigint, type string, epc_label string, "
    "staat string, titel string, korte_beschrijving string, hoofd_foto_url string, user_status string, n_sources int"
)


@pytest.mark.parametrize(
    "field, value",
    [
        ("postcode", 999), ("postcode", 10000), ("postcode", None), ("n_sources", 0), ("hoofd_foto_url", "not-a-url"),
        ("hoofd_foto_url", ""), ("prijs_eur", -1), ("lat", 52.0), ("lng", 1.0), ("gemeente", "  "), ("type", "kasteel"),
        ("epc_label", "G"), ("staat", "oud"), ("user_status", "weg"), ("fingerprint", "short"), ("titel", None),
    ],
)
def test_listing_constraints(spark, field, value):
    row = spark.createDataFrame([tuple({**GOOD, field: value}.values())], SCHEMA)
    name = "sources" if field == "n_sources" else field
    assert V.check_listings(row).first()["reasons"] == [name]


def test_good_listing(spark):
    checked = V.check_listings(spark.createDataFrame([tuple(GOOD.values())], SCHEMA))
    assert V.accepted(checked).count() == 1 and V.quarantined(checked).count() == 0


def test_sources_have_one_row_contract_at_every_size(spark):
    s = spark.range(1000).repartition(7).select(
        F.when(F.col("id") < 900, "big").otherwise("small").alias("listing_id"), F.lit("s").alias("source_name"),
        F.col("id").cast("string").alias("source_id"), (1000 - F.col("id")).alias("first_seen"))
    rows = Q.sorted_sources(s).collect()
    for name, ids in (("big", range(900)), ("small", range(900, 1000))):
        mine = sorted((r["pos"], r["source_id"], r["n_sources"], r["first_source"]["source_id"]) for r in rows if r["listing_id"] == name)
        first = str(max(ids))
        assert mine == [(k, i, len(ids), first) for k, i in enumerate(sorted(map(str, ids)), 1)]


def test_a_hot_listing_lies_in_many_tasks(spark):
    rows = [("hot" if k < 900 else f"l{k % 7}", f"s{k % 3}", f"{k:04}", k % 50) for k in range(1000)]
    s = spark.createDataFrame(rows, "listing_id string, source_name string, source_id string, first_seen int").repartition(6)
    listings = spark.createDataFrame([("hot",), ("none",), *((f"l{k}",) for k in range(7))], "id string")
    got = sorted(tuple(r) for r in Q.with_sources(listings, s, 20).select(
        "id", "n_sources", "first_source.source_id", "pos", F.col("source_name"), F.col("source_id").alias("own")).collect())
    want = [("none", 0, None, None, None, None)]
    for listing in ["hot", *(f"l{k}" for k in range(7))]:
        mine = sorted(r for r in rows if r[0] == listing)
        first = min(mine, key=lambda r: (r[3], r[1], r[2]))[2]
        want += [(listing, len(mine), first, k, r[1], r[2]) for k, r in enumerate(mine, 1)]
    assert got == sorted(want)


def test_positions_of_ties_and_gaps(spark):
    from collections import defaultdict

    from plotmerge.operators.ranking import positions

    rows = [(None if k % 3 == 0 else k % 3, 10 ** (k % 17) if k % 5 else 7) for k in range(400)]
    found = defaultdict(list)
    for r in positions(spark.createDataFrame(rows, "k int, o long").repartition(5), ["k"], ["o"]).collect():
        found[r["k"]].append((r["pos"], r["o"]))
    for mine in found.values():
        mine.sort()
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1))
        assert [o for _, o in mine] == sorted(o for _, o in mine)
    assert sum(map(len, found.values())) == 400


def test_filters_are_pushed_to_the_scan(spark, tmp_path):
    from plotmerge.schemas import empty

    empty(spark, LISTING).write.parquet(str(tmp_path / "l"))
    df = Q.query_listings(spark.read.parquet(str(tmp_path / "l")), postcode=8500, prijs_min=1, limit=10).select("id", "titel")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(postcode,8500)" in text and "GreaterThanOrEqual(prijs_eur,1)" in text
    assert "TakeOrderedAndProject" in text and "straat" not in text


def test_listing_without_sources_stays(spark):
    listings = spark.createDataFrame([("1",), ("2",)], "id string")
    sources = spark.createDataFrame([("1", "b", "2", 1), ("1", "a", "1", 2)], "listing_id string, source_name string, source_id string, first_seen int")
    got = sorted((r["id"], r["n_sources"], r["pos"], r["source_name"], r["source_id"]) for r in Q.with_sources(listings, sources).collect())
    assert got == [("1", 2, 1, "a", "1"), ("1", 2, 2, "b", "2"), ("2", 0, None, None, None)]


def test_jitter_range_and_stability(spark):
    ids = spark.range(5000).select(F.col("id").cast("string").alias("id"))
    lat, lng = geo._jitter(geo.stable_hash(F.col("id")))
    row = ids.select(F.min(lat), F.max(lat), F.min(lng), F.max(lng)).first()
    assert -0.00751 < row[0] < 0 < row[1] < 0.0075 and -0.01001 < row[2] < 0 < row[3] < 0.01


def test_versioned_table(spark, tmp_path):
    t = tables.VersionedTable(spark, str(tmp_path), "listings", LISTING)
    assert t.version() == 0 and t.read().count() == 0
    one = spark.createDataFrame([("1", 8500)], "id string, postcode int")
    t.write(one, datetime(2024, 1, 1), ("postcode", "id"))
    t.write(t.read().unionByName(t.read().withColumn("id", F.lit("2"))), datetime(2024, 1, 2))
    assert t.version() == 2 and sorted(r["id"] for r in t.read().collect()) == ["1", "2"]
    assert t.read().schema.fieldNames() == LISTING.fieldNames()


def test_meta_last_value(spark, tmp_path):
    path = str(tmp_path / "m")
    assert tables.get_meta(spark, path, "last_refresh_at") is None
    tables.put_meta(spark, path, "last_refresh_at", "b", datetime(2024, 1, 2))
    tables.put_meta(spark, path, "last_refresh_at", "a", datetime(2024, 1, 1))
    assert tables.get_meta(spark, path, "last_refresh_at") == "b"


def test_enabled_sources():
    assert list(registry.enabled()) == ["zimmo", "immoweb", "immovlan", "immoscoop"]
    assert list(registry.enabled(["immovlan", "nergens"])) == ["immovlan"]


def test_gunzip(spark):
    import gzip

    packed = gzip.compress(b"<urlset/>")
    df = spark.createDataFrame(
        [("a.xml.gz", packed), ("b.xml", packed), ("c.xml.gz", b"plain"), ("d.xml.gz", packed[:12]), ("e", None)], "url string, body binary"
    )
    got = {r["url"]: r["body"] and bytes(r["body"]) for r in sitemaps.gunzip(df).collect()}
    assert got == {"a.xml.gz": b"<urlset/>", "b.xml": b"<urlset/>", "c.xml.gz": b"plain", "d.xml.gz": packed[:12], "e": None}


def test_sitemap_namespace_and_malformed(spark):
    ns = "xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'"
    docs = [f"<urlset {ns}><url><loc> a </loc></url><url><loc/></url></urlset>", "<urlset><url><loc>b</loc></url></urlset>", f"<urlset {ns}><loc>c</loc>", ""]
    df = spark.createDataFrame([("s", str(i), x) for i, x in enumerate(docs)], "source_name string, sitemap_url string, xml string")
    assert [(r["sitemap_url"], r["loc"]) for r in sitemaps.sitemap_locs(df).collect()] == [("0", "a")]


def test_error_samples(spark):
    df = spark.createDataFrame([("x", i, f"m{i}") for i in range(8)] + [("y", 1, "only")], "source_name string, o int, message string")
    got = {r["source_name"]: (r["errors"], r["messages"], r["suppressed"]) for r in quality.error_samples(df, "o").collect()}
    assert got == {"x": (8, ["m0", "m1", "m2", "m3", "m4"], 3), "y": (1, ["only"], 0)}


def test_known_pages_are_told_by_their_urls(spark):
    """No body is needed to tell them, and every known page is counted."""
    from plotmerge.operators import refresh as R

    pages = spark.createDataFrame(
        [("a", "u1", b"x"), ("a", "u2", b"x"), ("b", "u1", b"x"), ("a", "u2", b"y")], "source_name string, source_url string, body binary")
    known = spark.createDataFrame([("a", "u2"), ("c", "u1")], "source_name string, source_url string")
    new, skipped = R.new_pages(pages, known)
    assert new.columns == pages.columns
    assert sorted((r["source_name"], r["source_url"]) for r in new.collect()) == [("a", "u1"), ("b", "u1")]
    assert [(r["source_name"], r["ref_url"], r["stage"]) for r in skipped.collect()] == [("a", "u2", "skipped_known")] * 2
    none, nothing = R.new_pages(pages, known.where("source_name = 'c'"))
    assert none.count() == 4 and nothing.count() == 0


def test_rules_see_the_query(spark):
    df = spark.createDataFrame([("https://a/x?page=2",), ("https://a/x?p=2",), ("https://a?page=1",)], "url string")
    rules = spark.createDataFrame([("a", 1, False, "/x?page="), ("a", 2, False, "/?")], "host string, ord int, allow boolean, prefix string")
    assert [r["allowed"] for r in Fr.admit(df, rules).orderBy("url").collect()] == [True, False, False]


def test_a_second_writer_is_noticed(spark, tmp_path):
    from datetime import datetime

    from plotmerge.schemas import META

    one = tables.VersionedTable(spark, str(tmp_path), "meta_rows", META)
    two = tables.VersionedTable(spark, str(tmp_path), "meta_rows", META)
    rows = spark.createDataFrame([("k", "v", datetime(2024, 1, 1))], META)
    assert one.write(rows, datetime(2024, 1, 1)) == 1
    before, calls = two._current(), []
    real = two._current
    # The other writer finishes between this one's start and its end.
    def current():
        calls.append(1)
        if len(calls) == 2:
            one.write(rows.union(rows), datetime(2024, 1, 2))
        return real()
    two._current = current
    with pytest.raises(tables.WriteConflict):
        two.write(rows, datetime(2024, 1, 3))
    assert before[0] == 1 and one.version() == 2 and one.read().count() == 2


def test_shared_folder_is_refused_on_a_cluster_without_one():
    from plotmerge.session import shared_dir

    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_dir(Session, "x")
    Session.conf = Conf({"spark.master": "local[2]"})
    first = shared_dir(Session, "x")
    assert first.rsplit("/", 1)[0] == Session.conf["spark.checkpoint.dir"] == shared_dir(Session, "y").rsplit("/", 1)[0]


def test_location_words_find_long_keys(spark):
    docs = spark.createDataFrame([('{"place": {"long": 4.5, "longitude": 3, "name": "x"}}',)], "doc string")
    got = quality.json_key_profile(docs, "doc", words=quality.GEO_WORDS).collect()
    assert {r["path"] for r in got} == {"place.long", "place.longitude"}


def test_keys_of_all_list_items_are_profiled(spark):
    """Items behind the fifth, and items of lists in lists, are opened as the first ones are."""
    items = ", ".join(f'{{"id": {k}}}' for k in range(8))
    docs = spark.createDataFrame([
        (f'{{"list": [{items}, {{"lat": 1}}, {{"at": [0, 0, 0, 0, 0, {{"lng": "x"}}]}}]}}',),
        ('{"rings": [[[{"geo": [[{"a": {"b": [[[{"lat": 2}]]]}}]]}]], [], [[]]]}',),
        ('[{"lat": 3}, [{"lat": 4}]]',), ("[[[]]]",), ('{"lat": 5} x',), (None,),
    ], "doc string")
    got = quality.json_key_profile(docs, "doc", words=quality.GEO_WORDS).collect()
    assert {(r["path"], r["type"], r["n"], r["preview"]) for r in got} == {
        ("list.lat", "BIGINT", 1, "1"), ("list.at.lng", "STRING", 1, '"x"'),
        ("rings.geo", "ARRAY", 1, '[[{"a":{"b":[[[{"lat":2}]]]}}]]'), ("rings.geo.a.b.lat", "BIGINT", 1, "2"),
        ("lat", "BIGINT", 2, "3"),
    }
    every = quality.json_key_profile(docs, "doc").collect()
    assert {r["path"]: r["n"] for r in every} == {
        "list": 1, "list.id": 8, "list.lat": 1, "list.at": 1, "list.at.lng": 1,
        "rings": 1, "rings.geo": 1, "rings.geo.a": 1, "rings.geo.a.b": 1, "rings.geo.a.b.lat": 1, "lat": 2,
    }
