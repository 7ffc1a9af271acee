"""One page per layout, written here, and pages that must be rejected."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plotmerge.functions import markup as M
from plotmerge.functions import json_values as J
from plotmerge.schemas import RAW_PAGE
from plotmerge.sources.layouts import extract_candidates

AT = datetime(2024, 5, 1)

RESIDENCE = """<html><head><title>x</title>
<script type="application/ld+json">{"broken": </script>
<script type="application/ld+json">
{"@context": "https://schema.org", "@type": "SingleFamilyResidence", "name": " Hoekhuis aan het water ",
 "description": "Dak en keuken te renoveren.", "url": "https://z.example/nl/2018-zandpoort/te-koop/woning/40417/",
 "address": {"streetAddress": "Veerdam 61", "postalCode": "2018", "addressLocality": "Zandpoort"},
 "image": "https://z.example/1.jpg", "offers": {"price": 198500}, "numberOfRooms": 5,
 "floorSize": {"value": 163}, "energyEfficiencyScaleMin": "E", "energyConsumption": 407,
 "geo": {"latitude": 51.19, "longitude": 4.38}}</script></head></html>"""

PRODUCT_HOUSE = """<html><head>
<script type="application/ld+json">{"@type": "Product", "name": "Appartement", "description": "Instapklaar.",
 "image": ["https://s.example/a.jpg", "https://s.example/b.jpg"], "sku": "61932",
 "offers": {"price": "241900", "url": "https://s.example/te-koop/9300-wilgerode/61932"}}</script>
<script type="application/ld+json">{"@type": "House", "address": {"streetAddress": "Molenpad 8", "postalCode": 9300,
 "addressLocality": "Wilgerode"}, "geo": {"latitude": "1.0", "longitude": "2.0"}}</script></head>
<body><p>104 m² met 3 slaapkamers, EPC: C (188 kWh/m²)</p>
<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"property": {"id": 61932,
 "address": {"geo": {"lat": "50,94", "long": 4.04}}}}}}</script></body></html>"""

SPLIT = """<html><head><meta property="og:title" content="Huis te koop &amp; klaar">
<meta content="https://v.example/1.jpg" property='og:image'/>
<meta name="twitter:description" content="Huis | 329 500 € | woonopp. 131m² | 2 Slaapkamers">
<script type="application/ld+json">{"@type": "PostalAddress", "streetAddress": "Duinweg 17", "addressLocality": "Zeeburg"}</script>
<script type="application/ld+json">{"@type": "GeoCoordinates", "latitude": "51,31", "longitude": "3,07"}</script>
<script type="application/ld+json">{"@type": "House", "description": "Instapklaar huis. %s"}</script></head>
<body>EPC D - 296 kWh/m²</body></html>""" % ("x" * 600)

CLASSIFIED = """<html><script id='__NEXT_DATA__' type='application/json'>{"props": {"pageProps": {"classified": {
 "id": 90210077, "title": "Herenhuis", "description": "Karakter", "subType": "HOUSE", "buildingCondition": "TO_RENOVATE",
 "address": {"street": "Oude Vest", "houseNumber": "23", "postalCode": 8620, "city": "Noordkaai"},
 "location": {"latitude": 51.13, "longitude": 2.75}, "price": {"mainValue": 437000}, "habitableSurface": 187,
 "bedrooms": 6, "epc": {"label": "B", "consumption": 133}, "media": {"photos": [{"url": "https://w.example/1.jpg"}]}}}}}</script></html>"""

PAGES = {
    "residence": ("zimmo", "https://z.example/nl/2018-zandpoort/te-koop/woning/11/", RESIDENCE),
    "product_house": ("immoscoop", "https://s.example/te-koop/9300-wilgerode/61932", PRODUCT_HOUSE),
    "split": ("immovlan", "https://v.example/nl/detail/huis/te-koop/8420/zeeburg/vbe70551", SPLIT),
    "classified": ("immoweb", "https://w.example/nl/classified/huis/te-koop/noordkaai/8620/90210077", CLASSIFIED),
}


def extract(spark, *pages):
    rows = [(s, u, b if isinstance(b, bytes) else b.encode(), AT) for s, u, b in pages]
    return {r["ref_url"]: r for r in extract_candidates(spark.createDataFrame(rows, RAW_PAGE)).collect()}


@pytest.fixture(scope="module")
def rows(spark):
    found = extract(spark, *PAGES.values())
    return {n: found[u] for n, (_, u, _) in PAGES.items()}


EXPECTED = {
    "residence": dict(
        source_id="40417", source_url="https://z.example/nl/2018-zandpoort/te-koop/woning/40417/", postcode=2018, gemeente="Zandpoort",
        straat="Veerdam 61", prijs_eur=198500, oppervlakte_bewoonbaar_m2=163, slaapkamers=5, epc_label="E",
        epc_kwh=407, staat="te-renoveren", type="huis", lat=51.19, lng=4.38, titel="Hoekhuis aan het water", reject=None,
    ),
    "product_house": dict(
        source_id="61932", postcode=9300, gemeente="Wilgerode", prijs_eur=241900, oppervlakte_bewoonbaar_m2=104,
        slaapkamers=3, epc_label="C", epc_kwh=188, staat="instapklaar", type="appartement", lat=50.94, lng=4.04,
        hoofd_foto_url="https://s.example/a.jpg", reject=None,
    ),
    "split": dict(
        source_id="vbe70551", postcode=8420, gemeente="Zeeburg", straat="Duinweg 17", prijs_eur=329500,
        oppervlakte_bewoonbaar_m2=131, slaapkamers=2, epc_label="D", epc_kwh=296, staat="instapklaar", type="huis",
        lat=51.31, lng=3.07, titel="Huis te koop & klaar", hoofd_foto_url="https://v.example/1.jpg", reject=None,
    ),
    "classified": dict(
        source_id="90210077", postcode=8620, gemeente="Noordkaai", straat="Oude Vest 23", prijs_eur=437000,
        oppervlakte_bewoonbaar_m2=187, slaapkamers=6, epc_label="B", epc_kwh=133, staat="te-renoveren", type="huis",
        hoofd_foto_url="https://w.example/1.jpg", reject=None,
    ),
}


@pytest.mark.parametrize("layout", EXPECTED)
def test_layout(rows, layout):
    got = rows[layout].asDict()
    assert {k: got[k] for k in EXPECTED[layout]} == EXPECTED[layout]


def test_description_limit(rows):
    assert len(rows["split"]["korte_beschrijving"]) == 500


def test_rejects(spark):
    empty = "<html></html>"
    found = extract(
        spark,
        ("zimmo", "u1", empty),
        ("immoscoop", "u2", empty),
        ("immovlan", "https://v.example/contact", SPLIT),
        ("immoweb", "u4", empty),
        ("immoweb", "u5", "<script id='__NEXT_DATA__'>{\"props\": {}}</script>"),
        ("immoweb", "u6", b"\xff\xfe" + CLASSIFIED.encode()),
    )
    assert {u: r["reject"] for u, r in found.items()} == {
        "u1": "no_residence_block",
        "u2": "no_product_or_house_block",
        "https://v.example/contact": "url_not_parseable",
        "u4": "no_page_state",
        "u5": "no_classified",
        "u6": None,
    }


def test_product_house_falls_back_to_url(spark):
    page = '<script type="application/ld+json">{"@type": "Product", "name": "n"}</script>'
    url = "https://s.example/te-koop/9300-wilgerode/5/"
    row = extract(spark, ("immoscoop", url, page))[url]
    assert (row["postcode"], row["gemeente"], row["source_id"], row["reject"]) == (9300, "?", "5", None)


@pytest.mark.parametrize(
    "source,url,page,reject",
    [
        # The object's own URL names no advert: the page's URL does not stand in.
        ("zimmo", PAGES["residence"][1], RESIDENCE.replace("/woning/40417/", "/contact"), "no_id_in_url"),
        # No city, and the URL is no advert's.
        ("immoscoop", "https://s.example/over-ons", PRODUCT_HOUSE.replace('"addressLocality": "Wilgerode"', '"x": 1'), "no_city"),
        # The offer's own URL counts before the page's.
        ("immoscoop", PAGES["product_house"][1], PRODUCT_HOUSE.replace('"sku": "61932",', "").replace("/61932\"}}", "/x\"}}"), "no_id"),
        ("immoweb", PAGES["classified"][1], CLASSIFIED.replace('"id": 90210077, ', ""), "no_id"),
    ],
)
def test_rows_that_must_not_be_saved_by_the_page_url(spark, source, url, page, reject):
    assert extract(spark, (source, url, page))[url]["reject"] == reject


def test_what_a_layout_does_not_look_for(spark):
    """No price from page text, no description from meta; an empty description lets the name speak."""
    product = PRODUCT_HOUSE.replace('"price": "241900", ', "").replace("104 m²", "EUR 350.000 104 m²")
    split = SPLIT.replace('"description"', '"other"').replace("<body>", '<meta property="og:description" content="Instapklaar">')
    bare = RESIDENCE.replace("Dak en keuken te renoveren.", " ").replace("Hoekhuis aan het water", "Nieuwbouw hoekhuis")
    urls = [PAGES[n][1] for n in ("product_house", "split", "residence")]
    rows = extract(spark, ("immoscoop", urls[0], product), ("immovlan", urls[1], split), ("zimmo", urls[2], bare))
    assert rows[urls[0]]["prijs_eur"] is None
    assert (rows[urls[1]]["korte_beschrijving"], rows[urls[1]]["staat"]) == (None, None)
    assert rows[urls[2]]["staat"] == "nieuwbouw"


def test_open_comments_and_scripts_are_read_once(spark):
    import time

    pages = [("zimmo", f"u{k}", part * (1_000_000 // len(part))) for k, part in enumerate(("<!-- ", "<script>", "<style> <!-- <script"))]
    start = time.perf_counter()
    assert len(extract(spark, *pages)) == 3
    assert time.perf_counter() - start < 30


def test_unknown_source_is_left_out(spark):
    assert extract(spark, ("elders", "u", RESIDENCE)) == {}


def test_nodes_in_document_order(spark):
    html = (
        "<!-- <script type='application/ld+json'>{\"@type\": \"House\", \"n\": 0}</script> -->"
        "<script type='application/ld+json'>[{\"@type\": \"A\", \"n\": 1}, 7, {\"@type\": [\"House\"], \"n\": 2}]</script>"
        "<script data-x='>' type=application/ld+json>{\"@graph\": [{\"@type\": \"house\", \"n\": 3}, {\"@type\": \"House\", \"n\": 4}]}</script>"
    )
    df = spark.createDataFrame([(html,)], "h string").select(M.tags(F.col("h")).alias("t"))
    nodes = df.select(M.ld_nodes(M.json_ld(F.col("t"))).alias("n"))
    row = nodes.select(
        F.size("n").alias("size"),
        J.as_int(J.child(M.node_of_type(F.col("n"), "House"), "n")).alias("house"),
    ).first()
    assert (row["size"], row["house"]) == (5, 3)


def test_custom_source(spark):
    from dataclasses import replace

    from plotmerge.sources.registry import SOURCES

    def mine(pages):
        return pages.select("source_name", F.col("source_url").alias("ref_url"), F.lit("7").alias("source_id"))

    spec = replace(SOURCES["zimmo"], name="eigen", custom_extract=mine)
    rows = spark.createDataFrame([("eigen", "u", b"", AT), *[(s, u, b.encode(), AT) for s, u, b in PAGES.values()]], RAW_PAGE)
    found = extract_candidates(rows, {**SOURCES, "eigen": spec}).collect()
    assert sorted(r["source_name"] for r in found) == ["eigen", "immoscoop", "immovlan", "immoweb", "zimmo"]


def test_page_heads_agree_with_their_sql_on_odd_pages(spark, tmp_path):
    import duckdb
    from oracle_check import compare

    from plotmerge.plans import QUERIES

    odd = [
        ("https://a.example/x", '<html lang="nl"><title>A &quot;b&quot; &amp;amp; &lt;c&gt; &eacute;</title><script>1</script>'),
        ("http://u:p@a_b.example:8080/x y?q#f", "<HTML lang=nl><TITLE>A</TITLE><!-- <script>1</script> --><script src=a"),
        ("https://a.example?q=/p", "<html class=x lang=\"nl\"><title>\u00a0 \tA\n</title><SCRIPT></SCRIPT><scripts>"),
        ("geen url", "<title> </title>\n<title>B</title>"),
        ("HTTPS://A.example/", "<style><script></style><title>open"),
        (None, None),
    ]
    rows = [(k, url, html) for k, (url, html) in enumerate(odd)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(
        f"{tmp_path}/pages.parquet"
    )
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert compare(spark, con, QUERIES["page_heads"], str(tmp_path)) is None
