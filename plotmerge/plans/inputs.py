"""Listings, sources and observations derived from the given tables.

Each comes twice: as a DataFrame for the Spark side and as a SQL common table
expression for the comparison side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmerge.plans.catalog import Tables

LISTING_CTE = """fx_listing AS (
SELECT CAST(p_partkey AS VARCHAR) AS id,
  md5(concat('part:', CAST(p_partkey AS VARCHAR))) AS fingerprint,
  CAST(8000 + p_size * 20 AS INT) AS postcode,
  p_brand AS gemeente,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS straat,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(50.7 AS DOUBLE) + CAST(p_partkey % 500 AS DOUBLE) / 1000 END AS lat,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(3.0 AS DOUBLE) + CAST(p_partkey % 700 AS DOUBLE) / 1000 END AS lng,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(floor(p_retailprice * 100) AS BIGINT) END AS prijs_eur,
  CASE p_type WHEN 'ECONOMY' THEN 'huis' WHEN 'SMALL' THEN 'appartement' WHEN 'LARGE' THEN 'grond' ELSE 'other' END AS type,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size * 10 AS BIGINT) END AS oppervlakte_bewoonbaar_m2,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_size % 7 AS BIGINT) END AS slaapkamers,
  CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE substr('ABCDEF', CAST(1 + p_partkey % 6 AS INT), 1) END AS epc_label,
  CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE CAST(p_size * 9 + 20 AS BIGINT) END AS epc_kwh,
  CASE p_size % 4 WHEN 0 THEN 'instapklaar' WHEN 1 THEN 'te-renoveren' WHEN 2 THEN 'nieuwbouw' ELSE NULL END AS staat,
  p_name AS titel,
  concat(p_type, ' ', p_brand) AS korte_beschrijving,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE concat('https://img.example/', CAST(p_partkey AS VARCHAR), '.jpg') END AS hoofd_foto_url,
  CASE p_partkey % 4 WHEN 0 THEN 'nieuw' WHEN 1 THEN 'bekeken' WHEN 2 THEN 'interessant' ELSE 'afgewezen' END AS user_status,
  TIMESTAMP '2024-01-01 00:00:00' + p_partkey * INTERVAL '1' MINUTE AS created_at,
  TIMESTAMP '2024-01-01 00:00:00' + p_partkey * INTERVAL '1' MINUTE AS updated_at
FROM part)"""

SOURCE_CTE = """fx_source AS (
SELECT CAST(l_partkey AS VARCHAR) AS listing_id,
  CASE l_suppkey % 4 WHEN 0 THEN 's0' WHEN 1 THEN 's1' WHEN 2 THEN 's2' ELSE 's3' END AS source_name,
  concat(CAST(l_partkey AS VARCHAR), '-', CAST(l_suppkey AS VARCHAR)) AS source_id,
  min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen,
  CASE WHEN max(l_shipdate) < TIMESTAMP '1998-01-01 00:00:00' THEN 'gone' ELSE 'active' END AS status
FROM lineitem GROUP BY l_partkey, l_suppkey)"""

OBS_CTE = """fx_obs AS (
SELECT event_id AS ord, md5(concat('u:', CAST(user_id AS VARCHAR))) AS fingerprint,
  CASE user_id % 4 WHEN 0 THEN 's0' WHEN 1 THEN 's1' WHEN 2 THEN 's2' ELSE 's3' END AS source_name,
  concat(CAST(user_id AS VARCHAR), '-', event_type) AS source_id,
  ts AS fetched_at,
  CAST(1000 + user_id % 9000 AS INT) AS postcode,
  concat('City ', CAST(user_id % 300 AS VARCHAR)) AS gemeente,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS prijs_eur,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS titel,
  CASE WHEN event_id % 5 < 3 THEN NULL ELSE concat('Straat ', CAST(event_id % 97 AS VARCHAR)) END AS straat,
  CASE WHEN event_id % 2 = 0 THEN NULL ELSE CAST(event_id % 6 AS BIGINT) END AS slaapkamers,
  CASE WHEN event_type = 'click' THEN props ELSE NULL END AS korte_beschrijving
FROM events)"""

SOURCE_NAMES = ("s0", "s1", "s2", "s3")


def with_cte(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)}\n{body}"


def listings(t: Tables, part: DataFrame | None = None) -> DataFrame:
    k = F.col("p_partkey")

    def unless(n: int, value, residue: int = 0):
        return F.when(k % n != residue, value)

    created = F.timestamp_micros(
        F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + k * 60_000_000
    )
    return (t.part if part is None else part).select(
        k.cast("string").alias("id"),
        F.md5(F.concat(F.lit("part:"), k.cast("string"))).alias("fingerprint"),
        (8000 + F.col("p_size") * 20).cast("int").alias("postcode"),
        F.col("p_brand").alias("gemeente"),
        unless(5, F.col("p_name")).alias("straat"),
        unless(3, F.lit(50.7) + (k % 500).cast("double") / 1000).alias("lat"),
        unless(3, F.lit(3.0) + (k % 700).cast("double") / 1000).alias("lng"),
        unless(7, F.floor(F.col("p_retailprice") * 100)).cast("bigint").alias("prijs_eur"),
        F.when(F.col("p_type") == "ECONOMY", "huis")
        .when(F.col("p_type") == "SMALL", "appartement")
        .when(F.col("p_type") == "LARGE", "grond")
        .otherwise("other")
        .alias("type"),
        unless(4, (F.col("p_size") * 10).cast("bigint")).alias("oppervlakte_bewoonbaar_m2"),
        unless(6, (F.col("p_size") % 7).cast("bigint")).alias("slaapkamers"),
        unless(4, F.substr(F.lit("ABCDEF"), (1 + k % 6).cast("int"), F.lit(1)), 1).alias("epc_label"),
        unless(8, (F.col("p_size") * 9 + 20).cast("bigint")).alias("epc_kwh"),
        F.when(F.col("p_size") % 4 == 0, "instapklaar")
        .when(F.col("p_size") % 4 == 1, "te-renoveren")
        .when(F.col("p_size") % 4 == 2, "nieuwbouw")
        .alias("staat"),
        F.col("p_name").alias("titel"),
        F.concat_ws(" ", "p_type", "p_brand").alias("korte_beschrijving"),
        unless(9, F.concat(F.lit("https://img.example/"), k.cast("string"), F.lit(".jpg"))).alias(
            "hoofd_foto_url"
        ),
        F.when(k % 4 == 0, "nieuw")
        .when(k % 4 == 1, "bekeken")
        .when(k % 4 == 2, "interessant")
        .otherwise("afgewezen")
        .alias("user_status"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )


def _source_name(column: str):
    return F.concat(F.lit("s"), (F.col(column) % 4).cast("string"))


def sources(t: Tables) -> DataFrame:
    last = F.max("l_shipdate")
    return (
        t.dealt(t.lineitem, "lineitem", "l_partkey", "l_suppkey")
        .groupBy("l_partkey", "l_suppkey")
        .agg(F.min("l_shipdate").alias("first_seen"), last.alias("last_seen"))
        .select(
            F.col("l_partkey").cast("string").alias("listing_id"),
            _source_name("l_suppkey").alias("source_name"),
            F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias(
                "source_id"
            ),
            "first_seen",
            "last_seen",
            F.when(F.col("last_seen") < F.lit("1998-01-01").cast("date"), "gone")
            .otherwise("active")
            .alias("status"),
        )
    )


def observe(events: DataFrame) -> DataFrame:
    """Observations from event rows, batch or stream."""
    e, u = F.col("event_id"), F.col("user_id")
    return events.select(
        e.alias("ord"),
        F.md5(F.concat(F.lit("u:"), u.cast("string"))).alias("fingerprint"),
        _source_name("user_id").alias("source_name"),
        F.concat_ws("-", u.cast("string"), "event_type").alias("source_id"),
        F.col("ts").alias("fetched_at"),
        (1000 + u % 9000).cast("int").alias("postcode"),
        F.concat(F.lit("City "), (u % 300).cast("string")).alias("gemeente"),
        F.when(e % 3 != 0, F.floor("value").cast("bigint")).alias("prijs_eur"),
        F.when(e % 4 == 0, "").otherwise(F.col("event_type")).alias("titel"),
        F.when(e % 5 >= 3, F.concat(F.lit("Straat "), (e % 97).cast("string"))).alias("straat"),
        F.when(e % 2 != 0, (e % 6).cast("bigint")).alias("slaapkamers"),
        F.when(F.col("event_type") == "click", F.col("props")).alias("korte_beschrijving"),
    )


def obs(t: Tables) -> DataFrame:
    return observe(t.events)


# ---- landed pages, one of four layouts each ---------------------------------

PAGE_SOURCES = ("zimmo", "immoscoop", "immovlan", "immoweb")
RESIDENCE_TYPES = ("Residence", "RealEstateListing", "SingleFamilyResidence", "Apartment", "House")

# What the pages say, before each layout's own way of saying it. k % 4 is the
# layout; h numbers the pages of one layout and decides which fault a page has:
# 7 no structured data, 9 no postcode, 11 no city, 13 foreign URL, 15 far away.
PAGE_CTE = (
    LISTING_CTE
    + """, page0 AS (
SELECT *, CAST(id AS BIGINT) AS k, CAST(id AS BIGINT) // 4 AS h, lower(replace(gemeente, '#', '-')) AS slug FROM fx_listing
), page1 AS (
SELECT *, h % 40 AS fault,
  concat(titel, ' & ', CASE type WHEN 'huis' THEN 'ruime villa' WHEN 'appartement' THEN 'studio'
    WHEN 'grond' THEN 'bouwgrond' ELSE 'garage' END) AS title,
  concat('Te koop: ', titel, CASE staat WHEN 'instapklaar' THEN ', Instapklaar!' WHEN 'te-renoveren' THEN ', te renoveren.'
    WHEN 'nieuwbouw' THEN ', nieuwbouw.' ELSE '.' END, CASE WHEN h % 6 = 0 THEN repeat(' en nog meer', 60) ELSE '' END) AS about,
  CASE WHEN h % 40 = 15 THEN CAST(59.0 AS DOUBLE) ELSE lat END AS page_lat,
  CASE WHEN h % 40 = 13 THEN concat('https://elsewhere.example/contact/', id, '.html')
    WHEN k % 4 = 0 THEN concat('https://www.site0.example/nl/', postcode, '-', slug, '/te-koop/huis/', id, '-fraai/')
    WHEN k % 4 = 1 THEN concat('https://www.site1.example/te-koop/', postcode, '-', slug, '/', id)
    WHEN k % 4 = 2 THEN concat('https://www.site2.example/nl/detail/huis/te-koop/', postcode, '/', slug, '/vbe', id)
    ELSE concat('https://www.site3.example/nl/classified/huis/te-koop/', slug, '/', postcode, '/', id) END AS url
FROM page0)"""
)


def page_facts(t: Tables) -> DataFrame:
    """The same in Spark."""
    k = F.col("id").cast("bigint")
    facts = (
        listings(t, t.spread("part"))
        .withColumn("k", k)
        .withColumn("h", F.floor(k / 4))
        .withColumn("fault", F.col("h") % 40)
        .withColumn("slug", F.lower(F.replace("gemeente", F.lit("#"), F.lit("-"))))
        .withColumn("pc", F.col("postcode").cast("string"))
    )
    kind = F.col("type")
    word = (
        F.when(kind == "huis", "ruime villa")
        .when(kind == "appartement", "studio")
        .when(kind == "grond", "bouwgrond")
        .otherwise("garage")
    )
    state = (
        F.when(F.col("staat") == "instapklaar", ", Instapklaar!")
        .when(F.col("staat") == "te-renoveren", ", te renoveren.")
        .when(F.col("staat") == "nieuwbouw", ", nieuwbouw.")
        .otherwise(".")
    )
    more = F.when(F.col("h") % 6 == 0, " en nog meer" * 60).otherwise("")

    def url(*parts):
        return F.concat(*[F.lit(p) if "/" in p or "-" in p else F.col(p) for p in parts])

    r = F.col("k") % 4
    return (
        facts.withColumn("title", F.concat("titel", F.lit(" & "), word))
        .withColumn("about", F.concat(F.lit("Te koop: "), "titel", state, more))
        .withColumn("page_lat", F.when(F.col("fault") == 15, 59.0).otherwise(F.col("lat")))
        .withColumn(
            "url",
            F.when(F.col("fault") == 13, F.concat(F.lit("https://elsewhere.example/contact/"), "id", F.lit(".html")))
            .when(r == 0, url("https://www.site0.example/nl/", "pc", "-", "slug", "/te-koop/huis/", "id", "-fraai/"))
            .when(r == 1, url("https://www.site1.example/te-koop/", "pc", "-", "slug", "/", "id"))
            .when(r == 2, url("https://www.site2.example/nl/detail/huis/te-koop/", "pc", "/", "slug", "/vbe", "id"))
            .otherwise(url("https://www.site3.example/nl/classified/huis/te-koop/", "slug", "/", "pc", "/", "id")),
        )
    )


def _obj(**fields) -> F.Column:
    """A struct; names may carry a leading @ as AT_. NULL fields vanish in JSON."""
    return F.struct(*[v.alias(n.replace("AT_", "@")) for n, v in fields.items()])


def _script(body, attrs: str = 'type="application/ld+json"'):
    return F.concat(F.lit(f"<script {attrs}>"), body, F.lit("</script>"))


def _residence_page():
    c, h = F.col, F.col("h")
    wanted = F.element_at(
        F.array(*[F.lit(x) for x in RESIDENCE_TYPES]), (h % 5 + 1).cast("int")
    )
    amount = c("prijs_eur")
    block = F.to_json(
        _obj(
            AT_context=F.lit("https://schema.org"),
            AT_type=wanted,
            name=c("title"),
            description=c("about"),
            url=F.when(h % 8 == 0, F.concat("url", F.lit("#advert"))).when(
                h % 2 == 0,
                F.concat(F.lit("https://www.site0.example/nl/"), "pc", F.lit("-"), "slug", F.lit("/te-koop/huis/5550000000"), "id", F.lit("-advert/")),
            ),
            address=_obj(
                streetAddress=c("straat"),
                postalCode=F.when(c("fault") != 9, c("pc")),
                addressLocality=F.when(c("fault") != 11, c("gemeente")),
            ),
            image=c("hoofd_foto_url"),
            offers=_obj(
                price=F.when(h % 2 == 0, F.translate(F.format_number(amount, 0), ",", ".")).otherwise(
                    amount.cast("string")
                )
            ),
            numberOfRooms=c("slaapkamers"),
            floorSize=_obj(value=c("oppervlakte_bewoonbaar_m2")),
            energyEfficiencyScaleMin=c("epc_label"),
            energyConsumption=c("epc_kwh"),
            geo=_obj(latitude=c("page_lat"), longitude=c("lng")),
        )
    )
    placed = (
        F.when(h % 3 == 0, block)
        .when(h % 3 == 1, F.concat(F.lit('[{"@type": "BreadcrumbList"}, '), block, F.lit(", 3]")))
        .otherwise(
            F.concat(F.lit('{"@context": "https://schema.org", "@graph": [{"@type": ["House"]}, '), block, F.lit("]}"))
        )
    )
    return F.concat(
        _script(F.lit('{"@type": "House", "name": ')),
        F.lit("<!-- "), _script(F.lit('{"@type": "Residence", "name": "oud"}')), F.lit(" -->"),
        _script(placed, "data-n='1' type='application/ld+json'"),
    )


def _spec_text():
    c = F.col
    return F.concat_ws(
        "",
        F.concat(F.lit("<li>Bewoonbaar "), c("oppervlakte_bewoonbaar_m2").cast("string"), F.lit(" m²</li>")),
        F.concat(F.lit("<li>"), c("slaapkamers").cast("string"), F.lit(" slaapkamers</li>")),
        F.concat(F.lit("<p>EPC: "), c("epc_label"), F.lit("</p>")),
        F.concat(F.lit("<p>"), c("epc_kwh").cast("string"), F.lit(" kWh/m²</p>")),
    )


def _comma(number: F.Column) -> F.Column:
    return F.replace(number.cast("string"), F.lit("."), F.lit(","))


def _product_house_page():
    c, h = F.col, F.col("h")
    product = F.to_json(
        _obj(
            AT_type=F.lit("product"),
            name=c("title"),
            description=c("about"),
            image=F.array("hoofd_foto_url", F.lit("https://img.example/second.jpg")),
            sku=F.when(h % 3 != 0, F.concat(F.lit("P"), "id")),
            offers=_obj(
                price=c("prijs_eur").cast("string"),
                url=F.when(
                    h % 12 == 6,
                    F.concat(F.lit("https://www.site1.example/te-koop/"), "pc", F.lit("-"), "slug", F.lit("/6660000000"), "id"),
                ).when(h % 2 == 0, F.concat("url", F.lit("?o=1"))),
            ),
        )
    )
    house = F.to_json(
        _obj(
            AT_type=F.lit("House"),
            address=_obj(
                streetAddress=c("straat"),
                postalCode=F.when(c("fault") != 9, c("postcode")),
                addressLocality=F.when((c("fault") != 11) & ~((c("fault") == 13) & (h % 3 == 1)), c("gemeente")),
            ),
            description=F.lit("Nieuwbouw, maar niet dit huis"),
            image=F.lit("https://img.example/house.jpg"),
            geo=_obj(latitude=F.lit(50.5), longitude=F.lit(4.5)),
        )
    )
    geo = _obj(
        lat=_comma(c("page_lat")),
        long=F.when(h % 10 != 3, _comma(c("lng"))),
    )
    state = F.to_json(_obj(props=_obj(pageProps=_obj(property=_obj(id=c("id"), address=_obj(geo=geo))))))
    return F.concat(
        _script(product), _script(house), _script(F.lit("var pageProps = property;"), ""),
        F.when(h % 2 == 0, "<p>Vanaf € 123 456 nu</p>").otherwise(""),
        _spec_text(), _script(state, 'id="__NEXT_DATA__" type="application/json"'),
    )


def _split_blocks_page():
    c, h = F.col, F.col("h")

    def meta(attr: str, key: str, content, swapped=False):
        content = F.replace(content, F.lit("&"), F.lit("&amp;"))
        if swapped:
            return F.concat(F.lit("<meta content='"), content, F.lit(f"' {attr}='{key}'>"))
        return F.concat(F.lit(f'<meta {attr}="{key}" content="'), content, F.lit('" />'))

    summary = F.concat_ws(
        " | ",
        F.lit("Te koop"),
        F.concat(F.translate(F.format_number(c("prijs_eur"), 0), ",", " "), F.lit(" €")),
        F.concat(c("oppervlakte_bewoonbaar_m2").cast("string"), F.lit("m²")),
        F.concat(c("slaapkamers").cast("string"), F.lit(" Slaapkamers")),
    )
    told_in_meta = h % 4 == 1
    return F.concat_ws(
        "",
        meta("property", "og:title", c("title")),
        meta("property", "og:image", c("hoofd_foto_url")),
        meta("property", "og:description", F.when(told_in_meta, c("about")).otherwise("kort")),
        F.when(h % 2 == 0, meta("name", "twitter:description", summary, swapped=True)).otherwise(
            meta("name", "twitter:description", summary)
        ),
        _script(
            F.to_json(
                _obj(
                    AT_type=F.lit("PostalAddress"),
                    streetAddress=c("straat"),
                    addressLocality=F.when(c("fault") != 11, c("gemeente")),
                )
            )
        ),
        _script(F.to_json(_obj(AT_type=F.lit("GeoCoordinates"), latitude=c("page_lat"), longitude=c("lng")))),
        _script(F.to_json(_obj(AT_type=F.lit("House"), description=F.when(~told_in_meta, c("about"))))),
        F.concat_ws(
            "",
            F.concat(F.lit("<p>EPC: "), c("epc_label"), F.lit("</p>")),
            F.concat(F.lit("<p>"), c("epc_kwh").cast("string"), F.lit(" kWh/m²</p>")),
        ),
    )


def _classified_page():
    c, h = F.col, F.col("h")
    kind, staat = c("type"), c("staat")
    advert = F.to_json(
        _obj(
            id=F.when(h % 9 != 0, c("k") + 1_000_000),
            title=c("title"),
            description=c("about"),
            url=F.when(h % 2 == 0, F.concat("url", F.lit("?c=1"))),
            subType=F.when(kind == "huis", "HOUSE").when(kind == "appartement", "APARTMENT").when(kind == "grond", "LAND").otherwise("CASTLE"),
            buildingCondition=F.when(staat == "instapklaar", "GOOD").when(staat == "te-renoveren", "TO_RENOVATE").when(staat == "nieuwbouw", "NEW"),
            address=_obj(
                street=c("straat"),
                houseNumber=F.when(c("k") % 8 == 3, (c("k") % 50).cast("string")),
                postalCode=F.when(c("fault") != 9, c("postcode")),
                city=F.when(c("fault") != 11, c("gemeente")),
            ),
            location=_obj(latitude=c("page_lat"), longitude=c("lng")),
            price=_obj(mainValue=c("prijs_eur")),
            habitableSurface=c("oppervlakte_bewoonbaar_m2"),
            bedrooms=c("slaapkamers"),
            epc=_obj(label=c("epc_label"), consumption=c("epc_kwh")),
            media=_obj(photos=F.array(_obj(url=c("hoofd_foto_url")))),
        )
    )
    state = (
        F.when(h % 4 == 0, F.concat(F.lit('{"props": {"pageProps": {"classified": '), advert, F.lit("}}}")))
        .when(h % 4 == 1, F.concat(F.lit('{"classified": '), advert, F.lit("}")))
        .when(h % 4 == 2, F.concat(F.lit('{"classified": null, "listing": '), advert, F.lit("}")))
        .otherwise(F.concat(F.lit('{"listing": 5, "property": '), advert, F.lit("}")))
    )
    return _script(state, 'id="__NEXT_DATA__" type="application/json"')


def landed_pages(t: Tables) -> DataFrame:
    """Raw pages of four sources, written from the listings."""
    r = F.col("k") % 4
    body = (
        F.when(F.col("fault") == 7, "<p>Niet gevonden</p>")
        .when(r == 0, _residence_page())
        .when(r == 1, _product_house_page())
        .when(r == 2, _split_blocks_page())
        .otherwise(_classified_page())
    )
    html = F.concat(F.lit("<!DOCTYPE html><html lang='nl'><head>"), body, F.lit("</head></html>"))
    return page_facts(t).select(
        F.element_at(F.array(*[F.lit(s) for s in PAGE_SOURCES]), (r + 1).cast("int")).alias(
            "source_name"
        ),
        F.col("url").alias("source_url"),
        html.cast("binary").alias("body"),
        F.col("created_at").alias("fetched_at"),
    )
