"""Queries over text: fields read from whole documents, codes, coercions, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotmerge.functions import json_values as J
from plotmerge.functions import text as X
from plotmerge.plans import inputs as I
from plotmerge.plans.catalog import Tables, query
from plotmerge.sources import layouts

L = I.LISTING_CTE
NBSP = "\u00a0"

# A document with advert lines before and after its own text. The comparison side
# has no Unicode white space in its patterns, so it reads a no-break space as a space.
_ADVERT = f"""advert AS (
SELECT doc_id, replace(concat(head, text, tail), chr(160), ' ') AS text FROM (
SELECT doc_id, text,
  CASE doc_id % 6
    WHEN 0 THEN concat('Prijs: ', a, chr(160), '000 € ')
    WHEN 1 THEN concat('Vanaf EUR ', a, '.000 ')
    WHEN 2 THEN concat('999 € of ', a, '.000,00 € ')
    WHEN 3 THEN concat('€ ', a, ' 000 | ', a, ' 500 EUR ')
    WHEN 4 THEN concat('€', a, ' ')
    ELSE CASE doc_id % 4 WHEN 0 THEN concat(a, '000 eur ') WHEN 1 THEN concat(a, '00 EUROPESE ') ELSE '' END END AS head,
  CASE doc_id % 7
    WHEN 0 THEN concat(' ', b, ' m2, tuin 1.', b, ' m², ', b % 9, ' slaapkamers. EPC: C+ ', b, ' kWh/m²')
    WHEN 1 THEN concat(' 1', b, '00 m2 grond, 1', b, chr(160), 'm² EPC-label B (', b, ' kWh/m2) ', b % 5, chr(160), 'SLAAPKAMERS')
    WHEN 2 THEN concat(' EPC waarde van deze woning is F. ', b, b, 'kWh/m2 12 m²')
    WHEN 3 THEN ' 19 m2, 2001 m2, slaapkamers: 3, EPC G'
    WHEN 4 THEN concat(' ', b, 'M² en 8 slaapkamers of 9 slaapkamers')
    WHEN 5 THEN concat(' ', b, ' m ² NEPC A EPC B ', b, ' KWH / m²')
    ELSE '' END AS tail
FROM (SELECT *, CAST(100 + n_chars % 800 AS VARCHAR) AS a, 10 + n_chars % 90 AS b FROM documents)))"""


def _adverts(t: Tables):
    k, a = F.col("doc_id"), (100 + F.col("n_chars") % 800).cast("string")
    n = 10 + F.col("n_chars") % 90
    b = n.cast("string")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    head = (
        F.when(k % 6 == 0, text("Prijs: ", a, NBSP, "000 € "))
        .when(k % 6 == 1, text("Vanaf EUR ", a, ".000 "))
        .when(k % 6 == 2, text("999 € of ", a, ".000,00 € "))
        .when(k % 6 == 3, text("€ ", a, " 000 | ", a, " 500 EUR "))
        .when(k % 6 == 4, text("€", a, " "))
        .when(k % 4 == 0, text(a, "000 eur "))
        .when(k % 4 == 1, text(a, "00 EUROPESE "))
        .otherwise("")
    )
    tail = (
        F.when(
            k % 7 == 0,
            text(" ", b, " m2, tuin 1.", b, " m², ", n % 9, " slaapkamers. EPC: C+ ", b, " kWh/m²"),
        )
        .when(
            k % 7 == 1,
            text(" 1", b, "00 m2 grond, 1", b, NBSP, "m² EPC-label B (", b, " kWh/m2) ", n % 5, NBSP, "SLAAPKAMERS"),
        )
        .when(k % 7 == 2, text(" EPC waarde van deze woning is F. ", b, b, "kWh/m2 12 m²"))
        .when(k % 7 == 3, " 19 m2, 2001 m2, slaapkamers: 3, EPC G")
        .when(k % 7 == 4, text(" ", b, "M² en 8 slaapkamers of 9 slaapkamers"))
        .when(k % 7 == 5, text(" ", b, " m ² NEPC A EPC B ", b, " KWH / m²"))
        .otherwise("")
    )
    return t.spread("documents").select("doc_id", F.concat(head, "text", tail).alias("text"))


def _field_query(name: str, column: str, read, sql: str) -> None:
    @query(name, I.with_cte(f"SELECT doc_id, {sql} AS {column} FROM advert", _ADVERT))
    def run(t: Tables):
        return _adverts(t).select("doc_id", read(F.col("text")).alias(column))


def _digits(x: str) -> str:
    return f"TRY_CAST(regexp_replace({x}, '[^0-9]', '', 'g') AS BIGINT)"


# The comparison side has no look-around: a word boundary stands for "no letter".
_EURO = "€|(?i:\\bEUR\\b)"


def _plausible(pattern: str) -> str:
    return f"""list_filter(list_transform(regexp_extract_all(text, '{pattern}', 1), lambda x: {_digits('x')}),
      lambda n: n BETWEEN 1000 AND 100000000)[1]"""


_field_query(
    "price_text",
    "price",
    X.price,
    f"""coalesce({_plausible(f'([0-9][0-9 ,.\\s]*)(?:{_EURO})')}, {_plausible(f'(?:{_EURO})\\s*([0-9][0-9 ,.\\s]*)')})""",
)
_field_query(
    "surface_text",
    "m2",
    X.surface,
    """list_max(list_filter(list_transform(regexp_extract_all(text, '(?i)([0-9]{2,4})\\s*m\\s*[²2]', 1),
      lambda x: CAST(x AS BIGINT)), lambda n: n BETWEEN 20 AND 2000))""",
)
_field_query(
    "bedrooms_text",
    "bedrooms",
    X.bedrooms,
    "TRY_CAST(nullif(regexp_extract(text, '(?i)([0-9]+)\\s*slaapkamer', 1), '') AS BIGINT)",
)
_field_query(
    "epc_text",
    "label",
    X.epc_label_in,
    "nullif(regexp_extract(text, '\\bEPC[^A-Z]{0,30}([A-F]\\+?)\\b', 1), '')",
)
_field_query(
    "kwh_text",
    "kwh",
    X.epc_kwh_in,
    "TRY_CAST(nullif(regexp_extract(text, '(?i)([0-9]{2,4})\\s*kWh\\s*/\\s*m', 1), '') AS BIGINT)",
)


# ---- coercion of JSON values -------------------------------------------------

_JSON_TEXT = """doc AS (
SELECT p_partkey AS k, p_size AS n,
  CASE p_partkey % 9
    WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN concat('"', p_size, '.000"')
    WHEN 2 THEN concat(p_size, '.75') WHEN 3 THEN concat('-', p_size) WHEN 4 THEN 'true'
    WHEN 5 THEN 'null' WHEN 6 THEN concat('"', p_size, ',5"') WHEN 7 THEN concat('"', p_name, '"')
    ELSE concat('[', p_size, ']') END AS v FROM part)"""


def _json_values(t: Tables):
    r, n = F.col("p_partkey") % 9, F.col("p_size").cast("string")
    v = (
        F.when(r == 0, n)
        .when(r == 1, F.concat(F.lit('"'), n, F.lit('.000"')))
        .when(r == 2, F.concat(n, F.lit(".75")))
        .when(r == 3, F.concat(F.lit("-"), n))
        .when(r == 4, "true")
        .when(r == 5, "null")
        .when(r == 6, F.concat(F.lit('"'), n, F.lit(',5"')))
        .when(r == 7, F.concat(F.lit('"'), "p_name", F.lit('"')))
        .otherwise(F.concat(F.lit("["), n, F.lit("]")))
    )
    doc = F.concat(F.lit('{"v": '), v, F.lit("}"))
    return t.part.select(
        F.col("p_partkey").alias("k"), J.child(J.parse_strict(doc), "v").alias("v")
    )


@query(
    "coerce_int",
    I.with_cte(
        """SELECT k, CAST(CASE k % 9 WHEN 0 THEN n WHEN 1 THEN n * 1000 WHEN 2 THEN n WHEN 6 THEN n * 10 + 5 END AS BIGINT) AS value
        FROM doc""",
        _JSON_TEXT,
    ),
)
def coerce_int(t: Tables):
    """Numbers are cut, strings keep their digits, the rest is NULL."""
    return _json_values(t).select("k", J.as_int(F.col("v")).alias("value"))


@query(
    "coerce_float",
    I.with_cte(
        """SELECT k, round(CAST(CASE k % 9 WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n + 0.75 WHEN 3 THEN -n END AS DOUBLE), 6) AS plain,
          round(CAST(CASE k % 9 WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n + 0.75 WHEN 3 THEN -n WHEN 6 THEN n + 0.5 END AS DOUBLE), 6) AS comma
        FROM doc""",
        _JSON_TEXT,
    ),
)
def coerce_float(t: Tables):
    """With and without the decimal comma."""
    return _json_values(t).select(
        "k",
        F.round(J.as_float(F.col("v")), 6).alias("plain"),
        F.round(J.as_float(F.col("v"), comma=True), 6).alias("comma"),
    )


@query(
    "first_truthy",
    I.with_cte(
        """SELECT id, coalesce(nullif(slaapkamers, 0), nullif(oppervlakte_bewoonbaar_m2, 0), epc_kwh) AS number,
          coalesce(nullif(straat, ''), nullif(CASE WHEN epc_kwh % 2 = 0 THEN '' ELSE epc_label END, ''), titel) AS words
        FROM fx_listing""",
        L,
    ),
)
def first_truthy(t: Tables):
    """Alternative keys: 0 and '' count as missing."""
    label = F.when(F.col("epc_kwh") % 2 == 0, "").otherwise(F.col("epc_label"))
    return I.listings(t).select(
        "id",
        X.first_nonzero(
            F.col("slaapkamers"), F.col("oppervlakte_bewoonbaar_m2"), F.col("epc_kwh")
        ).alias("number"),
        X.first_nonempty(F.col("straat"), label, F.col("titel")).alias("words"),
    )


@query(
    "typed_parameters",
    """SELECT event_id,
      CASE event_id % 4 WHEN 0 THEN CAST(user_id AS INT) END AS number,
      CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN NULL ELSE date_trunc('day', ts) END AS moment
    FROM events""",
)
def typed_parameters(t: Tables):
    """Blank or unreadable texts are NULL, never an error."""
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    number = (
        F.when(e % 4 == 0, F.concat(F.lit(" "), u, F.lit(" ")))
        .when(e % 4 == 1, "  ")
        .when(e % 4 == 2, F.concat(u, F.lit(".5")))
        .otherwise("abc")
    )
    moment = (
        F.when(e % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(e % 3 == 1, "gisteren")
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
    )
    return t.events.select(
        "event_id", X.int_or_null(number).alias("number"), X.timestamp_or_null(moment).alias("moment")
    )


# ---- classification ------------------------------------------------------------

_TITLES = """titled AS (
SELECT id, epc_label, staat, concat(titel, ' ',
  CASE CAST(id AS BIGINT) % 9 WHEN 0 THEN 'Villa met studio' WHEN 1 THEN 'BOUWGROND' WHEN 2 THEN 'Woning'
    WHEN 3 THEN 'appartement in huis' WHEN 4 THEN 'garage' WHEN 5 THEN 'Te renoveren huis'
    WHEN 6 THEN 'nieuwbouw, instapklaar' WHEN 7 THEN 'Instapklaar' ELSE 'renovatie nodig' END) AS titel
FROM fx_listing)"""


def _titled(t: Tables):
    words = (
        "Villa met studio", "BOUWGROND", "Woning", "appartement in huis", "garage",
        "Te renoveren huis", "nieuwbouw, instapklaar", "Instapklaar", "renovatie nodig",
    )
    picked = F.element_at(
        F.array(*[F.lit(w) for w in words]), (F.col("id").cast("bigint") % 9 + 1).cast("int")
    )
    return I.listings(t).select("id", "epc_label", "staat", F.concat_ws(" ", "titel", picked).alias("titel"))


@query(
    "classify_type",
    I.with_cte(
        """SELECT id, CASE WHEN lower(titel) LIKE '%appartement%' OR lower(titel) LIKE '%studio%' THEN 'appartement'
          WHEN lower(titel) LIKE '%huis%' OR lower(titel) LIKE '%woning%' OR lower(titel) LIKE '%villa%' THEN 'huis'
          WHEN lower(titel) LIKE '%grond%' THEN 'grond' ELSE 'other' END AS type FROM titled""",
        L,
        _TITLES,
    ),
)
def classify_type(t: Tables):
    return _titled(t).select("id", X.property_type(F.col("titel")).alias("type"))


@query(
    "classify_condition",
    I.with_cte(
        """SELECT id, CASE WHEN lower(titel) LIKE '%nieuwbouw%' THEN 'nieuwbouw'
          WHEN lower(titel) LIKE '%renoveren%' OR lower(titel) LIKE '%renovatie%' THEN 'te-renoveren'
          WHEN lower(titel) LIKE '%instapklaar%' THEN 'instapklaar' END AS staat FROM titled""",
        L,
        _TITLES,
    ),
)
def classify_condition(t: Tables):
    return _titled(t).select("id", X.condition(F.col("titel")).alias("staat"))


@query(
    "epc_labels",
    I.with_cte(
        """SELECT id, CASE WHEN k % 4 IN (0, 1) THEN epc_label WHEN k % 4 = 3 AND epc_label IS NOT NULL THEN 'A+' END AS exact,
          CASE WHEN k % 4 IN (0, 1, 2) THEN epc_label WHEN epc_label IS NOT NULL THEN 'A+' END AS lenient
        FROM (SELECT id, epc_label, CAST(id AS BIGINT) // 4 AS k FROM fx_listing)""",
        L,
    ),
)
def epc_labels(t: Tables):
    """Exact and lenient reading of label texts."""
    label, k = F.col("epc_label"), F.floor(F.col("id").cast("bigint") / 4)
    text = (
        F.when(k % 4 == 0, label)
        .when(k % 4 == 1, F.concat(F.lit(" "), F.lower(label), F.lit(" ")))
        .when(k % 4 == 2, F.concat(label, F.lit(" 120")))
        .when(label.isNotNull(), " a+ ")
    )
    return I.listings(t).select(
        "id", X.epc_exact(text).alias("exact"), X.epc_lenient(text).alias("lenient")
    )


@query(
    "enum_map",
    I.with_cte(
        """SELECT id, CASE code WHEN 'HOUSE' THEN 'huis' WHEN 'VILLA' THEN 'huis' WHEN 'APARTMENT' THEN 'appartement'
            WHEN 'STUDIO' THEN 'appartement' WHEN 'LAND' THEN 'grond' WHEN 'BUILDING_LAND' THEN 'grond' ELSE 'other' END AS type,
          CASE state WHEN 'NEW' THEN 'nieuwbouw' WHEN 'AS_NEW' THEN 'instapklaar' WHEN 'GOOD' THEN 'instapklaar'
            WHEN 'TO_RENOVATE' THEN 'te-renoveren' END AS staat
        FROM (SELECT id, ['HOUSE', 'VILLA', 'APARTMENT', 'STUDIO', 'LAND', 'BUILDING_LAND', 'CASTLE'][1 + k % 7] AS code,
          ['NEW', 'AS_NEW', 'GOOD', 'TO_RENOVATE', 'UNKNOWN'][1 + k % 5] AS state
          FROM (SELECT id, CAST(id AS BIGINT) AS k FROM fx_listing))""",
        L,
    ),
)
def enum_map(t: Tables):
    """Site codes through the code tables, with the text rule where a code is unknown."""
    k = F.col("id").cast("bigint")

    def pick(*values: str):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))

    code = pick("house", "VILLA", "Apartment", "STUDIO", "LAND", "building_land", "CASTLE")
    state = pick("new", "AS_NEW", " GOOD ", "TO_RENOVATE", "UNKNOWN")
    return I.listings(t).select(
        "id",
        F.coalesce(
            layouts.code(code, layouts.SUBTYPE_TO_TYPE), X.property_type(F.col("titel"))
        ).alias("type"),
        layouts.code(state, layouts.BUILDING_CONDITION).alias("staat"),
    )


# ---- keys, streets, cities ------------------------------------------------------


@query(
    "address_key",
    """SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g') AS key FROM documents""",
)
def address_key(t: Tables):
    """Normalised key of whole texts."""
    return t.spread("documents").select("doc_id", X.address_key("text").alias("key"))


@query(
    "street_and_city",
    I.with_cte(
        """SELECT id, nullif(trim(concat_ws(' ', nullif(straat, ''), nullif(CASE WHEN k % 3 = 0 THEN '' ELSE CAST(k AS VARCHAR) END, ''))), '') AS street,
          concat('Sint Brand ', substr(gemeente, 7)) AS city
        FROM (SELECT *, CAST(id AS BIGINT) AS k FROM fx_listing)""",
        L,
    ),
)
def street_and_city(t: Tables):
    """Street with number, city from its URL slug."""
    k = F.col("id").cast("bigint")
    number = F.when(k % 3 == 0, "").otherwise(F.col("id"))
    slug = F.concat(F.lit("sint-"), F.lower(F.replace("gemeente", F.lit("#"), F.lit("-"))))
    return I.listings(t).select(
        "id",
        X.street(F.col("straat"), number).alias("street"),
        X.city_from_slug(slug).alias("city"),
    )


@query(
    "unescape_entities",
    """SELECT doc_id, concat(text, chr(39), chr(39), 'A', chr(8364), chr(65533), '&bogus;', '&lt;', chr(8734)) AS text FROM documents""",
)
def unescape_entities(t: Tables):
    """Whole texts, written with character references and decoded again.

    References as they come follow the text: names of either standard, leading
    zeros, numbers that are no character, unknown names, an escaped reference.
    """
    written = F.col("text")
    for char, reference in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("é", "&eacute;"),
        ("è", "&#232;"), ("ç", "&#xE7;"), ("ñ", "&#xf1;"), ("ß", "&szlig;"), ("'", "&#39;"),
    ):
        written = F.replace(written, F.lit(char), F.lit(reference))
    return t.spread("documents").select("doc_id", written.alias("w")).select(
        "doc_id",
        X.unescape(
            F.concat("w", F.lit("&apos;&#0000000039;&#x000000041;&#X20AC;&#99999999999;&bogus;&amp;lt;&infin;"))
        ).alias("text"),
    )
