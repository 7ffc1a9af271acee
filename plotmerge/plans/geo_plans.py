"""Queries for the map and for data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotmerge.operators import geo
from plotmerge.operators import listing_query as Q
from plotmerge.operators import quality
from plotmerge.plans import inputs as I
from plotmerge.plans.catalog import Tables, query

L, S, O = I.LISTING_CTE, I.SOURCE_CTE, I.OBS_CTE

_CENTRES = """centre AS (SELECT postcode, avg(lat) AS c_lat, avg(lng) AS c_lng FROM fx_listing WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY postcode)"""
_HASHED = """hashed AS (SELECT *, CAST(concat('0x', substr(md5(id), 1, 8)) AS BIGINT) AS hash FROM fx_listing)"""
_PLACE = """SELECT f.id, round(CASE WHEN f.lat IS NOT NULL AND f.lng IS NOT NULL THEN f.lat ELSE c_lat + (hash % 1000 - 500) * 1.5e-5 END, 6) AS lat,
  round(CASE WHEN f.lat IS NOT NULL AND f.lng IS NOT NULL THEN f.lng ELSE c_lng + ((hash // 1000) % 1000 - 500) * 2e-5 END, 6) AS lng,
  NOT (f.lat IS NOT NULL AND f.lng IS NOT NULL) AS approximate"""


@query(
    "centroids",
    I.with_cte("SELECT postcode, round(c_lat, 6) AS c_lat, round(c_lng, 6) AS c_lng FROM centre", L, _CENTRES),
)
def centroids(t: Tables):
    """Mean coordinates per postcode."""
    return geo.centroids(I.listings(t)).select(
        "postcode", F.round("c_lat", 6).alias("c_lat"), F.round("c_lng", 6).alias("c_lng")
    )


@query(
    "place_all",
    I.with_cte(
        f"{_PLACE} FROM hashed f LEFT JOIN centre USING (postcode) WHERE f.lat IS NOT NULL AND f.lng IS NOT NULL OR c_lat IS NOT NULL",
        L,
        _CENTRES,
        _HASHED,
    ),
)
def place_all(t: Tables):
    """Every listing on the map: own coordinates, or its postcode's centre with jitter."""
    return geo.place(I.listings(t)).select(
        "id", F.round("pin_lat", 6).alias("lat"), F.round("pin_lng", 6).alias("lng"), "approximate"
    )


_PINS = f"""found AS (SELECT * FROM hashed WHERE prijs_eur >= 91000 AND user_status NOT IN ('afgewezen') ORDER BY created_at DESC, id LIMIT 2000),
pc AS (SELECT postcode, avg(lat) AS c_lat, avg(lng) AS c_lng FROM found WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY postcode),
pins AS ({_PLACE}, postcode, gemeente, prijs_eur, type, oppervlakte_bewoonbaar_m2 AS m2, slaapkamers, epc_label, titel, straat, hoofd_foto_url, user_status
  FROM found f LEFT JOIN pc USING (postcode) WHERE f.lat IS NOT NULL AND f.lng IS NOT NULL OR c_lat IS NOT NULL),
firsts AS (SELECT listing_id, arg_min(source_name, (first_seen, source_name, source_id)) AS source_name,
  arg_min(source_id, (first_seen, source_name, source_id)) AS source_id,
  arg_min(concat('https://', source_name, '.example/', source_id), (first_seen, source_name, source_id)) AS source_url FROM fx_source GROUP BY listing_id)"""

_FILTERS = {"prijs_min": 91000, "exclude_user_status": ["afgewezen"]}


@query(
    "map_pins",
    I.with_cte(
        "SELECT pins.*, source_name, source_id, source_url FROM pins LEFT JOIN firsts ON listing_id = id", L, S, _HASHED, _PINS
    ),
)
def map_pins(t: Tables):
    """The newest 2,000 results as pins, centres taken from the same results."""
    url = F.concat(F.lit("https://"), "source_name", F.lit(".example/"), "source_id")
    pins = geo.map_pins(I.listings(t), I.sources(t).withColumn("source_url", url), **_FILTERS)
    return pins.withColumn("lat", F.round("lat", 6)).withColumn("lng", F.round("lng", 6))


@query(
    "map_pins_all_centres",
    I.with_cte(
        """, sel AS (SELECT * FROM hashed WHERE type = 'huis')
        {place} FROM sel f LEFT JOIN centre USING (postcode) WHERE f.lat IS NOT NULL AND f.lng IS NOT NULL OR c_lat IS NOT NULL""".replace(
            "{place}", _PLACE
        ),
        L,
        _CENTRES,
        _HASHED,
    ).replace("\n, sel", ", sel"),
)
def map_pins_all_centres(t: Tables):
    """All results as pins, centres taken from the whole table."""
    pins = geo.map_pins(I.listings(t), I.sources(t), limit=None, centroid_scope="all", type_in=["huis"])
    return pins.select("id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "approximate")


@query(
    "map_bounds",
    I.with_cte(
        """SELECT round(min(lat) - (max(lat) - min(lat)) * 0.1, 6) AS south, round(max(lat) + (max(lat) - min(lat)) * 0.1, 6) AS north,
          round(min(lng) - (max(lng) - min(lng)) * 0.1, 6) AS west, round(max(lng) + (max(lng) - min(lng)) * 0.1, 6) AS east
        FROM fx_listing""",
        L,
    ),
)
def map_bounds(t: Tables):
    """Padded bounding box of all located listings."""
    box = geo.bounds(I.listings(t).where(Q.listing_filter(located=True)))
    return box.select(*[F.round(c, 6).alias(c) for c in box.columns])


@query(
    "location_counts",
    I.with_cte(
        """SELECT count(*) AS results, count(*) FILTER (WHERE lat IS NOT NULL OR postcode IN (SELECT postcode FROM centre)) AS pins,
          count(*) - count(*) FILTER (WHERE lat IS NOT NULL OR postcode IN (SELECT postcode FROM centre)) AS without_location
        FROM fx_listing""",
        L,
        _CENTRES,
    ),
)
def location_counts(t: Tables):
    """Results, pins, and results the map cannot show."""
    found = I.listings(t)
    return quality.location_counts(found, geo.place(found))


@query(
    "coverage_report",
    I.with_cte(
        """SELECT field, n, total FROM (SELECT count(*) AS total, count(lat) AS lat_lng, count(prijs_eur) AS prijs_eur,
          count(oppervlakte_bewoonbaar_m2) AS oppervlakte_bewoonbaar_m2, count(slaapkamers) AS slaapkamers,
          count(nullif(epc_label, '')) AS epc_label, count(nullif(straat, '')) AS straat, count(nullif(hoofd_foto_url, '')) AS hoofd_foto_url FROM fx_listing)
        UNPIVOT (n FOR field IN (lat_lng, prijs_eur, oppervlakte_bewoonbaar_m2, slaapkamers, epc_label, straat, hoofd_foto_url))""",
        L,
    ),
)
def coverage_report(t: Tables):
    """How many listings have each field."""
    return quality.coverage(I.listings(t))


@query(
    "multi_source_listings",
    I.with_cte(
        """SELECT fingerprint, id, n > 1 AS multi_source FROM fx_listing
        LEFT JOIN (SELECT listing_id, count(*) AS n FROM fx_source GROUP BY listing_id) ON listing_id = id""",
        L,
        S,
    ).replace("n > 1 AS", "coalesce(n > 1, false) AS"),
)
def multi_source_listings(t: Tables):
    """Audit of all listings by fingerprint, flagged where several sources have them."""
    return quality.flag_multi_source(I.listings(t), I.sources(t)).select("fingerprint", "id", "multi_source")


@query(
    "multi_source_count",
    I.with_cte("SELECT count(*) AS n FROM (SELECT listing_id FROM fx_source GROUP BY 1 HAVING count(*) > 1)", S),
)
def multi_source_count(t: Tables):
    return quality.multi_source(I.sources(t)).agg(F.count(F.lit(1)).alias("n"))


@query(
    "observation_stats",
    I.with_cte(
        """SELECT source_name, count(*) - count(*) FILTER (WHERE stage = 'skipped_known') AS discovered,
          count(*) FILTER (WHERE stage = 'skipped_known') AS skipped_known,
          count(*) FILTER (WHERE stage IN ('rejected', 'inserted', 'merged')) AS fetched,
          count(*) FILTER (WHERE stage IN ('inserted', 'merged')) AS parsed,
          count(*) FILTER (WHERE stage = 'inserted') AS inserted, count(*) FILTER (WHERE stage = 'merged') AS merged,
          count(*) FILTER (WHERE stage IN ('fetch_error', 'rejected')) AS errors
        FROM (SELECT source_name, CASE event_type WHEN 'view' THEN 'merged' WHEN 'click' THEN 'skipped_known' WHEN 'error' THEN 'rejected'
          WHEN 'signup' THEN 'fetch_error' ELSE 'inserted' END AS stage
          FROM fx_obs JOIN events ON event_id = ord) GROUP BY ROLLUP (source_name)""",
        O,
    ),
)
def observation_stats(t: Tables):
    """Run counters per source and in total, every stage present."""
    kind = F.col("event_type")
    stage = (
        F.when(kind == "view", "merged").when(kind == "click", "skipped_known")
        .when(kind == "error", "rejected").when(kind == "signup", "fetch_error").otherwise("inserted")
    )
    rows = t.events.select(
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("source_name"), stage.alias("stage")
    )
    return quality.run_stats(rows)


@query(
    "error_samples",
    I.with_cte(
        """, ranked AS (SELECT source_name, concat('fout ', ord) AS message, row_number() OVER (PARTITION BY source_name ORDER BY ord) AS rn
          FROM fx_obs JOIN events ON event_id = ord WHERE event_type = 'error')
        SELECT source_name, count(*) AS errors, string_agg(message, ' | ' ORDER BY rn) FILTER (WHERE rn <= 5) AS messages,
          greatest(count(*) - 5, 0) AS suppressed FROM ranked GROUP BY source_name""",
        O,
    ).replace("\n, ranked", ", ranked"),
)
def error_samples(t: Tables):
    """First five messages of each source, and how many more there are."""
    errors = t.events.where(F.col("event_type") == "error").select(
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("source_name"),
        "event_id",
        F.concat(F.lit("fout "), F.col("event_id").cast("string")).alias("message"),
    )
    return quality.error_samples(errors, "event_id").withColumn("messages", F.array_join("messages", " | "))


@query(
    "run_window",
    """SELECT min(ts) AS started_at, max(ts) AS last_refresh_at,
      round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 6) AS seconds FROM events""",
)
def run_window(t: Tables):
    """Start, last refresh and duration of a run."""
    seen = t.events.select(F.col("ts").cast("timestamp").alias("fetched_at"))
    return quality.run_window(seen).withColumn("seconds", F.round("seconds", 6))


@query(
    "json_key_profile",
    """SELECT 'k' AS path, 'BIGINT' AS type, count(*) AS n, min(CAST(props::JSON->>'k' AS VARCHAR)) AS preview FROM events""",
)
def json_key_profile(t: Tables):
    """Types and previews of the keys of a JSON column."""
    return quality.json_key_profile(t.events, "props")


@query(
    "json_geo_keys",
    I.with_cte(
        """SELECT path, type, count(*) AS n, min(preview) AS preview FROM (
          SELECT unnest([
            {'path': 'place.geo', 'type': 'OBJECT', 'preview': concat('{"lat":', k % 90, ',"tags":["a",{"lng":', k % 7, '}]}')},
            {'path': 'place.geo.lat', 'type': 'BIGINT', 'preview': CAST(k % 90 AS VARCHAR)},
            {'path': 'place.geo.tags.lng', 'type': 'BIGINT', 'preview': CAST(k % 7 AS VARCHAR)},
            {'path': 'a.b.c.d.e.f.lat', 'type': 'BIGINT', 'preview': CAST(k % 5 AS VARCHAR)}], recursive := true)
          FROM (SELECT p_partkey AS k FROM part)) GROUP BY path, type""",
        L,
    ),
)
def json_geo_keys(t: Tables):
    """Location-like keys anywhere in nested documents."""
    k = F.col("p_partkey")
    inner = F.struct((k % 7).alias("lng"))
    tags = F.concat(F.lit('["a",'), F.to_json(inner), F.lit("]"))
    doc = F.concat(
        F.lit('{"id": 1, "place": {"geo": {"lat": '), (k % 90).cast("string"), F.lit(', "tags": '), tags, F.lit('}}, "a": {"b": {"c": {"d": {"e": {"f": {"lat": '), (k % 5).cast("string"), F.lit("}}}}}}}")
    )
    return quality.json_key_profile(t.spread("part").select(doc.alias("doc")), "doc", words=quality.GEO_WORDS)
