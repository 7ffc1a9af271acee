"""Placing listings on a map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmerge.operators.listing_query import MAP_LIMIT, first_sources, query_listings
from plotmerge.session import materialize

# ---- fixed values: spread of pins around a postcode centre ------------------
JITTER_CELLS = 1000
LAT_STEP = 1.5e-5
LNG_STEP = 2e-5
BOUNDS_PADDING = 0.10
# -----------------------------------------------------------------------------


def centroids(listings: DataFrame) -> DataFrame:
    """Mean coordinates per postcode over rows that have both."""
    return (
        listings.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
        .groupBy("postcode")
        .agg(F.avg("lat").alias("c_lat"), F.avg("lng").alias("c_lng"))
    )


def stable_hash(text: Column) -> Column:
    """First 32 bits of the MD5, the same in every run and engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _jitter(h: Column) -> tuple[Column, Column]:
    half = JITTER_CELLS // 2
    lat = (F.pmod(h, F.lit(JITTER_CELLS)) - half) * LAT_STEP
    lng = (F.pmod(F.floor(h / JITTER_CELLS), F.lit(JITTER_CELLS)) - half) * LNG_STEP
    return lat, lng


def _placed(joined: DataFrame) -> DataFrame:
    own = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    d_lat, d_lng = _jitter(stable_hash(F.col("id")))
    return (
        joined.withColumn("pin_lat", F.when(own, F.col("lat")).otherwise(F.col("c_lat") + d_lat))
        .withColumn("pin_lng", F.when(own, F.col("lng")).otherwise(F.col("c_lng") + d_lng))
        .withColumn("approximate", ~own)
        .where(F.col("pin_lat").isNotNull())
        .drop("c_lat", "c_lng")
    )


def place(listings: DataFrame, centres: DataFrame | None = None) -> DataFrame:
    """Own coordinates, else the postcode's centre with jitter, else no row.

    Up to ±0.0075 degrees of latitude and ±0.01 of longitude. Centres are one row per
    postcode, any number counts; Spark broadcasts them where it finds them small.
    """
    if centres is None:
        centres = centroids(listings)
    return _placed(listings.join(centres, "postcode", "left"))


def map_pins(
    listings: DataFrame,
    sources: DataFrame,
    *,
    limit: int | None = MAP_LIMIT,
    centroid_scope: str = "filtered",
    **filters,
) -> DataFrame:
    """Pins of the filtered listings with the source and URL each one links to.

    The result is stored once: its centres, its pins and its links are read from it.
    """
    found = materialize(query_listings(listings, sources, limit=limit, **filters), "found")
    placed = place(found, centroids(listings if centroid_scope == "all" else found))
    shown = found.select(F.col("id").alias("listing_id"))
    links = first_sources(sources.join(shown, "listing_id", "left_semi")).withColumnRenamed(
        "listing_id", "id"
    )
    return placed.join(links, "id", "left").select(
        "id",
        F.col("pin_lat").alias("lat"),
        F.col("pin_lng").alias("lng"),
        "approximate",
        "postcode",
        "gemeente",
        "straat",
        "prijs_eur",
        "type",
        F.col("oppervlakte_bewoonbaar_m2").alias("m2"),
        "slaapkamers",
        "epc_label",
        "titel",
        "hoofd_foto_url",
        F.col("first_source.source_name").alias("source_name"),
        F.col("first_source.source_id").alias("source_id"),
        F.col("first_source.source_url").alias("source_url"),
        "user_status",
    )


def bounds(pins: DataFrame, padding: float = BOUNDS_PADDING) -> DataFrame:
    """Bounding box of the pins, padded by a share of its own size."""
    box = pins.agg(
        F.min("lat").alias("s"), F.max("lat").alias("n"),
        F.min("lng").alias("w"), F.max("lng").alias("e"),
    )
    dy = (F.col("n") - F.col("s")) * padding
    dx = (F.col("e") - F.col("w")) * padding
    return box.select(
        (F.col("s") - dy).alias("south"), (F.col("w") - dx).alias("west"),
        (F.col("n") + dy).alias("north"), (F.col("e") + dx).alias("east"),
    )
