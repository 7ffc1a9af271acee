"""Row types, value domains and schema alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: domains every stored row must respect -------------------
SOURCE_NAMES = ("zimmo", "immoweb", "immovlan", "immoscoop")
SOURCE_STATUSES = ("active", "gone")
PROPERTY_TYPES = ("huis", "appartement", "grond", "other")
CONDITIONS = ("instapklaar", "te-renoveren", "nieuwbouw")
EPC_LABELS = ("A+", "A", "B", "C", "D", "E", "F")
USER_STATUSES = ("nieuw", "bekeken", "interessant", "afgewezen")
POSTCODE_MIN, POSTCODE_MAX = 1000, 9999
LAT_MIN, LAT_MAX = 49.4, 51.6
LNG_MIN, LNG_MAX = 2.5, 6.5
FINGERPRINT_MIN_LENGTH = 16
SCOPE_RANGES = ((8000, 8999), (9000, 9999))
# ----------------------------------------------------------------------------

RAW_PAGE = T.StructType(
    [
        T.StructField("source_name", T.StringType(), False),
        T.StructField("source_url", T.StringType(), False),
        T.StructField("body", T.BinaryType(), False),
        T.StructField("fetched_at", T.TimestampType(), False),
    ]
)

LISTING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("postcode", T.IntegerType()),
        T.StructField("gemeente", T.StringType()),
        T.StructField("straat", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lng", T.DoubleType()),
        T.StructField("prijs_eur", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("oppervlakte_bewoonbaar_m2", T.LongType()),
        T.StructField("slaapkamers", T.LongType()),
        T.StructField("epc_label", T.StringType()),
        T.StructField("epc_kwh", T.LongType()),
        T.StructField("staat", T.StringType()),
        T.StructField("titel", T.StringType()),
        T.StructField("korte_beschrijving", T.StringType()),
        T.StructField("hoofd_foto_url", T.StringType()),
        T.StructField("user_status", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

LISTING_SOURCE = T.StructType(
    [
        T.StructField("listing_id", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("status", T.StringType()),
    ]
)

META = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("at", T.TimestampType()),
    ]
)

# Columns the merge fills from later observations while they are missing.
FILL_FIELDS = (
    "straat",
    "lat",
    "lng",
    "prijs_eur",
    "oppervlakte_bewoonbaar_m2",
    "slaapkamers",
    "epc_label",
    "epc_kwh",
    "staat",
    "titel",
    "korte_beschrijving",
    "hoofd_foto_url",
)
# Columns that always stay as the earliest observation had them.
FIRST_FIELDS = ("id", "postcode", "gemeente", "type", "user_status", "created_at")


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to ``schema``; columns an older dataset lacks become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
