"""Row constraints with visible reasons; bad rows are set aside, never lost."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotmerge.functions.text import strip_of
from plotmerge.functions.urls import is_http_url
from plotmerge.schemas import (
    CONDITIONS,
    EPC_LABELS,
    FINGERPRINT_MIN_LENGTH,
    LAT_MAX,
    LAT_MIN,
    LNG_MAX,
    LNG_MIN,
    POSTCODE_MAX,
    POSTCODE_MIN,
    PROPERTY_TYPES,
    SOURCE_NAMES,
    SOURCE_STATUSES,
    USER_STATUSES,
)


def strip_strings(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            strip_of(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _optional(ok: Column, column: str) -> Column:
    return F.col(column).isNull() | ok


def _listing_rules(columns: Iterable[str]) -> dict[str, Column]:
    """Name of each constraint and its condition, in checking order."""
    c = F.col
    rules = {
        "fingerprint": F.length("fingerprint") >= FINGERPRINT_MIN_LENGTH,
        "postcode": c("postcode").between(POSTCODE_MIN, POSTCODE_MAX),
        "gemeente": F.length("gemeente") >= 1,
        "lat": _optional(c("lat").between(LAT_MIN, LAT_MAX), "lat"),
        "lng": _optional(c("lng").between(LNG_MIN, LNG_MAX), "lng"),
        "prijs_eur": _optional(c("prijs_eur") >= 0, "prijs_eur"),
        "type": c("type").isin(*PROPERTY_TYPES),
        "oppervlakte_bewoonbaar_m2": _optional(
            c("oppervlakte_bewoonbaar_m2") >= 0, "oppervlakte_bewoonbaar_m2"
        ),
        "slaapkamers": _optional(c("slaapkamers") >= 0, "slaapkamers"),
        "epc_label": _optional(c("epc_label").isin(*EPC_LABELS), "epc_label"),
        "epc_kwh": _optional(c("epc_kwh") >= 0, "epc_kwh"),
        "staat": _optional(c("staat").isin(*CONDITIONS), "staat"),
        "titel": c("titel").isNotNull(),
        "korte_beschrijving": c("korte_beschrijving").isNotNull(),
        "hoofd_foto_url": _optional(is_http_url(c("hoofd_foto_url")), "hoofd_foto_url"),
        "user_status": c("user_status").isin(*USER_STATUSES),
        "created_at": c("created_at").isNotNull(),
        "updated_at": c("updated_at").isNotNull(),
        "sources": c("n_sources") >= 1,
    }
    have = set(columns)
    return {n: r for n, r in rules.items() if (n if n != "sources" else "n_sources") in have}


def _reasons(rules: dict[str, Column]) -> Column:
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )


def check_listings(listings: DataFrame) -> DataFrame:
    """Stripped rows with ``reasons``: the constraints a row breaks, in order."""
    stripped = strip_strings(listings)
    return stripped.withColumn("reasons", _reasons(_listing_rules(stripped.columns)))


def check_sources(rows: DataFrame, source_names: Iterable[str] = SOURCE_NAMES) -> DataFrame:
    """The same for source rows."""
    stripped = strip_strings(rows)
    c = F.col
    rules = {
        "source_name": c("source_name").isin(*source_names),
        "source_id": F.length("source_id") >= 1,
        "source_url": is_http_url(c("source_url")),
        "first_seen": c("first_seen").isNotNull(),
        "last_seen": c("last_seen").isNotNull(),
        "status": c("status").isin(*SOURCE_STATUSES),
    }
    rules = {n: r for n, r in rules.items() if n in stripped.columns}
    return stripped.withColumn("reasons", _reasons(rules))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") == 0).drop("reasons")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") > 0)


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row, with their row count."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def valid_status_updates(updates: DataFrame) -> DataFrame:
    return updates.where(F.col("user_status").isin(*USER_STATUSES))
