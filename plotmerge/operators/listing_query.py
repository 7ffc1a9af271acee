"""The parametrised listing query, nested sources, newest-first top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotmerge.operators.ranking import dealt, place

LIST_LIMIT = 500
MAP_LIMIT = 2000


def _contains(column: str, text: str) -> Column:
    """Case-insensitive, with the text taken literally."""
    return F.lower(F.col(column)).contains(text.lower())


def listing_filter(
    *,
    gemeente: str | None = None,
    postcode: int | None = None,
    prijs_min: int | None = None,
    prijs_max: int | None = None,
    slaapkamers_min: int | None = None,
    opp_min: int | None = None,
    epc_label_in: Sequence[str] | None = None,
    type_in: Sequence[str] | None = None,
    staat_in: Sequence[str] | None = None,
    user_status_in: Sequence[str] | None = None,
    exclude_user_status: Sequence[str] | None = None,
    text: str | None = None,
    located: bool = False,
) -> Column:
    """All given conditions together; None, '' and [] set no condition.

    Comparisons fail on NULL, so a range filter drops rows without the value.
    """
    out = F.lit(True)
    if gemeente:
        out = out & _contains("gemeente", gemeente)
    if postcode is not None:
        out = out & (F.col("postcode") == postcode)
    for column, low in (
        ("prijs_eur", prijs_min),
        ("slaapkamers", slaapkamers_min),
        ("oppervlakte_bewoonbaar_m2", opp_min),
    ):
        if low is not None:
            out = out & (F.col(column) >= low)
    if prijs_max is not None:
        out = out & (F.col("prijs_eur") <= prijs_max)
    for column, values in (
        ("epc_label", epc_label_in),
        ("type", type_in),
        ("staat", staat_in),
        ("user_status", user_status_in),
    ):
        if values:
            out = out & F.col(column).isin(*values)
    if exclude_user_status:
        out = out & ~F.col("user_status").isin(*exclude_user_status)
    if text:
        out = out & (_contains("titel", text) | _contains("korte_beschrijving", text))
    if located:
        out = out & F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return out


def newest_first(listings: DataFrame, limit: int | None = None) -> DataFrame:
    """By creation time, newest first, id as tie-break; a limit plans as a top-k."""
    ordered = listings.orderBy(F.desc("created_at"), "id")
    return ordered if limit is None else ordered.limit(limit)


def with_any_source(
    listings: DataFrame, sources: DataFrame, source_in: Sequence[str]
) -> DataFrame:
    """Listings advertised by any of the sources.

    The source side is reduced to distinct ids first, so that a listing with very
    many source rows weighs no more than any other in the join.
    """
    ids = (
        sources.where(F.col("source_name").isin(*source_in))
        .select(F.col("listing_id").alias("id"))
        .distinct()
    )
    return listings.join(ids, "id", "left_semi")


def query_listings(
    listings: DataFrame,
    sources: DataFrame | None = None,
    *,
    source_in: Sequence[str] | None = None,
    limit: int | None = None,
    **filters,
) -> DataFrame:
    """Filtered listings, newest first."""
    out = listings.where(listing_filter(**filters))
    if source_in:
        if sources is None:
            raise ValueError("source_in needs the source table")
        out = with_any_source(out, sources, source_in)
    return newest_first(out, limit)


def first_sources(sources: DataFrame) -> DataFrame:
    """The source a listing is linked to: first seen, then by name and id; with its URL."""
    url = F.col("source_url") if "source_url" in sources.columns else F.lit(None).cast("string")
    return sources.groupBy("listing_id").agg(
        F.min(
            F.struct("first_seen", "source_name", "source_id", url.alias("source_url"))
        ).alias("first_source")
    )


def _placed_sources(sources: DataFrame, tasks: int | None) -> tuple[DataFrame, DataFrame]:
    """Sources in the order of listing and name, and for each listing and partition of them the offset of
    their places, with the number of sources and the first source of the listing."""
    placed = place(
        sources.select("listing_id", "source_name", "source_id", "first_seen"),
        ["listing_id"], ["source_name", "source_id"], tasks,
    )
    # Dealt before they are grouped: a task that reads several files would sort all their rows.
    runs = dealt(placed, tasks, "listing_id", "_part").groupBy("listing_id", "_part").agg(
        F.min("_at").alias("_from"),
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct("first_seen", "source_name", "source_id")).alias("_seen"),
    )
    one = Window.partitionBy("listing_id")
    runs = dealt(runs, tasks, "listing_id").select(
        "listing_id",
        "_part",
        (F.sum("_n").over(one.orderBy("_part")) - F.col("_n") - F.col("_from") + 1).alias("_shift"),
        F.sum("_n").over(one).alias("n_sources"),
        F.min("_seen").over(one).alias("first_source"),
    )
    return dealt(placed.drop("first_seen"), tasks, "listing_id", "_part"), runs


def _numbered(joined: DataFrame) -> DataFrame:
    return joined.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def sorted_sources(sources: DataFrame, tasks: int | None = None) -> DataFrame:
    """Sources of each listing in name order, one row each: (listing_id, n_sources,
    first_source, pos, source_name, source_id).

    Rows are numbered where they lie after a range sort, so a listing may have any
    number of sources; the count and the first source come from one aggregate. ``tasks``
    is into how many the rows are sorted and joined, if not as Spark's settings say.
    """
    placed, runs = _placed_sources(sources, tasks)
    return _numbered(placed.join(runs, ["listing_id", "_part"]))


def with_sources(listings: DataFrame, sources: DataFrame, tasks: int | None = None) -> DataFrame:
    """Listings with a row for each source; one without sources keeps one row."""
    placed, runs = _placed_sources(sources, tasks)
    facts = listings.join(runs.withColumnRenamed("listing_id", "id"), "id", "left")
    # A listing's facts are rows per partition of its sources, so these meet without a hot key.
    joined = facts.join(placed.withColumnRenamed("listing_id", "id"), ["id", "_part"], "left")
    return _numbered(joined).withColumn("n_sources", F.coalesce("n_sources", F.lit(0).cast("bigint")))


def all_listings(listings: DataFrame) -> DataFrame:
    """The whole table, oldest first."""
    return listings.orderBy("created_at", "id")


def by_fingerprint(listings: DataFrame, fingerprint: str) -> DataFrame:
    return listings.where(F.col("fingerprint") == fingerprint)
