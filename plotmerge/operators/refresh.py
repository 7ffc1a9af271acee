"""One refresh: landed pages into the stored listings, with an outcome per page."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmerge.functions.text import fingerprint
from plotmerge.operators import consolidate as C
from plotmerge.operators import validate as V
from plotmerge.operators.frontier import flag_known
from plotmerge.session import materialize
from plotmerge.sources.layouts import extract_candidates
from plotmerge.sources.registry import SOURCES, SourceSpec
from plotmerge.sources.tables import BucketedTable


class Refresh(NamedTuple):
    listings: DataFrame
    sources: DataFrame
    outcomes: DataFrame


def observations(
    pages: DataFrame,
    run_ts: Column,
    specs: Mapping[str, SourceSpec] = SOURCES,
    fingerprint_mode: str = "md5",
) -> DataFrame:
    """Checked candidate rows of the pages, good and bad.

    ``reject`` names what is wrong with the page, ``reasons`` which constraints the
    row breaks; a usable row has neither. ``ord`` is the arrival order, total and
    independent of how the pages are split over files and micro-batches.
    """
    found = extract_candidates(pages, specs)
    key = fingerprint(F.col("source_name"), F.col("source_id"), fingerprint_mode)
    rows = (
        found.withColumn("fingerprint", key)
        .withColumn("id", C.listing_id(F.col("fingerprint")))
        .withColumn("titel", F.coalesce("titel", F.lit("")))
        .withColumn("korte_beschrijving", F.coalesce("korte_beschrijving", F.lit("")))
        .withColumn("user_status", F.lit("nieuw"))
        .withColumn("created_at", run_ts)
        .withColumn("updated_at", run_ts)
        .withColumn("ord", F.struct("fetched_at", "source_name", "source_id", "ref_url"))
    )
    return V.check_listings(rows)


def usable(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reject").isNull() & (F.size("reasons") == 0)).drop(
        "reject", "reasons"
    )


def page_sources(good: DataFrame) -> DataFrame:
    """The source row each usable page stands for."""
    return good.select(
        "fingerprint",
        "source_name",
        "source_id",
        "ord",
        "source_url",
        F.col("fetched_at").alias("first_seen"),
        F.col("fetched_at").alias("last_seen"),
        F.lit("active").alias("status"),
    )


def failures(checked: DataFrame) -> DataFrame:
    """Outcome rows of pages that gave no usable row."""
    bad = checked.where(F.col("reject").isNotNull() | (F.size("reasons") > 0))
    return bad.select(
        "source_name",
        "ref_url",
        F.when(F.col("reject").isNotNull(), "rejected").otherwise("invalid").alias("stage"),
        F.coalesce("reject", F.concat(F.lit("constraint: "), F.get("reasons", F.lit(0)))).alias(
            "message"
        ),
    )


def new_pages(pages: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages at URLs that their source has not stored, and an outcome row per other page.

    Only URL columns are shuffled to tell them apart, see ``split_known``.
    """
    landed = pages.select("source_name", F.col("source_url").alias("url"))
    keys = [c for c in ("source_name", "source_url", "ref_url") if c in sources.columns]
    return split_known(pages, flag_known(landed, sources.select(*keys)))


def split_known(pages: DataFrame, flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same, from rows (source_name, url, known) of the pages.

    The keys of new pages go back to
    the bodies by a semi-join: broadcast where Spark finds them small (a scan over mostly
    known pages), and none at all where no page is known (a first load).
    """
    flagged = materialize(flagged, "landed")
    known = flagged.where("known")
    skipped = known.select(
        "source_name",
        F.col("url").alias("ref_url"),
        F.lit("skipped_known").alias("stage"),
        F.lit(None).cast("string").alias("message"),
    )
    if known.isEmpty():
        return pages, skipped
    new = flagged.where(~F.col("known")).select("source_name", F.col("url").alias("source_url"))
    return pages.join(new.distinct(), ["source_name", "source_url"], "left_semi").select(
        *pages.columns
    ), skipped


def refresh(
    pages: DataFrame,
    listings: DataFrame,
    sources: DataFrame,
    run_ts: Column,
    specs: Mapping[str, SourceSpec] = SOURCES,
    skip_known: bool = True,
    fingerprint_mode: str = "md5",
) -> Refresh:
    """Consolidate the pages with the store; write the result as new versions.

    Known URLs are found first, from the URL columns alone, and their pages are not
    parsed; they count as ``skipped_known``. The other pages are parsed once, into rows
    without a body, which are written to the shared folder like the merged store. With
    ``skip_known=False`` known pages come in again and can fill gaps only.
    """
    skipped = None
    if skip_known:
        pages, skipped = new_pages(pages, sources)
    checked = materialize(observations(pages, run_ts, specs, fingerprint_mode), "checked")
    good = usable(checked)
    merged = materialize(C.consolidate(good, run_ts, listings), "merged")
    new_sources = C.merge_sources(page_sources(good)).join(
        merged.select("fingerprint", F.col("id").alias("listing_id")), "fingerprint"
    )
    stored = [c for c in sources.columns if c in new_sources.columns]
    known_sources = sources.select(*C.SOURCE_KEY)
    added = new_sources.join(known_sources, C.SOURCE_KEY, "left_anti").select(stored)
    outcomes = failures(checked).unionByName(
        C.classify(good, listings).select(
            "source_name",
            "ref_url",
            F.col("outcome").alias("stage"),
            F.lit(None).cast("string").alias("message"),
        )
    )
    if skipped is not None:
        outcomes = outcomes.unionByName(skipped)
    return Refresh(merged, sources.select(stored).unionByName(added), outcomes)


def refresh_store(
    pages: DataFrame,
    listings: BucketedTable,
    sources: BucketedTable,
    run_ts: Column,
    at: datetime,
    specs: Mapping[str, SourceSpec] = SOURCES,
    skip_known: bool = True,
    fingerprint_mode: str = "md5",
) -> DataFrame:
    """Consolidate the pages into bucketed stores in place; returns the outcomes, stored.

    Listings are bucketed by fingerprint, sources by listing_id. Only the buckets that the new
    pages touch are read, folded and written. The listings are made current first: a run that
    is lost in between leaves listings without their new sources, and running it again adds these.
    """
    skipped = None
    if skip_known:
        pages, skipped = new_pages(pages, sources.read())
    checked = materialize(observations(pages, run_ts, specs, fingerprint_mode), "checked")
    good = usable(checked)
    outcomes = failures(checked).unionByName(
        C.classify(good, listings.read_for(good)).select(
            "source_name", "ref_url", F.col("outcome").alias("stage"),
            F.lit(None).cast("string").alias("message"),
        )
    )
    if skipped is not None:
        outcomes = outcomes.unionByName(skipped)
    outcomes = materialize(outcomes, "outcomes")
    listings.update(good, lambda stored, rows: C.consolidate(rows, run_ts, stored), at)
    ids = listings.read_for(good).select(C.KEY, F.col("id").alias("listing_id"))
    found = materialize(C.merge_sources(page_sources(good)).join(ids, C.KEY), "new-sources")

    def add(stored: DataFrame, rows: DataFrame) -> DataFrame:
        new = rows.join(stored.select(*C.SOURCE_KEY), C.SOURCE_KEY, "left_anti")
        return stored.unionByName(new.select(stored.columns))

    sources.update(found, add, at)
    return outcomes
