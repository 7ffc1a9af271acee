"""Which discovered URLs to process: grammar, scope, novelty, caps, admission, pace."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmerge.functions import urls
from plotmerge.operators.ranking import DEFAULT_WIDTH, row_numbers
from plotmerge.schemas import SCOPE_RANGES
from plotmerge.sources.registry import SOURCES, SourceSpec, by_source

KEYS = ["source_name", "url"]
#: Tasks that share the URLs of one host where its rules are joined.
SPREAD = 16


def match_urls(locs: DataFrame, sources: Mapping[str, SourceSpec] = SOURCES) -> DataFrame:
    """Keep URLs that fit their source's grammar; add postcode, city and advert id."""
    parsed = by_source(F.col("source_name"), lambda s: s.grammar.parse(F.col("url")), sources)
    # inline() drops the NULLs, and later filters cannot copy the patterns.
    return locs.select("*", F.inline(F.array_compact(F.array(parsed))))


def in_scope(postcode: Column, ranges: Iterable[tuple[int, int]] = SCOPE_RANGES) -> Column:
    """Postcode inside any of the inclusive ranges."""
    out = F.lit(False)
    for low, high in ranges:
        out = out | postcode.between(low, high)
    return out


def first_occurrences(found: DataFrame, order: str = "ord") -> DataFrame:
    """One row per (source, URL): its earliest position.

    Only the key and a number are aggregated, so copies of a URL collapse in a hash
    map before the shuffle, and the result stays partitioned for a join on the URL.
    """
    return found.groupBy(*KEYS).agg(F.min(order).alias(order))


def discover(
    locs: DataFrame,
    sources: Mapping[str, SourceSpec] = SOURCES,
    ranges: Iterable[tuple[int, int]] = SCOPE_RANGES,
    order: str = "ord",
) -> DataFrame:
    """The frontier: distinct advert URLs in scope, with what the URL says.

    URLs that fit no grammar or lie elsewhere go before the shuffle. The parsed
    columns do not travel; they are read from the distinct URLs again.
    """
    found = match_urls(locs, sources).where(in_scope(F.col("postcode"), ranges))
    return match_urls(first_occurrences(found, order), sources)


def flag_known(frontier: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``known``: the same source has stored this URL, now or before.

    ``known`` has source_name and source_url, optionally the URL it was discovered
    under as ref_url; either makes a URL known. Both sides shuffle on the URL.
    """
    stored = known.select("source_name", F.col("source_url").alias("url"))
    if "ref_url" in known.columns:
        stored = stored.unionByName(known.select("source_name", F.col("ref_url").alias("url")))
    stored = stored.where(F.col("url").isNotNull()).distinct().withColumn("known", F.lit(True))
    return frontier.join(stored, KEYS, "left").withColumn(
        "known", F.coalesce("known", F.lit(False))
    )


def drop_known(frontier: DataFrame, known: DataFrame, skip_known: bool = True) -> DataFrame:
    """URLs still to fetch; everything if known ones are to be fetched again."""
    if not skip_known:
        return frontier
    return flag_known(frontier, known).where(~F.col("known")).drop("known")


def cap_per_source(
    flagged: DataFrame, limit: int | None, order: str = "ord", width: int = DEFAULT_WIDTH
) -> DataFrame:
    """First ``limit`` unknown URLs of each source in discovery order."""
    unknown = flagged.where(~F.col("known"))
    if limit is None:
        return unknown
    return row_numbers(unknown, ["source_name"], order, width=width, at_most=limit, ties=("url",))


def skipped_counts(
    flagged: DataFrame, limit: int | None, order: str = "ord", width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Per source: URLs discovered and known ones skipped before the cap was reached."""
    if limit is None:
        return flagged.groupBy("source_name").agg(
            F.count_if(~F.col("known")).alias("discovered"),
            F.count_if("known").alias("skipped_known"),
        )
    kept = cap_per_source(flagged, limit, order, width)
    ends = kept.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("discovered"), F.max(order).alias("_last")
    )
    # One row per source of the registry, whatever the frontier's size.
    counted = flagged.join(F.broadcast(ends), "source_name", "left").groupBy("source_name").agg(
        F.coalesce(F.any_value("discovered", True), F.lit(0)).alias("discovered"),
        F.count_if(
            F.col("known")
            & (F.coalesce(F.col("discovered") < limit, F.lit(True)) | (F.col(order) < F.col("_last")))
        ).alias("skipped_known"),
    )
    return counted


def admit(frontier: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``allowed`` from allow/deny path-prefix rules of the URL's host.

    ``rules`` has host, ord, allow, prefix. The first rule in order whose prefix
    starts the path with its query decides; a host without rules, or no host, is
    allowed. The rules of one host come from one rule file and become one short
    array, so each URL stays one row. Few hosts hold most URLs: both sides meet on
    the host and one of ``SPREAD`` salts, where Spark does not broadcast the rules.
    """
    per_host = rules.groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct("ord", "allow", "prefix"))).alias("_rules")
    )
    per_host = per_host.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    path = F.coalesce(F.nullif(urls.path(F.col("url")), F.lit("")), F.lit("/"))
    located = frontier.withColumn("host", urls.host(F.col("url"))).withColumns(
        {
            "_path": F.concat_ws("?", path, urls.query(F.col("url"))),
            "_salt": F.pmod(F.xxhash64("url"), F.lit(SPREAD)).cast("int"),
        }
    )
    joined = located.join(per_host, ["host", "_salt"], "left")
    decisive = F.get(
        F.filter("_rules", lambda r: F.startswith(F.col("_path"), r["prefix"])), F.lit(0)
    )
    return joined.withColumn("allowed", F.coalesce(decisive["allow"], F.lit(True))).drop(
        "_rules", "_path", "_salt"
    )


def schedule(
    frontier: DataFrame,
    start: Column,
    order: str = "ord",
    default_per_minute: int = 180,
    overrides: Mapping[str, int] | None = None,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Planned request time: consecutive requests to a host 60/N seconds apart.

    N is at least 1. A host may hold any share of the frontier.
    """
    located = frontier.withColumn("host", urls.host(F.col("url")))
    numbered = row_numbers(located, ["host"], order, out="host_position", width=width, ties=("url",))
    per_minute = F.lit(max(default_per_minute, 1))
    if overrides:
        pairs = [F.lit(x) for h, n in overrides.items() for x in (h, max(n, 1))]
        per_minute = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("host")), per_minute)
    micros = F.floor((F.col("host_position") - 1) * F.lit(60_000_000) / per_minute)
    return numbered.withColumn(
        "request_at", F.timestamp_micros(F.unix_micros(start) + micros)
    )
