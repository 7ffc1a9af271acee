"""Coverage, run statistics, error samples, JSON profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotmerge.functions import json_values as J
from plotmerge.session import materialize

# ---- fixed values ----------------------------------------------------------
GEO_WORDS = ("lat", "lng", "long", "geo", "coord", "location", "position")
ERROR_SAMPLES = 5
PREVIEW_LENGTH = 80
# ----------------------------------------------------------------------------


def _filled(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def coverage(listings: DataFrame) -> DataFrame:
    """How many rows have each field: (field, n, total), from one scan."""
    tests = {
        "lat_lng": F.col("lat").isNotNull() & F.col("lng").isNotNull(),
        "prijs_eur": F.col("prijs_eur").isNotNull(),
        "oppervlakte_bewoonbaar_m2": F.col("oppervlakte_bewoonbaar_m2").isNotNull(),
        "slaapkamers": F.col("slaapkamers").isNotNull(),
        "epc_label": _filled("epc_label"),
        "straat": _filled("straat"),
        "hoofd_foto_url": _filled("hoofd_foto_url"),
    }
    counted = listings.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(t).alias(n) for n, t in tests.items()]
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("n")) for n in tests])
    return counted.select(F.explode(pairs).alias("p"), "total").select("p.field", "p.n", "total")


def multi_source(sources: DataFrame) -> DataFrame:
    """Listings advertised more than once, with the number of their source rows."""
    return (
        sources.groupBy("listing_id")
        .agg(F.count(F.lit(1)).alias("n_sources"))
        .where(F.col("n_sources") > 1)
    )


def flag_multi_source(listings: DataFrame, sources: DataFrame) -> DataFrame:
    """The listing rows with ``multi_source``, by fingerprint."""
    many = multi_source(sources).withColumnRenamed("listing_id", "id")
    return (
        listings.join(many, "id", "left")
        .withColumn("multi_source", F.col("n_sources").isNotNull())
        .drop("n_sources")
        .orderBy("fingerprint")
    )


def run_stats(outcomes: DataFrame) -> DataFrame:
    """Counters per source and, where source_name is NULL, of the whole run.

    ``outcomes``: source_name, stage; stages: skipped_known, fetch_error,
    rejected, invalid, inserted, merged.
    """

    def n(*stages: str) -> Column:
        return F.count_if(F.col("stage").isin(*stages))

    return outcomes.rollup("source_name").agg(
        n("fetch_error", "rejected", "invalid", "inserted", "merged").alias("discovered"),
        n("skipped_known").alias("skipped_known"),
        n("rejected", "invalid", "inserted", "merged").alias("fetched"),
        n("invalid", "inserted", "merged").alias("parsed"),
        n("inserted").alias("inserted"),
        n("merged").alias("merged"),
        n("fetch_error", "rejected", "invalid").alias("errors"),
    )


def error_samples(
    errors: DataFrame, order: str, sample: int = ERROR_SAMPLES
) -> DataFrame:
    """First messages of each source in order, and how many more there are.

    The group limit is applied before the shuffle: a source with any number of
    errors sends ``sample`` rows per task. The errors are stored, as they are read twice:
    what finds them, a parse of all pages perhaps, runs once.
    """
    errors = materialize(errors.select("source_name", order, "message"), "errors")
    first = Window.partitionBy("source_name").orderBy(order)
    shown = (
        errors.withColumn("_rn", F.row_number().over(first))
        .where(F.col("_rn") <= sample)
        .groupBy("source_name")
        .agg(F.sort_array(F.collect_list(F.struct("_rn", "message"))).alias("_m"))
    )
    totals = errors.groupBy("source_name").agg(F.count(F.lit(1)).alias("errors"))
    return totals.join(shown, "source_name").select(
        "source_name",
        "errors",
        F.transform("_m", lambda m: m["message"]).alias("messages"),
        F.greatest(F.col("errors") - sample, F.lit(0)).alias("suppressed"),
    )


def location_counts(found: DataFrame, pins: DataFrame) -> DataFrame:
    """Results, pins, and results without a place on the map."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    marks = found.select(one.alias("r"), none.alias("p")).unionAll(
        pins.select(none.alias("r"), one.alias("p"))
    )
    counts = marks.agg(
        F.coalesce(F.sum("r"), none).alias("results"), F.coalesce(F.sum("p"), none).alias("pins")
    )
    return counts.withColumn("without_location", F.col("results") - F.col("pins"))


def run_window(observations: DataFrame, at: str = "fetched_at") -> DataFrame:
    """Start, last refresh and duration in seconds of a run."""
    return observations.agg(F.min(at).alias("started_at"), F.max(at).alias("last_refresh_at")).withColumn(
        "seconds",
        (F.unix_micros("last_refresh_at") - F.unix_micros("started_at")) / F.lit(1_000_000.0),
    )


#: Levels opened within one row before the deeper ones are taken up again.
LEVELS_AT_ONCE = 4


def json_paths(docs: DataFrame, text: str, words: Sequence[str] | None = None) -> DataFrame:
    """One row per key of each document: (path, name, type, preview).

    Objects and all items of lists are opened level by level until none is left; a list
    within a list is a level without a name. Some levels are opened within the row, so
    that documents are read and parsed once; values below them are stored and opened in
    another round, which flat documents never need. With ``words`` only keys whose name
    contains one are kept.
    """
    entry = "array<struct<path:string,name:string,v:variant>>"

    def keys_of(value: Column, path: Column) -> Column:
        return F.transform(
            F.map_entries(J.members(value)),
            lambda m: F.struct(
                F.concat_ws(".", F.nullif(path, F.lit("")), m["key"]).alias("path"),
                m["key"].alias("name"),
                m["value"].alias("v"),
            ),
        )

    def nameless(value: Column, path: Column) -> Column:
        return F.array(F.struct(path.alias("path"), F.lit(None).cast("string").alias("name"), value.alias("v")))

    def inside(e: Column) -> Column:
        opened = F.coalesce(J.items(e["v"]), F.array(e["v"]))
        return _concat(F.transform(opened, lambda v: F.when(
            J.is_list(v), nameless(v, e["path"])
        ).otherwise(keys_of(v, e["path"]))), entry)

    def below(level: Column) -> Column:
        return _concat(F.transform(level, inside), entry)

    def opened(levels: DataFrame) -> DataFrame:
        for n in range(1, LEVELS_AT_ONCE):
            levels = levels.withColumn(f"l{n}", below(F.col(f"l{n - 1}")))
        last = f"l{LEVELS_AT_ONCE - 1}"
        deeper = F.filter(F.col(last), lambda e: F.size(inside(e)) > 0)
        names = [F.transform(F.col(c), lambda e: F.struct(
            e["path"].alias("path"), e["name"].alias("name"),
            F.regexp_extract(J.kind(e["v"]), r"^\w+", 0).alias("type"),
            F.substring(F.to_json(e["v"]), 1, PREVIEW_LENGTH).alias("preview"),
        )) for c in levels.columns]
        found = F.filter(F.concat(*names), lambda e: e["name"].isNotNull())
        return materialize(levels.select(found.alias("found"), deeper.alias("deeper")), "json-paths")

    rows = opened(
        docs.select(J.parse_strict(F.col(text)).alias("v")).select(
            F.coalesce(
                F.when(J.is_list(F.col("v")), nameless(F.col("v"), F.lit(""))).otherwise(keys_of(F.col("v"), F.lit(""))),
                F.array().cast(entry),
            ).alias("l0")
        )
    )
    found = rows.select(F.inline("found"))
    while not (rows := rows.where(F.size("deeper") > 0)).isEmpty():
        rows = opened(rows.select(below(F.col("deeper")).alias("l0")))
        found = found.union(rows.select(F.inline("found")))
    if words is None:
        return found
    name = F.lower("name")
    hit = F.lit(False)
    for w in words:
        hit = hit | name.contains(w)
    return found.where(hit)


def _concat(arrays: Column, dtype: str) -> Column:
    """One array of arrays' elements; missing arrays count as empty."""
    return F.coalesce(F.flatten(F.array_compact(arrays)), F.array().cast(dtype))


def json_key_profile(docs: DataFrame, text: str, words=None) -> DataFrame:
    """Per path and JSON type: rows that have it and the smallest preview."""
    return json_paths(docs, text, words).groupBy("path", "type").agg(
        F.count(F.lit(1)).alias("n"), F.min("preview").alias("preview")
    )
