"""Merge observations into one canonical row per fingerprint.

The merge is a fold in arrival order: the earliest row gives the fixed columns,
and each fillable column keeps the earliest value that is there. Written as
``min(struct(order, value))`` per column it is associative, so it runs as one
partial and final aggregation (a fingerprint with a third of all rows collapses
before the shuffle), and stored state merges with new rows by the same ``min``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotmerge.operators.validate import valid_status_updates
from plotmerge.schemas import FILL_FIELDS, FIRST_FIELDS

KEY = "fingerprint"
SOURCE_KEY = ["source_name", "source_id"]


def listing_id(fingerprint: Column) -> Column:
    """Identifier derived from the fingerprint, in UUID notation."""
    return F.regexp_replace(
        fingerprint, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


def _present(name: str, dtype: T.DataType) -> Column:
    """A missing value is NULL or ''; 0 is a value."""
    there = F.col(name).isNotNull()
    return there & (F.col(name) != "") if isinstance(dtype, T.StringType) else there


def _texts(types: dict[str, T.DataType]) -> list[str]:
    return [c for c in FILL_FIELDS if isinstance(types.get(c), T.StringType)]


def lift(rows: DataFrame, order: str | None, order_type: T.DataType | None = None) -> DataFrame:
    """One-row fold state per row.

    ``order`` names a totally ordered column; ``None`` marks stored rows, which
    come before every new row (their order is NULL of ``order_type``).
    """
    types = {f.name: f.dataType for f in rows.schema.fields}
    stored = order is None
    at = F.struct(
        F.lit(0 if stored else 1).alias("run"),
        (F.lit(None).cast(order_type) if stored else F.col(order)).alias("ord"),
    )
    first = [c for c in (*FIRST_FIELDS, "updated_at") if c in types]
    # Which texts the row has as '': where no row has more, '' must stay ''.
    blank = sum(
        (F.when(F.col(c) == "", 1 << i).otherwise(0) for i, c in enumerate(_texts(types))),
        F.lit(0),
    )
    return rows.select(
        KEY,
        F.lit(0 if stored else 1).cast("bigint").alias("n_new"),
        F.lit(1 if stored else 0).cast("bigint").alias("n_stored"),
        F.struct(at.alias("at"), blank.alias("blank"), *first).alias("head"),
        *[
            F.when(_present(c, types[c]), F.struct(at.alias("at"), F.col(c).alias("v"))).alias(c)
            for c in FILL_FIELDS
            if c in types
        ],
    )


def fold(states: DataFrame) -> DataFrame:
    """Merge fold states: one state row per fingerprint."""
    counters = ["n_new", "n_stored"]
    rest = [c for c in states.columns if c not in (KEY, *counters)]
    return states.groupBy(KEY).agg(
        *[F.sum(c).alias(c) for c in counters], *[F.min(c).alias(c) for c in rest]
    )


def finish(state: DataFrame, run_ts: Column) -> DataFrame:
    """Canonical rows of a folded state.

    ``updated_at`` becomes ``run_ts`` only where a row was merged into another.
    ``n_new`` and ``n_stored`` stay, for counting.
    """
    head_fields = [
        f.name for f in state.schema["head"].dataType.fields if f.name not in ("at", "blank")
    ]
    types = {c: state.schema[c].dataType["v"].dataType for c in FILL_FIELDS if c in state.columns}
    texts = _texts(types)

    def filled(c: str) -> Column:
        value = F.col(f"{c}.v")
        if c not in texts:
            return value
        was_blank = F.col("head.blank").bitwiseAND(1 << texts.index(c)) != 0
        return F.coalesce(value, F.when(was_blank, ""))

    merged = F.col("n_new") + F.col("n_stored") > 1
    before = [f"head.{c}" for c in ("updated_at", "created_at") if c in head_fields]
    kept = F.coalesce(*before) if before else F.lit(None).cast("timestamp")
    return state.select(
        KEY,
        *[F.col(f"head.{c}").alias(c) for c in head_fields if c != "updated_at"],
        *[filled(c).alias(c) for c in types],
        F.when(merged, run_ts).otherwise(kept).alias("updated_at"),
        "n_new",
        "n_stored",
    )


def consolidate(
    new: DataFrame, run_ts: Column, stored: DataFrame | None = None, order: str = "ord"
) -> DataFrame:
    """Insert or merge ``new`` rows into ``stored`` by fingerprint, in arrival order."""
    states = lift(new, order)
    if stored is not None:
        old = lift(stored, None, new.schema[order].dataType)
        states = old.unionByName(states, allowMissingColumns=True)
    return finish(fold(states), run_ts)


def merge_sources(
    new: DataFrame, stored: DataFrame | None = None, order: str = "ord"
) -> DataFrame:
    """Union of source rows per fingerprint; the earliest row of a source stays.

    Later sightings change nothing of a known source, its last_seen included.
    """
    value = [c for c in new.columns if c not in (KEY, *SOURCE_KEY, order)]

    def lifted(rows: DataFrame, run: int, at: Column) -> DataFrame:
        return rows.select(
            KEY,
            *SOURCE_KEY,
            F.struct(F.lit(run).alias("run"), at.alias("ord"), *value).alias("s"),
        )

    states = lifted(new, 1, F.col(order))
    if stored is not None:
        missing = F.lit(None).cast(new.schema[order].dataType)
        states = lifted(stored, 0, missing).unionByName(states)
    return (
        states.groupBy(KEY, *SOURCE_KEY)
        .agg(F.min("s").alias("s"))
        .select(KEY, *SOURCE_KEY, *[F.col(f"s.{c}").alias(c) for c in value])
    )


def classify(new: DataFrame, stored: DataFrame, order: str = "ord") -> DataFrame:
    """Add ``outcome`` to each new row: inserted or merged.

    The first row of a fingerprint the store lacks is inserted. The rows meet
    their group's first one on (fingerprint, order), a key without hot values.
    """
    heads = new.groupBy(KEY).agg(F.min(order).alias(order))
    fresh = heads.join(stored.select(KEY).distinct(), KEY, "left_anti").withColumn(
        "_fresh", F.lit(True)
    )
    return new.join(fresh, [KEY, order], "left").withColumn(
        "outcome", F.when(F.col("_fresh"), "inserted").otherwise("merged")
    ).drop("_fresh")


def upsert(stored: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows with the changed ones put in place by key."""
    kept = stored.join(changed.select(key), key, "left_anti").select(stored.columns)
    return kept.unionByName(changed.select(stored.columns))


def replace_sources(
    stored: DataFrame, changed_listings: DataFrame, changed_sources: DataFrame
) -> DataFrame:
    """Source rows of a changed listing are replaced as a whole."""
    changed = changed_listings.select(F.col("id").alias("listing_id")).distinct()
    kept = stored.join(changed, "listing_id", "left_anti").select(stored.columns)
    return kept.unionByName(changed_sources.select(stored.columns))


def of_listings(sources: DataFrame, listings: DataFrame) -> DataFrame:
    """Source rows whose listing is still there."""
    ids = listings.select(F.col("id").alias("listing_id"))
    return sources.join(ids, "listing_id", "left_semi")


def mark_gone(sources: DataFrame, gone: DataFrame) -> DataFrame:
    """Set status gone on the (source_name, source_id) given; no row is removed."""
    flags = gone.select(*SOURCE_KEY).distinct().withColumn("_gone", F.lit(True))
    return (
        sources.join(flags, SOURCE_KEY, "left")
        .withColumn("status", F.when(F.col("_gone"), "gone").otherwise(F.col("status")))
        .select(sources.columns)
    )


def set_user_status(listings: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply the last valid status of each listing; ``updates``: id, user_status, at."""
    last = (
        valid_status_updates(updates)
        .groupBy("id")
        .agg(F.max(F.struct("at", "user_status")).alias("_u"))
    )
    return (
        listings.join(last, "id", "left")
        .withColumn("user_status", F.coalesce("_u.user_status", "user_status"))
        .withColumn("updated_at", F.coalesce("_u.at", "updated_at"))
        .select(listings.columns)
    )


def clear_location(listings: DataFrame, sources: DataFrame, source_name: str) -> DataFrame:
    """Set coordinates to NULL on listings that have the given source."""
    flagged = (
        sources.where(F.col("source_name") == source_name)
        .select(F.col("listing_id").alias("id"))
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    joined = listings.join(flagged, "id", "left")
    for c in ("lat", "lng"):
        joined = joined.withColumn(c, F.when(F.col("_hit").isNull(), F.col(c)))
    return joined.select(listings.columns)
