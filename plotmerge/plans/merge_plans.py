"""Queries over observations: fold, source union, classification, updates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from plotmerge.functions import text as X
from plotmerge.operators import consolidate as C
from plotmerge.operators import quality
from plotmerge.plans import inputs as I
from plotmerge.plans.catalog import QUERIES, Tables, query
from plotmerge.schemas import LISTING
from plotmerge.session import shared_dir
from plotmerge.sources import tables
from plotmerge.streaming import refresh as stream

L, S, O = I.LISTING_CTE, I.SOURCE_CTE, I.OBS_CTE
RUN_TS = datetime(2024, 6, 1)
RUN_SQL = "TIMESTAMP '2024-06-01 00:00:00'"
# Observations up to this time count as stored before the run.
CUT = datetime(2024, 1, 20)
CUT_SQL = "TIMESTAMP '2024-01-20 00:00:00'"

_FILL = ("prijs_eur", "titel", "straat", "slaapkamers", "korte_beschrijving")
_TEXT = ("titel", "straat", "korte_beschrijving")


def _fold_sql(source: str) -> str:
    def fill(c: str) -> str:
        there = f"{c} IS NOT NULL" + (f" AND {c} <> ''" if c in _TEXT else "")
        found = f"arg_min({c}, ord) FILTER (WHERE {there})"
        if c in _TEXT:
            found = f"coalesce({found}, CASE WHEN arg_min(coalesce({c}, '~'), ord) = '' THEN '' END)"
        return f"{found} AS {c}"

    return f"""SELECT fingerprint, arg_min(postcode, ord) AS postcode, arg_min(gemeente, ord) AS gemeente,
      min(created) AS created_at, {', '.join(fill(c) for c in _FILL)},
      CASE WHEN count(*) > 1 THEN {RUN_SQL} ELSE min(created) END AS updated_at
    FROM (SELECT *, first_value(fetched_at) OVER (PARTITION BY fingerprint ORDER BY ord) AS created FROM {source})
    GROUP BY fingerprint"""


_FOLD_COLUMNS = ["fingerprint", "postcode", "gemeente", "created_at", *_FILL, "updated_at"]


def _run_ts():
    return F.lit(RUN_TS)


def _observations(t: Tables):
    return I.obs(t).withColumn("created_at", F.col("fetched_at"))


@query("consolidate_fold", I.with_cte(_fold_sql("fx_obs"), O))
def consolidate_fold(t: Tables):
    """One row per fingerprint: first row's fixed columns, earliest value elsewhere."""
    return C.consolidate(_observations(t), _run_ts()).select(*_FOLD_COLUMNS)


@query(
    "consolidate_into_store",
    I.with_cte(
        f"""SELECT fingerprint, arg_min(postcode, ord) AS postcode,
          {', '.join(f"arg_min({c}, ord) FILTER (WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '') AS {c}" for c in _FILL)},
          CASE WHEN count(*) FILTER (WHERE fetched_at >= {CUT_SQL}) > 0 AND count(*) > 1 THEN {RUN_SQL}
            WHEN count(*) > 1 THEN {RUN_SQL} - INTERVAL '1' DAY ELSE min(fetched_at) END AS updated_at
        FROM fx_obs GROUP BY fingerprint""",
        O,
    ),
)
def consolidate_into_store(t: Tables):
    """Observations merged into a store that earlier observations made."""
    rows = _observations(t)
    early = F.col("fetched_at") < F.lit(CUT)
    stored = C.consolidate(rows.where(early), _run_ts() - F.expr("interval 1 day")).drop(
        "n_new", "n_stored"
    )
    merged = C.consolidate(rows.where(~early), _run_ts(), stored)
    return merged.select("fingerprint", "postcode", *_FILL, "updated_at")


@query(
    "consolidate_sources",
    I.with_cte(
        """SELECT fingerprint, source_name, source_id, arg_min(url, ord) AS source_url,
          arg_min(fetched_at, ord) AS first_seen, arg_min(fetched_at, ord) AS last_seen
        FROM (SELECT *, concat('https://x.example/', source_id, '?o=', CAST(ord AS VARCHAR)) AS url FROM fx_obs)
        GROUP BY fingerprint, source_name, source_id""",
        O,
    ),
)
def consolidate_sources(t: Tables):
    """Union of source rows; the earliest of each source stays as it was."""
    rows = I.obs(t).select(
        "fingerprint",
        "source_name",
        "source_id",
        "ord",
        F.concat(F.lit("https://x.example/"), "source_id", F.lit("?o="), F.col("ord").cast("string")).alias(
            "source_url"
        ),
        F.col("fetched_at").alias("first_seen"),
        F.col("fetched_at").alias("last_seen"),
    )
    return C.merge_sources(rows)


_OUTCOMES = f"""outcomes AS (
SELECT n.*, CASE WHEN s.fingerprint IS NULL AND n.rn = 1 THEN 'inserted' ELSE 'merged' END AS stage
FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY ord) AS rn
      FROM fx_obs WHERE fetched_at >= {CUT_SQL}) n
LEFT JOIN (SELECT DISTINCT fingerprint FROM fx_obs WHERE fetched_at < {CUT_SQL} AND source_name <> 's3') s
  USING (fingerprint))"""


def _outcomes(t: Tables):
    rows = I.obs(t)
    early = F.col("fetched_at") < F.lit(CUT)
    stored = rows.where(early & (F.col("source_name") != "s3")).select("fingerprint")
    return C.classify(rows.where(~early), stored)


@query(
    "insert_or_merge_rows",
    I.with_cte("SELECT ord, source_name, stage AS outcome FROM outcomes", O, _OUTCOMES),
)
def insert_or_merge_rows(t: Tables):
    """Whether each new observation was inserted or merged."""
    return _outcomes(t).select("ord", "source_name", "outcome")


@query(
    "insert_vs_merge_counts",
    I.with_cte(
        """SELECT source_name, count(*) AS discovered, CAST(0 AS BIGINT) AS skipped_known,
          count(*) AS fetched, count(*) AS parsed,
          count(*) FILTER (WHERE stage = 'inserted') AS inserted,
          count(*) FILTER (WHERE stage = 'merged') AS merged, CAST(0 AS BIGINT) AS errors
        FROM outcomes GROUP BY ROLLUP (source_name)""",
        O,
        _OUTCOMES,
    ),
)
def insert_vs_merge_counts(t: Tables):
    """Run counters per source and in total."""
    return quality.run_stats(_outcomes(t).withColumnRenamed("outcome", "stage"))


@query(
    "upsert_store",
    I.with_cte(
        """SELECT id, titel, prijs_eur FROM fx_listing WHERE type <> 'huis' AND prijs_eur IS NOT NULL
        UNION ALL
        SELECT id, concat(titel, ' nieuw'), prijs_eur + 1 FROM fx_listing WHERE type = 'huis' OR prijs_eur IS NULL""",
        L,
    ),
)
def upsert_store(t: Tables):
    """Stored rows with changed and added ones put in place by id."""
    stored, changed = _stored_and_changed(t)
    return C.upsert(stored, changed).select("id", "titel", "prijs_eur")


def _stored_and_changed(t: Tables):
    rows = I.listings(t)
    stored = rows.where(F.col("prijs_eur").isNotNull())
    changed = (
        rows.where((F.col("type") == "huis") | F.col("prijs_eur").isNull())
        .withColumn("titel", F.concat("titel", F.lit(" nieuw")))
        .withColumn("prijs_eur", F.col("prijs_eur") + 1)
    )
    return stored, changed


@query("upsert_bucketed_store", QUERIES["upsert_store"].sql)
def upsert_bucketed_store(t: Tables):
    """The same in a stored table of which only the touched buckets are written again."""
    stored, changed = _stored_and_changed(t)
    base = shared_dir(t.spark, "store")
    table = tables.BucketedTable(t.spark, base, "listings", LISTING, "id", buckets=16)
    table.upsert(stored, CUT)
    table.upsert(changed, RUN_TS)
    return table.read().select("id", "titel", "prijs_eur")


@query(
    "replace_listing_sources",
    I.with_cte(
        """SELECT listing_id, source_name, source_id FROM fx_source
        WHERE listing_id NOT IN (SELECT id FROM fx_listing WHERE type = 'huis')
        UNION ALL
        SELECT id, 's9', concat(id, '-new') FROM fx_listing WHERE type = 'huis'""",
        L,
        S,
    ),
)
def replace_listing_sources(t: Tables):
    """A changed listing's source rows are replaced as a whole."""
    changed = I.listings(t).where(F.col("type") == "huis")
    stored = I.sources(t).select("listing_id", "source_name", "source_id")
    new = changed.select(
        F.col("id").alias("listing_id"),
        F.lit("s9").alias("source_name"),
        F.concat("id", F.lit("-new")).alias("source_id"),
    )
    return C.replace_sources(stored, changed, new)


@query(
    "sources_of_remaining_listings",
    I.with_cte(
        """SELECT source_name, source_id FROM fx_source
        WHERE listing_id IN (SELECT id FROM fx_listing WHERE user_status <> 'afgewezen')""",
        L,
        S,
    ),
)
def sources_of_remaining_listings(t: Tables):
    """Source rows go with their listing."""
    kept = I.listings(t).where(F.col("user_status") != "afgewezen")
    return C.of_listings(I.sources(t), kept).select("source_name", "source_id")


@query(
    "mark_gone",
    I.with_cte(
        """SELECT source_name, source_id,
          CASE WHEN last_seen < TIMESTAMP '2000-01-01 00:00:00' THEN 'gone' ELSE status END AS status
        FROM fx_source""",
        S,
    ),
)
def mark_gone(t: Tables):
    """Sources not seen since a day are gone; their rows stay."""
    rows = I.sources(t)
    unseen = rows.where(F.col("last_seen") < F.lit("2000-01-01").cast("date"))
    return C.mark_gone(rows, unseen).select("source_name", "source_id", "status")


_UPDATES = """updates AS (
SELECT CAST(user_id AS VARCHAR) AS id, ts AS "at", event_id,
  CASE event_type WHEN 'view' THEN 'bekeken' WHEN 'click' THEN 'interessant'
    WHEN 'purchase' THEN 'afgewezen' WHEN 'error' THEN 'kapot' ELSE 'nieuw' END AS user_status
FROM events)"""


@query(
    "user_status_last_write",
    I.with_cte(
        """SELECT l.id, coalesce(u.user_status, l.user_status) AS user_status, coalesce(u."at", l.updated_at) AS updated_at
        FROM fx_listing l LEFT JOIN (
          SELECT id, max("at") AS "at", arg_max(user_status, "at") AS user_status FROM updates
          WHERE user_status IN ('nieuw', 'bekeken', 'interessant', 'afgewezen') GROUP BY id) u ON u.id = l.id""",
        L,
        _UPDATES,
    ),
)
def user_status_last_write(t: Tables):
    """Last valid status of each listing; unknown statuses change nothing."""
    kind = F.col("event_type")
    updates = t.events.select(
        F.col("user_id").cast("string").alias("id"),
        F.col("ts").alias("at"),
        F.when(kind == "view", "bekeken")
        .when(kind == "click", "interessant")
        .when(kind == "purchase", "afgewezen")
        .when(kind == "error", "kapot")
        .otherwise("nieuw")
        .alias("user_status"),
    )
    return C.set_user_status(I.listings(t), updates).select("id", "user_status", "updated_at")


@query(
    "backfill_null_geo",
    I.with_cte(
        """SELECT id, CASE WHEN hit THEN NULL ELSE round(lat, 6) END AS lat, CASE WHEN hit THEN NULL ELSE round(lng, 6) END AS lng
        FROM (SELECT *, id IN (SELECT listing_id FROM fx_source WHERE source_name = 's2' AND status = 'active') AS hit FROM fx_listing)""",
        L,
        S,
    ),
)
def backfill_null_geo(t: Tables):
    """Coordinates cleared on listings that have one source."""
    active = I.sources(t).where(F.col("status") == "active")
    return C.clear_location(I.listings(t), active, "s2").select(
        "id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng")
    )


@query(
    "fingerprint",
    I.with_cte(
        """SELECT source_name, source_id, md5(concat(source_name, ':', source_id)) AS fingerprint,
          regexp_replace(md5(concat(source_name, ':', source_id)),
            '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS id FROM fx_source""",
        S,
    ),
)
def fingerprint(t: Tables):
    fp = X.fingerprint(F.col("source_name"), F.col("source_id"))
    return I.sources(t).select(
        "source_name", "source_id", fp.alias("fingerprint"), C.listing_id(fp).alias("id")
    )


@query("fingerprint_blake2b")
def fingerprint_blake2b(t: Tables):
    """The same keys as stores that use BLAKE2b-128; no SQL function has it."""
    fp = X.fingerprint(F.col("source_name"), F.col("source_id"), "blake2b")
    return I.sources(t).select("source_name", "source_id", fp.alias("fingerprint"))


@query(
    "meta_latest",
    """SELECT key, arg_max(value, "at") AS value, max("at") AS "at" FROM (
      SELECT concat('user.', CAST(user_id AS VARCHAR)) AS key, CAST(event_id AS VARCHAR) AS value, ts AS "at" FROM events)
    GROUP BY key""",
)
def meta_latest(t: Tables):
    """Last value written under each key."""
    rows = t.events.select(
        F.concat(F.lit("user."), F.col("user_id").cast("string")).alias("key"),
        F.col("event_id").cast("string").alias("value"),
        F.col("ts").alias("at"),
    )
    return tables.latest_meta(rows)


@query(
    "align_schema",
    I.with_cte(
        """SELECT id, CAST(postcode AS INT) AS postcode, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lng, prijs_eur
        FROM fx_listing""",
        L,
    ),
)
def align_schema(t: Tables):
    """A table from before the coordinates existed, read in today's schema."""
    from plotmerge.schemas import LISTING, align

    old = I.listings(t).drop("lat", "lng", "staat")
    return align(old, LISTING).select("id", "postcode", "lat", "lng", "prijs_eur")


@query("incremental_refresh", I.with_cte(_fold_sql("fx_obs"), O))
def incremental_refresh(t: Tables):
    """The fold as a stream over the events files: micro-batches, then the log."""
    events = stream.read_pages(t.spark, t.path("events"), t.events.schema)
    rows = I.observe(events).withColumn("created_at", F.col("fetched_at"))
    base = shared_dir(t.spark, "refresh")
    run = stream.fold_stream(rows, f"{base}/log", f"{base}/offsets")
    run.awaitTermination()
    return stream.current(t.spark, f"{base}/log", _run_ts()).select(*_FOLD_COLUMNS)


@query(
    "stream_new_urls",
    "SELECT DISTINCT event_type AS source_name, concat('https://e.example/', user_id) AS url FROM events",
)
def stream_new_urls(t: Tables):
    """First sighting of each (source, URL) of a stream, its state in the RocksDB store."""
    events = stream.read_pages(t.spark, t.path("events"), t.events.schema)
    seen = events.select(
        F.col("event_type").alias("source_name"),
        F.concat(F.lit("https://e.example/"), F.col("user_id").cast("string")).alias("url"),
    )
    base = shared_dir(t.spark, "urls")
    stream.write_new_urls(seen, f"{base}/urls", f"{base}/offsets").awaitTermination()
    return t.spark.read.parquet(f"{base}/urls")
