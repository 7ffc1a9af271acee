"""Queries over listings and their sources: filters, joins, top-k, validation."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from plotmerge.functions import text as X
from plotmerge.operators import listing_query as Q
from plotmerge.operators import validate as V
from plotmerge.operators.text_index import TextIndex
from plotmerge.plans import inputs as I
from plotmerge.plans.catalog import QUERIES, Tables, query
from plotmerge.session import shared_dir

L, S = I.LISTING_CTE, I.SOURCE_CTE
SHOWN = "id, postcode, gemeente, prijs_eur, type, user_status, created_at"
SHOWN_COLUMNS = [c.strip() for c in SHOWN.split(",")]


def _filter_query(name: str, where: str, **filters) -> None:
    sql = I.with_cte(f"SELECT {SHOWN} FROM fx_listing WHERE {where}", L)

    @query(name, sql)
    def run(t: Tables):
        # Sorting is not part of the comparison and would be a shuffle for nothing.
        return I.listings(t).where(Q.listing_filter(**filters)).select(*SHOWN_COLUMNS)


@query(
    "listing_query_semi_topk",
    I.with_cte(
        f"""SELECT {SHOWN} FROM fx_listing
        WHERE prijs_eur >= 91000 AND user_status NOT IN ('afgewezen')
          AND id IN (SELECT listing_id FROM fx_source WHERE source_name IN ('s0', 's1'))
        ORDER BY created_at DESC, id LIMIT 500""",
        L,
        S,
    ),
)
def listing_query_semi_topk(t: Tables):
    """Filtered listings of some sources, newest 500."""
    return Q.query_listings(
        I.listings(t),
        I.sources(t),
        prijs_min=91000,
        exclude_user_status=["afgewezen"],
        source_in=["s0", "s1"],
        limit=Q.LIST_LIMIT,
    ).select(*SHOWN_COLUMNS)


_filter_query("listing_filter_city", "contains(lower(gemeente), 'brand#2')", gemeente="BRAND#2")
_filter_query("listing_filter_postcode", "postcode = 8500", postcode=8500)
_filter_query(
    "listing_filter_price_range",
    "prijs_eur >= 91000 AND prijs_eur <= 140000",
    prijs_min=91000,
    prijs_max=140000,
)
_filter_query("listing_filter_bedrooms_min", "slaapkamers >= 3", slaapkamers_min=3)
_filter_query("listing_filter_surface_min", "oppervlakte_bewoonbaar_m2 >= 150", opp_min=150)
_filter_query("listing_filter_epc_in", "epc_label IN ('A', 'B', 'C')", epc_label_in=["A", "B", "C"])
_filter_query("listing_filter_type_in", "type IN ('huis', 'grond')", type_in=["huis", "grond"])
_filter_query(
    "listing_filter_condition_in",
    "staat IN ('instapklaar', 'nieuwbouw')",
    staat_in=["instapklaar", "nieuwbouw"],
)
_filter_query(
    "listing_filter_status_in", "user_status IN ('nieuw', 'interessant')",
    user_status_in=["nieuw", "interessant"],
)
_filter_query(
    "listing_filter_exclude_status", "user_status NOT IN ('afgewezen', 'bekeken')",
    exclude_user_status=["afgewezen", "bekeken"],
)
_filter_query(
    "listing_filter_text",
    "(contains(lower(titel), 'ring') OR contains(lower(korte_beschrijving), 'ring'))",
    text="RING",
)
_filter_query("listing_filter_located", "lat IS NOT NULL AND lng IS NOT NULL", located=True)
_filter_query(
    "listing_filter_blank", "TRUE", gemeente="", text="", type_in=[], epc_label_in=None
)
_filter_query(
    "listing_filter_combined",
    """contains(lower(gemeente), 'brand') AND prijs_eur <= 180000 AND slaapkamers >= 1
    AND type IN ('huis', 'other') AND user_status NOT IN ('afgewezen')""",
    gemeente="brand",
    prijs_max=180000,
    slaapkamers_min=1,
    type_in=["huis", "other"],
    exclude_user_status=["afgewezen"],
)


@query(
    "document_text_filter",
    """SELECT doc_id, lang, source FROM documents
    WHERE contains(lower(text), 'tion') OR contains(lower(source), 'tion')""",
)
def document_text_filter(t: Tables):
    """The text filter over whole document texts."""
    docs = t.documents.withColumnRenamed("text", "titel").withColumn(
        "korte_beschrijving", F.col("source")
    )
    return docs.where(Q.listing_filter(text="TION")).select("doc_id", "lang", "source")


@query("document_text_index", QUERIES["document_text_filter"].sql)
def document_text_index(t: Tables):
    """The same by a trigram index of the texts: only candidate rows are read."""
    index = TextIndex(t.spark, shared_dir(t.spark, "text-index"))
    index.build(t.documents.select("doc_id", "lang", "source", "text"), ["text", "source"])
    return index.search("TION").select("doc_id", "lang", "source")


@query(
    "listing_filter_source_in",
    I.with_cte(
        """SELECT id, type FROM fx_listing
        WHERE EXISTS (SELECT 1 FROM fx_source s WHERE s.listing_id = id AND s.source_name IN ('s2', 's3'))""",
        L,
        S,
    ),
)
def listing_filter_source_in(t: Tables):
    return Q.with_any_source(I.listings(t), I.sources(t), ["s2", "s3"]).select("id", "type")


@query(
    "listing_with_sources",
    I.with_cte(
        """SELECT id, coalesce(n, 0) AS n_sources, first_name AS first_source, first_id AS first_source_id,
          pos, source_name, source_id
        FROM fx_listing LEFT JOIN (
          SELECT listing_id, source_name, source_id, count(*) OVER one AS n,
            row_number() OVER (PARTITION BY listing_id ORDER BY source_name, source_id) AS pos,
            first_value(source_name) OVER seen AS first_name, first_value(source_id) OVER seen AS first_id
          FROM fx_source
          WINDOW one AS (PARTITION BY listing_id),
            seen AS (PARTITION BY listing_id ORDER BY first_seen, source_name, source_id)) s ON s.listing_id = id""",
        L,
        S,
    ),
)
def listing_with_sources(t: Tables):
    """A row for each source in name order, and the source a listing links to."""
    return Q.with_sources(I.listings(t).select("id"), I.sources(t), t.tasks("lineitem")).select(
        "id",
        "n_sources",
        F.col("first_source.source_name").alias("first_source"),
        F.col("first_source.source_id").alias("first_source_id"),
        "pos",
        "source_name",
        "source_id",
    )


@query(
    "all_listings_created",
    I.with_cte("SELECT id, fingerprint, titel, created_at FROM fx_listing ORDER BY created_at, id", L),
)
def all_listings_created(t: Tables):
    return Q.all_listings(I.listings(t)).select("id", "fingerprint", "titel", "created_at")


@query(
    "newest_listings",
    I.with_cte(
        "SELECT id, titel, created_at FROM fx_listing ORDER BY created_at DESC, id LIMIT 500", L
    ),
)
def newest_listings(t: Tables):
    return Q.newest_first(I.listings(t), Q.LIST_LIMIT).select("id", "titel", "created_at")


@query(
    "listing_by_fingerprint",
    I.with_cte(
        "SELECT id, fingerprint FROM fx_listing WHERE fingerprint = md5('part:42')", L
    ),
)
def listing_by_fingerprint(t: Tables):
    """Point lookup; no row if absent."""
    wanted = hashlib.md5(b"part:42").hexdigest()
    return Q.by_fingerprint(I.listings(t), wanted).select("id", "fingerprint")


# Faults are written into some rows of every constraint's column.
_FAULTY = """faulty AS (
SELECT id,
  CASE WHEN k % 11 = 0 THEN 'short' ELSE fingerprint END AS fingerprint,
  CAST(CASE WHEN k % 13 = 0 THEN 999 WHEN k % 13 = 1 THEN 10000 ELSE postcode END AS INT) AS postcode,
  CASE WHEN k % 17 = 0 THEN '  ' ELSE concat(' ', gemeente, ' ') END AS gemeente,
  CASE WHEN k % 19 = 1 THEN CAST(59.0 AS DOUBLE) ELSE lat END AS lat, lng,
  CASE WHEN k % 23 = 0 THEN -1 ELSE prijs_eur END AS prijs_eur,
  CASE WHEN k % 29 = 0 THEN 'kasteel' ELSE type END AS type,
  CASE WHEN k % 31 = 0 THEN 'G' ELSE epc_label END AS epc_label,
  CASE WHEN k % 37 = 0 THEN '' WHEN k % 37 = 1 THEN 'ftp://x' ELSE hoofd_foto_url END AS hoofd_foto_url,
  CASE WHEN k % 41 = 0 THEN NULL ELSE user_status END AS user_status
FROM (SELECT *, CAST(id AS BIGINT) AS k FROM fx_listing))"""

_REASONS = """concat_ws(',',
  CASE WHEN length(fingerprint) >= 16 THEN NULL ELSE 'fingerprint' END,
  CASE WHEN postcode BETWEEN 1000 AND 9999 THEN NULL ELSE 'postcode' END,
  CASE WHEN length(trim(gemeente)) >= 1 THEN NULL ELSE 'gemeente' END,
  CASE WHEN lat IS NULL OR lat BETWEEN 49.4 AND 51.6 THEN NULL ELSE 'lat' END,
  CASE WHEN lng IS NULL OR lng BETWEEN 2.5 AND 6.5 THEN NULL ELSE 'lng' END,
  CASE WHEN prijs_eur IS NULL OR prijs_eur >= 0 THEN NULL ELSE 'prijs_eur' END,
  CASE WHEN type IN ('huis', 'appartement', 'grond', 'other') THEN NULL ELSE 'type' END,
  CASE WHEN epc_label IS NULL OR epc_label IN ('A+', 'A', 'B', 'C', 'D', 'E', 'F') THEN NULL ELSE 'epc_label' END,
  CASE WHEN hoofd_foto_url IS NULL OR regexp_matches(hoofd_foto_url, '^https?://[^ /]+') THEN NULL ELSE 'hoofd_foto_url' END,
  CASE WHEN user_status IN ('nieuw', 'bekeken', 'interessant', 'afgewezen') THEN NULL ELSE 'user_status' END)"""


def _faulty(t: Tables):
    rows = I.listings(t).withColumn("k", F.col("id").cast("bigint"))

    def where(n: int, value, name: str, residue: int = 0):
        return F.when(F.col("k") % n == residue, F.lit(value)).otherwise(F.col(name)).alias(name)

    return rows.select(
        "id",
        where(11, "short", "fingerprint"),
        F.when(F.col("k") % 13 == 0, 999)
        .when(F.col("k") % 13 == 1, 10000)
        .otherwise(F.col("postcode"))
        .alias("postcode"),
        F.when(F.col("k") % 17 == 0, "  ")
        .otherwise(F.concat(F.lit(" "), "gemeente", F.lit(" ")))
        .alias("gemeente"),
        where(19, 59.0, "lat", 1),
        "lng",
        where(23, -1, "prijs_eur"),
        where(29, "kasteel", "type"),
        where(31, "G", "epc_label"),
        F.when(F.col("k") % 37 == 0, "")
        .when(F.col("k") % 37 == 1, "ftp://x")
        .otherwise(F.col("hoofd_foto_url"))
        .alias("hoofd_foto_url"),
        where(41, None, "user_status"),
    )


@query(
    "validate_reject_reasons",
    I.with_cte(f"SELECT id, {_REASONS} AS reasons FROM faulty", L, _FAULTY),
)
def validate_reject_reasons(t: Tables):
    """Every row with the constraints it breaks; '' for an accepted one."""
    return V.check_listings(_faulty(t)).select("id", F.array_join("reasons", ",").alias("reasons"))


@query(
    "validate_accepted",
    I.with_cte(
        f"SELECT id, trim(gemeente) AS gemeente, postcode FROM faulty WHERE {_REASONS} = ''", L, _FAULTY
    ),
)
def validate_accepted(t: Tables):
    return V.accepted(V.check_listings(_faulty(t))).select("id", "gemeente", "postcode")


@query(
    "validate_quarantine_counts",
    I.with_cte(
        f"""SELECT reason, count(*) AS n FROM (
          SELECT unnest(string_split({_REASONS}, ',')) AS reason FROM faulty) WHERE reason <> ''
        GROUP BY reason""",
        L,
        _FAULTY,
    ),
)
def validate_quarantine_counts(t: Tables):
    bad = V.quarantined(V.check_listings(_faulty(t)))
    return bad.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "validate_source_rows",
    I.with_cte(
        """SELECT source_id, status, concat_ws(',',
          CASE WHEN source_name IN ('s0', 's1', 's2') THEN NULL ELSE 'source_name' END,
          CASE WHEN listing_id LIKE '%7' THEN 'source_url' END) AS reasons
        FROM fx_source""",
        S,
    ),
)
def validate_source_rows(t: Tables):
    """Source rows against a registry of three, some with a broken URL."""
    broken = F.col("listing_id").endswith("7")
    rows = I.sources(t).withColumn(
        "source_url",
        F.when(broken, "www.no-scheme.example").otherwise(
            F.concat(F.lit("https://x.example/"), "source_id")
        ),
    )
    return V.check_sources(rows, ("s0", "s1", "s2")).select(
        "source_id", "status", F.array_join("reasons", ",").alias("reasons")
    )


@query(
    "duplicate_source_keys",
    I.with_cte(
        """SELECT source_name, source_id, count(*) AS n FROM (
          SELECT source_name, source_id FROM fx_source
          UNION ALL SELECT source_name, source_id FROM fx_source WHERE status = 'gone')
        GROUP BY ALL HAVING count(*) > 1""",
        S,
    ),
)
def duplicate_source_keys(t: Tables):
    """Source keys held twice after gone rows were written again."""
    keys = I.sources(t).select("source_name", "source_id", "status")
    again = F.when(F.col("status") == "gone", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    twice = keys.select("source_name", "source_id", F.explode(again).alias("copy"))
    key = ["source_name", "source_id"]
    return V.duplicate_keys(t.dealt(twice, "lineitem", *key), key)


@query(
    "price_display",
    I.with_cte(
        """SELECT id,
          CASE WHEN p IS NULL OR p = 0 THEN 'onbekend' ELSE replace(format('{:,}', p), ',', '.') END AS in_list,
          CASE WHEN p IS NULL THEN 'onbekend' ELSE replace(format('{:,}', p), ',', '.') END AS on_map
        FROM (SELECT id, CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN 0 ELSE prijs_eur END AS p FROM fx_listing)""",
        L,
    ),
)
def price_display(t: Tables):
    p = F.when(F.col("id").cast("bigint") % 10 == 0, F.lit(0)).otherwise(F.col("prijs_eur"))
    return I.listings(t).select(
        "id",
        X.price_display(p).alias("in_list"),
        X.price_display(p, zero_is_unknown=False).alias("on_map"),
    )
