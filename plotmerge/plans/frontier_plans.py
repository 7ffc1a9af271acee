"""Queries over discovered URLs: sitemaps, grammar, scope, novelty, admission, pace."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from plotmerge.operators import frontier as Fr
from plotmerge.operators import known as K
from plotmerge.operators.ranking import row_numbers
from plotmerge.plans import inputs as I
from plotmerge.plans.catalog import Tables, query
from plotmerge.session import materialize, shared_dir
from plotmerge.sources import registry, sitemaps
from plotmerge.sources.layouts import page_text

SOURCES = ("zimmo", "immoscoop", "immovlan", "immoweb")
CAP = 200

# One discovered URL per line item; many come more than once, some fit no grammar
# (a rental, an overview page), a third lie outside the wanted postcodes.
_LOCS = """locs AS (
SELECT l_orderkey * 8 + l_linenumber AS ord, ['zimmo', 'immoscoop', 'immovlan', 'immoweb'][1 + l_suppkey % 4] AS source_name,
  CASE WHEN l_suppkey % 10 = 9 THEN concat('https://www.site.example/te-huur/', pc, '-stad/', l_partkey, '?p=1')
    WHEN l_suppkey % 4 = 0 THEN concat('https://www.site0.example/nl/', pc, '-SINT-stad/Te-Koop/', CASE WHEN l_partkey % 2 = 0 THEN 'te-koop/' ELSE '' END, l_partkey, CASE WHEN l_suppkey % 3 = 0 THEN '-mooi/' ELSE '' END)
    WHEN l_suppkey % 4 = 1 THEN concat('https://www.site1.example/te-koop/', pc, '-de-pinte/', l_partkey, CASE WHEN l_suppkey % 3 = 0 THEN '/' ELSE '' END)
    WHEN l_suppkey % 4 = 2 THEN concat('https://www.site2.example/NL/detail/huis/te-koop/', pc, '/gent/vbe', l_partkey)
    ELSE concat('https://www.site3.example/nl/classified/huis/te-koop/gent-zuid/', pc, '/', l_partkey) END AS url, pc, l_partkey
FROM (SELECT *, CAST(7000 + l_partkey % 3000 AS VARCHAR) AS pc FROM lineitem))"""

_MATCHED = """matched AS (
SELECT ord, source_name, url, CAST(pc AS INT) AS postcode,
  CASE source_name WHEN 'zimmo' THEN 'Sint Stad' WHEN 'immoscoop' THEN 'De Pinte' WHEN 'immovlan' THEN 'Gent' ELSE 'Gent Zuid' END AS gemeente,
  CASE source_name WHEN 'immovlan' THEN concat('vbe', l_partkey) ELSE CAST(l_partkey AS VARCHAR) END AS source_id
FROM locs WHERE url NOT LIKE '%/te-huur/%' AND (source_name <> 'zimmo' OR contains(url, 'te-koop')))"""

_FRONTIER = """frontier AS (
SELECT source_name, url, min(ord) AS ord, any_value(postcode) AS postcode, any_value(source_id) AS source_id FROM matched
WHERE postcode BETWEEN 8000 AND 9999 GROUP BY source_name, url)"""

_FLAGGED = """flagged AS (
SELECT f.*, EXISTS (SELECT 1 FROM frontier k WHERE k.source_name = f.source_name AND k.url = f.url AND CAST(regexp_extract(k.source_id, '[0-9]+', 0) AS BIGINT) % 3 = 0) AS known
FROM frontier f)"""

# The same again in one row per URL, for the cap.
_CAPPED = f"""capped AS (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY ord, url) AS rn FROM flagged WHERE NOT known)
WHERE rn <= {CAP})"""


def _locs(t: Tables):
    c, k = F.col, F.col("l_suppkey")
    pc = (7000 + c("l_partkey") % 3000).cast("string")
    part = c("l_partkey").cast("string")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    url = (
        F.when(k % 10 == 9, text("https://www.site.example/te-huur/", pc, "-stad/", part, "?p=1"))
        .when(
            k % 4 == 0,
            text(
                "https://www.site0.example/nl/", pc, "-SINT-stad/Te-Koop/",
                F.when(c("l_partkey") % 2 == 0, "te-koop/").otherwise(""), part,
                F.when(k % 3 == 0, "-mooi/").otherwise(""),
            ),
        )
        .when(k % 4 == 1, text("https://www.site1.example/te-koop/", pc, "-de-pinte/", part, F.when(k % 3 == 0, "/").otherwise("")))
        .when(k % 4 == 2, text("https://www.site2.example/NL/detail/huis/te-koop/", pc, "/gent/vbe", part))
        .otherwise(text("https://www.site3.example/nl/classified/huis/te-koop/gent-zuid/", pc, "/", part))
    )
    name = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (k % 4 + 1).cast("int"))
    return t.spread("lineitem").select(
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("ord"), name.alias("source_name"), url.alias("url")
    )


def _frontier(t: Tables):
    return Fr.discover(_locs(t))


def _flagged(t: Tables):
    frontier = _frontier(t)
    return Fr.flag_known(frontier, _stored(frontier))


def _stored(frontier):
    """Of a frontier, what the store has already."""
    stored = frontier.where(F.regexp_extract("source_id", "[0-9]+", 0).cast("bigint") % 3 == 0)
    return stored.select("source_name", F.col("url").alias("source_url"))


@query(
    "url_frontier",
    I.with_cte("SELECT ord, source_name, url, postcode, gemeente, source_id FROM matched", _LOCS, _MATCHED),
)
def url_frontier(t: Tables):
    """URLs that fit their source's grammar, with postcode, city and id."""
    return Fr.match_urls(_locs(t)).select("ord", "source_name", "url", "postcode", "gemeente", "source_id")


@query(
    "url_scope",
    I.with_cte(
        """SELECT source_name, postcode, count(*) AS n FROM matched
        WHERE postcode BETWEEN 8000 AND 8999 OR postcode BETWEEN 9000 AND 9999 GROUP BY ALL""",
        _LOCS,
        _MATCHED,
    ),
)
def url_scope(t: Tables):
    """URLs in scope per source and postcode."""
    found = Fr.match_urls(_locs(t)).where(Fr.in_scope(F.col("postcode")))
    return found.groupBy("source_name", "postcode").agg(F.count(F.lit(1)).alias("n"))


@query(
    "url_dedup",
    I.with_cte("SELECT source_name, url, ord, postcode, source_id FROM frontier", _LOCS, _MATCHED, _FRONTIER),
)
def url_dedup(t: Tables):
    """First occurrence of each URL of a source."""
    return _frontier(t).select("source_name", "url", "ord", "postcode", "source_id")


@query(
    "url_known_anti",
    I.with_cte("SELECT source_name, url, ord FROM flagged WHERE NOT known", _LOCS, _MATCHED, _FRONTIER, _FLAGGED),
)
def url_known_anti(t: Tables):
    """URLs the store does not have yet."""
    return _flagged(t).where(~F.col("known")).select("source_name", "url", "ord")


@query(
    "url_known_filtered",
    I.with_cte("SELECT source_name, url, ord FROM flagged WHERE NOT known", _LOCS, _MATCHED, _FRONTIER, _FLAGGED),
)
def url_known_filtered(t: Tables):
    """The same by a Bloom filter of the stored URLs: only what passes it is compared by URL."""
    frontier = materialize(_frontier(t), "frontier")
    flagged = K.flag_known_filtered(frontier, _stored(frontier))
    return flagged.where(~F.col("known")).select("source_name", "url", "ord")


@query(
    "url_cap",
    I.with_cte("SELECT source_name, url, ord, rn FROM capped", _LOCS, _MATCHED, _FRONTIER, _FLAGGED, _CAPPED),
)
def url_cap(t: Tables):
    """The first unknown URLs of each source in discovery order."""
    return Fr.cap_per_source(materialize(_flagged(t), "frontier"), CAP, width=20_000).select("source_name", "url", "ord", "rn")


@query(
    "url_skip_counts",
    I.with_cte(
        f"""SELECT f.source_name, any_value(e.n) AS discovered,
          count(*) FILTER (WHERE f.known AND (e.n < {CAP} OR f.ord < e.last)) AS skipped_known
        FROM flagged f JOIN (SELECT source_name, count(*) AS n, max(ord) AS last FROM capped GROUP BY 1) e USING (source_name)
        GROUP BY f.source_name""",
        _LOCS,
        _MATCHED,
        _FRONTIER,
        _FLAGGED,
        _CAPPED,
    ),
)
def url_skip_counts(t: Tables):
    """URLs taken, and known ones passed over before the cap was reached."""
    return Fr.skipped_counts(materialize(_flagged(t), "frontier"), CAP, width=20_000)


@query(
    "row_numbers_in_buckets",
    """SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey,
      row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn
    FROM lineitem""",
)
def row_numbers_in_buckets(t: Tables):
    """Positions within very large groups, without a group in one task."""
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return row_numbers(
        rows, ["l_returnflag"], "l_orderkey", width=1_000, ties=("l_linenumber", "l_partkey", "l_suppkey")
    )


# ---- admission and pace of web page URLs -----------------------------------------

_RULES = (
    ("www.", 1, True, "/en/"), ("www.", 2, False, "/en"), ("www.", 3, False, "/fr/8"),
    ("blog.", 1, False, "/"), ("m.", 1, False, "/de/"), ("m.", 2, True, "/"),
    ("www.", 0, False, "/en/133?utm_"), ("m.", 0, False, "/en/82?page="),
)

_RULE_CTE = f"""kinds(prefix_of, ord, allow, prefix) AS (VALUES {', '.join(
    f"('{h}', {o}, {str(a).lower()}, '{p}')" for h, o, a, p in _RULES)}),
located AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
  concat(coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/'), regexp_extract(url, '\\?[^#]*')) AS path FROM pages),
rules AS (SELECT DISTINCT l.host, k.ord, k.allow, k.prefix FROM located l JOIN kinds k ON starts_with(l.host, k.prefix_of))"""


@query(
    "robots_admission",
    I.with_cte(
        """SELECT l.page_id, l.host, coalesce(arg_min(r.allow, r.ord), true) AS allowed
        FROM located l LEFT JOIN rules r ON r.host = l.host AND starts_with(l.path, r.prefix) GROUP BY l.page_id, l.host""",
        _RULE_CTE,
    ),
)
def robots_admission(t: Tables):
    """First matching path rule of the URL's host decides; no rule allows."""
    from plotmerge.functions import urls

    kinds = F.array(
        *[
            F.struct(F.lit(h).alias("of"), F.lit(o).alias("ord"), F.lit(a).alias("allow"), F.lit(p).alias("prefix"))
            for h, o, a, p in _RULES
        ]
    )
    hosts = t.pages.select(urls.host(F.col("url")).alias("host")).distinct()
    fitting = F.filter(kinds, lambda r: F.startswith(F.col("host"), r["of"]))
    rules = hosts.select("host", F.inline(fitting)).drop("of")
    return Fr.admit(t.pages.select("page_id", "url"), rules).select("page_id", "host", "allowed")


@query(
    "fetch_schedule",
    I.with_cte(
        """SELECT page_id, host, n AS host_position, TIMESTAMP '2024-06-01 00:00:00' + to_microseconds(CAST(floor((n - 1) * 60000000 / rate) AS BIGINT)) AS request_at
        FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id, url) AS n,
            CASE WHEN host = 'blog.tionsh.example.net' THEN 7 WHEN host = 'm.ththth.example.net' THEN 1 ELSE 180 END AS rate FROM located)""",
        _RULE_CTE,
    ),
)
def fetch_schedule(t: Tables):
    """Planned request times, spaced per host."""
    planned = Fr.schedule(
        t.pages.select("page_id", "url"),
        F.lit(datetime(2024, 6, 1)),
        order="page_id",
        overrides={"blog.tionsh.example.net": 7, "m.ththth.example.net": 0},
        width=100,
    )
    return planned.select("page_id", "host", "host_position", "request_at")


# ---- sitemaps ----------------------------------------------------------------------

# Parts make pages, pages make sitemaps of up to 50 entries, and four sites have an
# index each. Site 2 and 3 name no child that fits: one reads all, one reads none.
_SITEMAPS = """part_loc AS (
SELECT p_partkey AS k, ['zimmo', 'immoscoop', 'immovlan', 'immoweb'][1 + p_partkey % 4] AS source_name, p_partkey // 200 AS doc FROM part),
page_loc AS (
SELECT source_name, concat('https://', source_name, '.example/', CASE WHEN source_name IN ('immovlan', 'immoweb') THEN 'map' WHEN doc % 3 = 0 THEN 'nieuws' ELSE 'te-koop' END, '-', doc, '.xml') AS sitemap_url,
  doc, k, concat('https://', source_name, '.example/advert/', k, '?a=1&b=2') AS url FROM part_loc
WHERE doc % 7 <> 5)"""


def _sitemap_docs(t: Tables):
    """Sitemap files of the four sites: (source_name, sitemap_url, xml)."""
    k = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (k % 4 + 1).cast("int"))
    rows = t.part.select(k.alias("k"), name.alias("source_name"), F.floor(k / 200).alias("doc"))
    kind = (
        F.when(F.col("source_name").isin("immovlan", "immoweb"), "map")
        .when(F.col("doc") % 3 == 0, "nieuws")
        .otherwise("te-koop")
    )
    address = F.concat(
        F.lit("https://"), "source_name", F.lit(".example/"), kind, F.lit("-"), F.col("doc").cast("string"), F.lit(".xml")
    )
    entry = F.concat(
        F.lit("<url><loc> https://"), "source_name", F.lit(".example/advert/"), F.col("k").cast("string"),
        F.lit("?a=1&amp;b=2\n</loc><lastmod>2024</lastmod></url>"),
    )
    # A document number covers 50 parts of a source: every array stays that short.
    urlset = "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9' xmlns:x='urn:x'>"
    children = (
        rows.groupBy("source_name", "doc")
        .agg(F.concat_ws("", F.array_sort(F.collect_list(entry))).alias("entries"))
        .withColumn("sitemap_url", address)
    )
    inner = F.concat(F.lit(urlset), "entries", F.lit("<url><x:loc>urn:no</x:loc><loc> </loc></url></urlset>"))
    xml = (
        F.when(F.col("doc") % 7 == 5, F.concat(inner, F.lit("<broken>")))
        .when(
            F.col("doc") % 7 == 1,
            F.concat(F.lit("<html><body><div id='webkit-xml-viewer-source-xml'>"), inner, F.lit("</div></body></html>")),
        )
        .when(F.col("doc") % 7 == 2, F.concat(F.lit("<html><pre>"), inner, F.lit("</pre></html>")))
        .otherwise(F.concat(F.lit("<?xml version='1.0'?>"), inner))
    )
    pages = children.select("source_name", "sitemap_url", xml.alias("xml"))
    # The index of a site is itself split: 1,000 children to a file.
    index = (
        children.withColumn("part", F.floor(F.col("doc") / 1000))
        .groupBy("source_name", "part")
        .agg(
            F.concat_ws(
                "",
                F.array_sort(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "sitemap_url", F.lit("</loc></sitemap>")))),
            ).alias("entries")
        )
        .select(
            "source_name",
            F.concat(F.lit("https://"), "source_name", F.lit(".example/index-"), F.col("part").cast("string"), F.lit(".xml")).alias("sitemap_url"),
            F.concat(F.lit("<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>"), "entries", F.lit("</sitemapindex>")).alias("xml"),
        )
    )
    return pages, index


@query(
    "sitemap_locs",
    I.with_cte("SELECT source_name, sitemap_url, url AS loc FROM page_loc", _SITEMAPS),
)
def sitemap_locs(t: Tables):
    """Page URLs in sitemap files, wrapped in viewer pages or malformed ones too."""
    pages, _ = _sitemap_docs(t)
    return sitemaps.sitemap_locs(pages).select("source_name", "sitemap_url", "loc")


@query(
    "sitemap_walk",
    I.with_cte(
        """SELECT source_name, sitemap_url, url FROM page_loc
        WHERE contains(sitemap_url, 'te-koop') OR (source_name IN ('zimmo', 'immoweb') AND source_name NOT IN (
          SELECT source_name FROM part_loc WHERE source_name IN ('zimmo', 'immoscoop') AND doc % 3 <> 0))""",
        _SITEMAPS,
    ),
)
def sitemap_walk(t: Tables):
    """From each site's index through the fitting child sitemaps to page URLs."""
    pages, index = _sitemap_docs(t)
    found = sitemaps.sitemap_locs(pages.unionByName(index))
    roots = index.select("source_name", "sitemap_url")
    return sitemaps.walk(found, roots).select("source_name", "sitemap_url", "url")


@query(
    "sitemap_files_gunzip",
    I.with_cte("SELECT source_name, url FROM page_loc", _SITEMAPS),
)
def sitemap_files_gunzip(t: Tables):
    """Gzip-compressed sitemap files, written and read back as bytes.

    The files have no .gz name but the magic bytes; each holds several documents.
    """
    pages, _ = _sitemap_docs(t)
    path = shared_dir(t.spark, "sitemaps")
    flat = F.regexp_replace("xml", r"\s+", " ")
    pages.select(flat.alias("value")).write.option("compression", "gzip").text(path)
    files = sitemaps.gunzip(sitemaps.read_sitemap_files(t.spark, path))
    docs = files.select(F.explode(F.split(page_text(F.col("body")), "\n")).alias("xml")).where("xml <> ''")
    found = docs.select(F.explode(sitemaps.locs(sitemaps.unwrap_xml(F.col("xml")))).alias("url"))
    return found.select(F.regexp_extract("url", "//([a-z]+)", 1).alias("source_name"), "url")


@query(
    "source_registry",
    """SELECT ['zimmo', 'immoscoop', 'immovlan', 'immoweb'][1 + s_suppkey % 4] AS source_name, s_suppkey FROM supplier
    WHERE s_suppkey % 4 IN (0, 2)""",
)
def source_registry(t: Tables):
    """Rows of the enabled sources; unknown names in the selection are ignored."""
    table = registry.registry_table(t.spark, registry.enabled(["zimmo", "immovlan", "nergens"]))
    name = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return t.supplier.select("s_suppkey", name.alias("source_name")).join(
        F.broadcast(table.select("source_name")), "source_name", "left_semi"
    )
