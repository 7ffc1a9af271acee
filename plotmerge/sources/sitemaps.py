"""Sitemap files: bytes, XML, URL rows, and the index-to-page walk."""

from __future__ import annotations

import gzip
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotmerge.sources.registry import SOURCES, SourceSpec, by_source

# ---- fixed values ----------------------------------------------------------
SITEMAP_NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
GZIP_MAGIC = b"\x1f\x8b"
XML_VIEWER_DIV = r"(?is)<div\b[^>]*\bid\s*=\s*[\"']?webkit-xml-viewer-source-xml[\"']?[^>]*>(.*?)</div>"
SITEMAP_BLOCK = r"(?is)<(urlset|sitemapindex)\b.*?</\1\s*>"
# ----------------------------------------------------------------------------


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed sitemap files as (url, body)."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("url"), F.col("content").alias("body")
    )


def gunzip(files: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """Unpack bodies whose URL ends in .gz or that start like gzip; others stay.

    A body that cannot be unpacked also stays as it is. A sitemap file has at
    most 50 MB, so a row fits a task many times over.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[body] = [_unpacked(u, b) for u, b in zip(pdf[url], pdf[body], strict=True)]
            yield pdf

    return files.mapInPandas(unpack, files.schema)


def _unpacked(url: str | None, body: bytes | None) -> bytes | None:
    if body is None or not ((url or "").endswith(".gz") or body[:2] == GZIP_MAGIC):
        return body
    try:
        return gzip.decompress(body)
    except (OSError, EOFError, zlib.error):
        return body


def unwrap_xml(text: Column) -> Column:
    """XML inside a browser's XML viewer page; plain XML and other text unchanged."""
    start = F.ltrim(text)
    plain = (
        F.startswith(start, F.lit("<?xml"))
        | F.startswith(start, F.lit("<urlset"))
        | F.startswith(start, F.lit("<sitemapindex"))
    )
    viewer = F.nullif(F.regexp_extract(text, XML_VIEWER_DIV, 1), F.lit(""))
    block = F.regexp_substr(text, F.lit(SITEMAP_BLOCK))
    return F.when(plain, text).otherwise(F.coalesce(viewer, block, text))


def _locs_of(xml: str | None) -> list[str]:
    try:
        root = ET.fromstring((xml or "").strip())
    except (ET.ParseError, ValueError):
        return []
    found = (e.text.strip() for e in root.iter(f"{{{SITEMAP_NAMESPACE}}}loc") if e.text)
    return [t for t in found if t]


@F.udf(T.ArrayType(T.StringType()), useArrow=False)
def locs(xml: str | None) -> list[str]:
    """Trimmed, non-empty <loc> texts of the sitemap namespace; [] if malformed.

    A worker holds a hundred documents at a time; an Arrow batch would be 10,000 of them.
    """
    return _locs_of(xml)


def sitemap_locs(docs: DataFrame) -> DataFrame:
    """(source_name, sitemap_url, pos, loc) of sitemap texts in ``xml``."""
    read = docs.select("source_name", "sitemap_url", locs(unwrap_xml(F.col("xml"))).alias("_locs"))
    return read.select("source_name", "sitemap_url", F.posexplode("_locs").alias("pos", "loc"))


def child_sitemaps(
    index_locs: DataFrame, sources: Mapping[str, SourceSpec] = SOURCES
) -> DataFrame:
    """Child sitemaps to read, by the source's name rule.

    Where no child of a source matches, some sources fall back to all children.
    """
    name = F.col("source_name")
    matched = index_locs.where(name.isin(*sources)).withColumn(
        "_match", by_source(name, lambda s: F.col("loc").rlike(s.child_sitemap_pattern), sources)
    )
    # One row per source of the registry; no index, however large, is in one task.
    any_match = matched.groupBy("source_name").agg(F.bool_or("_match").alias("_any"))
    fallback = by_source(name, lambda s: F.lit(s.all_children_if_none_match), sources, F.lit(False))
    return (
        matched.join(F.broadcast(any_match), "source_name")
        .where(F.col("_match") | (fallback & ~F.col("_any")))
        .drop("_match", "_any")
    )


def walk(
    locs_table: DataFrame,
    roots: DataFrame,
    sources: Mapping[str, SourceSpec] = SOURCES,
) -> DataFrame:
    """Page URLs below each source's index: (source_name, sitemap_url, pos, url).

    ``roots``: source_name, sitemap_url of the index files.
    """
    index = locs_table.join(roots, ["source_name", "sitemap_url"], "left_semi")
    children = child_sitemaps(index, sources).select(
        "source_name", F.col("loc").alias("sitemap_url")
    )
    return locs_table.join(children.distinct(), ["source_name", "sitemap_url"], "left_semi").select(
        "source_name", "sitemap_url", "pos", F.col("loc").alias("url")
    )

