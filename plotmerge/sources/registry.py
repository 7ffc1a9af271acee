"""The sources: URL grammar, sitemap rule and page layout of each.

A further source is one more ``SourceSpec`` in the mapping handed to the
operators. Its layout is either one of the declarative layouts or any callable
``pages -> candidates`` (for example one built on ``mapInPandas``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmerge.functions import urls
from plotmerge.functions.urls import UrlGrammar


@dataclass(frozen=True)
class SourceSpec:
    name: str
    grammar: UrlGrammar
    layout: str
    child_sitemap_pattern: str
    all_children_if_none_match: bool
    requests_per_minute: int = 180
    custom_extract: Callable[[DataFrame], DataFrame] | None = None


# ---- fixed values: the four sources ----------------------------------------
# The child sitemap patterns are this project's own defaults; set them to the
# names the sites use at the time.
SOURCES: dict[str, SourceSpec] = {
    s.name: s
    for s in (
        SourceSpec("zimmo", urls.DATED_PATH, "residence", r"(?i)(te-koop|panden|propert)", True),
        SourceSpec("immoweb", urls.CLASSIFIED_PATH, "classified", r"(?i)classified", True),
        SourceSpec("immovlan", urls.DETAIL_PATH, "split_blocks", r"(?i)(detail|te-koop)", False),
        SourceSpec("immoscoop", urls.SALE_PATH, "product_house", r"(?i)(te-koop|propert)", False),
    )
}
# ----------------------------------------------------------------------------


def enabled(
    names: Iterable[str] | None = None, sources: Mapping[str, SourceSpec] = SOURCES
) -> dict[str, SourceSpec]:
    """The wanted sources; all by default, unknown names are ignored."""
    if names is None:
        return dict(sources)
    wanted = set(names)
    return {n: s for n, s in sources.items() if n in wanted}


def registry_table(spark: SparkSession, sources: Mapping[str, SourceSpec] = SOURCES) -> DataFrame:
    return spark.createDataFrame(
        [(s.name, s.layout, s.all_children_if_none_match, s.requests_per_minute) for s in sources.values()],
        "source_name string, layout string, all_children_if_none_match boolean, requests_per_minute int",
    )


def by_source(
    source_name: Column,
    value: Callable[[SourceSpec], Column],
    sources: Mapping[str, SourceSpec],
    otherwise: Column | None = None,
) -> Column:
    """Per row, the expression of the row's own source."""
    out = None
    for spec in sources.values():
        is_it = source_name == spec.name
        out = F.when(is_it, value(spec)) if out is None else out.when(is_it, value(spec))
    return out if otherwise is None else out.otherwise(otherwise)
