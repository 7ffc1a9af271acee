"""Registered queries over the given tables, with their comparison SQL."""

from plotmerge.plans import (  # noqa: F401
    frontier_plans,
    geo_plans,
    listing_plans,
    merge_plans,
    page_plans,
    text_plans,
)
from plotmerge.plans.catalog import QUERIES

__all__ = ["QUERIES"]
