"""Landed pages, sitemaps, source registry, stored tables."""
