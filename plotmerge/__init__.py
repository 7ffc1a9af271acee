"""Consolidation of property adverts from many sources, as Spark DataFrame plans."""
