"""Operators for training-data pipelines; their queries are in ``queries``."""
