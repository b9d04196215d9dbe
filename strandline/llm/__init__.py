"""Operators for training-data pipelines. ``queries`` applies them to the given tables."""
