"""Operators for training-data pipelines: search, mixing, filtering, deduplication, scoring, alignment.

Nothing outside this subpackage imports it.
"""
