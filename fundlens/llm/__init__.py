"""Operators of a training-data pipeline: filtering, deduplication, formatting, packing and search.

Nothing else in the library imports this package.
"""
