"""Operators of a training-data pipeline: filtering, deduplication, formatting, token files.

Nothing outside this subpackage imports it; the library works without it.
"""
