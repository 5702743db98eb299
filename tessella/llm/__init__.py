"""Operators for building training corpora: mixing, deduplication, scoring, encoding and search.

Nothing outside this subpackage imports it.
"""
