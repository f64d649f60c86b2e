"""Operators for large training corpora: packing, filtering, deduplication and formatting.

Nothing outside this package imports it; see ``queries`` for the registered queries.
"""
