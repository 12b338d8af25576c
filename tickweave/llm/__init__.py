"""Operators for preparing training corpora: dedup, sharding, mixing, tokenising, scoring and extraction.

Nothing outside this subpackage imports it; its queries are in ``queries.py``.
"""
