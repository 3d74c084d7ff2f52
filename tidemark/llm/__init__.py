"""Operators for preparing training data: search, counting, scoring, formatting, mixing and deduplication.

Nothing outside this subpackage imports it.
"""
