"""Operators for building training corpora: tokenising, filtering, deduplicating and scoring documents at scale.

Nothing outside this package imports it.
"""
