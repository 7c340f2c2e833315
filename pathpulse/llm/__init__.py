"""Operators on text corpora: scoring, rules, deduplication, packing and their queries.

Nothing else in the library imports this package.
"""
