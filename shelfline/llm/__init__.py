"""Operators for preparing training text: sharding, scoring, filtering, deduplication, packing.

Nothing else in the library imports this package. Every module holds one operator with a general interface and
the registered query that applies it to whole tables; ``registry`` collects the queries.
"""
