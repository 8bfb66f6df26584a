"""Training-data operators: identification, deduplication, privacy, mixing, packing, sharding, search, filtering.

Nothing else in the library imports this subpackage. ``registry`` names the queries and their SQL.
"""
