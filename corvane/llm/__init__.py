"""Training-data operators: filtering, deduplication, mixing, packing, archives, search, scoring.

Nothing else in the library imports this subpackage.
"""
