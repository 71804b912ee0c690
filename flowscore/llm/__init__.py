"""Training-data operators: deduplication, quality, archives, scoring, mixing.

Nothing else in the library imports this subpackage.
"""
