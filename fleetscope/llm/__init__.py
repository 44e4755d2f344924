"""Training-data operators: deduplication, language, quality, safety, packing.

Nothing else in the library imports this subpackage.
"""
