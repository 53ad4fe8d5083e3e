"""Training-data operators: deduplication, extraction, filters, mixing, packing.

Nothing outside this subpackage imports it.
"""
