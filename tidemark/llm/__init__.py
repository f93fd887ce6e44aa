"""Training-data operators: search, deduplication, packing, tokenizing, filters and scans.

Nothing outside this subpackage imports it.
"""
