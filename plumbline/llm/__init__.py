"""Training-data operators: deduplication, tokenizing, scoring, filtering, packing, archives.

Nothing outside this subpackage imports it.
"""
