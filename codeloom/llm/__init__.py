"""Training-data operators: deduplication, decontamination, filtering, mixing, sharding and export.

Nothing outside this subpackage imports it.
"""
