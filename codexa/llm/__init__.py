"""Training-data operators: texts, near-duplicates, vectors, packing.

Nothing outside this subpackage imports it; the library works without it.
"""
