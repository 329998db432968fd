"""Training-data operators: language ID, quality rules, WARC, deduplication,
URL filters, mixing and packing.

Each module holds one operator with its general interface; ``queries`` holds
the thin registered queries.  Nothing else in the library imports this
subpackage.
"""
