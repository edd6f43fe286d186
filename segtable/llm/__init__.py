"""Training-data operators: tokenising, scoring, deduplication, mixing and token files.

Nothing outside this subpackage imports it. Each module holds one operator with
its own general interface; ``queries`` derives the registered query results.
"""
