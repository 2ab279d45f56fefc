"""Training-data operators: similarity search, deduplication, filtering, tokenising, sharding.

Nothing outside this subpackage imports it.  Each module is one operator with its own general interface;
``queries`` holds the thin digest queries over the shared test tables.
"""
