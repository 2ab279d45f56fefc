"""Batch analytics over competitive deck-and-card data, as Spark DataFrames.

``bindings`` give tables in the canonical schema, ``operators`` work on these, ``functions`` are column
expressions, ``sources`` read retained snapshots, ``streaming`` has the incremental variants and ``plans`` the
named queries with their SQL counterparts.
"""
