"""Training-data operators: tokenising, formatting, near-duplicates, packing.

Nothing outside this subpackage imports it; ``queries`` and ``oracle_sql`` are
its only entry points for the registry.
"""
