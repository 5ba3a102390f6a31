"""Operators for large-scale training-data preparation.

Nothing outside this package imports it; ``queries`` registers its entries and
``sql`` holds the DuckDB counterparts of those that SQL can express.
"""
