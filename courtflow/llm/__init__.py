"""Operators for preparing training data: search, filters, dedup, mixing, packing, output.

Every operator takes DataFrames and returns DataFrames. Nothing else in the
library imports this subpackage.
"""
