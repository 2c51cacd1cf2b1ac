"""Operators for preparing training data: packing, filtering, joins, search, mixing and scans.

Every operator takes DataFrames and returns DataFrames.  Nothing outside this subpackage imports it.
"""
