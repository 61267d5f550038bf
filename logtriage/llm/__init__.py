"""Operators for preparing training text at scale (deduplication, packing, scoring, scans).

Every operator is a function from DataFrames to a DataFrame.  ``queries`` registers one
query per operator over the driver tables; nothing outside this package imports it.
"""
