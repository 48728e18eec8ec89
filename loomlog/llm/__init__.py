"""Operators for preparing training text, one module each.

Nothing outside this package imports it. An operator takes DataFrames and returns DataFrames;
``queries`` applies each to the sample tables.
"""
