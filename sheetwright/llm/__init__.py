"""Operators of a training-data pipeline: deduplication, filtering, mixing, formatting, packing and archives.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general interface;
``queries`` holds the thin queries that apply each operator to its whole table.
"""
