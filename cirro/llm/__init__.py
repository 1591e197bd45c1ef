"""Operators of a training-data pipeline: packing, quality, near duplicates, scans.

Each module holds one operator with a general interface; ``queries``
registers the thin ``opN_<name>`` queries and their SQL.  Nothing else in
the library imports this package.
"""
