"""Operators for preparing training data: filters, near-duplicates, scans, formatting and mixing.

Nothing else in the library imports this subpackage.
"""
