"""Operators for preparing training data: packing, scoring, mixing, near-duplicates, archives, filters, search.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
