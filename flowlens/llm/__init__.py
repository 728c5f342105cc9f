"""Operators for preparing training data: mixing, fingerprints, near-duplicates, packing, classifiers, scans.

Nothing outside this folder imports it, apart from the guarded registration of its queries.
"""
