"""Operators for preparing text corpora: deduplication, scans, filters, mixing and tokenization.

Nothing else in the library imports this subpackage.
"""
