"""Operators for preparing large text collections: language identification,
licence scans, deduplication, tokenisation, packing and decontamination.

Nothing outside this subpackage imports it.
"""
