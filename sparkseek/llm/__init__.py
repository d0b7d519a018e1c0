"""Operators for building training corpora: de-duplication, quality, mixing, search and tokenising.

Nothing outside this subpackage imports it.
"""
