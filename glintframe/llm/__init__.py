"""Operators for building training corpora: mixing, privacy, filtering, dedup, media, packing.

Nothing outside this subpackage imports it.  ``queries`` holds the registered queries
and ``common`` the few helpers that the operators share.
"""
