"""Operators for building training corpora at scale.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and returns a DataFrame; ``queries`` derives the digest columns from them.
"""
