"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the registered queries live in :mod:`sangam.llm.queries`.
"""
