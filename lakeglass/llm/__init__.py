"""Operators for preparing large language-model training corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin contract queries live in :mod:`lakeglass.llm.queries`.
"""
