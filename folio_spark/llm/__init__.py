"""Operators for preparing text corpora for language-model training.

Self-contained: nothing outside this subpackage imports it.  Each ``opN_*`` module
holds one operator with a general interface and the thin query registered for it.
"""
