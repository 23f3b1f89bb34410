"""Operators for large text corpora: one module for each operator, one query module for all.

Nothing outside this subpackage imports it.
"""
