"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it; the driver entry file adds its
queries only when it can be imported.
"""
