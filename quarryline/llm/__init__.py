"""Operators for preparing text corpora at scale.

Nothing outside this folder imports it.  ``queries`` holds the registered
queries (``QUERIES``) and their SQL twins (``ORACLES``).
"""
