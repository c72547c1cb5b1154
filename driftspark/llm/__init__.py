"""Operators for preparing training text at scale, each a DataFrame-in, DataFrame-out function.

Nothing outside this subpackage imports it; its queries are in ``queries.py``.
"""
