"""Operators for preparing training text: duplicates, scans, search, tokens, mixing and scores.

Nothing outside this package imports it.  Registered queries live in ``lintel.llm.queries``.
"""
