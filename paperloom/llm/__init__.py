"""Operators of a training-data pipeline over the ``documents`` and ``pages`` tables.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
