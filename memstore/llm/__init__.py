"""Operators of a large-scale training-data pipeline, one module each.

Nothing outside this subpackage imports it.  ``queries`` registers the thin
``opN_<name>`` queries; every operator itself is importable on its own.
"""
