"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  The operators live in one module
each; :mod:`docgrid.llm.queries` holds the thin ``opN_<name>`` queries.
"""
