"""Operators for preparing training corpora.

The subpackage stands alone: nothing else in the library imports it, and the
queries that apply its operators to whole tables are in ``llm.queries``.
"""
