"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it: the rest of the library works
without it.  Each module holds one operator with its own general interface;
``llm.queries`` holds the thin queries over the ``documents`` table.
"""
