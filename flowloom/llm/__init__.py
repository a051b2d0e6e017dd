"""Operators of a training-data pipeline over text, pages and vectors.

Nothing else in the library imports this subpackage. ``flowloom.llm.queries`` holds
the registered queries and their SQL.
"""
