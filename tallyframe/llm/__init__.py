"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; remove the folder and
the rest keeps working.  Each module holds one operator with its own general
interface; ``queries`` holds the thin ``opN_`` queries over the tables.
"""
