"""Operators of a training-data pipeline over large document tables.

Nothing else in the library imports this package.  Each module holds one operator with a general
interface; ``registry`` derives the query results from them.
"""
