"""Operators of a training-data pipeline over large text collections.

Nothing outside this package imports it.  Each module holds one operator with
its own interface; :mod:`weftline.llm.queries` derives the registered queries.
"""
