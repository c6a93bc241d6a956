"""Operators for preparing training text: documents and conversations in, training data out.

Nothing else in the library imports this package; `queries` binds each operator to the driver tables.
"""
