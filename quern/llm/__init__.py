"""Operators that prepare training data for language models.

Nothing else in the package imports this subpackage. Each module holds one
operator with its general interface and a thin ``query`` over the test tables.
"""
