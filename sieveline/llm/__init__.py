"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage. ``registry`` holds the
registered queries and their SQL; every module holds one operator with its own
general interface, and the ``opN_*`` query beside it derives digest columns.
"""
