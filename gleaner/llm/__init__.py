"""Operators of a training-data pipeline: ten methods over documents, vectors and labels.

Nothing outside this subpackage imports it.  ``queries.QUERIES`` and ``queries.SQL`` hold the entries of the driver
contract.
"""
