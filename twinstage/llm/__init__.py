"""Operators of a training-data pipeline; nothing outside this package imports it.

``catalog.py`` holds the registered queries ``opN_<name>``, the other modules the
operators, each with an interface of its own.
"""
