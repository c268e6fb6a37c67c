"""Operators for preparing training data; nothing outside this subpackage imports it.

One module per operator, ``queries`` with the registered queries and ``oracle``
with their SQL. Every operator is a DataFrame -> DataFrame function that keeps
working on its own general interface; the registered queries derive their digest
columns from it.
"""
