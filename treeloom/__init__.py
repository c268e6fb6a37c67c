"""treeloom: file-tree snapshots of many roots at once, as Spark DataFrame operators.

A *root* is a key column (one repository or document set), a walk is a table of
files, a snapshot is an ordered aggregation per root, a blueprint is a table of
nodes. Every operator is a ``DataFrame -> DataFrame`` function usable with
``DataFrame.transform``; column-level building blocks live in
``treeloom.functions``.
"""

__version__ = "0.1.0"
