"""finfacts: financial-statement analytics as Spark DataFrame operators.

Every operator takes a DataFrame (plus ``keys``, the grouping that tells one
series from another) and returns a lazy DataFrame; every scalar function is a
``Column`` factory.  Nothing in the package starts a job on its own unless its
docstring says so.
"""

__version__ = "0.1.0"
