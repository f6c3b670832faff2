"""Measurement analytics on PySpark DataFrames.

A measurement table is a plain ``DataFrame``: a few category columns (labels used
as group, pivot and merge keys) and many numeric feature columns.  Every operator
is a function ``f(df, ...) -> DataFrame`` that can be chained with
``df.transform``.
"""

__version__ = "0.1.0"
