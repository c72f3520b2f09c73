"""Small helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    A filter on a computed column is pushed below it by copying the expression,
    and a generator on it adds more copies. Parsing JSON twice or three times per
    row is too dear, and no predicate is pushed through the output of a generator.
    """
    return df.withColumn(name, F.explode(F.array(value)))
