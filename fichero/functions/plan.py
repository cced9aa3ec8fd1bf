"""Plan shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def evaluated_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and projections read instead of repeating it.

    Catalyst pushes a filter on a computed column below its projection and so computes it twice. It
    does not push one below a generator, and ``explode_outer`` of a one-element array is just that:
    no shuffle, one row out per row in.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode_outer(F.array(value)).alias(name))
