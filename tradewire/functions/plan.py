"""A way to keep the optimizer from copying a costly expression into every place that reads it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once for each row.

    Projections are merged, and an expression that a lambda reads would be evaluated for every item. A generator over one
    struct is not merged; it neither shuffles nor copies rows.
    """
    kept = [f"`{c}`" for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
