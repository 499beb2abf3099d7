"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that filters on them stay above.

    A filter on a plain column is pushed below it and its expression runs in both places, for a
    chain of steps once per path through the chain. Filters on unnested columns are not pushed.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
