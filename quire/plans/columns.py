"""Columns that a plan works out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.staging import fresh


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once a row.

    A projection would be merged with those above it, and a lambda would work out the array
    that it looks into anew for each element; a generator of one row stands between.
    """
    row = fresh(df.columns, "_settled")
    one = df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias(row))
    return one.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(row)[k].alias(k) for k in columns])
