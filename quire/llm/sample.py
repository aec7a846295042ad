"""A bounded sample of labelled rows, chosen by a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 7


def row_key(*columns: str) -> Column:
    """A hash of these columns, by which rows are chosen; rows that agree in all of them have one key."""
    return F.xxhash64(F.lit(SEED), *[F.col(c).cast("string") for c in columns])


def least_keys(rows: DataFrame, class_col: str, key_col: str, per_class: int) -> dict:
    """For each class the per_class least keys of its rows; rows are narrow (class and key) and cut in each task before any shuffle."""
    by = Window.partitionBy(class_col).orderBy(key_col)
    picked = rows.select(class_col, key_col).withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= per_class)
    found: dict = {}
    for r in picked.collect():
        found.setdefault(r[0], set()).add(r[1])
    return found


def rows_of(rows: DataFrame, key_col: str, keys) -> DataFrame:
    """One row for each key of a bounded set."""
    return rows.filter(F.col(key_col).isin(sorted(keys)) if keys else F.lit(False)).dropDuplicates([key_col])
