"""Surrogate ids for long keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dictionary(frames: list[DataFrame], column: str) -> DataFrame:
    """(column, id): a distinct id for each non-null value in any of the frames.

    Ids are unique but not dense: the partition in the upper bits, so no task sees all values. Give the result a checkpoint
    or a table before it is used more than once, as ids depend on how the values were dealt out.
    """
    values = reduce(DataFrame.unionByName, (f.select(column) for f in frames)).where(F.col(column).isNotNull()).distinct()
    return values.select(column, F.monotonically_increasing_id().alias("id"))


def encode(df: DataFrame, column: str, ids: DataFrame, alias: str = "id") -> DataFrame:
    """df with the id in place of the column; rows with null keep a null id."""
    return df.join(ids.select(F.col(column).alias("_v"), F.col("id").alias(alias)), F.col(column) == F.col("_v"), "left").drop("_v", column)
