"""Path counts in a graph given as an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumweave.functions import algebra as A

from .explicit import agg_over_join


def count_paths(edges: DataFrame, length: int, source: str = "src", target: str = "dst", alias: str = "n", wide: bool = False) -> DataFrame:
    """One row: walks of `length` edges, repeated edges counted repeatedly. Equals the self-join of the edges along a chain; costs one
    aggregate by node for each step. Counts on the way have up to 38 digits. The result is BIGINT, an error if it doesn't fit; wide: DECIMAL(38, 0)."""
    return _walks(edges, length, source, target, alias, {}, wide)


def count_paths_by_start(edges: DataFrame, length: int, source: str = "src", target: str = "dst", alias: str = "n", wide: bool = False) -> DataFrame:
    """(source, n) for every node where a walk begins."""
    return _walks(edges, length, source, target, alias, {source: f"e0.{source}"}, wide)


def _walks(edges: DataFrame, length: int, source: str, target: str, alias: str, group_by: dict[str, str], wide: bool) -> DataFrame:
    relations = {f"e{k}": edges for k in range(length)}
    on = [(f"e{k}.{target}", f"e{k + 1}.{source}") for k in range(length - 1)]
    out = agg_over_join(relations, on, group_by, {alias: ("count", None)}, root="e0", wide=True)
    return out if wide else out.withColumn(alias, A.narrow(F.col(f"`{alias}`")))


def propagate_frequencies(steps: list[tuple[DataFrame, str, str]], alias: str = "freq") -> DataFrame:
    """(key, freq): frequencies carried by hand along relations (df, from, to), as staged queries do; each step sums by its end."""
    df, start, end = steps[0]
    out = df.groupBy(F.col(end).alias("_k")).agg(F.count(F.lit(1)).alias("_f"))
    for df, start, end in steps[1:]:
        out = df.join(out, F.col(start) == F.col("_k")).groupBy(F.col(end).alias("_to")).agg(F.sum("_f").alias("_f")).withColumnRenamed("_to", "_k")
    return out.select(F.col("_k").alias("key"), F.col("_f").alias(alias))
