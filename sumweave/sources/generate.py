"""Seeded tables of the shapes that the benchmarks use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def series(spark: SparkSession, n: int, **columns: Column) -> DataFrame:
    """Columns over i = 1..n."""
    return spark.range(1, n + 1).withColumnRenamed("id", "i").select(*(c.alias(k) for k, c in columns.items()))


def modulo(m: int) -> Column:
    return F.col("i") % m


def uniform(seed: int, low: float = 0.0, high: float = 100.0) -> Column:
    """Numbers that depend on i and the seed alone, however the rows are dealt out."""
    return F.lit(low) + (F.xxhash64(F.lit(seed), F.col("i")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))) * (high - low)


def skewed(seed: int, keys: int, power: float = 3.0) -> Column:
    return F.floor(F.pow(uniform(seed, 0.0, 1.0), F.lit(power)) * keys).cast("bigint")


def label(prefix: str, m: int, width: int = 2) -> Column:
    return F.concat(F.lit(prefix), F.lpad((F.col("i") % m).cast("string"), width, "0"))


def mixed_pair(spark: SparkSession, rows: int, keys: int) -> tuple[DataFrame, DataFrame]:
    """Two tables (x, rv) and (x, sv, label, d)."""
    left = series(spark, rows, x=modulo(keys), rv=uniform(1))
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("i") % 10).cast("int"))
    return left, series(spark, rows, x=modulo(keys), sv=uniform(2), label=label("v", 10), d=day)


def chain(spark: SparkSession, rows: int, xs: int, ys: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """head (x, rv), bridge (x, y), tail (y, tv, d)."""
    head = series(spark, rows, x=modulo(xs), rv=uniform(1))
    bridge = series(spark, rows, x=modulo(xs), y=modulo(ys))
    return head, bridge, series(spark, rows, y=modulo(ys), tv=uniform(3), d=F.date_add(F.lit("2020-01-01").cast("date"), (F.col("i") % 365).cast("int")))
