"""Readers and writers for the formats that the queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EDGES = "src bigint, dst bigint"


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def edges_from_tsv(spark: SparkSession, path: str, schema: str = EDGES, comment: str = "#") -> DataFrame:
    """A graph's edge list: tab-separated numbers with comment lines. The schema is declared, so the file is read once."""
    return spark.read.csv(path, sep="\t", schema=schema, comment=comment, mode="FAILFAST")


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def discard(df: DataFrame) -> None:
    """Runs df and keeps nothing, for timing."""
    df.write.format("noop").mode("overwrite").save()


def register(spark: SparkSession, folder: str, tables: list[str]) -> None:
    """A view for each table of a folder of Parquet files."""
    for t in tables:
        spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(t)
