"""What several operators share: words, held-out rows, saved intermediates, broadcasts of checked size, components."""

from __future__ import annotations

import ctypes
import re
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Characters that separate words, as a regular expression class and as a string for trimming.
BLANK_CLASS = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
#: Most bytes that may be broadcast, as measured over the whole table.
BROADCAST_BYTES = 32 << 20
#: Rows that a Python worker has as Python objects at once.
ROWS = 500


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bucket_of(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty string."""
    text = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))
    return F.crc32(text) % modulus


def words_of(text: Column) -> Column:
    """Array of the words of a text, in order; empty for null and blank texts."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{BLANK_CLASS}+"))


def windows(items: Column, size: int, combine) -> Column:
    """combine(*elements) for each window of `size` consecutive elements of an array that has at least as many.

    Reads elements by index: slice() would wrap the whole array anew for each window.
    """
    return F.transform(F.sequence(F.lit(0), F.size(items) - size), lambda i: combine(*(F.get(items, i + k) for k in range(size))))


def window_hashes(words: Column, size: int) -> Column:
    """xxhash64 of each window of words, from hashes of the words."""
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: windows(h, size, F.xxhash64))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(column, rows: int = ROWS):
    """The values of an Arrow column as lists of at most so many, so that a worker never has a whole batch as Python objects."""
    for k in range(0, len(column), rows):
        yield column.slice(k, rows).to_pylist()


def give_back() -> None:
    """Returns freed memory of a worker that lives on to the system: idle workers stand beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_key(text: str) -> list[Column]:
    """128 bits x, y that stand for a text, null ones too, where rows cannot be told apart by their ids."""
    return [F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y")]


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named, as in tests, a temporary one, but only if driver and executors
    are one machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    if named is None:
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def save(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: computed once, survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _width(kind: DataType, value: Column) -> Column:
    """Bytes of a value, roughly: its strings' and 8 for anything else of fixed size."""
    if isinstance(kind, StructType):
        return sum((_width(f.dataType, value[f.name]) for f in kind), F.lit(8))
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, (ArrayType, MapType)):
        return F.octet_length(F.to_json(value)) + 8
    return F.lit(8)


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint when its measured bytes, all rows counted, are few; else df, which Spark then joins by shuffling. df should be cheap to read."""
    n = df.agg(F.sum(sum((_width(f.dataType, df[f.name]) for f in df.schema), F.lit(16)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if n <= most else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as rows (a, b).

    Alternates the large-star and small-star steps (Kiveris et al. 2014) until every node hangs on the smallest node of its
    component. Each round is saved, so no plan grows with the rounds and no edge leaves the executors. Returns (node, root)
    for every node that has an edge to another node; root is the smallest node.
    """
    now = save(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = seen
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = save(small.distinct())
