"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, let, load, lower_ascii, save, text_key, window_hashes, words_of

SHINGLE = 5
CONTAINMENT = 0.8


def shingles(text: Column, size: Column) -> Column:
    """Distinct word shingles of the lower-cased text; none of a text with fewer words."""

    def of(words: Column) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
        return F.when(F.size(words) >= size, F.array_distinct(all_)).otherwise(F.array().cast("array<string>"))

    return let(words_of(lower_ascii(text)), of)


def _hashes(words: Column, size: int) -> Column:
    return F.when(F.size(words) >= size, F.array_distinct(window_hashes(words, size))).otherwise(F.array().cast("array<bigint>"))


def hashes(text: Column, size: int = SHINGLE) -> Column:
    """Distinct xxhash64 of the shingles, word by word; none of a text with fewer words."""
    return let(words_of(lower_ascii(text)), lambda w: _hashes(w, size))


def sketches(items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """MinHash sketches (item, words, least, hash) of the rows (item, text), partitioned by size.

    An item with fewer than SHINGLE words is one shingle of them all: there is a partition for each such number of `words`, for which
    documents are searched by shingles of that many. Other items are sets of m shingles; one of m falls into the partition of
    sizes [u / 2, u) with u a power of two. A document that holds a share `threshold` of the item misses at most
    m - ceil(threshold * m) of its shingles, so it holds one of any m - ceil(threshold * m) + 1. That number grows with m; each
    partition keeps the bottom-k sketch for its largest size: the k smallest hashes of the item. Searching for them loses no
    document, whatever the document's length. `least` is the fewest shingles of a document that can hold an item of the partition.
    """

    def of(words: Column) -> Column:
        h = F.when(F.size(words) >= SHINGLE, _hashes(words, SHINGLE))
        for n in range(1, SHINGLE):
            h = h.when(F.size(words) == n, _hashes(words, n))
        return F.struct(F.least(F.size(words), F.lit(SHINGLE)).alias("words"), F.sort_array(h).alias("h"))

    m = items.select("item", let(words_of(lower_ascii(F.col("text"))), of).alias("s")).select("item", "s.*").where("words > 0")
    upper = F.pow(2, F.floor(F.log2(F.size("h"))) + 1).cast("int")
    k = (upper - 1) - F.ceil(threshold * (upper - 1) - 1e-9) + 1
    least = F.ceil(threshold * upper / 2 - 1e-9)
    return m.select("item", "words", least.cast("int").alias("least"), F.explode(F.slice(F.col("h"), F.lit(1), k.cast("int"))).alias("hash"))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Items found inside documents: (doc_id, item_id, n_item, n_shared, containment), containment >= threshold.

    Candidates share a hash of an item's size-partitioned MinHash sketch (`sketches`: no pair is lost); they are verified by the
    exact share of the item's distinct word shingles that are in the document, as strings: shingles of five words, or of all the
    words of an item that has fewer. Equal item texts are searched once. Rows are known by id and 128 bits of their text, so rows that
    share an id, or have none, are never tried against each other's items. Keys and hashes are broadcast where their bytes are
    few, texts of items only once each; else Spark shuffles.

    Items and documents without words, null texts too, match nothing; very long texts are read whole; a containment of just the
    threshold counts. Rows with equal (doc_id, item_id) give one row, the best; null ids are matched like others; empty tables
    give no rows; further columns are ignored, whatever their names.
    """
    d = docs.select(F.struct(F.col(doc_id).alias("id"), *text_key(text)).alias("doc"), F.col(text).alias("text"))
    i = save(items.select(F.col(item_id).alias("item_id"), F.struct(*text_key(item_text)).alias("item"), F.col(item_text).alias("text")))
    texts = save(i.groupBy("item").agg(F.min("text").alias("item_text")))
    sketch = save(sketches(texts.select("item", F.col("item_text").alias("text")), threshold))
    found = None
    for n in sorted(r[0] for r in sketch.select("words").distinct().collect()) or [SHINGLE]:  # SHINGLE numbers at most
        part = sketch.where(F.col("words") == n).select("item", "words", "least", "hash")
        hit = d.select("doc", hashes(F.col("text"), n).alias("h")).select("doc", F.size("h").alias("n"), F.explode("h").alias("hash"))
        hit = hit.join(broadcast_if_small(part), "hash").where("n >= least").select("doc", "item", "words")
        found = hit if found is None else found.unionByName(hit)
    found = save(found.distinct())
    pairs = d.join(broadcast_if_small(found.withColumnRenamed("doc", "_doc")), F.expr("doc <=> _doc")).select("doc", "item", "words", "text")
    pairs = pairs.join(broadcast_if_small(texts), "item")
    pairs = pairs.select("doc", "item", F.array(shingles(F.col("item_text"), F.col("words")), shingles(F.col("text"), F.col("words"))).alias("s"))
    pairs = pairs.select("doc", "item", F.size(F.col("s")[0]).alias("n_item"), F.size(F.array_intersect(F.col("s")[0], F.col("s")[1])).alias("n_shared"))
    pairs = pairs.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= threshold)
    best = F.max(F.struct("containment", "n_shared", "n_item")).alias("b")
    ids = i.select("item_id", F.col("item").alias("_item")).distinct()
    pairs = pairs.join(broadcast_if_small(ids), F.expr("item = _item"))
    return pairs.groupBy(F.col("doc.id").alias("doc_id"), "item_id").agg(best).select("doc_id", "item_id", "b.n_item", "b.n_shared", "b.containment")


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, each_row: bool = False) -> DataFrame:
    """The rows of docs whose id has no item inside; with each_row, whose own text has none, whatever other rows with the id hold.

    Null, empty and very long texts as in `contained_items`; repeated rows stay or go together; all columns stay, whatever their names; without
    items or rows nothing goes.
    """
    key = F.struct(*text_key("text")) if each_row else F.col("doc_id")
    rows = docs.select(key.alias("id"), F.struct("*").alias("row"))  # the row's own names can't clash with others
    leaks = save(contained_items(rows.select("id", F.col("row.text").alias("text")), items, threshold, doc_id="id").select(F.col("doc_id").alias("leak")).distinct())
    return rows.join(broadcast_if_small(leaks), F.expr("id <=> leak"), "left_anti").select("row.*")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+') AS w FROM benchmark),
z AS (SELECT DISTINCT least(len(w), 5) AS z FROM i WHERE w <> ['']),
ds AS (SELECT DISTINCT doc_id, z, array_to_string(list_slice(w, k, k + z - 1), ' ') AS s FROM (SELECT doc_id, w, z FROM d, z WHERE w <> [''] AND len(w) >= z) e, LATERAL (SELECT unnest(range(1, len(w) - z + 2)) AS k)),
s AS (SELECT DISTINCT item_id, z, array_to_string(list_slice(w, k, k + z - 1), ' ') AS s FROM (SELECT item_id, w, least(len(w), 5) AS z FROM i WHERE w <> ['']) e, LATERAL (SELECT unnest(range(1, len(w) - z + 2)) AS k)),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id)
SELECT doc_id, item_id, CAST(any_value(n.n) AS INTEGER) AS n_item, CAST(count(*) AS INTEGER) AS n_shared, count(*) / any_value(n.n)::DOUBLE AS containment
FROM ds JOIN s USING (z, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / any_value(n.n)::DOUBLE >= 0.8
"""
