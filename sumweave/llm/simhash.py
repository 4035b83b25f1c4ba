"""SimHash near-duplicates: fingerprints, a binary trie self-join within a Hamming budget, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, components, give_back, load, save, slices, text_key

SHINGLE = 3
SEED = 42
BUDGET = 3
#: A bucket of more fingerprints than this is split by further bits.
BUCKET = 4096
#: Fingerprints in the buckets that a worker joins together.
VALUES = 200_000
#: Rows for which bits are counted at once, and node pairs that a traversal holds at once.
CHUNK, FRONTIER = 1 << 15, 1 << 18


def fingerprint(text: str | None) -> int:
    """SimHash of a text's word shingles as a signed 64-bit integer; 0 without words. Repeated shingles count repeatedly."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes both concern ASCII alone
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= SHINGLE else iter([b" ".join(words)])
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    digests = map(xxhash.xxh64_digest, shingles, repeat(SEED))
    for _ in range(0, n, CHUNK):
        part = b"".join(d for d, _ in zip(digests, range(CHUNK)))
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t) for part in slices(b.column(1)) for t in part], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])
        give_back()

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def trie_pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values within the budget, for each range [start, end) of ascending distinct uint64 values.

    A range is a binary trie: the node at a depth is the run of values with the same leading bits. Node pairs descend together, bit
    by bit; a pair whose prefixes differ in more bits than the budget is dropped with everything below it, and a pair of two
    leaves is compared at once. All pairs of a level go through numpy together; a wide level is worked off in parts.
    """
    counts: dict[int, np.ndarray] = {}

    def ones(bit: int) -> np.ndarray:
        if bit not in counts:
            counts[bit] = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int32)]).astype(np.int32)
        return counts[bit]

    keep = ends - starts > 1
    s, e = starts[keep].astype(np.int32), ends[keep].astype(np.int32)
    stack = [(63, s, e, s, e, np.zeros(len(s), np.int8))]
    while stack:
        bit, a0, a2, b0, b2, diff = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(bit, a0[half:], a2[half:], b0[half:], b2[half:], diff[half:]), (bit, a0[:half], a2[:half], b0[:half], b2[:half], diff[:half])]
            continue
        leaf = (a2 - a0 == 1) & (b2 - b0 == 1)
        i, j = a0[leaf], b0[leaf]
        near = (np.bitwise_count(values[i] ^ values[j]) <= budget) & (i != j)
        if near.any():
            yield i[near], j[near]
        a0, a2, b0, b2, diff = a0[~leaf], a2[~leaf], b0[~leaf], b2[~leaf], diff[~leaf]
        if not len(a0) or bit < 0:
            continue
        c = ones(bit)
        a1, b1, same = a2 - (c[a2] - c[a0]), b2 - (c[b2] - c[b0]), a0 == b0
        cross = ~same
        parts = [(a0, a1, b0, b1, diff, slice(None)), (a1, a2, b1, b2, diff, slice(None)), (a0, a1, b1, b2, diff + 1, slice(None)), (a1, a2, b0, b1, diff + 1, cross)]
        nxt = [tuple(x[k] for x in (p, q, r, t, d)) for p, q, r, t, d, k in parts]
        p, q, r, t, d = (np.concatenate(x) for x in zip(*nxt, strict=True))
        live = (q > p) & (t > r) & (d <= budget) & ((p != r) | (q - p > 1))
        stack.append((bit - 1, p[live], q[live], r[live], t[live], d[live]))


def _forest(i: np.ndarray, j: np.ndarray, parent: dict[int, int]) -> list[tuple[int, int]]:
    """Of the links those that join two trees so far."""

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        if (rx := root(x)) != (ry := root(y)):
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def _linked(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = b.column(0).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // VALUES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y > x:
                yield _links_of(b.column(0).slice(x, y - x), sizes[x:y], budget)


def _links_of(lists: pa.ListArray, sizes: np.ndarray, budget: int) -> pa.RecordBatch:
    """Links within each of some lists of fingerprints."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum(sizes)
    group = np.repeat(np.arange(len(ends)), sizes)
    values = flat[np.lexsort((flat, group))]
    parent: dict[int, int] = {}
    found = [x for i, j in trie_pairs(values, ends - sizes, ends, budget) for x in _forest(i, j, parent)]
    signed = values.view(np.int64)
    i, j = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(signed[i], pa.int64()), pa.array(signed[j], pa.int64())], ["a", "b"])


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    cuts = [round(k * len(bits) / parts) for k in range(parts + 1)]
    return [bits[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]


def trie_links(fps: DataFrame, budget: int = BUDGET, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints of column fp as all pairs within the budget would.

    Two fingerprints within the budget agree on one of budget + 1 blocks of bits, so buckets by the value of each block hold all
    pairs; every bucket is a trie self-join. A bucket of more than `bucket` fingerprints is split the same way by the bits
    that are left (those that differ are still within the budget), and so on until bits run out, so no task
    gets an unbounded bucket. Only links that join parts of a bucket are returned.
    """
    parts = budget + 1
    paths = [(0, list(range(64)))]  # mask of the agreed bits, bits left
    rows, links = fps.select("fp", F.lit(0).alias("path")), None
    while True:
        children = [(mask | sum(1 << k for k in block), [k for k in left if k not in block]) for mask, left in paths for block in _blocks(left, parts)]
        signed = [m - (1 << 64) if m >> 63 else m for m, _ in children]
        masks = F.array(*(F.lit(m).cast("long") for m in signed))
        ways = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.struct((F.col("path") * parts + k).alias("path"), F.col("fp").bitwiseAND(F.get(masks, F.col("path") * parts + k)).alias("value")))
        keyed = rows.select("fp", F.explode(ways).alias("w")).select("fp", "w.path", "w.value")
        paths = children
        last = min(len(left) for _, left in paths) <= 20  # at most 2 ** 20 distinct values are left in a bucket
        big = None
        if not last:
            big = save(keyed.groupBy("path", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("path", "value"))
            big = big if big.limit(1).count() else None
        small = keyed if big is None else keyed.join(big, ["path", "value"], "left_anti")
        groups = small.groupBy("path", "value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
        new = groups.mapInArrow(lambda batches: _linked(batches, budget), "a long, b long")
        links = new if links is None else links.unionByName(new)
        if big is None:
            return links
        rows = save(keyed.join(big, ["path", "value"], "left_semi").select("fp", "path"))


def _groups(fp: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """From the saved fingerprints of rows (doc_id, fp, ...): nodes (fp, least, n), and (fp, root, least) of those that are linked to others."""
    nodes = save(fp.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(trie_links(nodes.select("fp"), budget))
    return nodes, save(nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp").select("fp", "root", "least"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id) for each row: documents whose SimHash fingerprints differ in at most `budget` bits are linked.

    Equal fingerprints are one node; the trie self-join links nodes (`trie_links`) and components are found on the executors.
    component_id is the smallest doc_id reachable, the document's own included; null ids are passed over unless a component
    has no other. Texts without words, null ones too, have fingerprint 0 and link like others; very long texts are read whole; a bit
    that is set in just half the shingles is 0. Repeated rows stay. An empty table gives an empty result; further columns are
    ignored, whatever their names.
    """
    fp = save(fingerprints(docs, doc_id, text))
    nodes, member = _groups(fp, budget)
    least = member.groupBy("root").agg(F.min("least").alias("component"))
    linked = member.join(least, "root").select("fp", "component")
    alone = nodes.where("n > 1").join(member.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component"))
    known = linked.unionByName(alone)
    return fp.join(broadcast_if_small(save(known)), "fp", "left").select("doc_id", "fp", F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: of those with the smallest id, null ids after all others, one.

    Ids may repeat or be null: a row is known by its id and 128 bits of its text, and rows are in one group only if their fingerprints are. Only the keys of
    rows that go, and of rows that occur several times, meet the table again, by broadcast if their bytes are few. Texts without words, null
    ones too, have fingerprint 0 and are one group; very long texts are read whole; all columns stay as they are, whatever their names;
    an empty table gives an empty result.
    """
    rows = docs.select(F.struct("doc_id", *text_key("text")).alias("id"), F.struct("*").alias("row"))  # the row's own names can't clash with others
    fp = save(fingerprints(rows.select("id", F.col("row.text").alias("text")), "id"))
    _, member = _groups(fp, BUDGET)
    same = fp.groupBy("fp", "doc_id").agg(F.count(F.lit(1)).alias("times")).join(member.select("fp", "root"), "fp", "left")
    same = save(same.select(F.coalesce("root", "fp").alias("root"), F.col("doc_id").alias("key"), "times"))
    order = F.struct(F.col("key.doc_id").isNull().alias("no_id"), F.col("key"))
    first = same.groupBy("root").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("root").alias("of"), F.col("f.key").alias("first"))
    gone = save(same.join(first, F.expr("root = of and not (key <=> first)")).select("key"))
    often = save(same.where("times > 1").join(gone.withColumnRenamed("key", "_gone"), F.expr("key <=> _gone"), "left_anti").select("key"))
    kept = rows.join(broadcast_if_small(gone), F.expr("id <=> key"), "left_anti")
    if not often.limit(1).count():
        return kept.select("row.*")
    once = kept.join(broadcast_if_small(often), F.expr("id <=> key"), "left_anti")
    more = kept.join(broadcast_if_small(often), F.expr("id <=> key"), "left_semi")
    return once.select("row.*").unionByName(more.groupBy("id").agg(F.min("row").alias("row")).select("row.*"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
