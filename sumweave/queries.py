"""The library's queries on the tables of a folder, and the SQL that gives the same rows.

A text in SQL runs through the engine here and as it stands elsewhere. Sums of doubles are rounded, as summaries add in another order.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators.dictionary import dictionary, encode
from .operators.explicit import agg_over_join, head_bridge_tail, one_sided
from .operators.paths import count_paths, count_paths_by_start, propagate_frequencies
from .sources.files import edges_from_tsv, parquet, register, write_parquet
from .sources.generate import chain, mixed_pair, modulo, series

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"]
#: A graph from all line items: suppliers and parts as nodes of one kind.
EDGES = "SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem"
#: Line items with nulls in keys, groups and payload.
NULLS = "SELECT nullif(l_orderkey % 40, 7) AS k, nullif(l_returnflag, 'N') AS g, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS v FROM lineitem"

SQL: dict[str, str] = {
    # arguments on one side
    "one_sided_grouped_sum": "SELECT o_orderkey, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "one_sided_grouped_count": "SELECT o_orderkey, count(l_shipdate) AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "one_sided_grouped_count_star": "SELECT o_orderkey, count(*) AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "one_sided_grouped_avg": "SELECT o_orderkey, round(avg(l_quantity), 6) AS a FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "one_sided_grouped_minmax": "SELECT o_orderkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "one_sided_minmax_string": "SELECT l_suppkey, min(p_name) AS lo, max(p_type) AS hi FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey",
    "one_sided_minmax_date": "SELECT o_custkey, min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey",
    "one_sided_multi": "SELECT a.l_partkey AS k, sum(b.l_quantity) AS q, count(*) AS n, count(b.l_tax) AS c, round(avg(b.l_discount), 6) AS a, min(b.l_shipmode) AS lo, max(b.l_quantity) AS hi FROM lineitem a JOIN (SELECT *, l_returnflag AS l_shipmode FROM lineitem) b ON a.l_partkey = b.l_partkey GROUP BY a.l_partkey",
    "one_sided_subset_key": "SELECT a.l_partkey AS k, sum(b.l_quantity) AS q, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey GROUP BY a.l_partkey",
    "one_sided_ungrouped": "SELECT sum(b.l_quantity) AS q, count(*) AS n, max(b.l_returnflag) AS m FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey",
    "one_sided_empty": "SELECT count(*) AS n, count(l_tax) AS c, sum(l_quantity) AS q, round(avg(l_tax), 6) AS a, min(l_tax) AS lo FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey < 0",
    "one_sided_empty_grouped": "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey < 0 GROUP BY o_orderkey",
    "group_by_row_id": "SELECT o_orderkey, o_custkey, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey",
    "integral_sum": "SELECT o_custkey, CAST(sum(l_linenumber) AS BIGINT) AS s, round(avg(l_linenumber), 6) AS a FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey",
    # arguments on both sides
    "mixed_grouped": "SELECT a.l_suppkey AS k, sum(a.l_quantity) AS q, sum(b.l_linenumber + 0.0e0) AS r, count(*) AS n, round(avg(b.l_quantity), 4) AS v, min(a.l_shipdate) AS lo, max(b.l_shipdate) AS hi FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey GROUP BY a.l_suppkey",
    "mixed_composite": "SELECT a.l_partkey AS p, a.l_suppkey AS s, sum(a.l_quantity) AS q, sum(b.l_quantity) AS r, max(CAST(b.l_shipdate AS DATE)) AS d FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey GROUP BY a.l_partkey, a.l_suppkey",
    "mixed_subset_key": "SELECT a.l_partkey AS p, sum(a.l_quantity) AS q, sum(b.l_quantity) AS r, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey GROUP BY a.l_partkey",
    "mixed_second_key": "SELECT b.l_suppkey AS s, sum(a.l_quantity) AS q, sum(b.l_quantity) AS r, min(b.l_returnflag) AS m FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey GROUP BY b.l_suppkey",
    "mixed_ungrouped": "SELECT sum(a.l_quantity) AS q, sum(b.l_quantity) AS r, count(*) AS n, max(a.l_shipdate) AS d, min(b.l_returnflag) AS m FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey",
    "mixed_three_keys": "SELECT a.l_returnflag AS f, count(*) AS n, sum(b.l_quantity) AS q FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_returnflag = b.l_returnflag GROUP BY a.l_returnflag",
    "mixed_nonnumeric": "SELECT a.l_partkey AS k, min(a.l_returnflag) AS f, max(b.l_linestatus) AS s, max(CAST(b.l_shipdate AS DATE)) AS d FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey GROUP BY a.l_partkey",
    "pk_fk": "SELECT c_mktsegment, count(*) AS n, sum(o_custkey + 0.0e0) AS s, min(o_orderdate) AS d FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "group_both_sides": "SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(avg(c_acctbal), 4) AS a, max(o_totalprice) AS m FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment, o_orderpriority",
    # kinds of keys, nulls
    "varchar_key": "SELECT a.l_returnflag AS f, count(*) AS n, sum(a.q) AS s FROM (SELECT l_returnflag, l_quantity AS q FROM lineitem) a JOIN (SELECT l_returnflag FROM lineitem) b ON a.l_returnflag = b.l_returnflag GROUP BY a.l_returnflag",
    "double_key": "SELECT a.l_quantity AS k, count(*) AS n, sum(b.l_linenumber + 0.0e0) AS s FROM lineitem a JOIN lineitem b ON a.l_quantity = b.l_quantity GROUP BY a.l_quantity",
    "date_key": "SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n, sum(l_quantity) AS q FROM orders JOIN lineitem ON CAST(o_orderdate AS DATE) = CAST(l_shipdate AS DATE) GROUP BY CAST(o_orderdate AS DATE)",
    "wide_decimal_key": "SELECT a.k, count(*) AS n, sum(b.l_quantity) AS q FROM (SELECT CAST(o_orderkey AS DECIMAL(38, 0)) AS k FROM orders) a JOIN (SELECT CAST(l_orderkey AS DECIMAL(38, 0)) AS k, l_quantity FROM lineitem) b ON a.k = b.k GROUP BY a.k",
    "different_key_types": "SELECT o_orderkey, count(*) AS n FROM orders JOIN (SELECT CAST(l_orderkey AS INTEGER) AS i FROM lineitem) l ON o_orderkey = i GROUP BY o_orderkey",
    "expression_key": "SELECT o_orderkey % 10 AS k, count(*) AS n, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey % 10 = l_linenumber + 1 GROUP BY o_orderkey % 10",
    "expression_argument": "SELECT o_custkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey",
    "null_key": f"SELECT a.k, count(*) AS n, sum(b.v) AS s, count(b.v) AS c FROM ({NULLS}) a JOIN ({NULLS}) b ON a.k = b.k GROUP BY a.k",
    "null_group": f"SELECT a.g, count(*) AS n, sum(b.v) AS s FROM ({NULLS}) a JOIN ({NULLS}) b ON a.k = b.k GROUP BY a.g",
    "null_payload": "SELECT o_orderkey, sum(v) AS s, round(avg(v), 6) AS a, count(v) AS c, min(v) AS m FROM orders JOIN (SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE l_quantity END AS v FROM lineitem) l ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "unmatched_build_key": "SELECT o_orderkey, count(*) AS n FROM orders JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) l ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "filter_selects_nothing": "SELECT o_orderkey, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 1000 GROUP BY o_orderkey",
    "comma_join": "SELECT n_name, count(*) AS n, max(c_acctbal) AS m FROM nation, customer WHERE n_nationkey = c_nationkey GROUP BY n_name",
    # three and more relations
    "final_bag_grouped": "SELECT c_custkey, sum(c_nationkey + 0.0e0) AS h, sum(l_quantity) AS t, max(CAST(l_shipdate AS DATE)) AS d FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_custkey",
    "final_bag_ungrouped": "SELECT sum(c_nationkey + 0.0e0) AS h, sum(l_quantity) AS t, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey",
    "final_bag_head_minmax": "SELECT c_custkey, min(c_name) AS lo, max(c_acctbal) AS hi, sum(l_quantity) AS t FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_custkey",
    "bridge_argument": "SELECT c_custkey, max(o_totalprice) AS b, count(o_orderstatus) AS c, sum(l_quantity) AS t FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_custkey",
    "tail_label": "SELECT p_brand, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "chain5_grouped_region": "SELECT r_name, count(*) AS n, sum(l_quantity) AS q, max(o_totalprice) AS m FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY r_name",
    "star": "SELECT n_name, p_brand, count(*) AS n, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, p_brand",
    "many_to_many_tree": "SELECT a.l_suppkey AS k, count(*) AS n, sum(b.l_quantity) AS q, sum(o_shippriority + 0.0e0) AS p FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey JOIN (SELECT o_orderkey, o_custkey % 3 AS o_shippriority FROM orders) o ON b.l_orderkey = o_orderkey GROUP BY a.l_suppkey",
    # around the aggregate
    "having_order_limit": "SELECT o_custkey, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey HAVING count(*) > 20 ORDER BY q DESC, o_custkey LIMIT 25",
    "aggregate_in_subquery": "SELECT n_name, count(*) AS n, sum(q) AS q FROM (SELECT o_custkey, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey) t JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "aggregate_expression": "SELECT o_custkey, round(sum(l_quantity) / count(*) + max(l_linenumber), 6) AS x, CASE WHEN count(*) > 10 THEN 'many' ELSE 'few' END AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey",
    "decimal_sum": "SELECT a.l_partkey AS k, sum(CAST(b.l_extendedprice AS DECIMAL(12, 2))) AS s, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey GROUP BY a.l_partkey",
    "float_sum": "SELECT o_custkey, round(sum(CAST(l_quantity AS FLOAT)), 4) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey",
    "semi_below_join": "SELECT n_name, count(*) AS n, max(c_acctbal) AS m FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY n_name",
    "outer_below_join": "SELECT n_name, count(*) AS n, sum(q) AS q FROM nation JOIN (SELECT c_nationkey, o_orderkey % 7 + 0.0e0 AS q FROM customer LEFT JOIN orders ON o_custkey = c_custkey) t ON n_nationkey = c_nationkey GROUP BY n_name",
    "filter_by_scalar": "SELECT o_custkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey HAVING count(*) > (SELECT count(*) / 15000e0 FROM orders JOIN lineitem ON o_orderkey = l_orderkey)",
    "scalar_subquery": "SELECT (SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey) AS n, (SELECT max(l_quantity) FROM lineitem) AS m",
    "union_of_aggregates": "SELECT 'p' AS t, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey UNION ALL SELECT 's' AS t, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey",
    "string_functions": "SELECT concat(lpad(CAST(l_suppkey AS VARCHAR(10)), 5, '0'), repeat('x', 2)) AS k, count(*) AS n, sum(s_suppkey % 7 + 0.0e0) AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY concat(lpad(CAST(l_suppkey AS VARCHAR(10)), 5, '0'), repeat('x', 2))",
    "case_coalesce": "SELECT coalesce(nullif(o_orderstatus, 'F'), 'none') AS s, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END + 0.0e0) AS big FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY coalesce(nullif(o_orderstatus, 'F'), 'none')",
    "math_functions": "SELECT o_custkey, round(sum(power(abs(l_discount - 0.5e0), 2)), 6) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey",
    # paths and staged queries
    **{
        f"path_count_{k}": f"WITH e AS ({EDGES}) SELECT count(*) AS n FROM e e0 " + " ".join(f"JOIN e e{i} ON e{i - 1}.dst = e{i}.src" for i in range(1, k))
        for k in (2, 3)
    },
    "cte_freqprop": f"WITH e AS ({EDGES}), s1 AS (SELECT dst AS k, count(*) AS f FROM e GROUP BY dst), s2 AS (SELECT e.dst AS k, CAST(sum(s1.f) AS BIGINT) AS f FROM e JOIN s1 ON e.src = s1.k GROUP BY e.dst), s3 AS (SELECT e.dst AS k, CAST(sum(s2.f) AS BIGINT) AS f FROM e JOIN s2 ON e.src = s2.k GROUP BY e.dst) SELECT CAST(sum(f) AS BIGINT) AS n FROM s3",
    "cte_chain_grouped": "WITH a AS (SELECT o_custkey AS c, count(*) AS f FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey), b AS (SELECT c_nationkey AS n, CAST(sum(f) AS BIGINT) AS f FROM a JOIN customer ON c = c_custkey GROUP BY c_nationkey) SELECT n_name, CAST(sum(f) AS BIGINT) AS f FROM b JOIN nation ON n = n_nationkey GROUP BY n_name",
    # other tables
    "events_by_user": "SELECT a.user_id, count(*) AS n, min(a.event_type) AS t, max(b.ts) AS m FROM events a JOIN events b ON a.user_id = b.user_id GROUP BY a.user_id",
    "docs_labels": "SELECT lang, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS t, max(n_chars) AS m FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY lang",
    # left to plain Spark
    "distinct_bails": "SELECT o_custkey, count(DISTINCT l_suppkey) AS d, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey",
    "filter_bails": "SELECT o_custkey, count(*) FILTER (WHERE l_quantity > 10) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey",
    "outer_bails": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "semi_bails": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_mktsegment",
    "theta_bails": "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey < n_regionkey GROUP BY r_name",
    "cross_side_bails": "SELECT o_orderstatus, round(sum(o_custkey * l_quantity), 0) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus",
    "rollup_bails": "SELECT o_orderstatus, l_returnflag, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ROLLUP (o_orderstatus, l_returnflag)",
    "cycle_bails": "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey JOIN lineitem c ON b.l_partkey = c.l_partkey AND c.l_suppkey = a.l_suppkey",
    "stddev_bails": "SELECT o_orderstatus, round(stddev_samp(l_quantity), 6) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus",
    "window_function": "SELECT o_custkey, q, row_number() OVER (ORDER BY q DESC, o_custkey) AS r FROM (SELECT o_custkey, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey HAVING sum(l_quantity) > 1000) t",
}


def _sql(text: str, policy: str = "always") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, [t for t in TABLES if re.search(rf"\b{t}\b", text)])
        return Engine(spark, policy).sql(text)

    return run


def _steps(k: int, last: str) -> str:
    """Walks of k edges by their start, from the end backwards; direct joins of whole tables would take too long."""
    steps = [f"p{k} AS (SELECT src, sum(f) AS n FROM s GROUP BY src)", *(f"p{i} AS (SELECT s.src, sum(f * n) AS n FROM s JOIN p{i + 1} ON s.dst = p{i + 1}.src GROUP BY s.src)" for i in range(k - 1, 0, -1))]
    return f"WITH e AS ({EDGES}), s AS (SELECT src, dst, count(*) AS f FROM e GROUP BY src, dst), {', '.join(steps)} {last}"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["lineitem"])
    return spark.sql(EDGES)


def _paths(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Walks of k edges as BIGINT, as in the SQL. A number that no BIGINT holds, for which the SQL is an error, is given whole as DECIMAL(38, 0):
    the walks are counted at once, as the type follows from their number."""
    n = int(count_paths(_edges(spark, sf_dir), k, wide=True).first()["n"])
    return spark.sql(f"SELECT CAST('{n}' AS {'BIGINT' if n < 2**63 else 'DECIMAL(38, 0)'}) AS n")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    return agg_over_join({"o": o, "l": li}, [("o.o_orderkey", "l.l_orderkey")], {"c": "o.o_custkey"}, {"q": ("sum", "l.l_quantity"), "n": ("count", None), "m": ("max", "o.o_totalprice")}, unique={"o": [["o_orderkey"]]})


def _one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    return one_sided(li, li, ["l_partkey", "l_suppkey"], ["l_suppkey"], {"q": ("sum", "l_quantity"), "n": ("count", None)})


def _head_bridge_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li = (_table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    c, o, li = c.withColumnRenamed("c_custkey", "x"), o.withColumnsRenamed({"o_custkey": "x", "o_orderkey": "y"}), li.withColumnRenamed("l_orderkey", "y")
    return head_bridge_tail(c, o, li, "x", "y", {"lo": ("min", "head.c_name"), "b": ("max", "bridge.o_totalprice"), "t": ("sum", "tail.l_quantity")})


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    o = _table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "o_orderkey")
    ids = dictionary([c, o], "c_mktsegment")
    ids = ids.checkpoint() if spark.sparkContext.getCheckpointDir() else ids.sort("c_mktsegment").coalesce(1)
    a, b = encode(c, "c_mktsegment", ids), encode(o, "c_mktsegment", ids)
    out = agg_over_join({"a": a, "b": b}, [("a.id", "b.id")], ["a.id"], {"n": ("count", None), "m": ("max", "b.o_orderkey")})
    return out.join(ids, "id").select("c_mktsegment", "n", "m")


def _generated_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = mixed_pair(spark, 20_000, 500)
    return agg_over_join({"l": left, "r": right}, [("l.x", "r.x")], {"x": "l.x"}, {"n": ("count", None), "lo": ("min", "r.label"), "hi": ("max", "r.d")})


def _generated_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, b, t = chain(spark, 5_000, 200, 150)
    return head_bridge_tail(h, b, t, "x", "y", {"n": ("count", None), "d": ("max", "tail.d")})


def _generated_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few keys hold most rows: key k of 0 to 99 has 20,000 / (k + 1) rows, rounded down."""
    a = series(spark, 100, k=F.col("i") - 1).select("k", F.explode(F.sequence(F.lit(1), F.floor(F.lit(20_000) / (F.col("k") + 1)).cast("int"))).alias("v")).withColumn("v", F.col("v").cast("bigint"))
    return agg_over_join({"a": a, "b": a}, [("a.k", "b.k")], ["a.k"], {"n": ("count", None), "s": ("sum", "b.v")})


def _from_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph written as an edge list, read back, and walked."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:  # no shared folder is named: the list stays in the plan
        return count_paths(_edges(spark, sf_dir), 2)
    path = f"{folder}/edges-{uuid.uuid4().hex}"
    _edges(spark, sf_dir).select("src", "dst").write.csv(path, sep="\t")
    return count_paths(edges_from_tsv(spark, path), 2)


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result written as Parquet and read back."""
    out = agg_over_join({"o": _table(spark, sf_dir, "orders"), "l": _table(spark, sf_dir, "lineitem")}, [("o.o_orderkey", "l.l_orderkey")], ["o.o_custkey"], {"q": ("sum", "l.l_quantity")})
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        return out
    path = f"{folder}/sums-{uuid.uuid4().hex}"
    write_parquet(out, path)
    return parquet(spark, path)


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join that makes no more rows than it reads: the cost policy leaves it."""
    a = series(spark, 5_000, x=F.col("i") * 7, v=modulo(10))
    a.createOrReplaceTempView("sparse_rows")
    e = Engine(spark, "cost")
    out = e.sql("SELECT a.x, sum(b.v) AS s FROM sparse_rows a JOIN sparse_rows b ON a.x = b.x GROUP BY a.x")
    return out.withColumn("rewritten", F.lit(e.decisions[0].rewritten))


OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "explicit_api": (_explicit, "SELECT o_custkey AS c, sum(l_quantity) AS q, count(*) AS n, max(o_totalprice) AS m FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey"),
    "explicit_one_sided": (_one_sided, "SELECT a.l_suppkey, sum(a.l_quantity) AS q, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey GROUP BY a.l_suppkey"),
    "explicit_head_bridge_tail": (_head_bridge_tail, "SELECT c_custkey AS x, min(c_name) AS lo, max(o_totalprice) AS b, sum(l_quantity) AS t FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_custkey"),
    "paths_4_api": (lambda s, d: count_paths(_edges(s, d), 4), _steps(4, "SELECT CAST(sum(n) AS BIGINT) AS n FROM p1")),
    "paths_6_by_start": (lambda s, d: count_paths_by_start(_edges(s, d), 6), _steps(6, "SELECT src, CAST(n AS BIGINT) AS n FROM p1")),
    **{f"path_count_{k}": (lambda s, d, k=k: _paths(s, d, k), _steps(k, "SELECT CAST(sum(n) AS BIGINT) AS n FROM p1")) for k in (7, 8, 9)},
    "staged_frequencies": (lambda s, d: propagate_frequencies([(_edges(s, d), "src", "dst")] * 3), f"WITH e AS ({EDGES}), a AS (SELECT dst AS k, count(*) AS f FROM e GROUP BY dst), b AS (SELECT e.dst AS k, sum(f) AS f FROM e JOIN a ON e.src = a.k GROUP BY e.dst) SELECT e.dst AS key, CAST(sum(f) AS BIGINT) AS freq FROM e JOIN b ON e.src = b.k GROUP BY e.dst"),
    "dictionary_encoded_join": (_encoded, "SELECT a.c_mktsegment, count(*) AS n, max(o_orderkey) AS m FROM customer a JOIN (SELECT c_mktsegment, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey) b ON a.c_mktsegment = b.c_mktsegment GROUP BY a.c_mktsegment"),
    "generated_mixed": (_generated_mixed, "WITH l AS (SELECT i % 500 AS x FROM range(1, 20001) t(i)), r AS (SELECT i % 500 AS x, 'v' || lpad(CAST(i % 10 AS VARCHAR), 2, '0') AS label, CAST(DATE '2000-01-01' + CAST(i % 10 AS INTEGER) AS DATE) AS d FROM range(1, 20001) t(i)) SELECT l.x, count(*) AS n, min(label) AS lo, max(d) AS hi FROM l JOIN r ON l.x = r.x GROUP BY l.x"),
    "generated_chain": (_generated_chain, "WITH h AS (SELECT i % 200 AS x FROM range(1, 5001) t(i)), b AS (SELECT i % 200 AS x, i % 150 AS y FROM range(1, 5001) t(i)), t AS (SELECT i % 150 AS y, CAST(DATE '2020-01-01' + CAST(i % 365 AS INTEGER) AS DATE) AS d FROM range(1, 5001) t(i)) SELECT h.x, count(*) AS n, max(t.d) AS d FROM h JOIN b ON h.x = b.x JOIN t ON b.y = t.y GROUP BY h.x"),
    "generated_skew": (_generated_skew, "WITH a AS (SELECT i - 1 AS k, unnest(range(1, CAST(floor(20000 / i) AS BIGINT) + 1)) AS v FROM range(1, 101) t(i)), s AS (SELECT k, count(*) AS c, sum(v) AS s FROM a GROUP BY k) SELECT k, CAST(c * c AS BIGINT) AS n, CAST(c * s AS BIGINT) AS s FROM s"),
    "edge_list_paths": (_from_tsv, _steps(2, "SELECT CAST(sum(n) AS BIGINT) AS n FROM p1")),
    "written_sums": (_written, "SELECT o_custkey, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey"),
    "sparse_cost_policy": (_sparse, "SELECT i * 7 AS x, CAST(i % 10 AS BIGINT) AS s, false AS rewritten FROM range(1, 5001) t(i)"),
}

SQL_AS_CHOSEN = ("one_sided_grouped_sum", "one_sided_multi", "mixed_grouped", "mixed_ungrouped", "final_bag_grouped", "chain5_grouped_region", "many_to_many_tree", "aggregate_in_subquery", "scalar_subquery", "union_of_aggregates", "cte_chain_grouped", "null_key", "events_by_user")
#: The same texts as the default policy and the size policy leave or rewrite them.
OTHERS |= {f"{k}_by_cost": (_sql(SQL[k], "cost"), SQL[k]) for k in SQL_AS_CHOSEN}
OTHERS |= {f"{k}_by_size": (_sql(SQL[k], "reference"), SQL[k]) for k in ("mixed_grouped", "mixed_nonnumeric", "final_bag_grouped", "events_by_user")}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _sql(v) for k, v in SQL.items()} | {k: f for k, (f, _) in OTHERS.items()}
ORACLES: dict[str, str] = SQL | {k: s for k, (_, s) in OTHERS.items()}
