"""The widened queries read every line item."""

import re

import pytest

from sumweave import queries


def test_no_query_reads_part_of_a_table():
    for k, text in queries.ORACLES.items():
        if not k.startswith("one_sided_empty"):  # empty inputs are what these two are about
            assert not re.search(r"(o|l)_orderkey < |% 50\b|l_linenumber = 1\b|src < 10", text), k


@pytest.mark.parametrize("name", ["null_key", "double_key"])
def test_every_line_item_counts(spark, name):
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_quantity").collect()]
    keys = [None if k % 40 == 7 else k % 40 for k, _ in items] if name == "null_key" else [float(q) for _, q in items]
    want = {k: keys.count(k) ** 2 for k in set(keys) if k is not None}
    assert {r["k"]: r["n"] for r in queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()} == want
