"""Walks in numbers that no BIGINT holds, in the result and on the way."""

import duckdb
import pytest

from sumweave.operators.paths import count_paths, count_paths_by_start
from sumweave.queries import ORACLES, QUERIES


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.ansi.enabled", before)


def loops(spark, n):
    return spark.range(n, numPartitions=2).selectExpr("1L AS src", "1L AS dst")


@pytest.mark.parametrize("n", [100, 128, 200])  # 128 ** 9 is 2 ** 63
def test_query_counts_what_no_bigint_holds(spark, tmp_path, ansi, n):
    loops(spark, n).selectExpr("src AS l_suppkey", "dst AS l_partkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES["path_count_9"](spark, str(tmp_path))
    assert [int(r["n"]) for r in found.collect()] == [n**9]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    if n**9 < 2**63:
        assert con.execute(ORACLES["path_count_9"]).fetchall() == [(n**9,)]
    else:
        with pytest.raises(duckdb.ConversionException):
            con.execute(ORACLES["path_count_9"]).fetchall()
    assert found.schema.simpleString() == ("struct<n:bigint>" if n**9 < 2**63 else "struct<n:decimal(38,0)>")


def test_counts_on_the_way_may_be_wider_than_the_result(spark, ansi):
    layers = spark.range(8 * 300, numPartitions=2).selectExpr("id % 8 AS src", "id % 8 + 1 AS dst")  # 300 ** 8 walks of 8 edges, none of 9
    assert count_paths(layers, 9).first()["n"] == 0
    assert count_paths_by_start(layers, 9).collect() == []
    assert [tuple(map(int, r)) for r in count_paths_by_start(layers, 8, wide=True).collect()] == [(0, 300**8)]


def test_what_does_not_fit_is_an_error(spark, ansi):
    with pytest.raises(Exception, match=f"{200**9} rows are more than a BIGINT can count"):
        count_paths(loops(spark, 200), 9).collect()
    assert count_paths(loops(spark, 100), 9).schema.simpleString() == "struct<n:bigint>"
    for count in (count_paths, count_paths_by_start):
        with pytest.raises(Exception, match="38 digits|NUMERIC_VALUE_OUT_OF_RANGE|overflow"):
            count(loops(spark, 20_000), 9, wide=True).collect()  # 5.12e38
