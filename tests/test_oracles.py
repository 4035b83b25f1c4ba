"""Every query of the library against its SQL on DuckDB."""

import duckdb
import pytest

from sumweave.queries import ORACLES, QUERIES, SQL, TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(data, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert rows(df.collect(), df.columns) == rows(found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(k for k in SQL if k.endswith("_bails")))
def test_left_alone(spark, name):
    from sumweave.engine import Engine
    from sumweave.sources.files import register

    register(spark, FOLDER, TABLES)
    e = Engine(spark, "always")
    e.sql(SQL[name])
    assert all(not d.rewritten and d.reasons for d in e.decisions)


@pytest.mark.parametrize("name", ["one_sided_grouped_sum", "mixed_composite", "final_bag_grouped", "chain5_grouped_region", "aggregate_in_subquery", "path_count_3"])
def test_rewritten_with_same_schema(spark, name):
    from sumweave.engine import Engine
    from sumweave.sources.files import register

    register(spark, FOLDER, TABLES)
    e = Engine(spark, "always")
    df = e.sql(SQL[name])
    assert any(d.rewritten for d in e.decisions)
    direct = spark.sql(SQL[name])
    assert df.schema.simpleString() == direct.schema.simpleString()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan if name == "mixed_composite" else plan.rindex("Aggregate") > plan.index("Join"), "an aggregate below the join, or no join of equal rows"
