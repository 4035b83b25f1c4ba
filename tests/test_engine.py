"""The engine's policies without a pass over the data, and what it leaves alone whatever goes wrong."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sumweave import engine as engines
from sumweave.engine import Engine
from sumweave.operators.explicit import agg_over_join
from sumweave.plans import policy

SELF = "SELECT a.k, sum(b.v) AS s, count(*) AS n FROM {0} a JOIN {0} b ON a.k = b.k GROUP BY a.k"


def jobs_of(spark, run):
    group = f"g{datetime.datetime.now().timestamp()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_no_job_where_the_catalog_has_statistics(spark):
    spark.range(40_000).select((F.col("id") % 500).alias("k"), F.col("id").cast("double").alias("v")).write.mode("overwrite").saveAsTable("known")
    spark.sql("ANALYZE TABLE known COMPUTE STATISTICS FOR ALL COLUMNS")
    try:
        e = Engine(spark, "cost")
        assert jobs_of(spark, lambda: e.sql(SELF.format("known"))) == 0
        (d,) = e.decisions
        assert d.rewritten and d.estimate["inputs"] == {"r0": 40_000, "r1": 40_000} and 2e6 < d.estimate["joined"] < 5e6
    finally:
        spark.sql("DROP TABLE known")


@pytest.mark.parametrize(("keys", "filtered"), [(50, ""), (5000, ""), (200_000, ""), (50, " WHERE k % 4 = 0")])
def test_samples_are_bounded_and_near(spark, tmp_path, monkeypatch, keys, filtered):
    monkeypatch.setattr(policy, "SAMPLE", 10_000)
    n = 200_000
    spark.range(n, numPartitions=4).select((F.xxhash64("id") % keys).alias("h"), F.col("id").cast("double").alias("v")).selectExpr("abs(h) AS k", "v").write.parquet(f"{tmp_path}/t{keys}")
    spark.read.parquet(f"{tmp_path}/t{keys}").createOrReplaceTempView("sampled")
    e = Engine(spark, "cost")
    e.sql(SELF.format(f"(SELECT * FROM sampled{filtered})"))
    (d,) = e.decisions
    rows = n // (4 if filtered else 1)
    assert d.estimate["inputs"]["r0"] == pytest.approx(rows, rel=0.2)
    assert d.rewritten == (keys < 200_000)
    if keys <= 5000:
        assert d.estimate["joined"] == pytest.approx(rows * n / keys, rel=0.5)


def test_small_tables_are_known_exactly(spark):
    spark.createDataFrame([(k % 10, float(k)) for k in range(100)], "k int, v double").createOrReplaceTempView("small")
    e = Engine(spark, "cost")
    e.sql(SELF.format("small"))
    assert e.decisions[0].estimate == {"inputs": {"r0": 100, "r1": 100}, "joined": 1000.0}
    assert e.counters() == {"rewritten: one-sided, by key": 1}


@pytest.mark.parametrize("chosen", ["cost", "always", "reference"])
def test_streams_are_left_alone(spark, tmp_path, chosen):
    spark.range(10).selectExpr("id % 3 AS k", "id AS v").write.parquet(f"{tmp_path}/s")
    stream = spark.readStream.schema("k bigint, v bigint").parquet(f"{tmp_path}/s")
    static = spark.range(3).withColumnRenamed("id", "j")
    df = stream.join(static, F.col("k") == F.col("j")).groupBy("k").agg(F.sum("v"))
    e = Engine(spark, chosen)
    assert e.optimize(df) is df and "stream" in e.explain()


def test_any_error_leaves_the_plain_plan(spark, monkeypatch):
    spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, v double").createOrReplaceTempView("some")

    def fails(*_, **__):
        raise RuntimeError("broken\nbadly")

    for name in ("aggregate_over_join", "read", "put"):
        with monkeypatch.context() as m:
            m.setattr(engines, name, fails)
            e = Engine(spark, "always")
            assert [tuple(r) for r in e.sql(SELF.format("some")).collect()] == [(1, 10.0, 4)]
            assert e.decisions[-1].reasons == ["not rewritten: RuntimeError: broken"]
    with monkeypatch.context() as m:
        m.setattr(Engine, "_walk", fails)
        assert [tuple(r) for r in Engine(spark, "always").sql(SELF.format("some")).collect()] == [(1, 10.0, 4)]


def test_subqueries_in_expressions_are_rewritten(spark):
    spark.createDataFrame([(k % 5, float(k)) for k in range(50)], "k int, v double").createOrReplaceTempView("t")
    inner = "(SELECT count(*) FROM t a JOIN t b ON a.k = b.k)"
    for text in (f"SELECT {inner} AS n", f"SELECT k, v + {inner} AS x FROM t", f"SELECT k FROM t WHERE v * 20 > {inner}", f"SELECT k, max(v + {inner}) AS m FROM t GROUP BY k", f"SELECT k, count(*) + {inner} AS m FROM t GROUP BY k HAVING sum(v) > {inner} / 100"):
        e = Engine(spark, "always")
        got = e.sql(text)
        assert any(d.rewritten for d in e.decisions), text
        want = spark.sql(text)
        assert got.schema.simpleString() == want.schema.simpleString() and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_floats_are_summed_as_doubles(spark, ansi):
    a = spark.createDataFrame([(1, 0.1), (1, 0.2), (2, 0.3)], "k int, v float")
    b = spark.createDataFrame([(1,), (1,), (1,), (2,)], "k int")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for unique in (None, {"a": [["k"]]}):
            rows = a if unique is None else a.where("k = 2 or v > 0.15")
            want = {r[0]: r[1] for r in rows.join(b, "k").groupBy("k").agg(F.sum("v")).collect()}
            got = {r["k"]: r["s"] for r in agg_over_join({"a": rows, "b": b}, [("a.k", "b.k")], ["a.k"], {"s": ("sum", "a.v")}, unique=unique).collect()}
            assert got == pytest.approx(want, abs=1e-15)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize(("digits", "scale"), [(7, 2), (12, 2), (15, 2), (15, 6), (18, 2)])
def test_decimal_sums_and_averages(spark, digits, scale):
    big = Decimal(10) ** (digits - scale) - Decimal(1).scaleb(-scale)
    rows = [(k % 3, Decimal(k * 7919 % 1009).scaleb(-scale) if k % 5 else (big if k % 2 else -big) if k != 20 else None) for k in range(60)]
    spark.createDataFrame(rows, f"k int, v decimal({digits},{scale})").createOrReplaceTempView("money")
    text = "SELECT b.k, sum(a.v) AS s, avg(a.v) AS m, count(a.v) AS c FROM money a JOIN money b ON a.k = b.k JOIN money c ON b.k = c.k GROUP BY b.k"
    e = Engine(spark, "always")
    got, want = e.sql(text), spark.sql(text)
    assert got.schema.simpleString() == want.schema.simpleString() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert e.decisions[0].rewritten == (digits <= 15)


def test_decimal_sums_refuse_what_they_cannot_count(spark):
    from sumweave.functions.algebra import weighted

    kind = spark.createDataFrame([], "v decimal(15,2)").schema["v"].dataType
    df = spark.createDataFrame([(Decimal("1.00"), 10**17)], "v decimal(15,2), n bigint").select(weighted(F.col("v"), kind, F.col("n")))
    with pytest.raises(Exception, match="multiplies more rows"):
        df.collect()


def test_other_joins_below_are_relations(spark):
    spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id int, g int").createOrReplaceTempView("heads")
    spark.createDataFrame([(1, 5), (1, 6), (2, None)], "id int, v int").createOrReplaceTempView("tails")
    for text in (
        "SELECT g, count(*) AS n, sum(v) AS s FROM heads JOIN tails ON heads.id = tails.id WHERE EXISTS (SELECT 1 FROM heads h WHERE h.id = tails.id) GROUP BY g",
        "SELECT heads.g, count(x.w) AS n FROM heads JOIN (SELECT h.id, t.v AS w FROM heads h LEFT JOIN tails t ON h.id = t.id) x ON heads.id = x.id GROUP BY heads.g",
    ):
        e = Engine(spark, "always")
        got = sorted(map(tuple, e.sql(text).collect()))
        assert e.decisions[0].rewritten and got == sorted(map(tuple, spark.sql(text).collect()))


SELF_JOINS = [
    "SELECT a.k, sum(a.v) AS s, sum(b.v) AS r, count(*) AS n, min(b.g) AS m FROM {0} a JOIN {0} b ON a.k = b.k GROUP BY a.k",
    "SELECT sum(a.v) AS s, avg(b.v) AS r, count(*) AS n FROM {0} a JOIN {0} b ON a.k = b.k",
    "SELECT b.k, b.g, sum(a.v) AS s, count(*) AS n FROM {0} a JOIN {0} b ON a.k = b.k AND a.g = b.g GROUP BY b.k, b.g",
    "SELECT a.k, sum(c.v) AS s, count(b.v) AS c, count(*) AS n FROM {0} a JOIN {0} b ON a.k = b.k JOIN {0} c ON a.k = c.k GROUP BY a.k",
    "SELECT a.k % 3 AS x, sum(b.v) AS s FROM {0} a JOIN {0} b ON a.k % 3 = b.k % 3 GROUP BY a.k % 3",
]


@pytest.mark.parametrize("text", SELF_JOINS)
@pytest.mark.parametrize("rows", ["twice", "(SELECT * FROM twice WHERE v > 3 OR v IS NULL)"])
def test_self_joins_on_equal_keys_read_their_rows_once(spark, tmp_path, text, rows):
    made = [(None if k % 11 == 0 else k % 7, None if k % 5 == 0 else f"g{k % 3}", None if k % 13 == 0 else float(k)) for k in range(300)]
    spark.createDataFrame(made, "k int, g string, v double").write.parquet(f"{tmp_path}/twice")
    spark.read.parquet(f"{tmp_path}/twice").createOrReplaceTempView("twice")
    text = text.format(rows)
    e = Engine(spark, "always")
    got, want = e.sql(text), spark.sql(text)
    assert got.schema.simpleString() == want.schema.simpleString() and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("parquet") > 0 and "Join" not in plan


@pytest.mark.parametrize(
    "text",
    [
        "SELECT a.k, sum(b.v) AS s FROM twice a JOIN twice b ON a.k = b.j GROUP BY a.k",  # other columns
        "SELECT a.j, sum(b.v) AS s FROM twice a JOIN twice b ON a.k = b.k GROUP BY a.j",  # other groups
        "SELECT a.k, sum(b.v) AS s FROM twice a JOIN (SELECT * FROM twice WHERE j > 2) b ON a.k = b.k GROUP BY a.k",  # other rows
        "SELECT a.k, sum(c.v) AS s, count(*) AS n FROM twice a JOIN twice b ON a.k = b.k JOIN twice c ON b.j = c.j GROUP BY a.k",
    ],
)
def test_other_self_joins_are_joined(spark, text):
    spark.createDataFrame([(k % 4, k % 5, float(k)) for k in range(60)], "k int, j int, v double").createOrReplaceTempView("twice")
    e = Engine(spark, "always")
    got, want = e.sql(text), spark.sql(text)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and e.decisions[0].rewritten
    assert "Join" in got._jdf.queryExecution().optimizedPlan().toString()


def test_one_dataframe_given_twice(spark):
    a = spark.createDataFrame([(k % 4, float(k)) for k in range(40)] + [(None, 1.0)], "k int, v double")
    df = agg_over_join({"a": a, "b": a}, [("a.k", "b.k")], ["a.k"], {"n": ("count", None), "s": ("sum", "b.v"), "t": ("sum", "a.v")})
    assert sorted(map(tuple, df.collect())) == [(k, 100, 10 * sum(range(k, 40, 4)), 10 * sum(range(k, 40, 4))) for k in range(4)]
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
