from pyspark.sql import functions as F

from sumweave.operators.dictionary import dictionary, encode
from sumweave.operators.paths import count_paths, propagate_frequencies
from sumweave.sources.files import edges_from_tsv, parquet, write_csv, write_parquet
from sumweave.sources.generate import series, skewed, uniform
from sumweave.streaming.static_join import stream_aggregate


def test_edge_list_round_trip(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# from to\n1\t2\n2\t3\n2\t3\n")
    e = edges_from_tsv(spark, str(tmp_path / "g.txt"))
    write_parquet(e, str(tmp_path / "g"))
    write_csv(e, str(tmp_path / "c"))
    assert sorted(map(tuple, parquet(spark, str(tmp_path / "g")).collect())) == [(1, 2), (2, 3), (2, 3)]
    assert count_paths(e, 2).first()["n"] == 2
    assert [tuple(r) for r in propagate_frequencies([(e, "src", "dst")] * 2).collect()] == [(3, 2)]


def test_generators_dont_depend_on_partitions(spark):
    a = series(spark, 1000, u=uniform(3), k=skewed(4, 50))
    b = spark.range(1, 1001).repartition(7).withColumnRenamed("id", "i").select(uniform(3).alias("u"), skewed(4, 50).alias("k"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.where("u < 0 or u >= 100 or k < 0 or k >= 50").count() == 0


def test_dictionary(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "s string, v int")
    ids = dictionary([a, a], "s").checkpoint()
    assert ids.count() == 2 and ids.select("id").distinct().count() == 2
    coded = {r["v"]: r["id"] for r in encode(a, "s", ids).collect()}
    assert coded[3] is None and coded[1] != coded[2]


def test_stream_with_static_side(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 5.0), (9, 1.0)], "k int, v double").repartition(1)
    rows.write.parquet(str(tmp_path / "in"))
    static = spark.createDataFrame([(1, 7.0), (1, 3.0), (2, 1.0)], "k int, w double")
    stream = spark.readStream.schema("k int, v double").parquet(str(tmp_path / "in"))
    out = stream_aggregate(stream, {"s": static}, [("stream.k", "s.k")], ["stream.k"], {"n": ("count", None), "v": ("sum", "stream.v"), "w": ("sum", "s.w")})
    q = out.writeStream.format("memory").queryName("joined").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("joined").select("k", "n", "v", "w").collect())) == [(1, 4, 60.0, 20.0), (2, 1, 5.0, 1.0)]
