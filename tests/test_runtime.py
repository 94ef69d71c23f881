import pytest
from pyspark.sql import functions as F

from gleanery import runtime


def test_materialise(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    kept = runtime.materialise(df)
    assert sorted(kept.collect()) == sorted(df.collect()) and kept.schema == df.schema
    assert runtime.materialise(df.limit(0)).collect() == []
    assert runtime.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


@pytest.mark.parametrize("fits", [True, False])
def test_join_per_key(spark, fits):
    rows = spark.range(6000).select(F.when(F.col("id") < 5000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("k"), "id")
    per_key = runtime.materialise(rows.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("k <> 'k7'"))
    got = runtime.join_per_key(rows, per_key, "k", "c", 6000, fits)
    assert got.count() == 5990 and got.where("k = 'hot'").first()["c"] == 5000


def test_fits_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([("a" * 100,), ("b",)], "s string")
    assert runtime.fits_broadcast(df, 8, "s") and runtime.fits_broadcast(df.limit(0), 8, "s")
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 100)
    assert not runtime.fits_broadcast(df, 8, "s")
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 1)
    assert not runtime.fits_broadcast(df, 8)


def test_spread(spark):
    df = spark.range(0, 100, 1, 1)
    assert runtime.partitions(runtime.spread(df)) == runtime.parallelism(spark)
    wide = spark.range(0, 100, 1, 50)
    assert runtime.spread(wide) is wide


def test_ship(spark):
    runtime.ship(spark)
    runtime.ship(spark)
    assert spark.sparkContext._gleanery_shipped


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())


def test_left_join_per_key(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), "id")
    per_key = runtime.materialise(spark.createDataFrame([(0, 2000)], "k bigint, c bigint"))
    for fits in (True, False):
        got = runtime.join_per_key(rows, per_key, "k", "c", 3000, fits, "left")
        assert got.count() == 3000 and got.where("c is null").count() == 2000
