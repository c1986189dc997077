"""Joins on hot keys, running sums, the shared folder."""

import random

import pytest
from pyspark.sql import functions as F

from termweave.llm import common

SHUFFLED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}


@pytest.fixture
def shuffled(spark):
    """Joins by shuffle, and nothing mended at run time."""
    before = {k: spark.conf.get(k) for k in SHUFFLED}
    for k, v in SHUFFLED.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_keys_are_spread(shuffled, how):
    spark, n = shuffled, 100_000
    left = spark.range(0, n, 1, 4).select(F.when(F.col("id") % 10 != 0, F.lit(-1)).otherwise(F.col("id") % 1777).alias("k"), F.lit(1).alias("same"), F.lit("left").alias("__h2"))
    left = common.stage(left, "test-left")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("w"))
    right = common.stage(counts.where("k % 7 <> 0").select("k", "w", (F.col("k") * 2).alias("twice")), "test-right")
    out = common.attach(left, right, "k", "w", n, how)
    assert out.columns == ["k", "same", "__h2", "twice"]
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / 16
    wrong = out.where("twice IS DISTINCT FROM CASE WHEN k % 7 <> 0 THEN 2 * k END").count()
    want = left.count() if how == "left" else left.where("k % 7 <> 0").count()
    assert wrong == 0 and sum(sizes) == want


def test_attach_to_nothing(spark):
    left = spark.createDataFrame([], "k string, v int")
    right = spark.createDataFrame([], "k string, w long, x int")
    assert common.attach(left, right, "k", "w", 0).collect() == []


def test_running_sums(spark):
    rng = random.Random(1)
    lists = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 5000)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<int>").select("i", common.running(F.col("v")).alias("s")).collect()
    for r in got:
        assert r.s == [sum(lists[r.i][:k]) for k in range(len(lists[r.i]))] if len(lists[r.i]) < 300 else r.s[-1] == sum(lists[r.i][:-1])


def test_ranged_sums(spark):
    rows = [(i * 7919 % 1000, i % 3, float(i % 5)) for i in range(1000)]
    frame = spark.createDataFrame(rows, "a int, b int, c double").repartition(5)
    got = common.ranged(frame, [F.col("b"), F.col("a").desc()], {"at": F.lit(1).cast("long"), "c_before": F.col("c")}, "test-ranged").collect()
    done, total = 0, 0.0
    for a, b, c in sorted(rows, key=lambda r: (r[1], -r[0])):
        r = next(x for x in got if (x.a, x.b) == (a, b))
        assert (r.at, r.c_before) == (done, total)
        done, total = done + 1, total + c


def test_shared_folder(spark):
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        common.shared_dir(Cluster)
    assert common.shared_dir(spark)
