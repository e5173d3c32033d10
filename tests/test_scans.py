"""Scans with carried values against windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import checks, reports, scans


@pytest.fixture
def many(spark):
    """A session whose sorts have many ranges, none of them joined."""
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def table(spark, n, keys, seed=1):
    rng = random.Random(seed)
    data = [(k, rng.choice(keys), rng.choice(("x", None)), rng.choice((None, *range(-3, 9)))) for k in range(n)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "id int, a string, b string, v int").repartition(5)


@pytest.mark.parametrize("keys", [("one",), ("one", "two", None), [str(k) for k in range(90)]])
@pytest.mark.parametrize("partition", [[], ["a"], ["a", "b"]])
def test_scans_are_those_of_windows(many, keys, partition):
    df = table(many, 500, keys)
    for order in ([F.col("id")], [F.desc_nulls_last("v"), F.col("id")]):
        w = Window.partitionBy(*partition).orderBy(*order)
        want = df.withColumns({"n": F.row_number().over(w), "t": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), "u": F.sum(F.lit(2)).over(w.rowsBetween(Window.unboundedPreceding, 0)), "p": F.lag("v").over(w), "q": F.lag("id").over(w)})
        got = scans.scan(df, partition, order, number="n", totals={"t": F.col("v"), "u": F.lit(2)}, previous={"p": F.col("v"), "q": F.col("id")})
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert scans.scan(df.limit(0), partition, [F.col("id")], number="n").count() == 0


def test_no_task_holds_a_large_key(many):
    """Of a key with all rows, and of rows that all tie, no range has more than a fraction."""
    df = many.range(20_000).select(F.col("id").alias("id"), F.lit("all").alias("a"), F.lit(1).alias("v"))
    held = {}

    def spy(frame, label):
        held[label] = frame.groupBy("__p").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        return original(frame, label)

    original = scans.stored
    scans.stored = spy
    try:
        for order in (F.col("id"), F.col("v")):
            got = scans.scan(df, ["a"], [order], number="n", totals={"t": F.col("v")})
            assert got.agg(F.max("n"), F.max("t"), F.sum("t")).first() == (20_000, 20_000, 20_000 * 20_001 // 2)
            assert held["scan"] < 20_000 / 13 * 1.6
    finally:
        scans.stored = original


def test_checks_and_numbers_use_them(many):
    df = table(many, 300, ("k", "l"))
    w = Window.partitionBy("a").orderBy("id")
    falls = df.withColumn("previous", F.lag("v").over(w)).filter("previous >= v")
    assert sorted(map(tuple, checks.out_of_order(df, ["a"], F.col("id"), F.col("v")).collect())) == sorted(map(tuple, falls.collect()))
    over = df.withColumn("running", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("running > 200")
    assert sorted(map(str, checks.over_budget(df, ["a"], F.col("id"), F.col("v"), 200).collect())) == sorted(map(str, over.collect())) != []
    placed = reports.numbered(df, *reports.newest_first(F.col("v"), F.col("id").cast("string")), partition=["a"])
    want = df.withColumn("position", F.row_number().over(Window.partitionBy("a").orderBy(F.desc_nulls_last("v"), F.collate(F.col("id").cast("string"), "UNICODE"))))
    assert sorted(map(str, placed.drop("label").collect())) == sorted(map(str, want.collect()))
    assert {r["label"] for r in placed.filter("position in (1, 12)").collect()} == {"01", "012"}
