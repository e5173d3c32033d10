"""Trees of digests against the full comparison of two snapshots."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.operators import digest_tree, snapshots

SCHEMA = "path string, size long, mode string"


def rows(df):
    return sorted((r["path"] or "", r["change"]) for r in df.collect())


def some_tree(rng, n):
    names = ["a", "b", "c", ""]
    return {"/".join([*(rng.choice(names) for _ in range(rng.randrange(5))), f"f{rng.randrange(40)}"]): (rng.choice((None, 1, 2)), rng.choice(("x", None))) for _ in range(n)}


def changed(rng, tree):
    out = {k: v for k, v in tree.items() if rng.random() > 0.05}
    out |= {k: (v[0], "y") for k, v in tree.items() if rng.random() < 0.05}
    return out | some_tree(rng, 3)


def frame(spark, tree):
    return spark.createDataFrame([(k, *v) for k, v in tree.items()], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_differences_are_those_of_a_full_comparison(spark, seed):
    rng = random.Random(seed)
    one = some_tree(rng, 80)
    for two in (changed(rng, one), one, {}):
        a, b = frame(spark, one), frame(spark, two)
        if seed == 1:
            a, b = (df.unionByName(spark.createDataFrame([(None, 1, "x")], SCHEMA)) for df in (a, b))
        want = rows(snapshots.diff(a, b, ["path"], ["size", "mode"]))
        take = lambda df: digest_tree.take(df.withColumn("folder", F.lit(1)), "path", ["size", "mode"])
        assert rows(digest_tree.diff(take(a), take(b))) == want
        assert rows(digest_tree.diff(take(b), take(a))) == rows(snapshots.diff(b, a, ["path"], ["size", "mode"]))


def test_folders_fold_upwards(spark):
    df = frame(spark, {"a/b/x": (1, "x"), "a/b/y": (1, "x"), "a/z": (1, "x"), "top": (1, "x")})
    found = {r["folder"]: (r["parent"], r["depth"], r["own_n"], r["all_n"]) for r in digest_tree.folders(df, "path", ["size"]).collect()}
    assert found == {"": (None, 0, 1, 4), "a": ("", 1, 1, 3), "a/b": ("a", 2, 2, 2)}


def test_equal_folders_are_not_read(spark):
    tree = {f"d{k % 50}/e{k % 7}/f{k}": (k, "x") for k in range(2000)}
    other = tree | {"d3/e3/f3": (0, "x")}
    a, b = (digest_tree.take(frame(spark, t), "path", ["size", "mode"]) for t in (tree, other))
    assert [r[0] for r in digest_tree.changed_folders(a, b).collect()] == ["d3/e3"]
    damage(a)
    damage(b)
    assert rows(digest_tree.diff(a, b)) == [("d3/e3/f3", "changed")]
    assert digest_tree.changed_folders(a, a) is None and rows(digest_tree.diff(a, a)) == []


def damage(snapshot):
    """Make all files unreadable but those of the shard that holds d3/e3."""
    spark = snapshot.spark
    shard = spark.range(1).select(digest_tree._shard(F.lit("d3/e3"))).first()[0]
    broken = 0
    for folder in Path(snapshot.rows_at.removeprefix("file://")).iterdir():
        if folder.is_dir() and folder.name != f"__shard={shard}":
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"broken")
                broken += 1
    assert broken > 40
