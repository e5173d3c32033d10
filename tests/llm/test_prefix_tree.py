"""The prefix tree against a brute-force version, over one range and many."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm import prefix_tree


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, x = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        source = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = tuple(own.get(source, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    kids = defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in m if made[c] == k)
        out.append((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("key", F.lit(1)).withColumn("range", F.lit("x")).withColumn("node", F.lit(2)) if extra else df
    return sorted((tuple(r) for r in prefix_tree.tree(prefix_tree.rebuilt(df)).select(prefix_tree.RESULT).collect()), key=str)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_tree_is_that_of_brute_force(spark, ranges, monkeypatch):
    rng = random.Random(ranges)
    monkeypatch.setattr(prefix_tree, "PART_IDS", 3)
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for width in (1, 2, 6):
            rows = []
            for c in rng.sample(range(-20, 300), 130):
                for turn in range(rng.choice((1, 2, 3, 5, 12))):
                    rows.append((c, rng.choice((turn, None)) if rng.random() < 0.1 else turn, rng.choice(("user", "assistant", None)) if width > 1 else "user", "x" * rng.randrange(width)))
            rows += [(700 + k, t, "user", "héllo" * (t + 1)) for k in range(60) for t in range(1 + k % 3)]  # copies that stand in many ranges
            rows += [(None, 1, "user", "gone"), rows[0], rows[0], (10**12, None, None, None), (-(10**12), 3, "tool", "long " * 5000)]
            assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_conversations_without_turns_end_at_the_root(spark):
    rows = [(c, 0, "user", "a") for c in (1, 2, 3, 4, 6, 7, 8, 9)]  # no source, and most lose their only turn
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:0], False) == []


def test_shared_nodes_alone_are_grouped_again(spark):
    """A first turn that all conversations share is one row a range, whatever the number of conversations."""
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = [(5 * k, t, "user", "all the same" if t == 0 else f"own {k}") for k in range(800) for t in range(3)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        marks = prefix_tree.rebuilt(df).select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["mark"]), "")).alias("key"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
        placed = marks.repartitionByRange(8, "key", "conv_id").withColumn("range", F.spark_partition_id()).cache()
        shared = {k: (1 if k else -1, 1 if k < 7 else -1) for k in range(8)}
        local = prefix_tree.local_trees(placed, shared).collect()
        assert len([r for r in local if r["node"] is not None]) == 16  # root and first turn of 8 ranges
        assert max(placed.groupBy("range").count().toPandas()["count"]) < 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
