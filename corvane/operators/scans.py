"""Scans along an order within keys of any size: numbers, running totals and previous values.

A window by a key sorts all rows of the key in one task. Here rows are dealt by ranges of
(key, order), so a large key lies in many ranges; each range is scanned by itself, and what
ranges before it hold of its first key is carried over to it: a count, totals and a last
value, one row a range at most.

Edge cases: null keys are one key; rows that tie in the order are taken by a hash of all
their columns, so a large tie is dealt over several ranges too (rows that are equal in all
columns excepted); null values count as nothing in totals, and a total is null until there
is a value; a previous value may be null; an empty table gives no rows; columns whose names
start with two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.scratch import stored


def scan(records: DataFrame, partition: list[str], order: list[Column], number: str | None = None, totals: dict[str, Column] | None = None, previous: dict[str, Column] | None = None) -> DataFrame:
    """records with the position of each row in its key (from 1), running totals up to it, and values of the row before it."""
    totals, previous = totals or {}, previous or {}
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in records.columns])
    along = [*order, tie]
    ranged = records.repartitionByRange(*[F.col(p) for p in partition], *along).withColumn("__p", F.spark_partition_id())
    w = Window.partitionBy("__p", *partition).orderBy(*along)
    inside = {"__n": F.row_number().over(w)}
    inside |= {f"__t{k}": F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for k, c in enumerate(totals.values())}
    inside |= {f"__v{k}": F.lag(F.struct(c.alias("x"))).over(w) for k, c in enumerate(previous.values())}
    own = {f"__o{k}": F.struct(c.alias("x")) for k, c in enumerate(previous.values())}
    scanned = stored(ranged.withColumns(inside | own), "scan")

    # What each range holds of each of its keys, and of these what the ranges before it have: of its first key only.
    ends = [F.max("__n").alias("__n"), *[F.max_by(c, "__n").alias(c) for c in (*(f"__t{k}" for k in range(len(totals))), *own)]]
    held = scanned.groupBy("__p", *partition).agg(*ends)
    before = Window.partitionBy(*partition).orderBy("__p")
    carried = {"__cn": F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, -1))}
    carried |= {f"__ct{k}": F.sum(f"__t{k}").over(before.rowsBetween(Window.unboundedPreceding, -1)) for k in range(len(totals))}
    carried |= {f"__cv{k}": F.lag(f"__o{k}").over(before) for k in range(len(previous))}
    carry = held.withColumns(carried).filter("__cn is not null").select(F.col("__p").alias("__cp"), *[F.col(p).alias(f"__k{i}") for i, p in enumerate(partition)], *carried)

    same = F.col("__p") == F.col("__cp")
    for i, p in enumerate(partition):
        same = same & F.col(p).eqNullSafe(F.col(f"__k{i}"))
    joined = scanned.join(F.broadcast(carry), same, "left")
    out = {}
    if number:
        out[number] = (F.coalesce("__cn", F.lit(0)) + F.col("__n")).cast("int")
    for k, name in enumerate(totals):
        out[name] = F.when(F.col(f"__t{k}").isNull(), F.col(f"__ct{k}")).otherwise(F.col(f"__t{k}") + F.coalesce(f"__ct{k}", F.lit(0)))
    for k, name in enumerate(previous):
        out[name] = F.when(F.col("__n") == 1, F.col(f"__cv{k}")).otherwise(F.col(f"__v{k}"))["x"]
    return joined.select(*[F.col(f"`{c}`") for c in records.columns if c not in out], *[c.alias(n) for n, c in out.items()])
