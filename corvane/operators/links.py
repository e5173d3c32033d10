"""Relations between records: ordered references, closures and bijections.

Edges are arrays of ids or key columns. Every operator is a join on the key that
Spark may run as it likes; the small side is broadcast by the optimizer when its
size is known to be small, never by a hint.

Edge cases: a null reference refers to nothing and is missing, a null key is referred to
by nothing; repeated links and records count as often as they stand, but bijection()
and same_set() compare sets; null arrays have no edges; ties of an order are numbered in
any order, so give a total one; empty tables give no rows; columns whose names start with
two underscores are reserved, all others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(records: DataFrame, key: str, references: str) -> DataFrame:
    """(key, position from 1, reference) of an array column."""
    return records.select(key, F.posexplode(references).alias("position", "reference")).withColumn("position", F.col("position") + 1)


def resolve(links: DataFrame, reference: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Links with their targets; those without one are left out (see missing)."""
    return links.join(targets, links[reference] == targets[target_key])


def missing(links: DataFrame, reference: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Links whose target doesn't exist, repeated ones included."""
    return links.join(targets.select(F.col(target_key).alias("__t")), F.col(reference) == F.col("__t"), "left_anti")


def orphans(records: DataFrame, key: str, links: DataFrame, reference: str) -> DataFrame:
    """Records that nothing refers to."""
    return records.join(links.select(F.col(reference).alias("__r")), F.col(key) == F.col("__r"), "left_anti")


def bijection(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """(key, status): missing on the right, or extra there. Keys are compared as sets."""
    a = left.select(F.col(left_key).alias("key")).distinct().withColumn("l", F.lit(1))
    b = right.select(F.col(right_key).alias("key")).distinct().withColumn("r", F.lit(1))
    both = a.join(b, "key", "full_outer")
    return both.filter("l is null or r is null").select("key", F.when(F.col("r").isNull(), "missing").otherwise("extra").alias("status"))


def cardinality(expected: DataFrame, key: str, links: DataFrame, reference: str, name: str = "n") -> DataFrame:
    """(key, n): how many links each expected key has; the count is named `name`."""
    counts = links.groupBy(F.col(reference).alias("__r")).agg(F.count("*").alias("__n"))
    return expected.select(key).join(counts, F.col(key) == F.col("__r"), "left").select(key, F.coalesce("__n", F.lit(0)).alias(name))


def duplicates(records: DataFrame, *keys: Column | str, name: str = "n") -> DataFrame:
    """(keys, n) of keys that stand more than once; null is a key as any other."""
    counted = records.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1")
    return counted.withColumnRenamed("__n", name)


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def multiset_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, surplus): rows with how many more (or fewer) left has; empty if equal as multisets."""
    tagged = left.select(*columns, F.lit(1).alias("d")).unionByName(right.select(*columns, F.lit(-1).alias("d")))
    return tagged.groupBy(*columns).agg(F.sum("d").alias("surplus")).filter("surplus <> 0")


def ordinal(records: DataFrame, partition: list[str], order: list[Column | str], name: str = "ordinal") -> DataFrame:
    return records.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
