"""Snapshots of files or rows: differences, copies, manifests.

Edge cases: null values equal null values, but a null key equals no key, so such rows
are added and removed; keys should be unique, as rows that repeat a key are compared
with each other; a null content is one of its own; an empty table on either side makes
all rows of the other added, removed or extra; columns whose names start with two
underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import reports


def diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change): added, removed or changed; null values compare as equal to null."""
    a = before.select(*keys, F.struct(*values).alias("__a"), F.lit(True).alias("__in_a"))
    b = after.select(*keys, F.struct(*values).alias("__b"), F.lit(True).alias("__in_b"))
    both = a.join(b, keys, "full_outer")
    change = F.when(F.col("__in_a").isNull(), "added").when(F.col("__in_b").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return both.select(*keys, change.alias("change")).filter("change is not null")


def token(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row that changes when any row does: an order-free sum of row hashes and the count."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("token"))


def copies(built: DataFrame, generated: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """(name, problem) of built files that aren't byte for byte the generated file of their name."""
    g = generated.select(F.col(name).alias("__n"), F.col(content).alias("__c"))
    joined = built.join(g, F.col(name) == F.col("__n"), "left")
    problem = F.when(F.col("__n").isNull(), "extra").when(~F.col(content).eqNullSafe(F.col("__c")), "differs")
    return joined.select(name, problem.alias("problem")).filter("problem is not null")


def manifest_counts(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """(collection, declared, observed) where the counts of (collection, n) tables differ."""
    a = manifest.select("collection", F.col("n").cast("long").alias("declared"))
    b = observed.select("collection", F.col("n").cast("long").alias("observed"))
    return a.join(b, "collection", "full_outer").select("collection", F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("observed", F.lit(0)).alias("observed")).filter("declared <> observed")


def layer_of(path, layers: list[tuple[str, str]]):
    """The layer of the first matching (prefix, layer)."""
    out = F.lit(None).cast("string")
    for prefix, layer in reversed(layers):
        out = F.when(F.startswith(path, F.lit(prefix)), layer).otherwise(out)
    return out


def scope_table(scopes: DataFrame) -> DataFrame:
    """(path, kind, position): the scopes and, as kind `guard`, every folder above one that is no scope itself; by depth, then by code units.

    Positions come from sorted ranges, not from one task: each range starts behind the rows of those before it.
    """
    parts = F.split("path", "/")
    above = scopes.select(F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("n"), parts.alias("parts")).filter("n >= 1 and n < size(parts)")
    guards = above.select(F.array_join(F.slice("parts", 1, F.col("n")), "/").alias("path")).distinct().join(scopes.select("path"), "path", "left_anti")
    both = scopes.select("path", "kind").unionByName(guards.select("path", F.lit("guard").alias("kind")))
    return reports.positioned(both, *reports.by_depth(F.col("path")))
