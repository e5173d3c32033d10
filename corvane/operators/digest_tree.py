"""Snapshots with a tree of digests: what differs is found from the root down.

Each folder has two order-free digests: of the rows directly in it, and of all below it. They
are sums of two 64-bit hashes of rows, counted per folder first and then folded upwards, so
the root's sum is made from one row a folder. To compare two snapshots, only children of
folders whose digests differ are looked up, a level at a time, and only rows of folders whose own
rows differ are joined. Rows are stored in shards by folder, folders by depth, so what is equal
isn't read.

Edge cases: as snapshots.diff(), but that rows which repeat a path are equal if both sides have
them alike; rows without a path are removed and added; names between slashes may be empty;
two different sets of rows pass for equal with a chance of 2^-128; an empty snapshot differs from
any other in all its rows; columns whose names start with two underscores are reserved.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corvane.operators import snapshots
from corvane.sources.scratch import scratch_path

#: Shards of the rows of a snapshot, by their folder.
SHARDS = 64
SUMS = ("own_n", "own_a", "own_b", "all_n", "all_a", "all_b")
OWN, ALL = SUMS[:3], SUMS[3:]


def folder_of(path: Column) -> Column:
    """The part before the last slash; the root is empty."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _shard(folder: Column) -> Column:
    return F.when(folder.isNotNull(), F.pmod(F.xxhash64(folder), F.lit(SHARDS)).cast("int"))


def folders(rows: DataFrame, path: str, values: list[str]) -> DataFrame:
    """(folder, parent, depth, own and all sums) of every folder that holds rows or folders; depth 0 is the root."""
    keyed = rows.filter(F.col(path).isNotNull()).select(folder_of(F.col(path)).alias("folder"), *[F.xxhash64(F.lit(k), F.col(path), *[F.struct(F.col(v).alias("x")) for v in values]).alias(h) for k, h in enumerate(("a", "b"))])
    number = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    own = keyed.groupBy("folder").agg(F.count("*").alias("n"), number("a").alias("a"), number("b").alias("b"))
    names = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(names)), lambda k: F.array_join(F.slice(names, F.lit(1), k), "/"))
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.array_distinct(above))  # a first name that is empty is no folder of its own
    spread = own.select("folder", "n", "a", "b", F.posexplode(above).alias("depth", "at"))
    is_own = F.col("folder") == F.col("at")
    sums = [F.coalesce(F.sum(F.when(is_own, F.col(c))), F.lit(0)).alias(f"own_{c}") for c in "nab"] + [F.sum(c).alias(f"all_{c}") for c in "nab"]
    folded = spread.groupBy(F.col("at").alias("folder"), "depth").agg(*sums)
    return folded.withColumn("parent", F.when(F.col("depth") > 0, folder_of(F.col("folder"))))


@dataclass(frozen=True)
class Snapshot:
    """Places of the stored rows (by shard) and folders (by depth), the name of the path column and of those compared."""

    spark: SparkSession
    rows_at: str
    folders_at: str
    path: str
    values: tuple[str, ...]
    schema: StructType

    def rows(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema, StructField("__shard", IntegerType())])).parquet(self.rows_at)

    def folders(self) -> DataFrame:
        return self.spark.read.schema(FOLDERS).parquet(self.folders_at)


FOLDERS = "folder string, own_n long, own_a decimal(38,0), own_b decimal(38,0), all_n long, all_a decimal(38,0), all_b decimal(38,0), parent string, depth int"


def take(rows: DataFrame, path: str, values: list[str], label: str = "snapshot") -> Snapshot:
    """Store rows with their tree of digests."""
    spark = rows.sparkSession
    rows_at, folders_at = scratch_path(spark, f"{label}-rows"), scratch_path(spark, f"{label}-folders")
    kept = rows.select(path, *[v for v in values if v != path])
    kept.withColumn("__shard", _shard(folder_of(F.col(path)))).write.partitionBy("__shard").parquet(rows_at)
    schema = kept.schema
    stored = Snapshot(spark, rows_at, folders_at, path, tuple(values), schema)
    typed = folders(stored.rows(), path, values).select(*[F.col(x.split(" ")[0]).cast(x.split(" ")[1]) for x in FOLDERS.split(", ")])
    typed.write.partitionBy("depth").parquet(folders_at)
    return stored


def _different(a: DataFrame, b: DataFrame) -> DataFrame:
    """(folder, own): folders of one depth whose digests differ, and whether their own rows do."""
    named = lambda df, side: df.select("folder", F.struct(*OWN).alias(f"own_{side}"), F.struct(*ALL).alias(f"all_{side}"))
    both = named(a, "a").join(named(b, "b"), "folder", "full_outer").filter(~F.col("all_a").eqNullSafe(F.col("all_b")))
    return both.select("folder", (~F.col("own_a").eqNullSafe(F.col("own_b"))).alias("own"))


def changed_folders(a: Snapshot, b: Snapshot) -> DataFrame | None:
    """(folder) of those whose own rows differ, found from the root down; None if there are none."""
    found, depth, frontier = [], 0, None
    while True:
        level = [s.folders().filter(F.col("depth") == depth) for s in (a, b)]
        if frontier is not None:
            level = [df.join(frontier, "parent", "left_semi") for df in level]
        place = scratch_path(a.spark, "differing")
        _different(*level).write.parquet(place)
        now = a.spark.read.schema("folder string, own boolean").parquet(place)
        if now.isEmpty():
            break
        found.append(now.filter("own").select("folder"))
        frontier, depth = now.select(F.col("folder").alias("parent")), depth + 1
    return reduce(DataFrame.unionByName, found) if found else None


def diff(a: Snapshot, b: Snapshot) -> DataFrame:
    """(path, change): added, removed or changed."""
    changed = changed_folders(a, b)
    keyless = [s.rows().filter("__shard is null").select(a.path, F.lit(change).alias("change")) for s, change in ((a, "removed"), (b, "added"))]
    if changed is None:
        return keyless[0].unionByName(keyless[1])
    shards = [r[0] for r in changed.select(_shard(F.col("folder"))).distinct().collect()]  # SHARDS numbers at most

    def of(s: Snapshot) -> DataFrame:
        rows = s.rows().filter(F.col("__shard").isin(shards))
        return rows.withColumn("__folder", folder_of(F.col(s.path))).join(changed.withColumnRenamed("folder", "__folder"), "__folder", "left_semi")

    found = snapshots.diff(of(a), of(b), [a.path], list(a.values))
    return found.unionByName(keyless[0]).unionByName(keyless[1])
