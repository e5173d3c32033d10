"""Strict capture of a tree's scopes: metadata of all files first, then the bytes of the scopes that pass.

The first phase lists the tree without opening a file and adds up what each scope
would cost. Scopes with links, foreign entries, a file that is too large, too many files
or too many bytes are refused as a whole; only the files of the others are opened,
and each must still be the one that was listed.

Edge cases: rows without a scope take no part; an empty tree has no scopes; a scope of
folders alone is admitted and has no files; of several reasons the first counts; files that
change or vanish between the phases are problems of their own, not of the scope; a
scope may hold any share of the files, as its verdict is dealt over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import checks
from corvane.sources import release_tree
from corvane.sources.scratch import stored

#: Tasks over which the files of one scope are dealt at most when they get its verdict.
SALTS = 32


@dataclass(frozen=True)
class Limits:
    """Of a scope: files, bytes of a file and of all; the pattern of paths that may stand in it."""

    files: int = 10_000
    file_bytes: int = 8 * 1024 * 1024
    total_bytes: int = 256 * 1024 * 1024
    pattern: str = r"\.json$"


def totals(metadata: DataFrame, limits: Limits) -> DataFrame:
    """(scope, files, bytes, refused): what each scope holds, and why it isn't read."""
    is_file = F.col("kind") == "file"
    count = lambda c: F.count(F.when(c, 1))
    held = metadata.groupBy("scope").agg(
        count(is_file).alias("files"),
        F.coalesce(F.sum(F.when(is_file, F.col("size"))), F.lit(0)).alias("bytes"),
        count(F.col("problem").isNotNull() & (F.col("problem") != release_tree.LARGE)).alias("bad"),
        count((F.col("kind") != "directory") & ~F.col("path").rlike(limits.pattern)).alias("foreign"),
        F.coalesce(F.max(F.when(is_file, F.col("size"))), F.lit(0)).alias("largest"),
    )
    refused = (
        F.when(F.col("bad") > 0, "not plain files only")
        .when(F.col("foreign") > 0, "unexpected entry")
        .when(F.col("largest") > limits.file_bytes, "file beyond the limit")
        .when(F.col("files") > limits.files, "too many files")
        .when(F.col("bytes") > limits.total_bytes, "beyond the byte budget")
    )
    return held.select("scope", "files", "bytes", refused.alias("refused"))


@dataclass(frozen=True)
class Captured:
    """metadata: all files with their scope; scopes: totals(); files: those of admitted scopes with bytes, text and problem."""

    metadata: DataFrame
    scopes: DataFrame
    files: DataFrame

    def violations(self) -> DataFrame:
        """Refused scopes, and files of admitted ones that couldn't be read or aren't strict JSON."""
        scopes = self.scopes.filter("refused is not null").select(F.lit("scope.gate").alias("check_id"), F.col("scope").alias("record_id"), F.lit("files").alias("path"), F.col("refused").alias("message"))
        files = self.files.filter("problem is not null").select(F.lit("scope.file").alias("check_id"), F.col("path").alias("record_id"), F.lit("content").alias("path"), F.col("problem").alias("message"))
        return checks.all_of(scopes, files)


def capture(spark: SparkSession, root: str, scope: Column, limits: Limits = Limits(), slices: int = 1) -> Captured:
    """Both phases over a tree; scope is a column over its paths, null for what belongs to none."""
    listed = release_tree.read(spark, root, content=False, limit=limits.file_bytes, slices=slices)
    # Stored, so that both phases speak of one listing.
    metadata = stored(listed.withColumn("scope", scope).filter("scope is not null"), "scopes")
    scopes = totals(metadata, limits)
    return Captured(metadata, scopes, read_admitted(metadata, scopes, root, limits))


def read_admitted(metadata: DataFrame, scopes: DataFrame, root: str, limits: Limits = Limits()) -> DataFrame:
    """(scope, path, size, content, text, problem) of the files of scopes that aren't refused."""
    passed = scopes.filter("refused is null").select("scope", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = metadata.filter("kind = 'file'").withColumn("salt", (F.crc32(F.col("path").cast("binary")) % SALTS).cast("int"))
    admitted = dealt.join(passed, ["scope", "salt"]).select(metadata.columns)
    read = release_tree.contents(admitted, root, limits.file_bytes)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    judged = F.coalesce("problem", F.when(F.col("text").isNull(), "not UTF-8"), checks.json_problem(F.col("text")))
    return read.withColumn("text", text).select("scope", "path", "size", "content", "text", judged.alias("problem"))
