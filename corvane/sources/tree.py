"""Limits of a release tree, and what a listing of one breaks.

Edge cases: an empty listing breaks nothing; folders count as entries, not as files; sizes
that a store doesn't know count as nothing.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import checks
from corvane.sources import release_tree

#: Fixed limits of a release.
MAX_FILE_BYTES = release_tree.MAX_FILE_BYTES
MAX_TOTAL_BYTES = 256 * 1024 * 1024
MAX_FILES = 10_000
MAX_EXTRA_ENTRIES = 16


def tree(spark: SparkSession, root: str | Path, **options: int) -> DataFrame:
    """The metadata of all files and folders below a root; no file is opened."""
    return release_tree.read(spark, root, content=False, **options)


def budgets(listed: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_TOTAL_BYTES, max_extra: int = MAX_EXTRA_ENTRIES) -> DataFrame:
    """Violations of the limits on a tree as a whole: its files, its bytes, and its entries of any kind."""
    is_file = F.col("kind") == "file"
    sums = listed.agg(F.count(F.when(is_file, 1)).alias("files"), F.coalesce(F.sum(F.when(is_file, F.col("size"))), F.lit(0)).alias("bytes"), F.count("*").alias("entries"))
    rules = [
        ("tree.files", "files", F.col("files") <= max_files, "too many files"),
        ("tree.bytes", "bytes", F.col("bytes") <= max_bytes, "beyond the byte budget"),
        ("tree.entries", "entries", F.col("entries") <= max_files + max_extra, "too many entries"),
    ]
    return checks.violations(sums, F.lit("tree"), rules)
