"""How rows come to Python: over all cores, in small batches, each different row of a batch once."""

import pytest

from corvane import vectors
from corvane.functions import batches

FOLDER = "/root/testdata/sf0.001"


def test_equal_rows_are_judged_once():
    seen = []

    def judge(a, b):
        seen.append((a, b))
        return f"{a}{b}"

    assert batches.each(judge, [("x", None), ("y", 1), ("x", None), ("x", 1)]) == ["xNone", "y1", "xNone", "x1"]
    assert seen == [("x", None), ("y", 1), ("x", 1)]
    assert batches.each(judge, []) == []


@pytest.mark.parametrize("name", ["css_vectors", "markdown_vectors", "html_problem_vectors", "sentinel_variants"])
def test_vectors_of_one_row_group_are_judged_by_all_cores(spark, name):
    got = vectors.QUERIES[name](spark, FOLDER)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == batches.BATCH_BYTES


def test_files_of_a_tree_are_written_by_all_cores(spark, tmp_path):
    from pyspark.sql import functions as F

    from corvane.sources import release_tree

    rows = batches.dealt(spark.range(400).coalesce(1)).select(F.concat(F.lit("a/b/"), F.col("id").cast("string")).alias("path"), F.col("id").cast("string").alias("content"))
    release_tree.write(rows, tmp_path)
    parts = release_tree.commit_of(release_tree.store_of(str(tmp_path)))["parts"]
    assert len(parts) >= spark.sparkContext.defaultParallelism
    assert release_tree.verify(spark, tmp_path).count() == 0 and release_tree.read(spark, tmp_path).count() == 400


@pytest.mark.parametrize("name", ["html_extract", "html_problems", "html_links", "markdown_links"])
def test_whole_pages_come_in_small_batches(spark, name):
    from corvane import queries

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    queries.QUERIES[name](spark, FOLDER)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == batches.BATCH_BYTES
