"""Folders that driver and executors share, and small files in them.

Edge cases: a cluster without a shared folder is an error; a table without rows is stored as one;
deleting what isn't there does nothing.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none, a local master gets one of its own, set on the
    session so that later calls find it; on a cluster that is an error, as each
    executor would write to its own disk.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/corvane/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, place: str) -> tuple:
    """The store that holds a path, and the path, as the JVM has them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def make_folder(spark: SparkSession, folder: str) -> None:
    fs, path = _file_system(spark, folder)
    fs.mkdirs(path)


def exists(spark: SparkSession, place: str) -> bool:
    fs, path = _file_system(spark, place)
    return fs.exists(path)


def delete(spark: SparkSession, place: str) -> None:
    fs, path = _file_system(spark, place)
    fs.delete(path, True)


def read_text(spark: SparkSession, file: str) -> str | None:
    """The text of a small file, or None where there is none."""
    fs, path = _file_system(spark, file)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, file: str, text: str) -> None:
    """Write a small file as a whole and put it in place of the one that may be there, in one step."""
    jvm, held = spark.sparkContext._jvm, f"{file}.{uuid.uuid4().hex}"
    fs, path = _file_system(spark, held)
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(file)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(path, target, overwrite)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
