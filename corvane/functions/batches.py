"""How rows come to Python: dealt over all cores, in batches of bounded bytes, and each different row of a batch judged once.

Edge cases: an empty table gives no rows; rows are equal if all their values are, nulls included; a row larger than a batch is
one of its own; functions must depend on their row alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, and tasks a core for rows that are dealt anew.
BATCH_BYTES, TASKS_A_CORE = 8 << 20, 4


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get their rows in Arrow batches of BATCH_BYTES at most, for texts whose length isn't known."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows over all cores. A file of few row groups is read by as few tasks, which is too few where each row costs much."""
    return rows.repartition(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)


def each[T](function: Callable[..., T], rows: Iterable[tuple]) -> list[T]:
    """function of each row, called once for equal rows."""
    known: dict[tuple, T] = {}
    out = []
    for row in rows:
        if row not in known:
            known[row] = function(*row)
        out.append(known[row])
    return out
