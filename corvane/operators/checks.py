"""Checks as rows: (check_id, record_id, path, message).

A run is the union of its checks; fail_first keeps the first by input position.

Edge cases: a rule that gives null is broken; a null record id is reported as such;
repeated records are reported one by one; the first of equal positions is any of them;
null sizes count as nothing in a running total; empty tables give no rows; `previous`,
`running` and `record_id` replace columns of these names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import json_values, scans

COLUMNS = ("check_id", "record_id", "path", "message")


def violations(records: DataFrame, record_id: Column, rules: list[tuple[str, str, Column, str]]) -> DataFrame:
    """All broken rules of all records in one pass; a rule is (check_id, path, holds, message), null counts as broken."""
    broken = [F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(c).alias("check_id"), F.lit(p).alias("path"), F.lit(m).alias("message"))) for c, p, holds, m in rules]
    found = records.select(record_id.cast("string").alias("record_id"), F.explode(F.array_compact(F.array(*broken))).alias("v"))
    return found.select("v.check_id", "record_id", "v.path", "v.message")


def rows_of(found: DataFrame, check_id: str, record_id: Column, path: str, message: str) -> DataFrame:
    """Violations from the rows of a join or aggregate."""
    return found.select(F.lit(check_id).alias("check_id"), record_id.cast("string").alias("record_id"), F.lit(path).alias("path"), F.lit(message).alias("message"))


def all_of(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def fail_first(checks: DataFrame, position: Column) -> DataFrame:
    return checks.orderBy(position).limit(1)


def out_of_order(records: DataFrame, partition: list[str], position: Column, value: Column, strict: bool = True) -> DataFrame:
    """Records whose value doesn't follow the one before it; keys may be of any size (scans.scan)."""
    marked = scans.scan(records, partition, [position], previous={"previous": value})
    return marked.filter(F.col("previous") >= value if strict else F.col("previous") > value)


def over_budget(records: DataFrame, partition: list[str], position: Column, size: Column, budget: int) -> DataFrame:
    """Records with their running total, from the one that exceeds the budget on; keys may be of any size (scans.scan)."""
    return scans.scan(records, partition, [position], totals={"running": size}).filter(F.col("running") > budget)


def unknown_keys(json: Column, known: list[str]) -> Column:
    """Keys of a JSON object that its schema doesn't have: what strict schemas reject and Spark's reader drops."""
    return F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known]))


def json_problem(json: Column) -> Column:
    """null for strict JSON, else `syntax` or `repeated key`; a null text is broken."""
    return F.when(json.isNull(), "syntax").otherwise(json_values.problem(json))


def truncated(records: DataFrame, limit: int) -> DataFrame:
    """(n, truncated): how many records a reader with a limit gets, and whether it leaves some out; no more than limit + 1 are counted."""
    counted = records.select(F.lit(1).alias("one")).limit(limit + 1).agg(F.count("*").alias("c"))
    return counted.select(F.least("c", F.lit(limit)).alias("n"), (F.col("c") > limit).alias("truncated"))
