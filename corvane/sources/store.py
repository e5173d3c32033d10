"""A store of tables that only hold what passed its checks: write, audit, publish.

publish() writes a new version of a table and takes the counts of its broken rules in
the same pass (DataFrame.observe). What rows can't tell alone, repeated keys and checks
against other tables, is judged on the written version. Only if nothing is broken
does the name move to the new version, by one file that is replaced as a whole; else the
version is deleted, the name keeps what it had, and the violations are rows.

Edge cases: a rule that gives null is broken; rows without a key are violations; an empty
table passes unless a count is declared; a name that was never published has no table; if a
stage of the writing ran twice, the observed counts exceed the table's and are taken
again from the table; a version that was replaced stays until `keep` newer ones are published,
so that readers of it can finish.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corvane.operators import checks, links
from corvane.sources import scratch

Rules = list[tuple[str, str, Column, str]]
POINTER = "_current.json"


@dataclass(frozen=True)
class Published:
    """Whether the name moved, the rows written, how often each check was broken, and the violations (stored, at most all rows of each)."""

    accepted: bool
    rows: int
    broken: dict[str, int]
    violations: DataFrame


class Store:
    """Tables by name below a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2) -> None:
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _pointer(self, name: str) -> dict:
        text = scratch.read_text(self.spark, f"{self.root}/{name}/{POINTER}")
        return {"versions": []} if text is None else json.loads(text)

    def table(self, name: str) -> DataFrame | None:
        """The published version, or None."""
        versions = self._pointer(name)["versions"]
        return self.spark.read.parquet(f"{self.root}/{name}/{versions[-1]['version']}") if versions else None

    def rows(self, name: str) -> int | None:
        """How many rows the published version has; no table is read."""
        versions = self._pointer(name)["versions"]
        return versions[-1]["rows"] if versions else None

    def publish(self, name: str, df: DataFrame, key: str, rules: Rules, expected: int | None = None, audit: Callable[[DataFrame], DataFrame] | None = None, view: bool = False) -> Published:
        """Write df as the next version of a table and move the name to it if it breaks nothing.

        rules are as in checks.violations(); expected is a declared number of rows; audit gives violations of the written
        version, such as references to other tables. view makes a temporary view of the name, if it moves.
        """
        rules = [(f"{name}.key", key, F.col(key).isNotNull(), "no key"), *rules]
        version = f"v-{uuid.uuid4().hex}"
        place = f"{self.root}/{name}/{version}"
        seen = Observation()
        counts = [F.count("*").alias("n"), *[F.count(F.when(~F.coalesce(holds, F.lit(False)), 1)).alias(f"r{k}") for k, (_, _, holds, _) in enumerate(rules)]]
        df.observe(seen, *counts).write.parquet(place)
        written = self.spark.read.schema(df.schema).parquet(place)
        rows, observed = written.count(), seen.get
        if observed["n"] != rows:
            observed = written.agg(*counts).first().asDict()
        repeated = links.duplicates(written, key).filter(F.col(key).isNotNull())
        found = [checks.rows_of(repeated, f"{name}.unique", F.col(key), key, "repeated key")]
        broken = {check: observed[f"r{k}"] for k, (check, _, _, _) in enumerate(rules) if observed[f"r{k}"]}
        if broken:
            found.append(checks.violations(written, F.col(key), [r for r in rules if r[0] in broken]))
        if expected is not None and expected != rows:
            broken[f"{name}.count"] = 1
            found.append(self.spark.range(1).select(F.lit(f"{name}.count").alias("check_id"), F.lit(name).alias("record_id"), F.lit("rows").alias("path"), F.lit(f"{rows} rows, {expected} declared").alias("message")))
        if audit is not None:
            found.append(audit(written))
        violations = scratch.stored(checks.all_of(*found), "refused")
        later = {r["check_id"]: r["n"] for r in violations.groupBy("check_id").agg(F.count("*").alias("n")).collect()}  # a row a check
        accepted = not later
        if accepted:
            self._move(name, version, rows, written if view else None)
        else:
            scratch.delete(self.spark, place)
        return Published(accepted, rows, later, violations)

    def _move(self, name: str, version: str, rows: int, view: DataFrame | None) -> None:
        versions = [*self._pointer(name)["versions"], {"version": version, "rows": rows}]
        kept = versions[-self.keep :]
        scratch.replace_text(self.spark, f"{self.root}/{name}/{POINTER}", json.dumps({"versions": kept}))
        for old in versions[: -self.keep]:
            scratch.delete(self.spark, f"{self.root}/{name}/{old['version']}")
        if view is not None:
            view.createOrReplaceTempView(name)
