"""Change detection between batches.

There is no stream to process: a source is either unchanged since it was checked
or has to be checked again. Latch keeps the token of a checked table and stays
invalid once another one was seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from corvane.operators.snapshots import token


class Latch:
    def __init__(self, df: DataFrame, columns: list[str]) -> None:
        self.columns, self.invalidated = columns, False
        self.seen = tuple(token(df, columns).first())

    def unchanged(self, df: DataFrame) -> bool:
        """Whether df has the rows that were checked; once it has not, always false."""
        self.invalidated = self.invalidated or tuple(token(df, self.columns).first()) != self.seen
        return not self.invalidated
