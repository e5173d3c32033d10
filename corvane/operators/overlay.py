"""Locale overlay: allow-listed fields of records replaced by translations.

An overlay is a long table (collection, id, field, text). Identity for the source
language. For others a missing record or a blank or missing text is a violation
(or, in strict mode, an error raised by the job that reads the result); fields
that a record doesn't have are skipped.

Edge cases: null ids have no translation; of several texts for one id and field the
smallest that isn't blank holds; repeated records are translated one by one; empty
tables give no rows; columns whose names start with two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_overlay(overlay: DataFrame, column: str) -> DataFrame:
    """The long table of a map<collection, map<id, map<field, text>>> column."""
    a = overlay.select(F.explode(column).alias("collection", "m"))
    b = a.select("collection", F.explode("m").alias("id", "m"))
    return b.select("collection", "id", F.explode("m").alias("field", "text"))


def localize(records: DataFrame, overlay: DataFrame, fields: list[str], locale: str, key: str = "id", source_locale: str = "ru", strict: bool = True, collection: str | None = None) -> DataFrame:
    """records with `fields` in another language; collection, if given, tells which part of the overlay is theirs."""
    if locale == source_locale:
        return records
    own = overlay.filter(F.col("field").isin(fields) & (F.lit(True) if collection is None else F.col("collection") == collection))
    one = own.groupBy("id", "field").agg(F.coalesce(F.min(F.when(F.length(F.trim("text")) > 0, F.col("text"))), F.min("text")).alias("text"))
    texts = one.groupBy(F.col("id").alias("__id")).agg(F.map_from_entries(F.collect_list(F.struct("field", "text"))).alias("__t"))
    joined = records.join(texts, F.col(key) == F.col("__id"), "left")
    out = []
    for c in records.columns:
        if c not in fields:
            out.append(F.col(c))
            continue
        text = F.element_at(F.coalesce("__t", F.create_map().cast("map<string,string>")), F.lit(c))
        fine = F.length(F.trim(text)) > 0
        value = F.when(fine, text)
        if strict:
            value = F.coalesce(value, F.raise_error(F.concat(F.lit(f"no {locale} text of {c} for "), F.col(key).cast("string"))).cast("string"))
        out.append(F.when(F.col(c).isNotNull(), value).alias(c))
    return joined.select(*out)


def gaps(records: DataFrame, overlay: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(id, field): where localize() would fail."""
    wanted = records.select(F.col(key).alias("id"), F.explode(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields])).alias("field")).filter("field is not null")
    there = overlay.filter(F.length(F.trim("text")) > 0).select("id", "field")
    return wanted.join(there, ["id", "field"], "left_anti")
