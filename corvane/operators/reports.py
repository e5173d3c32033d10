"""Ordered reports over records: groups by a fixed list of keys, orders, pivots, cross tables.

Edge cases: null keys belong to no group of a list; ties of an order are placed in any
order (by numbered(): of a hash of their columns), so give a total one; of several values for one cell of attributes() the smallest
holds; null fields have no row in layers(); empty tables give no rows (citation() of
nulls leaves them out); columns whose names start with two underscores are reserved.
numbered() and positioned() are for tables and keys of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import scans
from corvane.sources.scratch import stored


def key_table(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """(ordinal, name) of a fixed list, in one row per key."""
    return df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(k) for k in keys])).alias("ordinal", name))


def grouped(records: DataFrame, key: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """A row per key of the list that has records, in the list's order, with a padded count."""
    counts = records.filter(F.col(key).isin(keys)).groupBy(key).agg(F.count("*").alias("n"), *aggregates)
    return key_table(records, key, keys).join(counts, key).withColumn("padded", T.pad_left(F.col("n"), 2))


def newest_first(year: Column, title: Column) -> list[Column]:
    """Year descending, unknown last; then title by a locale's rules."""
    return [F.desc_nulls_last(year), F.collate(title, "UNICODE")]


def by_code_units(name: Column) -> Column:
    return T.code_unit_key(name)


def by_depth(path: Column) -> list[Column]:
    return [F.size(F.split(path, "/")), T.code_unit_key(path)]


def top(records: DataFrame, n: int, *order: Column) -> DataFrame:
    return records.orderBy(*order).limit(n)


def positioned(records: DataFrame, *order: Column) -> DataFrame:
    """records with their position (from 1) in a total order over the whole table, without one task that sees all rows.

    Rows are dealt by ranges of the order and numbered within their range; the counts of the ranges (one row each) give
    where a range starts. Ties within the order are numbered in any order.
    """
    keys = [f"__k{i}" for i in range(len(order))]
    ranged = stored(records.withColumns(dict(zip(keys, order))).repartitionByRange(*keys).withColumn("__p", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*keys)))
    before = F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("__p").agg(F.count("*").alias("__c")).select("__p", F.coalesce(before, F.lit(0)).alias("__s"))
    return inside.join(F.broadcast(starts), "__p").select(*records.columns, (F.col("__s") + F.col("__n")).alias("position"))


def lookup(records: DataFrame, key: str, wanted: object, *order: Column, fallback: bool = True) -> DataFrame:
    """The record of a key; without one the first in order, or no row where that isn't wanted."""
    if not fallback:
        return records.filter(F.col(key) == wanted)
    return records.orderBy(F.coalesce(F.col(key) == wanted, F.lit(False)).desc(), *order).limit(1)


def citation(authors: Column, title: Column, year: Column, locator: Column) -> Column:
    """Authors, title, year (n.d. for none), and a locator where there is one."""
    return F.concat_ws(", ", F.array_join(authors, ", "), title, F.coalesce(year.cast("string"), F.lit("n.d.")), F.when(F.length(locator) > 0, locator))


def numbered(records: DataFrame, *order: Column, partition: list[str] | None = None) -> DataFrame:
    """With position (from 1) and its literal-zero label; keys may be of any size (scans.scan)."""
    return scans.scan(records, partition or [], list(order), number="position").withColumn("label", T.numbered(F.col("position")))


def attributes(records: DataFrame, key: str, fields: list[str], ids: list[object]) -> DataFrame:
    """A row per field, a column per id."""
    long = records.select(key, F.expr(f"stack({len(fields)}, " + ", ".join(f"'{f}', cast({f} as string)" for f in fields) + ") as (attribute, value)"))
    return long.groupBy("attribute").pivot(key, ids).agg(F.min("value"))


def layers(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row per record and field that isn't null."""
    return records.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("layer"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(key, "x.layer", "x.value").filter("value is not null")


def sitemap(routes: DataFrame, origin: str, locales: tuple[str, ...]) -> DataFrame:
    """(route, locale, entry): a url element for each route and locale, with all alternates."""
    by = routes.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in locales])).alias("locale"))
    link = lambda loc: F.concat(F.lit(origin), F.when(loc != locales[0], F.concat(F.lit("/"), loc)).otherwise(""), F.col("route"))
    alternates = F.concat(*[F.concat(F.lit(f'<xhtml:link rel="alternate" hreflang="{x}" href="'), T.escape_html(link(F.lit(x))), F.lit('"/>')) for x in locales])
    entry = F.concat(F.lit("<url><loc>"), T.escape_html(link(F.col("locale"))), F.lit("</loc>"), alternates, F.lit("</url>"))
    return routes.select("route").crossJoin(by).select("route", "locale", entry.alias("entry"))
