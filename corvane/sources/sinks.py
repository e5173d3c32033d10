"""Writers of reports: one JSON object a line, one file a row, and sitemaps.

Edge cases: an empty table gives no lines and a tree without files, but one empty sitemap;
null entries are left out of sitemaps' texts; entries that tie are in any order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import reports
from corvane.sources import release_tree

#: The most entries of a sitemap or an index, and how these begin.
SITEMAP_ENTRIES = 50_000
HEADS = {
    "urlset": '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:xhtml="http://www.w3.org/1999/xhtml">',
    "sitemapindex": '<?xml version="1.0" encoding="UTF-8"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">',
}


def write_json_lines(df: DataFrame, folder: str) -> None:
    """Each row as one line of JSON; null fields are left out."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("errorifexists").text(folder)


def sitemap_text(entries: DataFrame) -> DataFrame:
    """One row with the whole document of reports.sitemap() rows, in order of route and locale. For what may exceed SITEMAP_ENTRIES use sitemap_files()."""
    ordered = F.sort_array(F.collect_list(F.struct("route", "locale", "entry")))
    body = F.array_join(F.transform(ordered, lambda e: e["entry"]), "")
    return entries.agg(F.concat(F.lit(HEADS["urlset"]), body, F.lit("</urlset>")).alias("value"))


def sitemap_files(entries: DataFrame, origin: str, limit: int = SITEMAP_ENTRIES, nested: bool = True) -> DataFrame:
    """(path, content) of sitemaps over reports.sitemap() rows, in order of route and locale.

    Up to `limit` entries are one sitemap.xml; more are sitemap-1.xml and so on, and sitemap.xml is their index. As an
    index has the same limit, that many sitemaps have an index of their own, named by the one above. The protocol of
    sitemaps knows no index of indexes: without `nested`, sitemaps that one index can't name stand there without any. Positions
    come from sorted ranges, so a task holds the entries of one file. Without entries there is one empty sitemap.
    """
    level = reports.positioned(entries, F.col("route"), F.col("locale")).select((F.col("position") - 1).alias("at"), F.col("entry").alias("element"))
    spark, rows, prefix, kind = entries.sparkSession, [], "sitemap", "urlset"
    while True:
        count = level.agg(F.count("*")).first()[0]
        single = count <= limit
        name = F.lit("sitemap.xml") if single else F.concat(F.lit(f"{prefix}-"), (F.col("file") + 1).cast("string"), F.lit(".xml"))
        body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "element"))), lambda e: e["element"]), "")
        head, tail = HEADS[kind], f"</{kind}>"
        if count == 0:
            return spark.range(1).select(F.lit("sitemap.xml").alias("path"), F.lit(head + tail).alias("content"))
        files = level.groupBy(F.floor(F.col("at") / limit).alias("file")).agg(F.concat(F.lit(head), body, F.lit(tail)).alias("content"))
        rows.append(files.select(name.alias("path"), "content"))
        sitemaps = -(-count // limit)
        if single or not nested and sitemaps > limit:
            return reduce(DataFrame.unionByName, rows)
        place = F.concat(F.lit(f"<sitemap><loc>{origin}/{prefix}-"), (F.col("id") + 1).cast("string"), F.lit(".xml</loc></sitemap>"))
        level = spark.range(sitemaps).select(F.col("id").alias("at"), place.alias("element"))
        prefix, kind = f"{prefix}-index", "sitemapindex"


def write_files(files: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Each row (path, content) as a file of the release tree at a folder, committed as a whole; gives (path, bytes) of the tree's files.

    Files of a failed job or of an attempt that doesn't count are never seen (sources.release_tree). Paths should be unique:
    rows of one task that repeat one fail the job, release_tree.repeated() finds those of several. Null contents are empty
    files, and a null path is an error.
    """
    release_tree.write(files, folder, overwrite)
    written = release_tree.read(files.sparkSession, folder, content=False)
    return written.filter("kind = 'file'").select("path", F.col("size").alias("bytes"))
