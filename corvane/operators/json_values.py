"""JSON texts in the JVM: strict parsing, and all keys and values as rows.

Spark's parsers stop behind the first value and never tell repeated keys from broken
syntax. So a text is parsed within an array, before a string made from its own digest: what
follows the text can't be taken for part of it. The values are VARIANTs; a recursive
query opens all containers of a level at once, so its rounds are the depth of the
deepest text, whatever the number of texts.

Edge cases: a null text has no value and no problem; an empty or blank text is broken syntax;
keys that repeat at any depth are a problem of the whole text; numbers beyond a double are
infinite, as in the surveyed parser; NaN and leading zeros are syntax errors; an empty table
has no rows; keys of the input should be unique, as rows that repeat one are walked together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import canonical

#: Fixed: the most objects, members and items of a text.
MAX_NODES = 100_000
#: Spark stops recursive queries at a number of levels and rows, which would cut off data.
UNLIMITED = ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit")
OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "broken"}


def _guarded(json: Column) -> tuple[Column, Column]:
    """The text within an array, before its digest; and the digest."""
    mark = F.sha2(json.cast("binary"), 256)
    return F.concat(F.lit("["), json, F.lit(',"'), mark, F.lit('"]')), mark


def value(json: Column) -> Column:
    """The VARIANT of a strict JSON text, or null."""
    text, mark = _guarded(json)
    v = F.try_parse_json(text)
    whole = F.try_variant_get(v, "$[1]", "string").eqNullSafe(mark) & F.try_variant_get(v, "$[2]", "variant").isNull()
    return F.when(whole, F.try_variant_get(v, "$[0]", "variant"))


def problem(json: Column) -> Column:
    """null for strict JSON, else `syntax` or `repeated key`."""
    text, mark = _guarded(json)
    parts = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v array<string>, broken string", OPTIONS)
    valid = parts["broken"].isNull() & (F.size(parts["v"]) == 2) & F.get(parts["v"], F.lit(1)).eqNullSafe(mark)
    return F.when(json.isNull() | value(json).isNotNull(), None).when(F.coalesce(valid, F.lit(False)), "repeated key").otherwise("syntax")


def walk(records: DataFrame, key: str, json: str) -> DataFrame:
    """(key, depth, name, kind, text): every value of every strict text, from the whole one at depth 0 on.

    name is the key of an object's member; kind is object, array, string, number, boolean or null; text is that of strings.
    """
    spark = records.sparkSession
    for conf in UNLIMITED:
        spark.conf.set(conf, "-1")
    first = records.select(F.col(key).alias("id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("name"), value(F.col(json)).alias("value")).filter("value is not null")
    query = """WITH RECURSIVE walk(id, depth, name, value) AS (
        SELECT id, depth, name, value FROM {first}
        UNION ALL SELECT w.id, w.depth + 1, e.key, e.value FROM walk w, LATERAL variant_explode(w.value) AS e(pos, key, value)
    ) SELECT id, depth, name, value, schema_of_variant(value) AS kind FROM walk"""
    kind = F.regexp_extract("kind", r"^\w+", 0)
    named = F.when(kind.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN"), F.lower(kind)).when(kind == "VOID", "null").otherwise("number")
    text = F.when(kind == "STRING", F.try_variant_get("value", "$", "string"))
    return spark.sql(query, first=first).select(F.col("id").alias(key), "depth", "name", named.alias("kind"), text.alias("text"))


def summary(records: DataFrame, key: str, json: str) -> DataFrame:
    """(key, problem, nodes, keys, strings, depth) of each text; a text with a problem has no counts."""
    counted = (
        walk(records, key, json)
        .groupBy(key)
        .agg(F.count("*").alias("nodes"), F.count("name").alias("keys"), F.count("text").alias("strings"), F.max("depth").cast("long").alias("depth"))
    )
    judged = records.select(key, problem(F.col(json)).alias("problem")).join(counted, key, "left")
    return judged.select(key, F.coalesce("problem", F.when(F.col("nodes") > MAX_NODES, "too many nodes")).alias("problem"), "nodes", "keys", "strings", "depth")


def leaks(records: DataFrame, key: str, json: str, denied: canonical.Denied, wanted: tuple[str, ...] = canonical.FRAGMENT) -> DataFrame:
    """(key, leak): the kinds of leak in keys and strings of each text, and what keeps it from being read.

    Texts are judged once however often they stand, and plain ones that can hold no leak stay in the JVM.
    """
    walked = walk(records, key, json)
    texts = walked.select(key, F.explode(F.array_compact(F.array("name", "text"))).alias("t"))
    may = texts.filter(canonical.suspicious(F.col("t"))).withColumn("h", F.sha2(F.col("t").cast("binary"), 256))
    judged = may.groupBy("h").agg(F.min("t").alias("t")).select("h", canonical.leak_of(F.col("t"), denied, wanted).alias("leak")).filter("leak is not null")
    found = may.select(key, "h").join(judged, "h").select(key, "leak")
    unread = summary(records, key, json).filter("problem is not null").select(key, F.when(F.col("problem") == "syntax", "not JSON").otherwise(F.col("problem")).alias("leak"))
    return found.unionByName(unread).distinct()
