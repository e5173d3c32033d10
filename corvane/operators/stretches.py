"""Canonical forms and leaks over a dictionary of suspicious stretches.

Decoding never crosses a blank: no code holds one, and composition stops there. So a text
is cut at its blanks in the JVM. Stretches that are their own canonical form stay there;
of the others each different one is decoded once, however often and in however many texts it
stands, and joined back by its hash. The join is salted, as one stretch may stand in
any share of the texts; of a text only the number and place of its suspicious stretches
is moved, and texts without any aren't moved at all.

An error of a text is the one that decoding it as a whole would meet first: the earliest
step of any stretch, and of these the leftmost.

Edge cases: a null text has neither value nor error; an empty one is its own form; texts may
have any length, and so may stretches; keys must be unique (rows that repeat one get the
stretches of each other) and not null, and rows without one are judged as if they had one each;
an empty table gives no rows; columns whose names start with two underscores are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import canonical

#: Tasks over which the places of one stretch are dealt when they get its form.
SALTS = 16
#: Characters that decoding and folding leave as they are, wherever they stand: ASCII but for controls, Latin and Cyrillic
#: letters without compatibility forms, quotation marks and dashes, and the common ideographs.
INERT = r"\A[\x09\x0A\x0D\x20-\x7E¡§«»¿-ıĴ-ľŁ-ňŊ-žЀ-ҁҊ-ԯ–—‘-„、。一-鿿]*\z"
#: What is decoded where it stands.
CODE = rf"%[0-9A-Fa-f]{{2}}|&(?i:#x[0-9a-f]+|#[0-9]+|{'|'.join(canonical.ENTITIES)});"
LAST = 1 << 20


def inert(text: Column) -> Column:
    """Whether a text is its own canonical form, as the JVM can tell."""
    return text.rlike(INERT) & ~text.rlike(CODE)


def ranked(text: str) -> tuple[str | None, str | None, int]:
    """(value, error, step): canonical() of a stretch, and at which step of decoding its error comes up."""
    step = 0
    try:
        now = canonical.skeleton(text)
        for _ in range(canonical.MAX_ROUNDS + 1):
            after = now
            for mark, decode in (("%", canonical.decode_percents), ("&", canonical.decode_entities)):
                step += 1
                if mark in after:
                    after = decode(after)
                    step += 1
                    after = canonical.skeleton(after)
                else:
                    step += 1
            if after == now:
                return now, None, 0
            before, now = now, after
        if canonical.encoded(before):
            return None, "encoded more often than allowed", LAST
        return before, None, 0
    except canonical.Unsafe as e:
        return None, str(e), step


def dictionary(stretches: DataFrame) -> DataFrame:
    """(hash, value, error, step) of distinct stretches (hash, stretch)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [ranked(s) for s in batch["stretch"]]
            yield pd.DataFrame({"hash": batch["hash"], "value": [f[0] for f in found], "error": [f[1] for f in found], "step": [f[2] for f in found]})

    return stretches.mapInPandas(run, "hash string, value string, error string, step int")


def places(records: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, hash, stretch) of the suspicious stretches of texts that aren't inert as a whole."""
    parts = records.filter(F.col(text).isNotNull() & ~inert(F.col(text))).select(key, F.posexplode(F.split(text, " ")).alias("at", "stretch"))
    return parts.filter(~inert(F.col("stretch"))).withColumn("hash", F.sha2(F.col("stretch").cast("binary"), 256))


def distinct_stretches(found: DataFrame) -> DataFrame:
    return found.groupBy("hash").agg(F.min("stretch").alias("stretch"))


def canonical_texts(records: DataFrame, key: str, text: str) -> DataFrame:
    """records with value and error: canonical() of the text column."""
    marked = records.withColumn("__inert", F.col(text).isNull() | inert(F.col(text)) | F.col(key).isNull())
    done = marked.filter("__inert and " + f"`{key}` is not null").drop("__inert").withColumns({"value": F.col(text), "error": F.lit(None).cast("string")})
    keyless = records.filter(F.col(key).isNull()).withColumn("__c", canonical.canonical_text(F.col(text))).withColumns({"value": F.col("__c.value"), "error": F.col("__c.error")}).drop("__c")
    found = places(records.filter(F.col(key).isNotNull()), key, text)
    forms = dictionary(distinct_stretches(found)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = found.select(F.col(key).alias("__key"), "at", "hash").withColumn("salt", F.pmod(F.xxhash64("__key", "at"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(forms, ["hash", "salt"])
    fixed = joined.groupBy("__key").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("error").isNull(), F.struct("at", "value")))).alias("__forms"),
        F.min(F.when(F.col("error").isNotNull(), F.struct("step", "at", "error"))).alias("__first"),
    )
    rest = marked.filter("not __inert").drop("__inert").join(fixed, F.col(key) == F.col("__key"))
    whole = F.array_join(F.transform(F.split(text, " "), lambda s, i: F.coalesce(F.col("__forms")[i], s)), " ")
    rest = rest.withColumns({"value": F.when(F.col("__first").isNull(), whole), "error": F.col("__first.error")}).drop("__key", "__forms", "__first")
    return done.unionByName(keyless).unionByName(rest)


def leaks(records: DataFrame, key: str, text: str, denied: canonical.Denied, wanted: tuple[str, ...] = canonical.PROSE) -> DataFrame:
    """(key, leak): leak() of the text column's canonical form; only texts whose form can hold one are sent on."""
    forms = canonical_texts(records.select(key, text), key, text)
    known = F.when(F.col("error").isNotNull(), F.element_at(F.split("error", ":"), 1))
    # The form is canonical, so what is left to judge is its plain text; only controls were an error before.
    return forms.select(key, F.coalesce(known, canonical.settled_leak_of(F.col("value"), denied, wanted)).alias("leak"))
