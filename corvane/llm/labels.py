"""A bounded sample of labelled rows to learn from.

Edge cases: null ids and labels don't count; of several labels of an id the largest holds;
ids of equal hash are taken by id; null texts are empty ones; a document that repeats its
id is in the sample as often as it stands; without labelled rows the sample is empty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows a model is fitted on, at most; chosen by a hash of the id.
SAMPLE_ROWS = 20_000


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod modulus; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def sample(labels: DataFrame, column: str, modulus: int, held_out: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, label 0/1) of at most `rows` labelled ids outside the held-out remainder.

    Null ids and labels don't count; of several labels of an id the largest holds.
    """
    usable = labels.select("doc_id", F.col(column).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (remainder(F.col("doc_id"), modulus) != held_out))
    chosen = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    return chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def with_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(text, label) of the sampled documents; the sample is bounded, so it is broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "label", "doc_id")


def distinct(found: DataFrame) -> DataFrame:
    """with_texts() without repeated and nearly repeated texts: a text stays if it is the first of its smallest word triple under each of three orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signs = []
            for text in b.column(0).to_pylist():
                words = re.findall(r"\w+", text.lower())
                triples = [" ".join(words[k : k + 3]).encode() for k in range(max(1, len(words) - 2))]
                h = np.array([zlib.crc32(t) for t in triples], np.uint64)
                signs.append([int((h * np.uint64(m) % np.uint64(4294967291)).min()) for m in (1, 2654435761, 40503)])
            cols = [pa.array(c, pa.int64()) for c in zip(*signs)] if signs else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=["text", "label", "doc_id", "s0", "s1", "s2"])

    signed = found.select("text", "label", "doc_id").mapInArrow(run, "text string, label int, doc_id long, s0 long, s1 long, s2 long")
    first = [(F.min("doc_id").over(Window.partitionBy(s)) == F.col("doc_id")).alias(f"f{s}") for s in ("s0", "s1", "s2")]
    return signed.select("text", "label", "doc_id", *first).filter("fs0 and fs1 and fs2").select("text", "label", "doc_id")
