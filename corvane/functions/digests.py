"""Framing and digests as built-in expressions.

Edge cases: a null content has a null digest by itself and counts as empty within a release; empty
contents are framed as such; files that repeat a path count as often as they stand, in any
order among themselves; a release without files has no row; contents pass their hash one by
one, so a release may have any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame(data: Column) -> Column:
    """The bytes behind their length as eight bytes, big-endian."""
    data = data.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data).cast("long")), 16, "0")), data)


def sha256(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def ordered_digest(files: Column, domain: str) -> Column:
    """SHA-256 over the domain and the framed path and content of array<struct<path,content>>, by UTF-16 order of paths.

    An aggregate of one release, whose size a manifest bounds; for larger tables
    digest per partition key and fold those digests (fold_digest).
    """
    keyed = F.transform(files, lambda f: F.struct(F.encode(f["path"], "UTF-16BE").alias("key"), f["path"].alias("path"), f["content"].alias("content")))
    parts = F.transform(F.array_sort(keyed), lambda f: F.hex(F.concat(frame(f["path"]), frame(f["content"]))))
    return F.sha2(F.concat(F.lit(domain).cast("binary"), F.unhex(F.array_join(parts, ""))), 256)


def fold_digest(digests: Column, domain: str) -> Column:
    """SHA-256 over the domain and hex digests in array order: the second level of an ordered digest."""
    return F.sha2(F.concat(F.lit(domain).cast("binary"), F.array_join(digests, "").cast("binary")), 256)


def release_digest(files: Column, manifest_json: Column, domain: str) -> Column:
    """ordered_digest() with the framed canonical JSON of the manifest (without its binding) after the files."""
    keyed = F.transform(files, lambda f: F.struct(F.encode(f["path"], "UTF-16BE").alias("key"), f["path"].alias("path"), f["content"].alias("content")))
    parts = F.transform(F.array_sort(keyed), lambda f: F.hex(F.concat(frame(f["path"]), frame(f["content"]))))
    return F.sha2(F.concat(F.lit(domain).cast("binary"), F.unhex(F.array_join(parts, "")), frame(manifest_json)), 256)


def streamed_digests(files: DataFrame, domain: str, first: DataFrame | None = None) -> DataFrame:
    """(release, digest) of files (release, path, content): ordered_digest() of each release, read file by file.

    first (release, content) may hold a framed text that goes before the files. The files of a release are sorted by the
    UTF-16 order of their paths and pass one hash in that order, so a task holds a batch of files, not a release; releases
    are dealt over the tasks. A release without files has no row; rows repeating a path count as often as they stand.
    """
    rows = files.select("release", F.lit(1).alias("turn"), F.encode("path", "UTF-16BE").alias("key"), F.col("path").cast("binary").alias("path"), F.col("content").cast("binary").alias("content"))
    if first is not None:
        rows = rows.unionByName(first.select("release", F.lit(0).alias("turn"), F.lit(b"").alias("key"), F.lit(b"").alias("path"), F.col("content").cast("binary").alias("content")))
    dealt = rows.repartition("release").sortWithinPartitions("release", "turn", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, filed = None, None, False
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([state.hexdigest()])], names=["release", "digest"])
        for batch in batches:
            for k in range(batch.num_rows):
                release, turn, _, path, content = (batch.column(c)[k].as_py() for c in range(5))
                if state is None or release != now:
                    if state is not None and filed:
                        yield done()
                    now, state, filed = release, hashlib.sha256(domain.encode()), False
                for part in ((path, content or b"") if turn else (content or b"",)):
                    state.update(len(part).to_bytes(8, "big") + part)
                filed = filed or bool(turn)
        if state is not None and filed:
            yield done()

    return dealt.select(F.col("release").cast("string").alias("release"), "turn", "key", "path", "content").mapInArrow(run, "release string, digest string")
