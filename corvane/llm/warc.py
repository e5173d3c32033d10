"""WARC archives: a writer with revisit records and a splittable reader.

Writing: every record is a gzip member of its own. Of records with equal
payloads of at least `min_revisit_bytes` bytes, the one with the largest page_id
becomes a response; the others become revisits of it (headers only). Each task
writes files of its own name in the shared folder and returns a manifest row per
file; only files of the manifest count, so what a lost task left is never read.

Reading: a file is cut into byte ranges, one task row each; they are dealt to so
many tasks that each reads about TASK_BYTES. A task looks for the
gzip magic in its range, takes a place for a member only if a WARC header can be
decoded from it, and owns the records whose members start inside its range; the
last one is read beyond the end of the range. So any range size gives each
record exactly once. Records of all types are read (a warcinfo, a request and so on
have their block as payload), with header names in any case. A member with a WARC header that can't be decoded or parsed
to its end gives a row of record_type "broken" with its place; round_trip()
expects none and fails on one.

Files are reached through pyarrow's file systems, chosen by the folder's URI.

Edge cases: null html is an empty payload, null url gives no target header, a
null page_id is written as such and is a revisit if its payload has a page_id;
rows repeating the largest page_id of a payload are all responses; line breaks
in a url are percent-encoded; empty tables give no files and no rows. Only
page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import make_folder, scratch_path, stored

FILE_BYTES = 256 << 20
SPLIT_BYTES = 8 << 20
#: Bytes of archives that a task reads: one range.
TASK_BYTES = SPLIT_BYTES
SALTS = 32
MAGIC = b"\x1f\x8b\x08"
#: Bytes that are enough to decode the first line of a record from.
PROBE = 512
CHUNK = 1 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FOUND = "record_id string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, file string, offset long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, original: int | None) -> bytes:
    """One gzip member; a revisit if original is given."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if original is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if original is not None:
        head += [f"WARC-Refers-To: {name(original)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives; the manifest: file, bytes, records."""
    pages = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    pages = pages.withColumn("sum", F.sha1("html"))
    # One row per payload that occurs again; a payload may have a third of the rows, so the join is salted.
    again = pages.filter(F.octet_length("html") >= min_revisit_bytes).groupBy("sum").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1 and original is not null")
    again = again.select("sum", "original", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pages = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    pages = pages.join(again, ["sum", "salt"], "left")
    revisit = F.when(F.coalesce(F.col("page_id") < F.col("original"), F.lit(True)), F.col("original"))
    pages = pages.select("page_id", "url", "html", revisit.alias("original"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        fs, at = pafs.FileSystem.from_uri(folder)
        out, size, n, done = None, 0, 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{base}-{len(done):04d}.warc.gz"
                    out, size, n = fs.open_output_stream(f"{at}/{name}", compression=None), 0, 0
                size += out.write(member := record(*row)) or len(member)
                n += 1
                if size >= file_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["file", "bytes", "records"])

    make_folder(pages.sparkSession, folder)
    return stored(pages.mapInArrow(run, "file string, bytes long, records long"), "warc-manifest")


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with a blank goes on with the one before."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode(errors="replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _parse(member: bytes) -> dict[str, object]:
    """A record of any type: the payload is what an HTTP response holds, else the whole block; a revisit has none of its own."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = _fields(head.split(b"\r\n", 1)[1])
    kind, size = fields["warc-type"].lower(), int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("a block is shorter than its record says")
    payload, declared = rest[:size], None
    if kind in ("response", "revisit") and fields.get("content-type", "application/http").lower().startswith("application/http"):
        http, _, payload = payload.partition(b"\r\n\r\n")
        length = _fields(http).get("content-length", "")
        declared = int(length) if length.isdecimal() else None
    given = fields.get("warc-payload-digest")
    given = given and given.removeprefix("sha1:")
    own = kind != "revisit"
    page = lambda key: (lambda m: int(m[1]) if m else None)(re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(key, "")))
    return {
        "record_id": fields.get("warc-record-id"),
        "page_id": page("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": page("warc-refers-to"),
        "payload_digest": digest(payload) if own else given,
        "payload_bytes": len(payload) if own else declared,
        "payload": payload if own else None,
    }


def read_range(source: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, dict[str, object]]]:
    """(offset, record) of the records that start in [start, end)."""
    size = source.size()
    end = min(end, size)
    data, base = source.read_at(min(end + PROBE, size) - start, start), start
    at = start
    while at < end:
        at = data.find(MAGIC, at - base, end - base + len(MAGIC) - 1) + base
        if at < base:
            return
        try:
            valid = zlib.decompressobj(31).decompress(data[at - base : at - base + PROBE], 7) == b"WARC/1."
        except zlib.error:
            valid = False
        if not valid:
            at += 1
            continue
        unpack, parts, here = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof:
                chunk = data[here - base : here - base + CHUNK] if here < base + len(data) else source.read_at(min(CHUNK, size - here), here)
                if not chunk:
                    raise zlib.error("cut off")
                parts.append(unpack.decompress(chunk))
                here += len(chunk) - len(unpack.unused_data)
            found = _parse(b"".join(parts))
        except (zlib.error, KeyError, ValueError):
            yield at, {"record_type": "broken"}
            at += 1
            continue
        yield at, found
        at = here


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """A row per record of the files (columns file, bytes); without payloads their digests and sizes only."""
    splits = manifest.filter("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    # By number: ranges are short rows, which would otherwise be put together into one task.
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    splits = splits.repartition(max(1, -(-total // max(split_bytes, TASK_BYTES)), min(splits.count(), spark.sparkContext.defaultParallelism)))
    names = [x.split(" ")[0] for x in FOUND.split(", ")]
    kinds = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split(" ")[1]]) for n, x in zip(names, FOUND.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns)):
                fs, at = pafs.FileSystem.from_uri(file)
                rows, held = [], 0
                with fs.open_input_file(at) as source:
                    for offset, found in read_range(source, start, start + split_bytes):
                        held += len(found.get("payload") or b"") if payloads else 0
                        rows.append(found | {"file": file, "offset": offset} | ({} if payloads else {"payload": None}))
                        if len(rows) >= 2000 or held >= 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return splits.mapInArrow(run, FOUND)


def round_trip(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """The op10 digest: pages written to archives in the shared folder and read back."""
    manifest = write_archives(pages, scratch_path(spark, "warc"), min_revisit_bytes)
    whole = F.when(F.col("record_type") == "broken", F.raise_error(F.concat(F.lit("broken record in "), "file"))).otherwise(F.col("record_type"))
    return read_archives(spark, manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", whole.alias("record_type"), "refers_to")
