"""Release trees as a data source, read and written by tasks: format ``release_tree``.

Reading gives a row for each file and folder below ``path``: its identity, its bytes,
and as ``problem`` what is wrong with it. A partition is a folder: the driver lists
folders to ``levels`` deep and tasks the rest; ``slices`` deals the files of every
folder over several tasks. Filters by path, prefix, kind and size are pushed: folders that
can't hold such a path aren't opened, and other files are neither looked up nor read. With
``content`` false no file is opened at all.

Bytes are read stably: the file must be the plain, single-linked one that was listed, as
long as its metadata says, and the same after reading. Links, special files, files beyond
``limit`` and what changed or vanished meanwhile are rows with a problem and no bytes.

Writing takes rows (path, content). Each attempt of a task writes into a folder of its own
and sends one message with counts and a digest; the commit, one file that names the folders
of the attempts that count, is written last. So a failed job, a killed attempt or one
that ran twice leaves nothing that a reader sees. Appending adds folders to the commit;
overwriting names new ones only.

Edge cases: a root that isn't there has no rows; null contents are empty files; null or
unsafe paths fail the job, and so do rows of one task that repeat a path (`repeated` finds
those of different tasks); names that aren't UTF-8 are problems. On stores without links and
inodes these fields are null and identity is size and time. The commit of two jobs at
once is that of the last.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import stat
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

#: Fixed limits of a release.
MAX_FILE_BYTES = 64 * 1024 * 1024
MAX_DEPTH = 64
IDENTITY = ("dev", "ino", "mode", "nlink", "size", "mtime_ns", "ctime_ns")
SCHEMA = "path string, kind string, " + ", ".join(f"{x} long" for x in IDENTITY) + ", part string, problem string, content binary"
ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), *((x, pa.int64()) for x in IDENTITY), ("part", pa.string()), ("problem", pa.string()), ("content", pa.binary())])
#: Bytes and rows of a batch that a task gives on.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000
COMMIT, PARTS = "_release.json", "_parts"
LINK, LINKED, SPECIAL, LARGE, DEEP, NAME = "link", "linked more than once", "not a plain file", "beyond the limit", "too deep", "name isn't UTF-8"
CHANGED, GONE, LISTED = "changed while it was read", "vanished", "changed while it was listed"

Identity = tuple  # in the order of IDENTITY; None where a store doesn't know


class LocalStore:
    """A folder that all machines see as local."""

    def __init__(self, root: str) -> None:
        self.root, self.made = root, ""

    def at(self, path: str) -> str:
        return f"{self.root}/{path}" if path else self.root

    @staticmethod
    def _identity(s: os.stat_result) -> Identity:
        return s.st_dev, s.st_ino, s.st_mode, s.st_nlink, s.st_size, s.st_mtime_ns, s.st_ctime_ns

    def look(self, path: str) -> tuple[str, Identity] | None:
        """(kind, identity) of what is there."""
        try:
            s = os.lstat(self.at(path))
        except (FileNotFoundError, NotADirectoryError):
            return None
        kinds = ((stat.S_ISREG, "file"), (stat.S_ISDIR, "directory"), (stat.S_ISLNK, "link"))
        return next((kind for test, kind in kinds if test(s.st_mode)), "other"), self._identity(s)

    def names(self, folder: str) -> list[tuple[str, bool]]:
        """(name, whether it is a folder) of what a folder holds."""
        try:
            with os.scandir(self.at(folder)) as found:
                return [(e.name, e.is_dir(follow_symlinks=False)) for e in found]
        except FileNotFoundError:
            return []

    def read(self, path: str, expected: Identity) -> tuple[bytes | None, str | None]:
        """(bytes, problem) of a file that must be the expected one before and after."""
        try:
            handle = os.open(self.at(path), os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
        except FileNotFoundError:
            return None, GONE
        except OSError:
            return None, CHANGED
        try:
            opened = os.fstat(handle)
            if self._identity(opened) != expected:
                return None, CHANGED
            parts, left = [], opened.st_size + 1  # a byte more than there should be
            while left and (part := os.read(handle, left)):
                parts.append(part)
                left -= len(part)
            after = os.fstat(handle)
        finally:
            os.close(handle)
        data, now = b"".join(parts), self.look(path)
        same = len(data) == opened.st_size and self._identity(after) == expected and now is not None and now[1] == expected
        return (data, None) if same else (None, CHANGED)

    def write(self, path: str, data: bytes) -> None:
        """A new file; one that is there is an error. The folder of the file before isn't made again."""
        folder = os.path.dirname(self.at(path))
        if folder != self.made:
            os.makedirs(folder, exist_ok=True)
            self.made = folder
        with open(self.at(path), "xb", buffering=0) as out:
            left = memoryview(data)
            while left:
                left = left[out.write(left) :]

    def replace(self, path: str, data: bytes) -> None:
        """A file that appears as a whole, in place of one that may be there."""
        held = f"{self.at(path)}.{uuid.uuid4().hex}.tmp"
        os.makedirs(os.path.dirname(held), exist_ok=True)
        with open(held, "wb") as out:
            out.write(data)
        os.replace(held, self.at(path))

    def get(self, path: str) -> bytes | None:
        try:
            return Path(self.at(path)).read_bytes()
        except FileNotFoundError:
            return None

    def delete(self, folder: str) -> None:
        shutil.rmtree(self.at(folder), ignore_errors=True)


class ObjectStore:
    """A folder of a store that has files and folders but neither links nor inodes."""

    def __init__(self, fs: pafs.FileSystem, root: str) -> None:
        self.fs, self.root = fs, root.rstrip("/")

    def at(self, path: str) -> str:
        return f"{self.root}/{path}" if path else self.root

    @staticmethod
    def _identity(info: pafs.FileInfo) -> Identity:
        return None, None, None, None, info.size, info.mtime_ns, None

    def look(self, path: str) -> tuple[str, Identity] | None:
        info = self.fs.get_file_info(self.at(path))
        kinds = {pafs.FileType.File: "file", pafs.FileType.Directory: "directory", pafs.FileType.Unknown: "other"}
        return (kinds[info.type], self._identity(info)) if info.type in kinds else None

    def names(self, folder: str) -> list[tuple[str, bool]]:
        found = self.fs.get_file_info(pafs.FileSelector(self.at(folder), allow_not_found=True))
        return [(i.base_name, i.type == pafs.FileType.Directory) for i in found]

    def read(self, path: str, expected: Identity) -> tuple[bytes | None, str | None]:
        for check in (False, True):
            now = self.look(path)
            if now is None:
                return None, GONE
            if now[1] != expected:
                return None, CHANGED
            if not check:
                with self.fs.open_input_stream(self.at(path), compression=None) as f:
                    data = f.read()
        return (data, None) if len(data) == expected[4] else (None, CHANGED)

    def write(self, path: str, data: bytes) -> None:
        if self.look(path) is not None:
            raise FileExistsError(path)
        self.fs.create_dir(self.at(path).rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(self.at(path), compression=None) as out:
            out.write(data)

    def replace(self, path: str, data: bytes) -> None:
        held = f"{self.at(path)}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(held.rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(held, compression=None) as out:
            out.write(data)
        self.fs.move(held, self.at(path))

    def get(self, path: str) -> bytes | None:
        if self.look(path) is None:
            return None
        with self.fs.open_input_stream(self.at(path), compression=None) as f:
            return f.read()

    def delete(self, folder: str) -> None:
        if self.look(folder) is not None:
            self.fs.delete_dir(self.at(folder))


def store_of(root: str) -> LocalStore | ObjectStore:
    parts = urlsplit(str(root))
    if parts.scheme in ("", "file"):
        return LocalStore((unquote(parts.path) if parts.scheme else str(root)).rstrip("/") or "/")
    return ObjectStore(*pafs.FileSystem.from_uri(str(root)))


def commit_of(store: LocalStore | ObjectStore) -> dict | None:
    """What the last commit says, if the tree was written in this format."""
    data = store.get(COMMIT)
    return None if data is None else json.loads(data)


def safe_path(path: str | None) -> bool:
    return bool(path) and all(p not in ("", ".", "..") for p in path.split("/")) and "\0" not in path and path.split("/")[0] not in (COMMIT, PARTS)


def _units(name: str) -> bytes:
    return name.encode("utf-16-be", "surrogatepass")


# --- reading


@dataclass
class Folder(InputPartition):
    """A folder, all that is below it if deep, and which of the slices of its files. part: the attempt that wrote it."""

    folder: str
    deep: bool
    slice: int
    part: str | None = None


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.content = str(options.get("content", "true")).lower() != "false"
        self.limit = int(options.get("limit", MAX_FILE_BYTES))
        self.levels, self.slices = int(options.get("levels", 1)), max(1, int(options.get("slices", 1)))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take filters by path, kind and size; the others stay with Spark."""
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in", StringStartsWith: "starts", IsNotNull: "there"}
        known = {"path": ("=", "in", "starts", "there"), "kind": ("=", "in", "there"), "size": ("=", "in", ">", ">=", "<", "<=", "there")}
        for f in filters:
            sign = signs.get(type(f))
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if sign in known.get(column, ()):
                self.tests.append((column, sign, getattr(f, "value", None)))
            else:
                yield f

    def _wanted(self, column: str, value: object) -> bool:
        for c, sign, x in self.tests:
            if c != column:
                continue
            if value is None:
                return False
            holds = {"=": lambda: value == x, "in": lambda: value in x, "starts": lambda: value.startswith(x), "there": lambda: True, ">": lambda: value > x, ">=": lambda: value >= x, "<": lambda: value < x, "<=": lambda: value <= x}
            if not holds[sign]():
                return False
        return True

    def _may_hold(self, folder: str) -> bool:
        """Whether a wanted path can lie below a folder."""
        if not folder:
            return True
        inside = folder + "/"
        for column, sign, x in self.tests:
            if column != "path" or sign == "there":
                continue
            if sign == "starts" and not (inside.startswith(x) or x.startswith(inside)):
                return False
            if sign in ("=", "in") and not any(v is not None and v.startswith(inside) for v in ([x] if sign == "=" else x)):
                return False
        return True

    def partitions(self) -> list[Folder]:
        store = store_of(self.root)
        commit = commit_of(store)
        if commit is not None:
            found = [Folder("", True, k, p["name"]) for p in commit["parts"] for k in range(self.slices)]
        elif any(name == PARTS for name, _ in store.names("")):
            found = []  # written, but never committed
        else:
            folders, found = [("", 0)], []
            for folder, level in folders:
                deep = level >= self.levels
                found += [Folder(folder, deep, k) for k in range(self.slices)]
                if not deep:
                    below = sorted((f"{folder}/{n}".lstrip("/") for n, is_folder in store.names(folder) if is_folder), key=_units)
                    folders += [(b, level + 1) for b in below if self._may_hold(b)]
        return found or [Folder("", False, -1)]

    def read(self, p: Folder) -> Iterator[pa.RecordBatch]:
        if p.slice < 0:
            return
        store = store_of(self.root if p.part is None else f"{self.root.rstrip('/')}/{PARTS}/{p.part}")
        held, size = [], 0
        for row in self._walk(store, p):
            held.append(row)
            size += len(row[-1] or b"") + 200
            if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)

    def _walk(self, store: LocalStore | ObjectStore, p: Folder) -> Iterator[tuple]:
        mine = lambda path: zlib.crc32(path.encode("utf-8", "surrogateescape")) % self.slices == p.slice
        todo: list[tuple[str, bool]] = [(p.folder, p.deep)]
        while todo:
            folder, deep = todo.pop()
            before = store.look(folder) if folder else None
            if folder and before is None:
                continue
            deep_enough = folder.count("/") + 1 < MAX_DEPTH
            names = store.names(folder) if deep_enough else []
            for name, is_folder in sorted(names, key=lambda n: n[0].encode("utf-8", "surrogateescape")):
                path = f"{folder}/{name}" if folder else name
                if is_folder:
                    if deep and self._may_hold(path):
                        todo.append((path, True))
                    elif not self._may_hold(path) and mine(path) and (found := store.look(path)) is not None:
                        yield from self._row(path, found, None, p.part)  # nothing below it is wanted, but it may be so itself
                elif mine(path) and self._wanted("path", path):
                    yield from self._file(store, path, p.part)
            if folder and p.part is None and mine(folder):
                after = store.look(folder)
                problem = DEEP if not deep_enough else None if after == before else LISTED
                yield from self._row(folder, before, problem, None)

    def _row(self, path: str, found: tuple[str, Identity], problem: str | None, part: str | None, content: bytes | None = None) -> Iterator[tuple]:
        kind, identity = found
        if part is not None and kind == "directory":
            return  # folders of a commit are what its files need
        if self._wanted("path", path) and self._wanted("kind", kind) and self._wanted("size", identity[4]):
            try:
                path.encode()
            except UnicodeEncodeError:
                path, problem, content = path.encode("utf-8", "surrogateescape").decode(errors="replace"), NAME, None
            yield path, kind, *identity, part, problem, content

    def _file(self, store: LocalStore | ObjectStore, path: str, part: str | None) -> Iterator[tuple]:
        found = store.look(path)
        if found is None:
            yield from self._row(path, ("file", (None,) * len(IDENTITY)), GONE, part)
            return
        kind, identity = found
        if not (self._wanted("kind", kind) and self._wanted("size", identity[4])):
            return
        content, problem = None, plain_problem(kind, identity, self.limit)
        if problem is None and self.content:
            content, problem = store.read(path, identity)
        yield from self._row(path, found, problem, part, content)


def plain_problem(kind: str, identity: Identity, limit: int) -> str | None:
    """Why a file isn't read, from its metadata alone."""
    if kind == "link":
        return LINK
    if kind != "file":
        return SPECIAL
    if identity[3] not in (1, None):
        return LINKED
    return LARGE if identity[4] > limit else None


# --- writing


@dataclass
class Written(WriterCommitMessage):
    """What one attempt wrote: its folder, files and bytes, and the sum of its files' marks."""

    name: str
    files: int
    size: int
    digest: int


def file_mark(path: str, data: bytes) -> int:
    """60 bits of a digest over path and content; sums of marks don't depend on the order of files."""
    raw = path.encode()
    return int(hashlib.sha256(len(raw).to_bytes(8, "big") + raw + data).hexdigest()[:15], 16)


def file_mark_column(path: Column, content: Column) -> Column:
    """file_mark() of columns."""
    raw = path.cast("binary")
    framed = F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")), raw, content)
    return F.conv(F.substring(F.sha2(framed, 256), 1, 15), 16, 10).cast("decimal(38,0)")


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.root, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        name = f"{self.job}/{context.partitionId():06d}-{context.taskAttemptId()}"
        store = store_of(f"{self.root.rstrip('/')}/{PARTS}/{name}")
        out = Written(name, 0, 0, 0)
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                if not safe_path(path):
                    raise ValueError(f"not a path for a file: {path!r}")
                data = content.as_py() or b""
                data = data.encode() if isinstance(data, str) else data
                store.write(path, data)
                out.files, out.size, out.digest = out.files + 1, out.size + len(data), out.digest + file_mark(path, data)
        return out

    def commit(self, messages: list[Written | None]) -> None:
        store = store_of(self.root)
        before = commit_of(store)
        new = [{"name": m.name, "files": m.files, "bytes": m.size, "digest": str(m.digest)} for m in messages if m is not None and m.files]
        kept = [] if self.overwrite or before is None else before["parts"]
        parts = kept + new
        total = {"files": sum(p["files"] for p in parts), "bytes": sum(p["bytes"] for p in parts), "parts": parts}
        store.replace(COMMIT, json.dumps(total, separators=(",", ":")).encode())  # the one moment at which all of it is visible
        named = {p["name"] for p in parts}
        jobs = {self.job} | {p["name"].split("/")[0] for p in (before["parts"] if before else [])}
        for job in jobs:  # attempts that don't count, and what was overwritten
            for attempt, _ in store.names(f"{PARTS}/{job}"):
                if f"{job}/{attempt}" not in named:
                    store.delete(f"{PARTS}/{job}/{attempt}")

    def abort(self, messages: list[Written | None]) -> None:
        store_of(self.root).delete(f"{PARTS}/{self.job}")


class ReleaseTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "release_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        if not {"path", "content"} <= set(schema.names):
            raise ValueError("a release tree is written from columns path and content")
        return TreeWriter(self.options, overwrite)


# --- what a user calls


def _ready(spark: SparkSession) -> None:
    spark.dataSource.register(ReleaseTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, root: str | Path, content: bool = True, limit: int = MAX_FILE_BYTES, levels: int = 1, slices: int = 1) -> DataFrame:
    """Rows of SCHEMA for a tree; without content only metadata is read."""
    _ready(spark)
    options = {"path": str(root), "content": str(content).lower(), "limit": str(limit), "levels": str(levels), "slices": str(slices)}
    found = spark.read.format("release_tree").options(**options).load()
    return found if content else found.drop("content")


def write(files: DataFrame, root: str | Path, overwrite: bool = False) -> None:
    """Write (path, content) rows as files and commit them."""
    _ready(files.sparkSession)
    files.select("path", F.col("content").cast("binary").alias("content")).write.format("release_tree").mode("overwrite" if overwrite else "append").save(str(root))


def contents(metadata: DataFrame, root: str | Path, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """The rows of a metadata scan with their bytes, each read stably against the identity that was listed, and its problem.

    Only rows without a problem are opened. This is the second phase where the first decides what is read at all.
    """
    base = str(root).rstrip("/")
    names = metadata.columns
    columns = [names.index(c) for c in ("path", "part", "problem", "kind", *IDENTITY)]
    schema = StructType([f for f in metadata.schema if f.name != "problem"]).add("problem", "string").add("content", "binary")
    rest = [k for k, n in enumerate(names) if n != "problem"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in columns))
            start, size, problems, data = 0, 0, [], []

            def given() -> pa.RecordBatch:
                kept = [batch.column(k).slice(start, len(problems)) for k in rest]
                return pa.RecordBatch.from_arrays([*kept, pa.array(problems, pa.string()), pa.array(data, pa.binary())], names=[*(names[k] for k in rest), "problem", "content"])

            for path, part, problem, kind, *identity in rows:
                content, problem = None, problem or plain_problem(kind, tuple(identity), limit)
                if problem is None:
                    store = store_of(base if part is None else f"{base}/{PARTS}/{part}")
                    content, problem = store.read(path, tuple(identity))
                problems.append(problem)
                data.append(content)
                size += len(content or b"")
                if size >= BATCH_BYTES:
                    yield given()
                    start, size, problems, data = start + len(problems), 0, [], []
            if problems:
                yield given()

    return metadata.mapInArrow(run, schema)


def violations(tree: DataFrame) -> DataFrame:
    """(check_id, record_id, path, message) of rows with a problem."""
    return tree.filter("problem is not null").select(F.lit("tree.entry").alias("check_id"), F.col("path").alias("record_id"), F.col("kind").alias("path"), F.col("problem").alias("message"))


def repeated(tree: DataFrame) -> DataFrame:
    """(path, n) of files that several tasks wrote."""
    return tree.filter("kind = 'file'").groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")


def verify(spark: SparkSession, root: str | Path) -> DataFrame:
    """(part, problem) where the files of an attempt aren't those that its commit counted."""
    commit = commit_of(store_of(str(root)))
    parts = [(p["name"], p["files"], p["bytes"], p["digest"]) for p in (commit or {"parts": []})["parts"]]  # one a task
    declared = spark.createDataFrame(parts, "part string, files long, bytes long, digest string")
    mark = file_mark_column(F.col("path"), F.col("content"))
    found = read(spark, root).groupBy("part").agg(F.count("content").alias("n"), F.sum("size").alias("s"), F.sum(mark).cast("decimal(38,0)").alias("d"))
    same = (F.col("files") == F.col("n")) & (F.col("bytes") == F.col("s")) & (F.col("digest").cast("decimal(38,0)") == F.col("d"))
    problem = F.when(F.col("n").isNull(), "missing").when(~F.coalesce(same, F.lit(False)), "differs from its commit")
    return declared.join(found, "part", "left").select("part", problem.alias("problem")).filter("problem is not null")
