"""Prefix tree of conversations, built compressed (Patricia) from sorted sequences.

Each conversation is a row: the 128-bit fingerprints of its turns end to end, the
key, and the bytes of each text. The rows are sorted by key over all tasks, with
conv_id last, so that no group of equal conversations has to stay in one
task. Each range of the sort builds its tree from a stack: only branch points, end
points and leaves are made, with compressed edges; a point hands its counts to
the one above when it is closed, and the nodes within an edge are then written out
from sums over the edge's lower end.

Ranges share only the nodes on the path that the last sequence of one and the
first of the next have in common. How long these paths are is known before
(two numbers a range). Every count is taken where it is new: a node's bytes and its
place among the children count in the first range that has it, a leaf in the last;
so the parts of a shared node add up, and only shared nodes (at most the length of
the common path a range) are grouped again.

Edge cases: rows without a conv_id take no part; null roles and texts are empty; a null
turn comes first; turns of equal number are ordered by the fingerprint of role and
text; repeated rows are repeated turns; a conversation without turns is a member of
the root; an empty table has no nodes. Only the four named columns are read, so
other columns may have any name. A conversation is one row of some 20 bytes a turn, and a
task holds a range of them; texts aren't held, whatever their length. The decimal ids
of equal conversations pass one hash in order, in parts of bounded size, as SHA-256 demands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release_memory, stored

#: Bytes of a turn's fingerprint.
MARK = 16
#: Rows of a batch that a task writes, and ids in a part of a shared end.
BATCH, PART_IDS = 4000, 4096
LOCAL = "range int, depth long, node binary, parent binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends array<string>"
NAMES = [x.strip().split(" ")[0] for x in LOCAL.split(", ")]
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<turn, mark, bytes>>): each conversation's turns in order; mark is the fingerprint in hex."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    mark = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    row = F.struct(F.col("turn"), mark.alias("mark"), F.octet_length(text).alias("bytes"))
    own = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("t"))
    return own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, heads: int = 9, group: int = 5) -> DataFrame:
    """turns() with the first h turns of each conversation c taken from c - c % group; h is crc32(c) % heads."""
    own = turns(conversations)
    first = own.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("source"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    joined = own.withColumn("source", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h).join(first, "source", "left")
    kept = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", F.array_compact(F.slice("turns", 1, 0))), F.lit(1), F.col("h")), kept).alias("turns"))


def _common(a: Column, b: Column) -> Column:
    """How many turns two keys have in common at their start."""
    most = F.least(F.octet_length(a), F.octet_length(b)) / MARK
    depths = F.filter(F.sequence(F.lit(0), most.cast("int")), lambda d: F.substring(a, F.lit(1), d * MARK) == F.substring(b, F.lit(1), d * MARK))
    return F.size(depths) - 1


def common_turns(a: bytes, b: bytes) -> int:
    """The same for bytes: by halving, as equal starts are equal further up."""
    low, high = 0, min(len(a), len(b)) // MARK
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * MARK] == b[: mid * MARK] else (low, mid - 1)
    return low


class Point:
    """A branch point, end point or leaf: members, smallest member, and what was handed up from below."""

    __slots__ = ("depth", "seq", "first", "n", "least", "kids", "leaves", "saved", "ends", "rows")

    def __init__(self, depth: int, seq: int, first: bool) -> None:
        self.depth, self.seq, self.first = depth, seq, first
        self.n, self.least, self.kids, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends: list[int] = []
        self.rows: list[int] = []  # the topmost nodes of the edges below, which get their parent's conv_id when this point is closed


class Range:
    """The compressed tree of one range of sorted sequences, as rows of LOCAL.

    before, after: turns that the first sequence has in common with the one before the range, and the last with the one behind
    it; -1 where there is none.
    """

    def __init__(self, number: int, before: int, after: int) -> None:
        self.number, self.before, self.after = number, before, after
        self.keys: list[bytes] = []
        self.sizes: list[list[int]] = []
        self.rows: list[list] = []
        self.stack = [Point(0, 0, True)]

    def add(self, key: bytes, sizes: list[int], members: list[int]) -> None:
        """The next distinct sequence with its members in ascending order."""
        n = len(self.keys)
        if n:
            self._up_to(common_turns(self.keys[-1], key))
        self.keys.append(key)
        self.sizes.append(sizes)
        if sizes:
            self.stack.append(Point(len(sizes), n, n == 0))
        end = self.stack[-1]
        end.seq, end.ends, end.n = n, members, end.n + len(members)
        end.least = members[0] if end.least is None else min(end.least, members[0])

    def _up_to(self, depth: int, last: bool = False) -> None:
        """Close all points below a depth; a branch point comes to be where an edge passes it."""
        while self.stack[-1].depth > depth:
            point = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(Point(depth, point.seq, point.first))
            self._close(point, self.stack[-1], last)

    def _close(self, p: Point, above: Point | None, last: bool) -> None:
        """Write the nodes of the edge that ends at p, from sums over its lower end, and hand the counts up."""
        n, least, saved, sizes = p.n, p.least, p.saved, self.sizes[p.seq]
        goes_on = last and p.depth <= self.after
        leaves = p.leaves if p.kids or p.rows or goes_on else p.leaves + 1
        top = above.depth if above else -1
        kids = p.kids
        for q in range(p.depth, top, -1):
            new = not (p.first and q <= self.before)
            if q:
                saved += (n - new) * sizes[q - 1]
            shared = not new or (last and q <= self.after)
            at = len(self.rows)
            if q == p.depth:
                for row in p.rows:  # what hangs below p
                    self._adopt(row, least, shared, q, p.seq)
            else:
                self._adopt(at - 1, least, shared, q, p.seq)
            ends = p.ends if q == p.depth else []
            node = self._name(q, p.seq) if shared else None
            digest = None if shared else hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else EMPTY
            parts = [",".join(map(str, ends[k : k + PART_IDS])) for k in range(0, len(ends), PART_IDS)] if shared else None
            self.rows.append([self.number, q, node, None, least, None, n, kids, leaves, saved, digest, parts])
            kids = int(new)
        if above:
            above.rows.append(len(self.rows) - 1)
            above.n += n
            above.least = least if above.least is None else min(above.least, least)
            above.saved += saved
            above.leaves += leaves
            above.kids += kids

    def _name(self, depth: int, seq: int) -> bytes:
        """The fingerprint of a shared node: of its depth and the key up to it."""
        return hashlib.md5(b"%d:" % depth + self.keys[seq][: depth * MARK]).digest()

    def _adopt(self, row: int, least: int, shared: bool, depth: int, seq: int) -> None:
        """A node's parent: its smallest member, or its name if other ranges have members too."""
        if shared:
            self.rows[row][3] = self._name(depth, seq)
        else:
            self.rows[row][5] = least

    def finish(self) -> list[list]:
        """All rows; the points that are left lie on the path of the last sequence."""
        if self.keys:
            self._up_to(0, last=True)
            self._close(self.stack.pop(), None, last=True)
        return self.rows


def _batches(rows: list[list]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.string(), pa.list_(pa.string())]
    for k in range(0, len(rows), BATCH):
        columns = zip(*rows[k : k + BATCH])
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=NAMES)


def local_trees(placed: DataFrame, shared: dict[int, tuple[int, int]]) -> DataFrame:
    """Rows of LOCAL of every range; those with a node are parts of shared nodes. placed: (range, key, sizes, conv_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Range | None = None
        key, sizes, members = None, None, []
        for batch in batches:
            number, keys, all_sizes, ids = (batch.column(c) for c in range(4))
            for r, k, i, z in zip(number.to_pylist(), keys.to_pylist(), ids.to_pylist(), all_sizes):
                if now is not None and r == now.number and k == key:
                    members.append(i)
                    continue
                if now is not None:
                    now.add(key, sizes, members)
                if now is None or r != now.number:
                    if now is not None:
                        yield from _batches(now.finish())
                    now = Range(r, *shared[r])
                key, sizes, members = k, z.as_py(), [i]
        if now is not None:
            now.add(key, sizes, members)
            yield from _batches(now.finish())
        now = key = sizes = members = None
        release_memory()

    dealt = placed.repartition("range").sortWithinPartitions("range", "key", "conv_id")
    return dealt.select("range", "key", "sizes", "conv_id").mapInArrow(run, LOCAL)


def _end_digests(parts: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, range, part, ids): the parts of a node pass one hash in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])
        for batch in batches:
            for n, ids in zip(batch.column(0), batch.column(1)):
                n, ids = n.as_py(), ids.as_py()
                if n != node:
                    if state is not None:
                        yield done()
                    node, state = n, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if state is not None:
            yield done()

    return parts.repartition("node").sortWithinPartitions("node", "range", "part").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def tree(sequences: DataFrame) -> DataFrame:
    """RESULT, a row per node of the prefix tree of (conv_id, turns) sequences."""
    marks = F.transform("turns", lambda t: t["mark"])
    rows = sequences.select("conv_id", F.unhex(F.array_join(marks, "")).alias("key"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    ranged = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    placed = stored(ranged.withColumn("range", F.spark_partition_id()), "prefix-sorted")
    # One row a range of the sort: what its ends have in common with its neighbours.
    w = Window.orderBy("range")
    ends = placed.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    beside = ends.select("range", F.coalesce(_common(F.lag("high").over(w), F.col("low")), F.lit(-1)).alias("before"), F.coalesce(_common(F.col("high"), F.lead("low").over(w)), F.lit(-1)).alias("after"))
    shared = {r["range"]: (r["before"], r["after"]) for r in beside.collect()}
    local = stored(local_trees(placed, shared), "prefix-local")

    parts = local.filter("node is not null")
    ids = _end_digests(parts.select("node", "range", F.posexplode("ends").alias("part", "ids")))
    sums = parts.groupBy("node").agg(
        F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    )
    merged = stored(sums.join(ids, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))), "prefix-shared")
    least = merged.select("node", F.col("conv_id").alias("parent_conv_id"))
    above = merged.join(least.withColumnRenamed("node", "parent"), "parent", "left").select(RESULT)
    # Children of a shared node are joined range by range, so those of the root are dealt over all ranges.
    named = parts.select("range", "node").join(least, "node").withColumnRenamed("node", "parent")
    hung = local.filter("node is null and parent is not null").drop("parent_conv_id").join(named, ["range", "parent"]).select(RESULT)
    inner = local.filter("node is null and parent is null").select(RESULT)
    return inner.unionByName(hung).unionByName(above)
