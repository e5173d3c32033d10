"""Exact substring deduplication with longest-previous-factor arrays.

A byte is repeated when it lies in a string of `length` bytes that also starts
elsewhere (another document, or another place of the same one). With keep="none"
all repeated bytes are removed, with keep="first" those of later copies only; the
order is that of (doc_id, text hash, place).

A suffix array over a whole corpus doesn't distribute, so its windows (strings
of `length` bytes) are first dealt into groups that must hold all copies of a
window together:

1. Each window is keyed by the smallest hash of the K-byte strings in it, which
   depends on nothing but its bytes. Runs of windows with one key form segments,
   a few bytes longer than a window and about fifty windows each.
2. Segments are grouped by key and by two 64-bit hashes of their bytes (a class).
   Each batch of texts sends the first and the last segment of a class; those
   between them have copies on both sides and need no grouping, so a passage that
   a third of all documents share doesn't go to one task. A key with one segment
   holds no copies, unless its hash recurs within the segment (periodic text).
3. Of each class that may hold copies the bytes of its first two segments go to
   their key's group. There a suffix array (ranks by prefix doubling to the depth
   of a window), its LCP, and from previous and next smaller positions in suffix
   order the longest previous factors are built over bounded blocks of whole
   groups, segments in order of place. A previous factor of full length is an
   earlier copy, a next factor (the same over mirrored positions) a later one:
   these decide on every window. Further segments of a class fare as its second.
4. Keys with more than MAX_CLASSES classes (say, the edge of a passage that a third
   of all documents share) would make too large a group. Their segments are cut
   into windows, keyed by two hashes of the window; of each such key the first and
   the last window go the way of step 3, the others fare as these.

Spans of removed bytes are joined back to their documents.

Edge cases: null text is empty; texts shorter than `length` have no window; long
texts are processed in slices; rows that repeat id and text count as copies of
each other, and keep="first" keeps the passages of one of them (that with the
smallest hash of the columns passed on); a null doc_id is a value of its own;
bytes that aren't UTF-8 stay as they are; empty
tables give no rows. Only doc_id and text are read besides the columns that are
passed on, which may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, byte_column, release_memory, stored

LENGTH = 200
#: Bytes that are hashed for the key of a window.
K = 64
MAX_CLASSES = 1024
MAX_WINDOWS = 4096
BLOCK = 1 << 18
SUFFIX_BLOCK = 1 << 19
#: Segments of a batch among which equal ones are found before they are sent.
MAX_SEGMENTS = 500_000
_SEED = np.random.default_rng(20240229)
_CODE = _SEED.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_power: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses mod 2**64, at least n of each."""
    if not _power or len(_power[0]) < n:
        _power.clear()
        for b in _BASE:
            for x in (b, pow(b, -1, 2**64)):
                p = np.full(max(n, BLOCK + 4096), x, np.uint64)
                p[0] = 1
                _power.append(np.cumprod(p))
    return _power


def _sums(data: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums of byte codes times powers, so that any stretch's hash is a difference."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[which][data] * _powers(len(data) + 1)[2 * which][: len(data)], out=out[1:])
    return out


def _window_hashes(data: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each of the first n windows."""
    one, two = _sums(data, 0), _sums(data, 1)
    return _mixed((one[length : length + n] - one[:n]) * _power[1][:n]), _mixed((two[length : length + n] - two[:n]) * _power[3][:n])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    padded = np.full(-(-len(h) // width) * width, np.uint64(2**64 - 1))
    padded[: len(h)] = h
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, 1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def _recurring(h: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Whether a segment's key is the hash of more than one place in it: only then may windows of one segment be equal."""
    # A place is the smallest of some window if no window around it has a larger minimum.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), key, np.zeros(width - 1, np.uint64)])
    anchors = np.flatnonzero(h == ~_sliding_min(~padded, width))
    low, high = np.searchsorted(anchors, start), np.searchsorted(anchors, end + width - 1)
    count = high - low
    owner = np.repeat(np.arange(len(start)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[owner]
    return np.bincount(owner[h[anchors[at]] == key[start][owner]], minlength=len(start)) > 1


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Of texts end to end: row, start in the text, windows, key, two hashes of each segment, and whether its key recurs in it."""
    k = min(k, length)
    if len(data) < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64, bool))
    one, two = _sums(data, 0), _sums(data, 1)
    back1, back2 = _power[1], _power[3]
    h = _mixed((one[k:] - one[:-k]) * back1[: len(data) - k + 1])
    key = _sliding_min(h, length - k + 1)
    n = len(key)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    valid = np.arange(n) + length <= offsets[1:][row]
    cut = np.ones(n, bool)
    cut[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (valid[1:] != valid[:-1])
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    start, end = start[valid[start]], end[valid[start]]
    if len(start) and (end - start).max() > MAX_WINDOWS:
        parts = [np.arange(a, b, MAX_WINDOWS) for a, b in zip(start, end)]
        end = np.concatenate([np.append(p[1:], b) for p, b in zip(parts, end)])
        start = np.concatenate(parts)
    last = end + length - 1
    h1 = (one[last] - one[start]) * back1[start]
    h2 = (two[last] - two[start]) * back2[start] + (end - start).astype(np.uint64)
    return row[start], start - offsets[row[start]], end - start, key[start], _mixed(h1), _mixed(h2), _recurring(h, key, start, end, length - k + 1)


def _slices(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first row, first place) of bounded blocks; long texts in slices that overlap by a window."""
    for a, b in blocks(offsets, BLOCK):
        if offsets[b] - offsets[a] <= BLOCK:
            yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a, 0
            continue
        text = data[offsets[a] : offsets[b]]
        for at in range(0, max(1, len(text) - length + 1), BLOCK - length):
            part = text[at : at + BLOCK - 1]
            yield part, np.array([0, len(part)]), a, at


def _find_segments(docs: DataFrame, length: int, first: bool) -> DataFrame:
    """Segments; between: the batch has an earlier and a later one of its class, so the key is a mere number."""
    kinds = {"key": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "doc_id": pa.int64(), "tid": pa.int64(), "start": pa.int64(), "n": pa.int32(), "recurs": pa.bool_(), "between": pa.bool_()}

    def deal(batch: pa.RecordBatch, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        row, start, n, key, h1, h2, recurs = (np.concatenate(x) for x in zip(*parts))
        ids, tid = batch.column(0), batch.column(1).to_numpy()
        known, value = ids.is_valid().to_numpy(False)[row], ids.fill_null(0).to_numpy()[row]
        o = np.lexsort((start, tid[row], value, known, h2, h1, key))
        same = np.zeros(len(o) + 1, bool)
        same[1:-1] = (key[o][1:] == key[o][:-1]) & (h1[o][1:] == h1[o][:-1]) & (h2[o][1:] == h2[o][:-1])
        inner = same[1:] & same[:-1]
        between = np.zeros(len(o), bool)
        between[o[inner]] = True
        key = key.view(np.int64).copy()
        key[between] = (value * 31 + tid[row] + start * 1_000_003)[between]
        wanted = np.ones(len(o), bool)
        if first:  # rows that repeat the place of the first of their class are that first one
            lead = o[np.maximum.accumulate(np.where(same[:-1], 0, np.arange(len(o))))]
            wanted[o] = ~(inner & (known[o] == known[lead]) & (value[o] == value[lead]) & (tid[row[o]] == tid[row[lead]]) & (start[o] == start[lead]))
        at = np.flatnonzero(wanted)
        rows = pa.array(row[at])
        columns = [key[at], h1.view(np.int64)[at], h2.view(np.int64)[at], ids.take(rows), batch.column(1).take(rows), start[at], n[at], recurs[at], between[at]]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, kinds.values())], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(2))
            held, size = [], 0
            for part, cuts, at, place in _slices(data, offsets, length):
                row, start, *rest = segments(part, cuts, length)
                held.append((row + at, start + place, *rest))
                size += len(row)
                if size >= MAX_SEGMENTS:
                    yield deal(batch, held)
                    held, size = [], 0
            if size:
                yield deal(batch, held)
        release_memory()

    return docs.mapInArrow(run, "key long, h1 long, h2 long, doc_id long, tid long, start long, n int, recurs boolean, between boolean")


def ranks(text: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(bytes, rank of each place's so many bytes among all, zeros beyond the end) of every step of prefix doubling; the last has `depth`."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    step = min(8, depth)
    key = np.zeros(n, np.uint64)
    for i in range(step):
        key = (key << np.uint64(8)) | padded[i : n + i]
    out = [(step, np.unique(key, return_inverse=True)[1].astype(np.uint32) + np.uint32(1))]
    while step < depth:
        ahead = min(step, depth - step)
        rank = out[-1][1].astype(np.uint64)
        shifted = np.zeros(n, np.uint64)
        shifted[: max(0, n - ahead)] = rank[ahead:]
        step += ahead
        out.append((step, np.unique((rank << np.uint64(32)) | shifted, return_inverse=True)[1].astype(np.uint32) + np.uint32(1)))
    return out


def common_prefixes(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common bytes of the places a and b, pair by pair: all of the ranks' depth, or less, in whole steps of the first level."""
    depth, n = levels[-1][0], len(levels[-1][1])
    out = np.where(levels[-1][1][a] == levels[-1][1][b], depth, 0)
    for step, rank in reversed(levels[:-1]):
        p, q = a + out, b + out
        inside = (out + step <= depth) & (p < n) & (q < n)
        p, q = np.where(inside, p, 0), np.where(inside, q, 0)
        out = out + np.where(inside & (rank[p] == rank[q]), step, 0)
    return out


def previous_smaller(place: np.ndarray) -> np.ndarray:
    """For each entry the nearest one before it with a smaller place, or -1.

    Each entry points to the one before; while that one's place is larger, the entry takes over its pointer. All do so
    at once, and pointers grow as they are taken over, so there are about as many rounds as the logarithm of the entries.
    """
    out = np.arange(-1, len(place) - 1)
    todo = np.arange(len(place))
    while True:
        todo = todo[out[todo] >= 0]
        todo = todo[place[out[todo]] > place[todo]]
        if not len(todo):
            return out
        out[todo] = out[out[todo]]


def longest_previous_factors(place: np.ndarray, common: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each entry of a suffix array the longest match at a smaller place: of the common prefixes with its previous and its next smaller place in suffix order, the longer one."""
    n = len(place)
    before = previous_smaller(place)
    after = n - 1 - previous_smaller(place[::-1])[::-1]
    out = np.zeros(n, np.int64)
    for other, there in ((before, before >= 0), (after, after < n)):
        at = np.flatnonzero(there)
        out[at] = np.maximum(out[at], common(at, other[at]))
    return out


def copies(texts: list[bytes], windows: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, offset, earlier, later) of each window of texts that has a copy among them: one at an earlier place, one at a later."""
    sizes = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    levels = ranks(np.frombuffer(b"".join(texts), np.uint8), length)
    count = np.array(windows)
    owner = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = first[owner] + offset
    rank = levels[-1][1][place]
    order = np.argsort(rank, kind="stable")  # the suffix array of these places, to the depth of a window
    # Entries that share no full window with a neighbour have no factor of that length.
    tied = np.zeros(len(order) + 1, bool)
    tied[1:-1] = rank[order][1:] == rank[order][:-1]
    order = order[tied[:-1] | tied[1:]]
    at = place[order]
    common = lambda i, j: common_prefixes(levels, at[i], at[j])
    return owner[order], offset[order], longest_previous_factors(at, common) >= length, longest_previous_factors(-at, common) >= length


def _spans(owner: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring offsets: owner, first, last."""
    if not len(owner):
        return owner, offset, offset
    o = np.lexsort((offset, owner))
    owner, offset = owner[o], offset[o]
    cut = np.flatnonzero((owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)) + 1
    start = np.concatenate([[0], cut])
    end = np.concatenate([cut, [len(owner)]]) - 1
    return owner[start], offset[start], offset[end]


SPANS = "doc_id long, tid long, lo long, hi long"


def _decided(held: list[tuple], length: int, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (owner, first, last window) to remove in pieces of whole keys, which stand in order of place.

    A piece whose bytes equal those of an earlier one of its key has that as its previous factor, which in turn has a next
    one; so only different pieces go to the suffix array, and only with others of their key or where their key recurs.
    """
    lead: dict[tuple[int, bytes], int] = {}
    whole = np.zeros(len(held), bool)
    for k, row in enumerate(held):
        at = lead.setdefault((row[0], row[6]), k)
        if at != k:
            whole[k] = True
            whole[at] |= not first
    different: dict[int, list[int]] = {}
    for (key, _), k in lead.items():
        different.setdefault(key, []).append(k)
    chosen = sorted(k for ks in different.values() if (len(ks) > 1 or held[ks[0]][7]) and not whole[ks].all() for k in ks)
    parts = [(np.flatnonzero(whole), np.zeros(int(whole.sum()), np.int64), np.array([held[k][4] - 1 for k in np.flatnonzero(whole)], np.int64))]
    if chosen:
        owner, offset, earlier, later = copies([held[k][6] for k in chosen], [held[k][4] for k in chosen], length)
        owner = np.array(chosen)[owner]
        wanted = (earlier if first else earlier | later) & ~whole[owner]
        parts.append(_spans(owner[wanted], offset[wanted]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _spans_by_suffix_arrays(pieces: DataFrame, length: int, first: bool) -> DataFrame:
    """Spans within pieces (rows: key, doc_id, tid, start, n, turn, bytes, recurs), which come grouped by key, in rows of SPANS with the key."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        held = sorted({(*r[:4], r[5]): r for r in held}.values(), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3], r[5]))
        owner, lo, hi = _decided(held, length, first)
        base = np.array([r[3] for r in held], np.int64)[owner]
        of = lambda c: pa.array([held[k][c] for k in owner], pa.int64())
        return pa.RecordBatch.from_arrays([of(1), of(2), pa.array(base + lo), pa.array(base + hi + length), of(0)], names=["doc_id", "tid", "lo", "hi", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns)):
                    if size >= SUFFIX_BLOCK and row[0] != held[-1][0]:
                        yield flush(held)
                        held, size = [], 0
                    held.append(row)
                    size += len(row[6])
        if held:
            yield flush(held)
        held = []
        release_memory()

    return pieces.mapInArrow(run, f"{SPANS}, key long")


def _spans_by_windows(pieces: DataFrame, length: int, first: bool) -> DataFrame:
    """As above for keys with too many classes: their windows are grouped by two hashes, and of each group two go to the suffix arrays."""
    names = ["w1", "w2", "doc_id", "tid", "start", "turn", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                n = row[4]
                w1, w2 = _window_hashes(np.frombuffer(row[6], np.uint8), n, length)
                fill = lambda v: pa.array([v] * n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), fill(row[1]), fill(row[2]), fill(row[3]), fill(row[5]), pa.array(row[3] + np.arange(n))], names=names)

    seen = stored(pieces.mapInArrow(run, ", ".join(f"{c} long" for c in names)), "repeats-windows")
    place = F.struct("doc_id", "tid", "at", "turn", "start")
    ends = seen.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    asked = ends.select("w1", "w2", F.explode(F.array("first", "last")).alias("p")).select(F.xxhash64("w1", "w2").alias("key"), "w1", "w2", "p.*")
    held = pieces.select(*[F.col(c).alias(f"p_{c}") for c in ("doc_id", "tid", "start", "turn")], "bytes")
    found = asked.join(held, asked["doc_id"].eqNullSafe(held["p_doc_id"]) & (asked["tid"] == held["p_tid"]) & (asked["start"] == held["p_start"]) & (asked["turn"] == held["p_turn"]))
    window = F.substring("bytes", (F.col("at") - F.col("start") + 1).cast("int"), F.lit(length))
    ends_of = found.select("key", "doc_id", "tid", F.col("at").alias("start"), F.lit(1).alias("n"), F.col("turn").cast("int").alias("turn"), window.alias("bytes"), F.lit(False).alias("recurs")).distinct()
    known = _spans_by_suffix_arrays(ends_of.repartition(F.col("key")).sortWithinPartitions("key"), length, first).select("key").distinct()
    sure = ends.select("w1", "w2", F.col("first").alias("origin"), F.xxhash64("w1", "w2").alias("key")).join(known, "key").select("w1", "w2", "origin")
    of = F.struct("doc_id", "tid", "at")
    spans = seen.join(sure, ["w1", "w2"])
    if first:
        spans = spans.filter(of > F.struct("origin.doc_id", "origin.tid", "origin.at"))
    return spans.select("doc_id", "tid", F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))


def _merged(found: list[dict] | None) -> list[dict]:
    """Spans (lo, hi) as maximal spans (start, end)."""
    out: list[dict] = []
    for lo, hi in sorted((x["lo"], x["hi"]) for x in found or ()):
        if out and out[-1]["end"] >= lo:
            out[-1]["end"] = max(out[-1]["end"], hi)
        else:
            out.append({"start": lo, "end": hi})
    return out


def _without(text: bytes, spans: list[dict], whole: bool) -> bytes:
    """text without the spans; whole: each is shrunk to whole characters first."""
    out, at = [], 0
    for s in spans:
        lo, hi = s["start"], s["end"]
        if whole:
            while lo < hi and text[lo] & 0xC0 == 0x80:
                lo += 1
            while hi > lo and hi < len(text) and text[hi] & 0xC0 == 0x80:
                hi -= 1
        out.append(text[at:lo])
        at = hi
    return b"".join([*out, text[at:]])


def _cutter(whole: bool):
    """Merge the spans of each text and cut them out of it; whole: at whole characters, and without the texts as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [t or b"" for t in part.column("text").to_pylist()]
                spans = [_merged(f) for f in part.column("found").to_pylist()]
                kept = [_without(t, s, whole) if s else t for t, s in zip(texts, spans)]
                others = [c for c in part.schema.names if c not in ("text", "found")]
                columns, names = [part.column(c) for c in others], list(others)
                if not whole:
                    columns.append(part.column("text"))
                    names.append("text")
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind), pa.array(kept, pa.binary())], names=[*names, "spans", "kept"])
        release_memory()

    return run


def find_spans(docs: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """(doc_id, tid, found array<struct<lo,hi>>): the bytes to remove, of (doc_id, text binary, tid).

    For keep="first" rows that repeat doc_id and tid count as one row here.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep must be 'none' or 'first'")
    first = keep == "first"
    by_key = Window.partitionBy("key")
    by_class = Window.partitionBy("key", "h1", "h2")
    in_order = by_class.orderBy("doc_id", "tid", "start")
    # With keep="first" the first segment of a class stands in all rows that repeat its row, so these have turn 1 together.
    live = (
        _find_segments(docs.select("doc_id", "tid", "text"), length, first)
        .withColumn("turn", (F.rank() if first else F.row_number()).over(in_order))
        .withColumn("leads", F.row_number().over(in_order) == 1)
        .withColumn("second", (F.col("turn") > 1) & (F.lag("turn").over(in_order) == 1))
        .withColumn("equal", F.max("turn").over(by_class) > 1)
        .withColumn("classes", F.sum((F.col("leads") & ~F.col("between")).cast("int")).over(by_key))
        .filter("between or equal or classes > 1 or recurs")
        .select("key", "doc_id", "tid", "start", "n", "turn", "second", "classes", "between", "recurs", (F.col("leads") & (F.col("equal") | (F.col("classes") > 1) | F.col("recurs"))).alias("asks"))
    )
    live = stored(live, "repeats-live")
    # Those behind the second of their class fare as it does: it has an equal segment before it.
    spans = live.filter("between or (turn > 1 and not second)").select("doc_id", "tid", F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1 + length).alias("hi"))
    asked = live.filter("not between and (second or asks)")
    asked = asked.groupBy("doc_id", "tid").agg(F.collect_set(F.struct("key", "start", "n", F.least("turn", F.lit(2)).alias("turn"), "recurs", (F.col("classes") > MAX_CLASSES).alias("hot"))).alias("asked"))
    texts = docs.select("doc_id", "tid", "text").filter(F.octet_length("text") >= length)
    got = texts.join(asked, texts["doc_id"].eqNullSafe(asked["doc_id"]) & (texts["tid"] == asked["tid"])).select(texts["doc_id"], texts["tid"], "text", "asked")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc_id", "tid", "start", "n", "turn", "bytes", "recurs", "hot"]
        kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary(), pa.bool_(), pa.bool_()]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, tid, text, wanted in zip(*batch.columns):
                doc_id, tid, text = doc_id.as_py(), tid.as_py(), text.as_py()
                rows += [(s["key"], doc_id, tid, s["start"], s["n"], s["turn"], text[s["start"] : s["start"] + s["n"] - 1 + length], s["recurs"], s["hot"]) for s in wanted.as_py()]
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        release_memory()

    pieces = got.mapInArrow(fetch, "key long, doc_id long, tid long, start long, n int, turn int, bytes binary, recurs boolean, hot boolean")
    pieces = stored(pieces, "repeats-pieces")  # rows that repeat id and text give a piece several times; one of these counts
    columns = ["key", "doc_id", "tid", "start", "n", "turn", "bytes", "recurs"]
    grouped = pieces.filter(~F.col("hot")).select(columns).repartition(F.col("key")).sortWithinPartitions("key")
    spans = spans.unionByName(_spans_by_suffix_arrays(grouped, length, first).drop("key"))
    hot = pieces.filter("hot")
    if not hot.isEmpty():
        spans = spans.unionByName(_spans_by_windows(hot.select(columns), length, first))
    return spans.groupBy("doc_id", "tid").agg(F.collect_set(F.struct("lo", "hi")).alias("found"))


def _joined(docs: DataFrame, length: int, keep: str, others: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """(doc_id, the columns `others` under names of their own, text binary, found spans), and the names of the columns that are passed on."""
    texts = docs.select("doc_id", *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(others)], F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    texts = texts.withColumn("tid", F.xxhash64("text"))
    spans = find_spans(texts, length, keep)
    columns = ["doc_id", *[f"o{i}" for i in range(len(others))]]
    # The key of the join without nulls, so that rows are dealt once for the numbering and the join.
    keyed = lambda df: df.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "nameless": F.col("doc_id").isNull()})
    if keep == "first":
        same = Window.partitionBy("id", "nameless", "tid").orderBy(F.xxhash64(*[f"o{i}" for i in range(len(others))]) if others else F.lit(0))
        texts = keyed(texts).withColumn("again", (F.row_number().over(same) > 1) & (F.octet_length("text") >= length))
        whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.octet_length("text").cast("long").alias("hi")))
        found = F.when(F.col("again"), whole).otherwise(F.col("found")).alias("found")
    else:
        texts, found = keyed(texts), F.col("found")
    return texts.join(keyed(spans).drop("doc_id"), ["id", "nameless", "tid"], "left").select(*columns, "text", found), columns


def remove(docs: DataFrame, length: int = LENGTH, keep: str = "none", others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `others`, text (binary), spans array<struct<start,end>> (bytes, maximal), kept (binary)."""
    joined, columns = _joined(docs, length, keep, others)
    kinds = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in columns)
    cut = joined.mapInArrow(_cutter(False), f"{kinds}, text binary, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return cut.select("doc_id", *[F.col(f"o{i}").alias(c) for i, c in enumerate(others)], "text", "spans", "kept")


def digests(removed: DataFrame) -> DataFrame:
    """The op8 digest of remove()."""
    return removed.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        (F.octet_length("text") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (columns of documents) without later copies; a removed span is shrunk to whole characters, and texts of which nothing is left go."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    joined, columns = _joined(docs, length, "first", others)
    kinds = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in columns)
    kept = joined.mapInArrow(_cutter(True), f"{kinds}, spans array<struct<start:bigint,end:bigint>>, kept binary").filter((F.size("spans") == 0) | (F.octet_length("kept") > 0))
    kept = kept.withColumn("kept", F.col("kept").cast("string"))
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept")} | {c: F.col(f"o{i}") for i, c in enumerate(others)}
    return kept.select(*[(F.length("kept").cast("long") if c == "n_chars" else own[c]).alias(c) for c in docs.columns])
