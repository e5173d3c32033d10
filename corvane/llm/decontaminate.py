"""Benchmark decontamination with a generalised suffix automaton of the items.

The items are normalised to words and put into one suffix automaton (one state
per class of equal end positions, over all items together). A document's words
are streamed through it; at every word the state and the matched length give the
longest stretch ending there that occurs in an item. A word is hit when it lies
in an occurrence of a window: `window` consecutive item words, or the whole of
a shorter item.

Words outside the items' vocabulary, and neighbours that are no neighbours in
any item, cannot lie inside a match, so only the stretches between such places
are streamed; they are found for whole batches of documents with array
operations.

The items are dealt into blocks of about `block_words` words. Tasks build an
automaton for each block and write it to the shared folder; the documents pass all
blocks within one map, which loads them in turn and takes its texts in slices of bounded
size, so neither the driver nor the plan nor a task holds the benchmark or the words of a
batch as a whole.

Edge cases: null or wordless texts have no words and no hits; wordless items
match nothing; equal items are all reported; repeated rows are judged one by
one; any text length is streamed; bytes that aren't UTF-8 count as letters and stay
as they are; empty tables give no hits or no rows. Only the named columns are read,
and those passed on may have any name.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_column, make_folder, release_memory, scratch_path

WINDOW = 10
BLOCK_WORDS = 100_000
#: decontaminate(): documents with a larger share of hit words go whole.
MAX_COVERAGE = 0.5
#: decontaminate(): hit spans of at least so many words are removed.
MIN_SPAN = 1
#: Bytes of texts whose words a task holds at once (one text at least).
SLICE_BYTES = 2 << 20
_DELIMITERS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_NORMAL = bytes(range(256)).translate(bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256)))
_NORMAL = bytes(0x20 if c in _DELIMITERS else c for c in _NORMAL)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of digits, letters and non-ASCII characters."""
    return text.translate(_NORMAL).split()


class SuffixAutomaton:
    """Of several word sequences; tells which windows end at a matched place."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, object, int]] = []  # state, item, words of the prefix
        pairs: set[tuple[int, int]] = set()
        whole: list[tuple[int, object, int]] = []
        self.shortest = window
        for item, words in items:
            if not words:
                continue
            coded = [self.ids.setdefault(w, len(self.ids)) for w in words]
            pairs.update(zip(coded, coded[1:]))
            last = 0
            for n, c in enumerate(coded, 1):
                last = self._extend(last, c)
                ends.append((last, item, n))
            if len(coded) < window:
                whole.append((last, item, len(coded)))
                self.shortest = min(self.shortest, len(coded))
        n = len(self.ids)
        self.pairs = np.array(sorted(a * n + b for a, b in pairs), np.int64)
        self._mark(ends, whole)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _mark(self, ends: list, whole: list) -> None:
        """anchor: the state of the window-long suffix of each state's longest word; found[s]: items with that window."""
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.anchor = [-1] * len(self.next)
        self.found: dict[int, set] = {}
        self.short: list[tuple] = [()] * len(self.next)
        own: dict[int, list] = {}
        for s, item, n in whole:
            own.setdefault(s, []).append((n, item))
        for s in order:
            link = self.link[s]
            self.anchor[s] = s if self.length[link] < self.window <= self.length[s] else self.anchor[link] if self.length[s] >= self.window else -1
            self.short[s] = self.short[link] + tuple(own.get(s, ())) if s in own else self.short[link]
        for s, item, n in ends:
            if n >= self.window:
                self.found.setdefault(self.anchor[s], set()).add(item)

    def stream(self, coded: list[int]) -> Iterator[tuple[int, int, object]]:
        """(end, words, item or state's items) of every window occurrence, in order of end."""
        state = matched = 0
        for at, c in enumerate(coded):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                matched += 1
            else:
                matched = 0
            if matched >= self.window:
                yield at + 1, self.window, self.found[self.anchor[state]]
            for n, item in self.short[state]:
                if n <= matched:
                    yield at + 1, n, (item,)


def _runs(automaton: SuffixAutomaton, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of the word ids (-1: not in the vocabulary) whose neighbours all occur in an item."""
    known = coded >= 0
    if automaton.shortest <= 1:
        joined = np.zeros(len(coded), bool)
        joined[1:] = known[1:] & known[:-1]
    else:
        joined = np.zeros(len(coded), bool)
        at = np.flatnonzero(known[1:] & known[:-1]) + 1
        pair = coded[at - 1] * len(automaton.ids) + coded[at]
        k = np.searchsorted(automaton.pairs, pair)
        joined[at] = automaton.pairs[np.minimum(k, len(automaton.pairs) - 1)] == pair if len(automaton.pairs) else False
    starts = np.flatnonzero(known & ~joined)
    ends = np.concatenate([starts[1:], [len(coded)]]) if len(starts) else starts
    # a stretch ends where the next word isn't joined to it
    gap = np.flatnonzero(~joined)
    ends = gap[np.minimum(np.searchsorted(gap, starts, side="right"), len(gap) - 1)] if len(gap) else ends
    ends = np.where(ends <= starts, len(coded), ends)
    keep = ends - starts >= automaton.shortest
    return starts[keep], ends[keep]


def match(automaton: SuffixAutomaton, texts: list[bytes]) -> list[tuple[int, list[list[int]], set]]:
    """Per text: number of words, hit spans [start, end) in words, items."""
    split = [words_of(x) for x in texts]
    counts = [len(w) for w in split]
    out: list[tuple[int, list[list[int]], set]] = [(n, [], set()) for n in counts]
    get = automaton.ids.get
    coded = np.full(sum(counts) + len(counts), -1, np.int64)
    first = np.zeros(len(counts) + 1, np.int64)
    at = 0
    for k, words in enumerate(split):
        first[k] = at
        coded[at : at + len(words)] = [get(w, -1) for w in words]
        at += len(words) + 1
    first[-1] = at
    starts, ends = _runs(automaton, coded)
    owner = np.searchsorted(first, starts, side="right") - 1
    for k, start, end in zip(owner.tolist(), starts.tolist(), ends.tolist()):
        _, spans, items = out[k]
        base, last_found = start - int(first[k]), None
        for stop, n, found in automaton.stream(coded[start:end].tolist()):
            if found is not last_found:
                items.update(found)
                last_found = found
            a, b = base + stop - n, base + stop
            while spans and spans[-1][1] >= a:
                last = spans.pop()
                a, b = min(a, last[0]), max(b, last[1])
            spans.append([a, b])
    return out


def store_automata(benchmark: DataFrame, window: int, block_words: int) -> list[str]:
    """Build the automata of the items, a block each, in tasks, and write them to the shared folder; the names of the files."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    # About five bytes a word; how even the blocks are has no influence on the result.
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (5 * block_words)))
    folder = scratch_path(spark, "automata")
    make_folder(spark, folder)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)

        def write(block: int, held: list) -> pa.RecordBatch:
            name = f"{block:06d}-{TaskContext.get().taskAttemptId()}"  # attempts of one task don't share a file
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(pickle.dumps(SuffixAutomaton(sorted(held, key=lambda x: (x[0] is not None, x[0] or 0, x[1])), window)))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["file"])

        now, held = None, []
        for batch in batches:
            for item, text, block in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now and held:
                    yield write(now, held)
                    held = []
                now = block
                held.append((item, words_of(text)))
        if held:
            yield write(now, held)
        release_memory()

    files = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(run, "file string")
    return sorted(r["file"] for r in files.collect())


_loaded: dict[str, SuffixAutomaton] = {}


def load_automaton(file: str) -> SuffixAutomaton:
    """The automaton of a file; a worker keeps the last one."""
    if file not in _loaded:
        _loaded.clear()
        fs, path = pafs.FileSystem.from_uri(file)
        with fs.open_input_stream(path, compression=None) as source:
            _loaded[file] = pickle.loads(source.read())
    return _loaded[file]


def find(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, block_words: int = BLOCK_WORDS, edit: Callable[[bytes, int, list], bytes | None] | None = None) -> DataFrame:
    """Per document: the columns of `keep`, n_words, spans array<struct<start,end>> (words, merged), items array<long>.

    The order of items is that of their ids; null item ids are not reported but count as hits.
    edit(text, words, spans) may change the texts that have spans.
    """
    kept = [f"k{i}" for i in range(len(keep))]
    docs = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)], F.col("text").cast("binary").alias("text"))
    names = [*kept, "text", "n_words", "spans", "items"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    files = store_automata(benchmark, window, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Each automaton is loaded once a batch, and meets its texts slice by slice, so that only the words of a slice are held at a time.
            _, offsets = byte_column(whole.column("text"))
            slices = list(blocks(offsets, SLICE_BYTES)) or [(0, 0)]
            n_words = [0] * whole.num_rows
            spans: list[list[list[int]]] = [[] for _ in n_words]
            items: list[set] = [set() for _ in n_words]
            for file in files or [None]:
                automaton = load_automaton(file) if file else SuffixAutomaton([], window)
                for a, b in slices:
                    texts = [x or b"" for x in whole.column("text").slice(a, b - a).to_pylist()]
                    for at, (n, found, ids) in enumerate(match(automaton, texts), a):
                        n_words[at] = n
                        spans[at] += found
                        items[at] |= ids
            for a, b in slices:
                batch = whole.slice(a, b - a)
                texts = batch.column("text").to_pylist()
                merged = [_joined(s) for s in spans[a:b]]
                if edit is not None:
                    texts = [edit(t, n, s) if s else t for t, n, s in zip(texts, n_words[a:b], merged)]
                named = [sorted(i - {None}) for i in items[a:b]]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.binary()), pa.array(n_words[a:b], pa.int64()), pa.array(merged, span), pa.array(named, pa.list_(pa.int64()))], names=names)
        release_memory()

    df = docs.mapInArrow(run, f"{kinds}, n_words long, spans array<struct<start:bigint,end:bigint>>, items array<bigint>")
    return df.select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], "n_words", "spans", "items", F.col("text").cast("string").alias("text"))


def _joined(spans: list[list[int]]) -> list[dict[str, int]]:
    """Spans that meet or overlap as one."""
    out: list[dict[str, int]] = []
    for a, b in sorted(spans):
        if out and out[-1]["end"] >= a:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def _cut(text: bytes, spans: list) -> bytes:
    """text without the words of the spans; what stands between the words of one span goes with them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : places[s["start"]][0]])
        at = places[s["end"] - 1][1]
    return b"".join(out) + text[at:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_span: int = MIN_SPAN, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """docs (columns of documents) without hit spans of at least min_span words; documents with a larger share of hit words than max_coverage go."""
    keep = tuple(c for c in docs.columns if c != "text")

    def edit(text: bytes, words: int, spans: list) -> bytes | None:
        if sum(s["end"] - s["start"] for s in spans) > max_coverage * words:
            return None
        wanted = [s for s in spans if s["end"] - s["start"] >= min_span]
        return _cut(text, wanted) if wanted else text

    found = find(docs, benchmark, keep, window, edit=edit).filter((F.size("spans") == 0) | F.col("text").isNotNull())
    changed = F.size("spans") > 0
    return found.select(*[F.when(changed, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def digests(found: DataFrame) -> DataFrame:
    """The op1 digest of find()."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    named = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
