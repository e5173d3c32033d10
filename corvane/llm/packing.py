"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A document's cost is linear in its tokens plus quadratic (attention) in them.
Each task tokenises the documents of its partition and packs them in groups of
bounded size: pieces of a full sequence go into sequences of their own, the
rests are taken in descending length and put into the sequence of lowest cost
that has the capacity (a tree over the remaining capacities finds it); only where
no sequence of the group has it, the piece is cut at the cheapest one. The
capacities of a group add up to its tokens exactly: full sequences and a last one,
whose pieces are carried over to the task's next group. So a task pads one
sequence at most. No shuffle: a lost task is computed again from its input
partition, with the same result.

Edge cases: null text counts as empty (only the end token), a null doc_id is
kept as such, repeated rows are packed as often as they occur, rows of equal
length are taken in the order of their partition, a document of any length is cut
into pieces, bytes that aren't UTF-8 are read as replacement characters, an empty
table gives no rows. Only doc_id and text are read, so other columns may have any
name.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory

SEQUENCE_TOKENS = 4096
END_ID = 2
GROUP_TOKENS = 4_000_000
GROUP_DOCS = 50_000
LINEAR, QUADRATIC = 1.0, 1.0 / SEQUENCE_TOKENS
#: Entries of the caches of stretches and of their letters, after which a cache starts anew with the next texts, and the longest stretch that is kept.
CACHE_WORDS, CACHE_LETTERS, CACHE_LENGTH = 300_000, 600_000, 48
SCHEMA = "sequence_id long, offset long, doc_id long, start long, length long, doc_tokens long, ids binary"

_encoders: dict[str, "WordEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: what stands for each byte that isn't a printable Latin-1 character."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {byte: chr(256 + k) for k, byte in enumerate(x for x in range(256) if x not in shown)}


class _Stretches(dict):
    """Token ids by stretch; one that isn't known is encoded, and kept unless it is long."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        self.encode = encode

    def __missing__(self, stretch: str) -> bytes:
        ids = self.encode(stretch)
        if len(stretch) <= CACHE_LENGTH:
            self[stretch] = ids
        return ids


class WordEncoder:
    """Token ids of texts; the ids of a stretch between spaces are computed once and kept.

    The tokenizer splits at white space before anything else, so the ids of a
    text are those of its stretches end to end. It also splits letters from the
    punctuation marks behind them: Latin letters, once lower-case and in the
    byte-level alphabet, are one word for its model. All other stretches are
    encoded as they are.
    """

    latin, marks = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+"), ".,!?;:*#%&$|"
    bytes_as_letters = _byte_letters()

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.words = _Stretches(self._stretch)
        self.letters = _Stretches(self._letters)
        self.ends = _Stretches(self._encode)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        """Of a word of lower-case Latin letters."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.bytes_as_letters)
        ids = [t.id for t in self.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _stretch(self, stretch: str) -> bytes:
        word = stretch.rstrip(self.marks)
        if not self.latin.fullmatch(word):
            return self._encode(stretch)
        ids = self.letters[word.lower()]
        return ids if len(word) == len(stretch) else ids + self.ends[stretch[len(word) :]]

    def encode(self, texts: list[str]) -> list[bytes]:
        for cache, most in ((self.words, CACHE_WORDS), (self.letters, CACHE_LETTERS), (self.ends, CACHE_WORDS)):
            if len(cache) > most:
                cache.clear()
        get = self.words.__getitem__
        return [b"".join(map(get, x.replace("\n", " ").split(" "))) for x in texts]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


class Rooms:
    """Open sequences by remaining capacity: the cheapest of those with at least a given one.

    A heap per capacity, and over the capacities a tree of their cheapest entries.
    """

    def __init__(self, limit: int) -> None:
        self.size = 1 << limit.bit_length()
        self.heaps: dict[int, list[tuple[float, int]]] = {}
        self.best: list[tuple[float, int] | None] = [None] * (2 * self.size)

    def _settle(self, room: int) -> None:
        heap, best = self.heaps[room], self.best
        k = room + self.size
        best[k] = heap[0] if heap else None
        while k > 1:
            a, b = best[k], best[k ^ 1]
            k >>= 1
            now = b if a is None or (b is not None and b < a) else a
            if best[k] == now:
                return
            best[k] = now

    def put(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.heaps.setdefault(room, []), (cost, sequence))
        self._settle(room)

    def take(self, least: int, rooms: list[int]) -> tuple[float, int] | None:
        """Remove and return (cost, sequence) of the cheapest with room for `least`."""
        found, k = None, least + self.size
        best = self.best
        while True:  # the entries from `least` up are k and the right siblings on its way to the root
            if (b := best[k]) is not None and (found is None or b < found):
                found = b
            while k & 1:
                k >>= 1
            if k == 0:
                break
            k += 1
        if found is not None:
            room = rooms[found[1]]
            heapq.heappop(self.heaps[room])
            self._settle(room)
        return found


def assign(lengths: list[int], limit: int = SEQUENCE_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """(sequence, offset, document, start, length) of every piece, by sequence and offset; all sequences but the last are full."""
    pieces, rests, n = [], [], 0
    for d, length in enumerate(lengths):
        for start in range(0, length - limit + 1, limit):
            pieces.append((n, 0, d, start, limit))
            n += 1
        if rest := length % limit:
            rests.append((rest, d, length - rest))
    total = sum(r[0] for r in rests)
    capacity = [limit] * (total // limit) + [total % limit] * (total % limit > 0)
    room, rooms = list(capacity), Rooms(limit)
    for k, r in enumerate(room):
        rooms.put(r, 0.0, k)
    rests.sort(key=lambda r: (-r[0], r[1]))
    for length, d, start in rests:
        while length:
            c, k = rooms.take(length, room) or rooms.take(1, room)
            take = min(length, room[k])
            pieces.append((n + k, capacity[k] - room[k], d, start, take))
            room[k] -= take
            if room[k]:
                rooms.put(room[k], c + cost(take), k)
            length -= take
            start += take
    return sorted(pieces)


#: A document or what is left of one: its id, its token ids, how many come before these, and how many the document has.
Held = tuple[int | None, bytes, int, int]


def _pack(docs: list[Held], first: int, limit: int, end: bool) -> tuple[list[pa.RecordBatch], list[Held], int]:
    """The pieces, the documents carried over (those of an unfilled last sequence, unless this is the end), and sequences made."""
    pieces = assign([len(ids) // 4 for _, ids, _, _ in docs], limit)
    last = pieces[-1][0] if pieces else -1
    carried: list[Held] = []
    if pieces and not end and sum(x[4] for x in reversed(pieces) if x[0] == last) < limit:
        for _, _, d, start, length in [x for x in pieces if x[0] == last]:
            doc_id, ids, base, whole = docs[d]
            carried.append((doc_id, ids[4 * start : 4 * (start + length)], base + start, whole))
        pieces = [x for x in pieces if x[0] != last]
    out = []
    for k in range(0, len(pieces), 2000):
        part = pieces[k : k + 2000]
        whole = [docs[d] for _, _, d, _, _ in part]
        columns = [
            pa.array([first + s for s, *_ in part], pa.int64()),
            pa.array([x[1] for x in part], pa.int64()),
            pa.array([w[0] for w in whole], pa.int64()),
            pa.array([w[2] + x[3] for w, x in zip(whole, part)], pa.int64()),
            pa.array([x[4] for x in part], pa.int64()),
            pa.array([w[3] for w in whole], pa.int64()),
            pa.array([w[1][4 * x[3] : 4 * (x[3] + x[4])] for w, x in zip(whole, part)], pa.binary()),
        ]
        out.append(pa.RecordBatch.from_arrays(columns, names=["sequence_id", "offset", "doc_id", "start", "length", "doc_tokens", "ids"]))
    return out, carried, last + 1


def pack(docs: DataFrame, tokenizer_path: str, limit: int = SEQUENCE_TOKENS, reuse: bool = True) -> DataFrame:
    """A row per piece: sequence_id, offset in it, doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit).

    reuse keeps what a worker knows of stretches for its next task; without it the memory is free for other work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), np.array([END_ID], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 32
        held: list[Held] = []
        tokens = 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for k in range(0, batch.num_rows, 400):
                coded = enc.encode([(x or b"").decode(errors="replace") for x in texts.slice(k, 400).to_pylist()])
                held += [(i, c + end, 0, len(c) // 4 + 1) for i, c in zip(ids.slice(k, 400).to_pylist(), coded)]
                tokens += sum(map(len, coded)) // 4 + len(coded)
                if tokens >= GROUP_TOKENS or len(held) >= GROUP_DOCS:
                    out, held, made = _pack(held, first, limit, False)
                    yield from out
                    first, tokens, out = first + made, sum(len(x[1]) for x in held) // 4, []
        if held:
            yield from _pack(held, first, limit, True)[0]
        held = []
        if not reuse:
            enc = None
            _encoders.clear()
        release_memory()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def digests(packed: DataFrame) -> DataFrame:
    """The op6 digest of pack()."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
