"""Byte-level BPE by a pair occurrence index, and its decoder.

A task takes its texts in blocks. The distinct pieces of a block that the
tokenizer would merge within (letters with the space before them, digits, other
marks, white space) are laid end to end as byte symbols, linked forwards and
backwards. The index maps each pair of neighbours, named by its rank in the merge
table, to all positions in the block where it stands. The ranks in use are applied
in ascending order: all positions of the lowest are merged at once, and only the
pairs to the left and right of a merge leave their lists and join others, which may
bring new ranks into use. As the token that a merge makes can only be part of
later merges (checked when the table is read), this gives the tokens of a
greedy search piece by piece.

A text is cut before white space that follows other characters, where no piece
ever crosses; the ids of such a stretch are kept for later texts of the task.
Special tokens of the tokenizer that stand in a text are one id each, as the
library has them.

Edge cases: null text is an empty one, which has no ids; a null doc_id stays
null; repeated rows are encoded as often as they stand; ties can't occur, as a
pair has one rank and positions are merged from left to right; texts may have any
length and are read in slices (a stretch without white space and a piece of one kind
of characters are held whole, at some 60 bytes a byte); bytes that aren't UTF-8 are
read as replacement characters; an empty table gives no rows. Only doc_id and text
are read, so other columns may have any name.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory

#: Characters of text that a task takes at once, or of a long text; entries of the cache of stretches and the longest one it keeps.
BLOCK, CACHE, CACHE_LENGTH = 1 << 22, 300_000, 48
NONE = np.int32(2**31 - 1)
#: White space and the pattern of byte-level pieces, as the tokenizer's kind defines them.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_pieces = regex.compile(PIECES)
_stretches = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_uneven = re.compile(f" [{SPACE}]|[{SPACE}] ")
_cut = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
_coders: dict[str, "PairCoder"] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def new_in_unicode(text: str) -> bool:
    """Whether text holds characters that Python's tables don't know, whose classes libraries may take from different versions."""
    return not text.isascii() and max(text) >= "\u0558" and any(unicodedata.category(c) == "Cn" for c in text)


def pieces_of(text: str) -> list[str]:
    if new_in_unicode(text):
        from tokenizers import pre_tokenizers

        return [text[a:b] for _, (a, b) in pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]
    return _pieces.findall(text)


class PairIndex:
    """Symbols of pieces end to end, linked, and for each rank in use the positions of its pair."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, ranks: "Ranks") -> None:
        n = len(symbols)
        # Position n stands for no neighbour: its symbol is in no pair.
        self.symbols = np.append(symbols.astype(np.int32), np.int32(-1))
        self.after = np.arange(1, n + 2, dtype=np.int32)
        self.before = np.arange(-1, n, dtype=np.int32)
        self.after[starts[1:] - 1] = n
        self.before[starts] = n
        self.after[n] = self.before[n] = n
        self.ranks, self.alive = ranks, np.ones(n, bool)
        self.rank = np.full(n + 1, NONE, np.int32)
        self.lists: dict[int, list[np.ndarray]] = {}
        self.used: list[int] = []
        self._list(np.arange(n, dtype=np.int32))

    def _list(self, at: np.ndarray) -> None:
        """Enter the pairs that now start at the positions."""
        rank = self.ranks.of(self.symbols[at], self.symbols[self.after[at]])
        self.rank[at] = rank
        known = rank != NONE
        at, rank = at[known], rank[known]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        edges = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.concatenate([[0], edges])].tolist(), np.split(at, edges) if len(edges) else (at,)):
            if r in self.lists:
                self.lists[r].append(part)
            else:
                self.lists[r] = [part]
                heappush(self.used, r)

    def merge(self) -> None:
        """Apply the ranks in use in ascending order until none is left."""
        while self.used:
            r = heappop(self.used)
            parts = self.lists.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[self.rank[at] == r]  # the others were merged into something else meanwhile
            if not len(at):
                continue
            left, right, made = self.ranks.merges[r]
            if left == right:
                at = self._apart(np.sort(at))
            gone = self.after[at]
            follows = self.after[gone]
            self.symbols[at] = made
            self.after[at] = follows
            self.before[follows] = at
            self.before[-1] = len(self.alive)
            self.rank[gone] = NONE
            self.alive[gone] = False
            self._list(np.unique(np.concatenate([at, self.before[at]])))

    def _apart(self, at: np.ndarray) -> np.ndarray:
        """Of positions of a pair of equal symbols, in ascending order, those that a pass from left to right merges: every other one of a run."""
        fresh = np.ones(len(at), bool)
        fresh[1:] = self.after[at[:-1]] != at[1:]
        run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        return at[(np.arange(len(at)) - run) % 2 == 0]


class Ranks:
    """The merge table: rank of a pair of ids, and per rank (left, right, made)."""

    def __init__(self, merges: list[tuple[int, int, int]], size: int) -> None:
        born = {}
        for r, (left, right, made) in enumerate(merges):
            if born.get(left, -1) >= r or born.get(right, -1) >= r or made in born:
                raise ValueError("a merge uses a token that a later one makes, or makes one again")
            born[made] = r
        if any(born.get(x, -1) > r for r, (a, b, _) in enumerate(merges) for x in (a, b)):
            raise ValueError("a merge uses a token that a later one makes")
        self.merges, self.size = merges, size
        keys = np.array([a * size + b for a, b, _ in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.order = np.append(keys[order], np.int64(2**62)), np.append(order.astype(np.int32), NONE)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.order[at], NONE)


class PairCoder:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and model["type"] == "BPE"
        odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        special = spec.get("added_tokens", [])
        if not plain or odd or spec.get("normalizer") or any(t[k] for t in special for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
        vocab, letters = model["vocab"], byte_letters()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        size = 1 + max([*vocab.values(), *(t["id"] for t in special)])
        self.ranks = Ranks([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], size)
        self.bytes = np.array([vocab[x] for x in letters], np.int32)
        value = {x: b for b, x in enumerate(letters)}
        self.tokens = [b""] * size
        for token, i in vocab.items():
            self.tokens[i] = bytes(value[c] for c in token)
        for t in special:
            self.tokens[t["id"]] = t["content"].encode()
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in special}
        self.marks = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # Ids of stretches; a space before the stretch is left out in the keys of `spaced`.
        self.spaced: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}

    def _learn(self, stretches: list[str]) -> list[bytes]:
        """The ids of distinct stretches, by the pair index over their distinct pieces."""
        cut = [pieces_of(s) for s in stretches]
        pieces = list({p for c in cut for p in c})
        raw = [p.encode() for p in pieces]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        if not len(ends):
            return [b""] * len(stretches)
        starts = np.concatenate([[0], ends[:-1]])
        index = PairIndex(self.bytes[np.frombuffer(b"".join(raw), np.uint8)], starts, self.ranks)
        index.merge()
        ids = index.symbols[:-1][index.alive].astype("<u4").tobytes()
        bounds = [0, *(4 * np.cumsum(index.alive)[ends - 1]).tolist()]
        known = {p: ids[a:b] for p, a, b in zip(pieces, bounds, bounds[1:])}
        return [b"".join([known[p] for p in c]) for c in cut]

    def _slices(self, text: str) -> Iterator[str]:
        """Parts of a text of about BLOCK characters, cut where no piece crosses."""
        at = 0
        while len(text) - at > BLOCK:
            m = _cut.search(text, at + BLOCK)
            if m is None:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        if len(self.spaced) + len(self.others) > CACHE:
            self.spaced, self.others = {}, {}
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0
        for k, text in enumerate(texts):
            for part in self.marks.split(text) if self.marks else (text,):
                if part in self.special:
                    held.append((k, part))
                    continue
                for piece in self._slices(part):
                    held.append((k, piece))
                    size += len(piece)
                    if size >= BLOCK:
                        self._block(held, out)
                        held, size = [], 0
        self._block(held, out)
        return [b"".join(x) for x in out]

    def _block(self, held: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        """Append the ids of each (row, part) of a block."""
        split: list[tuple[list[str], list[str]]] = []
        for _, part in held:
            if part in self.special or not part:
                split.append(([], []))
            elif _uneven.search(part) or part[-1] == " ":
                split.append((_stretches.findall(part), []))
            else:
                first, *rest = part.split(" ")
                split.append(([first] if first else [], rest))
        others = list(set().union(*(a for a, _ in split)) - self.others.keys())
        spaced = list(set().union(*(b for _, b in split)) - self.spaced.keys())
        ids = self._learn(others + [" " + s for s in spaced])
        self.others.update(zip(others, ids))
        self.spaced.update(zip(spaced, ids[len(others) :]))
        other, space = self.others.__getitem__, self.spaced.__getitem__
        for (k, part), (a, b) in zip(held, split):
            out[k].append(self.special.get(part) or b"".join([*map(other, a), *map(space, b)]))
        for s in others:  # long ones are kept for this block only, so the cache is bounded in bytes too
            if len(s) > CACHE_LENGTH:
                del self.others[s]
        for s in spaced:
            if len(s) > CACHE_LENGTH:
                del self.spaced[s]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters, ids without a token are left out."""
        tokens, size = self.tokens, len(self.tokens)
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist() if i < size]).decode(errors="replace")


def coder(path: str) -> PairCoder:
    if path not in _coders:
        _coders[path] = PairCoder(path)
    return _coders[path]


def _groups(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` in total size, one row at least."""
    at, total = 0, 0
    for k, size in enumerate(sizes):
        if k > at and total + size > limit:
            yield at, k
            at, total = k, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids): the token ids of each text, little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer_path)
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.binary_length(texts).fill_null(0).to_pylist()
            for a, b in _groups(sizes, BLOCK):
                ids = code.encode([(x or b"").decode(errors="replace") for x in texts.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
        release_memory()

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, text) of encode()'s rows; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer_path)
        for batch in batches:
            ids = batch.column(1)
            sizes = pc.binary_length(ids).fill_null(0).to_pylist()
            for a, b in _groups(sizes, BLOCK):
                part = ids.slice(a, b - a)
                texts = [code.decode(x or b"") for x in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), part, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])
        release_memory()

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """The op11 digest of decode()."""
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
