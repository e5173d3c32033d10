"""Exact n-gram Jaccard self-join, by T-occurrence search with DivideSkip.

Two texts link when their sets of word shingles overlap enough: for a threshold
t, at least T(a, b) = ceil(t / (1 + t) * (a + b)) shared shingles for sets of
sizes a and b. The result is a component per text, so copies need not be
expanded into pairs, but no link between different texts is lost.

1. Texts with equal sets form one class (a fingerprint of the set), so only
   classes are compared. Shingles that are very frequent (heavy hitters over all
   texts, at most MAX_HOT) are put last in the order of shingles; this order
   changes the work, never the result.
2. Each class posts the first n - ceil(t n) + 1 shingles of its set in that
   order; classes that link share a posted shingle.
3. Contraction: each class is compared with the leader it meets most often among
   its posted shingles' classes (one pair per class).
4. What remains are pairs that share a posted shingle and don't link with the
   same leader. Two classes that meet at a frequent shingle post all their
   other shingles; so either they meet there too, or the frequent ones alone must
   reach T, which sizes rule out for most. Classes meet only in cells of their
   sizes; sizes and parity bitmaps, both exact bounds, leave few pairs.
5. Pairs are verified in cells of one query and candidates of about CELL shingles
   in all: the candidates' shingles make inverted lists; DivideSkip sets the
   longest lists aside, heap-merges the short ones for T minus their number of
   occurrences, and probes the long ones by binary search.

What a shingle's posts have in common (their number, leader, largest group) is
told by windows for ordinary shingles. The posts of a frequent one, which may be
those of a third of all rows, are dealt over SALTS tasks; what they have in
common is summed up in a table of MAX_HOT rows at most, which is broadcast.

Only sets of classes in question are shipped: a bit filter of fixed size with
their fingerprints is sent to the scan, and false hits cost nothing but their
transport.

Edge cases: null, empty and wordless texts have no shingles and link with
nothing; fewer words than a shingle make one element of the whole sequence; a
null doc_id has no component of its own id, but links like any row; rows that
repeat a doc_id are rows of their own, for keep_one too; texts may have any length
and need not be UTF-8; of equally good leaders that with the larger fingerprint
leads; empty tables give no rows. Only doc_id and text are read besides columns
that are passed on, which may have any name. Fingerprints and shingles are 64-bit
hashes.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import blocks, byte_column, discard, release_memory, stored
from .graph import components
from .hashing import Recent, mixed, shingle_sets

BLOCK = 1 << 18
#: Shingles of the candidates of a cell, on average.
CELL = 1 << 15
#: Least and most bits of the parity bitmap of a set; between them it has at least as many as the set has elements.
PARITY = (1024, 1 << 20)
#: Most shingles that count as very frequent, and the least texts they stand in.
MAX_HOT, HOT_TEXTS = 50_000, 256
#: Tasks that the posts of a frequent shingle are dealt over.
SALTS = 256
#: Share of a stretch of texts in which a shingle must stand to be counted as a heavy hitter.
HOT_SHARE = 0.001
STRETCH = 1_000_000
#: log2 of the bits of the filter of fingerprints.
FILTER_BITS = 25
#: The weight of DivideSkip's choice of long lists.
MU = 0.0085


def required(a: int, b: int, percent: int) -> int:
    """Shared elements that sets of sizes a and b need for a Jaccard similarity of percent / 100."""
    return -(-percent * (a + b) // (100 + percent))


def posted(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def fingerprint(tokens: np.ndarray) -> np.uint64:
    return mixed(np.array([mixed(tokens ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64))[0]


def parity(tokens: np.ndarray) -> bytes:
    """A bit per hash of an element, set if an odd number of elements share it; the number of bits is a power of two."""
    size = min(PARITY[1], max(PARITY[0], 1 << (len(tokens) - 1).bit_length() if len(tokens) else 0))
    return np.packbits((np.bincount((tokens >> np.uint64(20)) % np.uint64(size), minlength=size) & 1).astype(np.uint8)).tobytes()


def differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bits that differ between bitmaps, pair by pair: a lower bound of the symmetric difference. The longer one is folded to the shorter."""
    out = np.zeros(len(a), np.int64)
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b)]).reshape(-1, 2)
    for x, y in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes == (x, y)).all(1))
        for k in range(0, len(at), max(1, (8 << 20) // max(x, y))):
            part = at[k : k + max(1, (8 << 20) // max(x, y))]
            left, right = (np.frombuffer(b"".join(side[i] for i in part), np.uint8).reshape(len(part), -1) for side in (a, b))
            while left.shape[1] != right.shape[1]:
                if left.shape[1] < right.shape[1]:
                    left, right = right, left
                half = left.shape[1] // 2
                left = left[:, :half] ^ left[:, half:]
            out[part] = np.bitwise_count(left ^ right).sum(1)
    return out


def _sets(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, offsets = byte_column(batch.column(column))
    for a, b in blocks(offsets, BLOCK):
        yield a, shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """Rows of texts (hit false: doc_id, f fingerprint, n, parity) and heavy hitters of stretches (hit true: f shingle, n texts)."""

    def hits(held: list[np.ndarray]) -> pa.RecordBatch:
        u, c = np.unique(np.concatenate(held), return_counts=True)
        much = c >= max(4, HOT_SHARE * len(held))
        k = int(much.sum())
        return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(u[much].view(np.int64)), pa.array(c[much].astype(np.int64)), pa.nulls(k, pa.binary()), pa.array([True] * k, pa.bool_())], names=["doc_id", "f", "n", "parity", "hit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for first, sets in _sets(batch, 1, width):
                f = np.array([fingerprint(s) if len(s) else 0 for s in sets], np.uint64)
                bits = [parity(s) for s in sets]
                n = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array(f.view(np.int64)), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array([False] * len(sets), pa.bool_())], names=["doc_id", "f", "n", "parity", "hit"])
                held += [s for s in sets if len(s)]
                size += sum(n)
                if size >= STRETCH:
                    yield hits(held)
                    held, size = [], 0
        if held:
            yield hits(held)
        held.clear()
        release_memory()

    return docs.mapInArrow(run, "doc_id long, f long, n long, parity binary, hit boolean")


def postings(docs: DataFrame, width: int, percent: int, hot: np.ndarray) -> DataFrame:
    """(token, f, n, own, hot) of each text's posted shingles; own: how many of its shingles aren't hot. Equal sets of a task post once as a rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lately = Recent()
        for batch in batches:
            for _, sets in _sets(batch, 1, width):
                parts = []
                for s in sets:
                    if not len(s) or lately.holds(f := int(fingerprint(s))):
                        continue
                    n = len(s)
                    p = posted(n, percent)
                    if len(hot):
                        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                        frequent = hot[at] == s
                        own = s[~frequent]
                        rest = s[frequent][: max(0, p - len(own))]
                        tokens = np.concatenate([own[:p], rest])
                        parts.append((tokens, f, n, len(own), min(p, len(own))))
                    else:
                        parts.append((s[:p], f, n, n, p))
                if not parts:
                    continue
                sizes = [len(t) for t, *_ in parts]
                spread = lambda i, kind: np.repeat(np.array([x[i] for x in parts], kind), sizes)
                place = np.arange(sum(sizes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([t for t, *_ in parts]).view(np.int64)),
                        pa.array(spread(1, np.uint64).view(np.int64)),
                        pa.array(spread(2, np.int32)),
                        pa.array(spread(3, np.int32)),
                        pa.array(place >= spread(4, np.int64)),
                    ],
                    names=["token", "f", "n", "own", "hot"],
                )
        release_memory()

    return docs.mapInArrow(run, "token long, f long, n int, own int, hot boolean")


def _dealt(posts: DataFrame) -> DataFrame:
    """posts with `deal`, so that (token, deal) doesn't grow with a frequent token's posts."""
    return posts.withColumn("deal", F.when(F.col("hot"), F.pmod(F.xxhash64("f"), F.lit(SALTS))).otherwise(0).cast("int"))


def _in_common(posts: DataFrame, **of: Column) -> DataFrame:
    """posts (a stored table with deal) with aggregates over all posts of their token."""
    frequent = posts.filter("hot").groupBy("token").agg(*[c.alias(f"hot_{k}") for k, c in of.items()])
    window = Window.partitionBy("token", "deal")
    wide = posts.withColumns({k: c.over(window) for k, c in of.items()}).join(F.broadcast(frequent), "token", "left")
    return wide.withColumns({k: F.when(F.col("hot"), F.col(f"hot_{k}")).otherwise(F.col(k)) for k in of}).drop(*[f"hot_{k}" for k in of])


def divide_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """Occurrences of every record that stands in at least `least` of the sorted lists."""
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < least or not lists:
        return {}
    aside = min(int(least / (MU * max(1.0, np.log2(len(lists[-1]))) + 1)), least - 1, len(lists))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    out: dict[int, int] = {}
    record, count = None, 0

    def settle() -> None:
        nonlocal count
        left = len(long)
        for x in long:
            if count + left < least:
                return
            k = bisect_left(x, record)
            count += k < len(x) and x[k] == record
            left -= 1
        if count >= least:
            out[record] = count

    for r in heapq.merge(*short):
        if r != record:
            if record is not None and count + aside >= least:
                settle()
            record, count = r, 0
        count += 1
    if record is not None and count + aside >= least:
        settle()
    return out


def search(query: np.ndarray, candidates: list[np.ndarray], percent: int) -> list[int]:
    """Which candidates link with the query."""
    if not len(query) or not candidates:
        return []
    least = [required(len(query), len(c), percent) for c in candidates]
    tokens = np.concatenate(candidates)
    owner = np.repeat(np.arange(len(candidates)), [len(c) for c in candidates])
    at = np.searchsorted(query, tokens)
    at[at == len(query)] = 0
    inside = query[at] == tokens
    at, owner = at[inside], owner[inside]
    o = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[o])) + 1
    lists = [x.tolist() for x in np.split(owner[o], cuts)] if len(o) else []
    return sorted(k for k, n in divide_skip(lists, min(least)).items() if n >= least[k])


def _bits(needed: DataFrame) -> np.ndarray:
    """A bit per hash of the fingerprints (f): at most 2**FILTER_BITS bits, gathered as words of 32."""
    place = F.pmod("f", F.lit(1 << FILTER_BITS))
    words = needed.select((place / 32).cast("int").alias("word"), F.expr("shiftleft(1L, cast(pmod(f, 32) as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 32, np.uint32)
    rows = words.toArrow()
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return out


def verify(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (q, m, n_m shingles) of fingerprints whose sets link, as edges (a, b); pairs is a stored table."""
    bits = _bits(pairs.select(F.explode(F.array("q", "m")).alias("f")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lately = Recent()
        for batch in batches:
            for _, found in _sets(batch, 1, width):
                wanted: dict[int, bytes] = {}
                for s in found:
                    if len(s) and not lately.holds(int(f := fingerprint(s))):
                        x = int(f.view(np.int64))
                        place = x % (1 << FILTER_BITS)
                        if int(bits[place >> 5]) >> (place & 31) & 1:
                            wanted[x] = s.tobytes()
                if wanted:
                    yield pa.RecordBatch.from_arrays([pa.array(list(wanted), pa.int64()), pa.array(list(wanted.values()), pa.binary())], names=["f", "tokens"])
        release_memory()

    # Texts of one class in several tasks ship their set several times; one of them is enough.
    shipped = docs.mapInArrow(sets, "f long, tokens binary").groupBy("f").agg(F.first("tokens").alias("tokens"))
    many = pairs.groupBy("q").agg(F.ceil(F.sum("n_m") / F.lit(CELL)).cast("int").alias("cells")).filter("cells > 1")
    cells = pairs.join(many, "q", "left").withColumn("cell", F.coalesce(F.pmod(F.xxhash64("m"), F.col("cells")), F.lit(0)).cast("int"))
    members = cells.select("q", "cell", F.col("m").alias("f")).unionByName(cells.select("q", "cell", F.col("q").alias("f")).distinct())
    filled = members.join(shipped, "f").select("q", "cell", "f", "tokens")
    filled = filled.repartition(F.col("q"), F.col("cell")).sortWithinPartitions("q", "cell", "f")

    def solve(cell: tuple[int, int], held: dict[int, np.ndarray]) -> list[tuple[int, int]]:
        query = held.pop(cell[0], None)
        if query is None:
            return []
        names = list(held)
        return [(cell[0], names[k]) for k in search(query, [held[x] for x in names], percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        edges = lambda out: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        for batch in batches:
            out = []
            q, c, f = (batch.column(k).to_pylist() for k in range(3))
            for k in range(batch.num_rows):
                if (q[k], c[k]) != now:
                    if now is not None:
                        out += solve(now, held)
                    now, held = (q[k], c[k]), {}
                held[f[k]] = np.frombuffer(batch.column(3)[k].as_py(), np.uint64)
            yield edges(out)
        if now is not None:
            yield edges(solve(now, held))
        held = {}
        release_memory()

    return filled.mapInArrow(run, "a long, b long")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (q, m, n_m) that sizes and parity bitmaps don't rule out."""
    side = lambda c: classes.select(F.col("f").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"))
    wide = pairs.join(side("q"), "q").join(side("m"), "m")
    least = F.ceil(F.lit(percent) * (F.col("n_q") + F.col("n_m")) / F.lit(100.0 + percent))

    @F.pandas_udf("long")
    def differ(a, b):
        import pandas as pd

        return pd.Series(differing(a.tolist(), b.tolist()))

    wide = wide.filter(F.least("n_q", "n_m") >= least)
    return wide.filter((F.col("n_q") + F.col("n_m") - differ("p_q", "p_m")) / 2 >= least).select("q", "m", "n_m")


def _led(edges: DataFrame) -> DataFrame:
    """(node, root): the leader of each class (or that one's leader) with which it links. A class has one leader at most, so this is no search for components; it only leaves fewer pairs."""
    up = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    above = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return up.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def link(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, f, n, component): f is the fingerprint of the row's set, component the smallest doc_id of all rows reachable by links."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    found = stored(profiles(docs, width), "jaccard-profiles")
    rows = found.filter(~F.col("hit")).drop("hit")
    frequent = found.filter("hit").groupBy("f").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_TEXTS).orderBy(F.desc("n"), "f").limit(MAX_HOT)
    hot = np.sort(np.array([r["f"] for r in frequent.collect()], np.int64).view(np.uint64))
    classes = rows.filter("n > 0").groupBy("f").agg(F.min("n").alias("n"), F.first("parity").alias("parity"), F.min("doc_id").alias("doc_id"))
    classes = stored(classes, "jaccard-classes")

    # Classes that share a posted shingle; one row of a class and shingle, though several tasks may have posted it.
    by_token = Window.partitionBy("token", "deal")
    posts = _dealt(postings(docs, width, percent, hot)).withColumn("again", F.lag("f").over(by_token.orderBy("f"))).filter("again is null or again <> f").drop("again")
    posts = posts.withColumn("texts", F.count("*").over(by_token)).filter("texts > 1 or hot")
    posted_by = posts = stored(posts.select("token", "f", "n", "own", "hot", "deal", "texts"), "jaccard-posts")
    shared = posts.filter("hot").groupBy("token").agg(F.count("*").alias("all"))
    posts = posts.join(F.broadcast(shared), "token", "left").withColumn("texts", F.when(F.col("hot"), F.col("all")).otherwise(F.col("texts"))).drop("all")

    # A class whose posted shingles stand in many others is central; it leads where they meet.
    central = (F.sum(F.col("texts") * 1000).over(Window.partitionBy("f")) / F.col("n")).cast("long")
    weights = stored(posts.select("token", "f", "n", "hot", "deal", central.alias("weight")), "jaccard-weighed")
    weighed = _in_common(weights, leader=F.max(F.struct("weight", "f", "n"))).select("f", "n", F.col("leader.f").alias("leader"), F.col("leader.n").alias("leader_n"))
    near = F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * percent
    votes = weighed.filter((F.col("f") != F.col("leader")) & near).groupBy("f", "leader").agg(F.count("*").alias("votes"))
    chosen = votes.groupBy("f").agg(F.max(F.struct("votes", "leader")).alias("best")).select(F.col("best.leader").alias("q"), F.col("f").alias("m"))
    first = stored(_possible(chosen, classes, percent), "jaccard-first")
    discard(spark, weights)
    edges = stored(verify(docs, first, width, percent), "jaccard-edges")
    joined = _led(edges)

    # Pairs without a common leader that meet at a shingle. The largest such group of a shingle's classes needs no pairs within.
    met = posts.select("token", "f", "n", "own", "hot", "deal").join(joined.select(F.col("node").alias("f"), "root"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    rooted = stored(met, "jaccard-rooted")
    discard(spark, posted_by)
    met = _in_common(rooted, low=F.min("root"), high=F.max("root")).filter("low <> high").drop("low", "high")
    met = met.withColumn("size", F.count("*").over(Window.partitionBy("token", "deal", "root")))
    several = stored(met.withColumn("most", F.max(F.struct("size", "root")).over(by_token)), "jaccard-met")
    discard(spark, rooted)
    groups = several.filter("hot").groupBy("token", "root").agg(F.count("*").alias("size")).groupBy("token").agg(F.max(F.struct("size", "root"))["root"].alias("hot_largest"))
    # Sizes that may link lie in one cell or in neighbouring ones.
    cell = F.floor(F.log("n") / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    met = several.join(F.broadcast(groups), "token", "left").select("token", "f", "n", "own", "hot", "root", F.coalesce("hot_largest", "most.root").alias("largest"), cell.alias("cell"))
    near_by = F.explode(F.array(*[F.col("cell") + k for k in (-1, 0, 1)]))
    a = met.filter("root <> largest").select("token", near_by.alias("cell"), *[F.col(c).alias(f"a_{c}") for c in ("f", "n", "own", "hot", "root")])
    b = met.select("token", "cell", *[F.col(c).alias(f"b_{c}") for c in ("f", "n", "own", "root", "largest")])
    least = F.ceil(F.lit(percent) * (F.col("a_n") + F.col("b_n")) / F.lit(100.0 + percent))
    hot_reach = F.least(F.col("a_n") - F.col("a_own"), F.col("b_n") - F.col("b_own"))
    once = (F.col("b_root") == F.col("b_largest")) | (F.col("a_root") < F.col("b_root"))
    apart = once & (F.col("a_root") != F.col("b_root")) & (F.least("a_n", "b_n") >= least) & (~F.col("a_hot") | (hot_reach >= least))
    pairs = a.join(b, ["token", "cell"]).filter(apart).select(F.least("a_f", "b_f").alias("q"), F.greatest("a_f", "b_f").alias("m")).distinct()
    rest = stored(_possible(pairs, classes, percent), "jaccard-rest")
    more = stored(verify(docs, rest, width, percent), "jaccard-edges")
    roots = components(edges.unionByName(more))
    for done in (first, edges, several, rest, more):
        discard(spark, done)

    owned = classes.select("f", "doc_id").join(roots.select(F.col("node").alias("f"), "root"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    least_id = owned.groupBy("root").agg(F.min("doc_id").alias("component"))
    labelled = owned.join(least_id, "root").select("f", "component")
    return rows.select("doc_id", F.when(F.col("n") > 0, F.col("f")).alias("f"), "n").join(labelled, "f", "left").withColumn("component", F.coalesce("component", "doc_id"))


def components_of(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """The op4 result: doc_id, n_shingles, component_id."""
    return link(docs, width, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs (columns of documents) with one row of each component, and all rows without shingles, which link with nothing.

    The row with the smallest doc_id stays (null comes last), of those the one
    with the smallest hash of doc_id and text, then of its other columns.
    """
    # The columns of docs are o0, o1 and so on, so that they may have any name. Rows are named by what they say, as a doc_id
    # may be null or stand on different texts.
    own = [f"o{k}" for k in range(len(docs.columns))]
    doc_id, text = (own[docs.columns.index(c)] for c in ("doc_id", "text"))
    others = [o for o in own if o not in (doc_id, text)]
    named = docs.select(*[common.named(c).alias(o) for c, o in zip(docs.columns, own)]).withColumn("row", F.xxhash64(doc_id, text))
    linked = link(named.select(F.col("row").alias("doc_id"), F.col(text).alias("text")), width, percent)
    linked = linked.select(F.col("doc_id").alias("row"), (F.col("n") > 0).alias("one"), "component").distinct()
    order = F.struct(F.col(doc_id).isNull(), doc_id, "row")
    best = linked.filter("one").join(named.select("row", doc_id).distinct(), "row").groupBy("component").agg(F.min(order)["row"].alias("row"))
    stays = best.select("row", F.lit(True).alias("one")).unionByName(linked.filter("not one").select("row", "one"))
    turn = F.row_number().over(Window.partitionBy("row").orderBy(F.xxhash64(*others) if others else F.lit(0)))
    kept = named.join(stays, "row").withColumn("turn", turn).filter("turn = 1 or not one")
    return kept.select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own)])
