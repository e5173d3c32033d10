"""Approximate nearest neighbours by learned partitions.

On a bounded sample a nearest-neighbour graph is built and cut into balanced
parts (recursive bisection, then moves and swaps that keep more edges inside).
The sample grows with the rows up to SAMPLE_ROWS, and the parts with the sample:
one for each PART_ROWS of it. A small network learns which parts a vector's
neighbours lie in. Every vector is indexed under its most probable part; a query
visits the fewest parts that gave the wanted recall on the sample, and the
candidates there are ranked by exact cosines in double precision.

Parts and the queries that visit them are cut into chunks of bounded size, so
neither a popular part nor one with many queries becomes one task. Of equal
vectors only the k + 1 smallest ids can be an answer, so only these are indexed,
and equal queries are searched once; a vector that a third of all rows share
costs no more than one that stands alone.

Edge cases: null, zero and non-finite vectors, vectors with null components, and null
ids take no part; vectors of each length are searched among themselves, with a network of
their own where they are enough for parts; ties go to the smaller id; rows that repeat id and vector
count once, and an id with different vectors is as near as its nearest vector and
stands in an answer once; with fewer candidates than k all are returned; empty
tables give no rows. Only vec_id and embedding are read, so other columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE_ROWS = 8192
#: Sampled rows for each part.
PART_ROWS = 64
NEIGHBOURS = 10
#: Recall on the sample that decides how many parts a query visits.
WANTED_RECALL = 0.96
CHUNK = 4096
HIDDEN, STEPS, RATE = 128, 150, 0.01
#: Slack of the fast scores, within which exact ones decide.
SLACK = 1e-9


def clean(df: DataFrame) -> DataFrame:
    """(vec_id, v): usable vectors as little-endian doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, "<f8")
                norm = np.sqrt((x * x).sum()) if np.isfinite(x).all() else 0.0
                if norm > 0 and np.isfinite(norm):
                    ids.append(i)
                    out.append((x + 0.0).tobytes())  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, v binary")


def _matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of every row of unit vectors."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part per row, of equal sizes up to 5 %, with many graph edges inside the parts."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1 or len(rows) < 2:
            label[rows] = first
            continue
        own = x[rows] - x[rows].mean(0)
        axis = np.linalg.eigh(own.T @ own)[1][:, -1]
        order = rows[np.argsort(own @ axis, kind="stable")]
        left = n // 2
        cut = len(rows) * left // n
        todo += [(order[:cut], first, left), (order[cut:], first + left, n - left)]
    most = int(np.ceil(len(x) / parts * 1.05))
    source = np.repeat(np.arange(len(x)), near.shape[1])
    target = near.ravel()
    ends, others = np.concatenate([source, target]), np.concatenate([target, source])
    for _ in range(rounds):
        links = np.zeros((len(x), parts), np.int32)
        np.add.at(links, (ends, label[others]), 1)
        best = links.argmax(1)
        gain = links[np.arange(len(x)), best] - links[np.arange(len(x)), label]
        sizes = np.bincount(label, minlength=parts)
        moved = 0
        waiting: dict[tuple[int, int], list[int]] = {}
        for r in np.argsort(-gain, kind="stable"):
            if gain[r] <= 0:
                break
            a, b = int(label[r]), int(best[r])
            if sizes[b] < most:
                label[r] = b
                sizes[a] -= 1
                sizes[b] += 1
                moved += 1
            elif waiting.get((b, a)):
                other = waiting[b, a].pop()
                label[r], label[other] = b, a
                moved += 2
            else:
                waiting.setdefault((a, b), []).append(r)
        if not moved:
            break
    return label


@dataclass
class Router:
    """A network with one hidden layer that gives the probabilities of the parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(_unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def ranked(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def train_router(x: np.ndarray, target: np.ndarray) -> Router:
    """Fitted to the share of each part among a vector and its neighbours, by Adam steps over the whole sample."""
    rng = np.random.default_rng(11)
    d, parts = x.shape[1], target.shape[1]
    p = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, STEPS + 1):
        h = np.maximum(x @ p[0] + p[1], 0)
        z = h @ p[2] + p[3]
        e = np.exp(z - z.max(1, keepdims=True))
        g = (e / e.sum(1, keepdims=True) - target) / len(x)
        gh = (g @ p[2].T) * (h > 0)
        for k, grad in enumerate((x.T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*p)


def fit(vectors: np.ndarray, part_rows: int = PART_ROWS, k: int = 5, wanted: float = WANTED_RECALL) -> Router:
    """From a sample of distinct vectors; the number of probes is set by recall of k neighbours within it."""
    n, d = vectors.shape
    parts = max(1, n // part_rows)
    if parts == 1:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    x = _unit(vectors)
    near = neighbour_graph(x, min(NEIGHBOURS, n - 1))
    label = balanced_parts(x, near, parts)
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), near.shape[1]), label[near].ravel()), 1)
    np.add.at(target, (np.arange(n), label), 2)
    router = train_router(x, target / target.sum(1, keepdims=True))
    ranked = router.ranked(vectors)
    asked = np.arange(0, n, max(1, n // 1000))
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    true = np.argsort(-s, axis=1)[:, :k]
    place = (ranked[asked][:, None, :] == ranked[true][:, :, :1]).argmax(2)
    recall = [(place < p).mean() for p in range(1, parts + 1)]
    router.probes = next((p for p, r in enumerate(recall, 1) if r >= wanted), parts)
    return router


def nearest(query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of query, ids, scores) of the k nearest different ids by exact cosine, ties to the smaller id."""
    unit = _unit(vectors).T
    length = np.sqrt((vectors * vectors).sum(1))
    for at in range(0, len(query), 256):
        fast = _unit(query[at : at + 256]) @ unit
        for r, f in enumerate(fast, at):
            own, wide = query[r], k
            while True:
                least = np.partition(f, len(f) - wide)[len(f) - wide] if len(f) > wide else -np.inf
                held = np.flatnonzero(f >= least - SLACK)
                score = (vectors[held] * own).sum(1) / (length[held] * np.sqrt((own * own).sum()))
                o = np.lexsort((ids[held], -score))
                _, first = np.unique(ids[held][o], return_index=True)
                if len(first) >= k or wide >= len(f):
                    break
                wide *= 4  # an id with several vectors took more than one place
            o = o[np.sort(first)[:k]]
            yield r, ids[held][o], score[o]


def search(df: DataFrame, queries: DataFrame, k: int = 5, sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS, wanted: float = WANTED_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found rows of df (vec_id, embedding) for each row of queries, its own id left out."""
    usable = stored(clean(df), "ann-vectors")
    sizes = {r["size"]: r["count"] for r in usable.groupBy(F.octet_length("v").alias("size")).count().collect()}  # a row a length
    routers, first = {}, {}
    for size, count in sorted(sizes.items()):
        held: list[bytes] = []
        if count >= 2 * part_rows:  # fewer are one part whatever they are
            sample = usable.filter(F.octet_length("v") == size).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(sample_rows)
            held = sample.toArrow()["v"].to_pylist()
        routers[size] = fit(_matrix(held) if held else np.zeros((1, size // 8)), part_rows, k, wanted)
        first[size] = sum(routers[s].w2.shape[1] for s in first)
    turn = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    indexed = usable.distinct().withColumn("turn", turn).filter(F.col("turn") <= k + 1).drop("turn")

    def route(visits: bool):
        """The part of each vector, or the parts that a query visits, numbered through all lengths."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column("v").to_pylist()
                by_size: dict[int, list[int]] = {}
                for at, x in enumerate(v):
                    by_size.setdefault(len(x), []).append(at)
                for size, at in by_size.items():
                    if size not in routers:  # a query whose length no vector has
                        continue
                    r = routers[size].ranked(_matrix([v[i] for i in at]))[:, : routers[size].probes if visits else 1] + first[size]
                    rows = pa.array(np.repeat(np.array(at), r.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(r.ravel().astype(np.int32)), batch.column("vec_id").take(rows), batch.column("v").take(rows)], names=["part", "vec_id", "v"])

        return run

    placed = stored(indexed.mapInArrow(route(False), "part int, vec_id long, v binary"), "ann-index")
    asked = stored(clean(queries).distinct(), "ann-queries")
    visits = asked.groupBy("v").agg(F.min("vec_id").alias("vec_id")).mapInArrow(route(True), "part int, vec_id long, v binary")
    visits = stored(visits, "ann-visits")
    # chunks by part, so that every group of the search is bounded on both sides
    chunks = lambda t, name: t.groupBy("part").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias(name))
    grid = chunks(placed, "c").join(chunks(visits, "q"), "part")
    pick = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(F.broadcast(grid), "part").select("part", pick(F.col("c")).alias("ci"), all_of("q").alias("qi"), "vec_id", "v")
    right = visits.join(F.broadcast(grid), "part").select("part", all_of("c").alias("ci"), pick(F.col("q")).alias("qi"), "vec_id", "v")

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            keys = b["v"].tolist()
            for r, ids, scores in nearest(_matrix(keys), a["vec_id"].to_numpy(), _matrix(a["v"].tolist()), k + 1):
                out += [(keys[r], int(i), float(s)) for i, s in zip(ids, scores)]
        return pd.DataFrame(out, columns=["v", "vec_id", "score"])

    cell = ("part", "ci", "qi")
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(solve, "v binary, vec_id long, score double")
    best = Window.partitionBy("v").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("v", "vec_id").agg(F.max("score").alias("score")).withColumn("turn", F.row_number().over(best)).filter(F.col("turn") <= k + 1).drop("turn")
    own = asked.select(F.col("vec_id").alias("query_id"), "v").join(found, "v").filter("vec_id <> query_id")
    own = own.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    last = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", last.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
