"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of a text are Spark column expressions. On a bounded sample of
labelled rows boosted trees of small depth are grown; every path from a root to
a node becomes a conjunctive rule (thresholds on statistics), and a logistic
model with an L1 penalty over all rules keeps a few of them. The rules and their
weights are compiled into one column expression, so scoring is a projection of
the scan: no shuffle, no Python.

Edge cases: null and empty texts have all statistics 0 and are scored like any
other; without usable labels, with labels of one class, or with too few for a
rule, the score is the smoothed share of label 1; repeated rows are scored one by
one, and equal gains of two splits go to the first; texts may have any length; an
empty table gives no rows. Only doc_id and text are read besides columns that are
passed on, which may have any name. Labels, lang, source and ids are no inputs of
the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .labels import SAMPLE_ROWS, remainder, sample, with_texts

MODULUS, HELD_OUT = 4, 2
THRESHOLD = 0.7
TREES, DEPTH, BINS, RATE, MIN_LEAF = 24, 3, 24, 0.3, 10
PENALTY = 0.002
STEPS = 600


def statistics(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)
    count = lambda plain: chars - F.length(F.replace(text, F.lit(plain), F.lit("")))
    words = count(" ") + count("\n") + 1
    per_word = lambda n: n / words
    found = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return {
        "log_chars": F.log1p(chars.cast("double")),
        "word_chars": per_word((chars - words).cast("double")),
        "upper_words": per_word(found(r"[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ]+").cast("double")),
        "shouts": per_word(found(r"!+").cast("double")),
        "bars": per_word(count("|").cast("double")),
        "symbols": per_word(found(r"[#*$%&|@~^=+<>{}\\_]+").cast("double")),
        "digits": per_word(found(r"[0-9]+").cast("double")),
        "sentence_ends": per_word(found(r"[.?](?=\s|$)").cast("double")),
        "commas": per_word(count(",").cast("double")),
        "lines": per_word(count("\n").cast("double")),
        "repeats": per_word(found(r"(?<!\S)(\S++)(?=\s\1(?!\S))").cast("double")),
        "long_words": per_word(found(r"\S{20,}").cast("double")),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is_greater, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, greater, at in self.terms:
            out &= (x[:, k] > at) if greater else (x[:, k] <= at)
        return out

    def column(self, names: list[str]) -> Column:
        out = None
        for k, greater, at in self.terms:
            term = F.col(names[k]) > F.lit(at) if greater else F.col(names[k]) <= F.lit(at)
            out = term if out is None else out & term
        return out


@dataclass(frozen=True)
class Model:
    names: list[str]
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self) -> Column:
        """The score over columns of the statistics' names."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule.column(self.names), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(codes: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, curve: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """A tree by the Newton gain: the rules of its nodes, and its values."""
    rules: list[Rule] = []
    value = np.zeros(len(codes))

    def split(rows: np.ndarray, terms: tuple, depth: int) -> None:
        if terms:
            rules.append(Rule(terms))
        best = (1e-6, -1, -1)
        total_s, total_c = slope[rows].sum(), curve[rows].sum()
        if depth < DEPTH and len(rows) >= 2 * MIN_LEAF:
            for k, at in enumerate(cuts):
                if not len(at):
                    continue
                s = np.cumsum(np.bincount(codes[rows, k], slope[rows], len(at) + 1))[:-1]
                c = np.cumsum(np.bincount(codes[rows, k], curve[rows], len(at) + 1))[:-1]
                n = np.cumsum(np.bincount(codes[rows, k], minlength=len(at) + 1))[:-1]
                gain = s**2 / (c + 1) + (total_s - s) ** 2 / (total_c - c + 1) - total_s**2 / (total_c + 1)
                gain[(n < MIN_LEAF) | (len(rows) - n < MIN_LEAF)] = -1
                if gain.max() > best[0]:
                    best = (gain.max(), k, int(gain.argmax()))
        _, k, b = best
        if k < 0:
            value[rows] = -total_s / (total_c + 1)
            return
        low = codes[rows, k] <= b
        at = float(cuts[k][b])
        split(rows[low], (*terms, (k, False, at)), depth + 1)
        split(rows[~low], (*terms, (k, True, at)), depth + 1)

    split(np.arange(len(codes)), (), 0)
    return rules, value


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Model(names, [], [], bias)
    cuts = [(lambda u: (u[:-1] + u[1:]) / 2)(np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)))) for c in x.T]
    # Quantiles of a mostly constant statistic leave one value; cut those between it and the rest.
    cuts = [np.unique(np.concatenate([at, [np.partition(np.unique(c), 0)[0]], np.quantile(np.unique(c), [0.1, 0.3, 0.5, 0.7])])) for at, c in zip(cuts, x.T)]
    codes = np.stack([np.searchsorted(at, c, side="left") for at, c in zip(cuts, x.T)], 1)
    logit, rules = np.full(len(y), bias), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        new, value = _grow(codes, cuts, p - y, np.maximum(p * (1 - p), 1e-6))
        logit += RATE * value
        rules.update(dict.fromkeys(new))
    if not rules:  # too few rows for a split
        return Model(names, [], [], bias)
    kept = list(rules)
    held = np.stack([r.holds(x) for r in kept], 1).astype(float)
    _, first = np.unique(held, axis=1, return_index=True)  # rules of the same rows count once
    kept, held = [kept[k] for k in sorted(first)], held[:, sorted(first)]
    w, b = lasso(held, y)
    chosen = np.flatnonzero(w)
    return Model(names, [kept[k] for k in chosen], [float(w[k]) for k in chosen], float(b))


def lasso(a: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal steps."""
    n = len(y)
    a1 = np.hstack([a, np.ones((n, 1))])
    v = np.ones(a1.shape[1])
    for _ in range(20):
        v = a1.T @ (a1 @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / (v @ (a1.T @ (a1 @ v)))
    w = z = np.zeros(a1.shape[1])
    t = 1.0
    for _ in range(steps):
        g = a1.T @ (1 / (1 + np.exp(-(a1 @ z))) - y) / n
        u = z - step * g
        u[:-1] = np.sign(u[:-1]) * np.maximum(np.abs(u[:-1]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, z, t = u, u + (t - 1) / t2 * (u - w), t2
    return w[:-1], w[-1]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    stats = statistics(F.col("text"))
    found = with_texts(docs, sample(labels, "quality", MODULUS, HELD_OUT, rows)).select("label", *[c.alias(n) for n, c in stats.items()])
    got = np.array([tuple(r) for r in found.collect()], float).reshape(-1, len(stats) + 1)
    got = got[np.lexsort(got.T)]  # the order of the rows has no influence
    return fit(got[:, 1:], got[:, 0], list(stats))


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs as o0, o1 and so on, whatever their names, with score and barrier.

    barrier is no fixed value, so a filter that reads it too stays above the
    statistics, and each of them is computed once a row.
    """
    stats = statistics(F.col("text"))
    names = [f"s{k}" for k in range(len(model.names))]
    own = [common.named(c).alias(f"o{k}") for k, c in enumerate(docs.columns)]
    wide = docs.select(*own, *[stats[n].alias(m) for n, m in zip(model.names, names)], F.spark_partition_id().alias("barrier"))
    renamed = Model(names, model.rules, model.weights, model.bias)
    return wide.select(*[f"o{k}" for k in range(len(own))], renamed.column().alias("score"), "barrier")


def _named(scored: DataFrame, docs: DataFrame, *others: Column, without: str | None = None) -> DataFrame:
    return scored.select(*[F.col(f"o{k}").alias(c) for k, c in enumerate(docs.columns) if c != without], *others)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the score as column `name`, which replaces one of that name."""
    return _named(_scored(docs, model), docs, F.col("score").alias(name), without=name)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The op2 result: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    held = F.coalesce(remainder(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects."""
    scored = _scored(docs, train(docs, labels))
    return _named(scored.filter((F.col("score") >= THRESHOLD) & (F.col("barrier") >= 0)), docs)
