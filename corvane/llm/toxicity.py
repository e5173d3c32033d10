"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer maps words (and quotation marks) to classes: insult, threat,
target (an address), negation, limit ("only", "long"), contrast, reported speech,
self, mention ("the word"), quote, other. Five small sequential transducers then mark an
insult or threat that stands in the scope of a negation (not of "not only" or "not
long"), behind a word that mentions it as a word, after a verb of reporting in its clause
(or in a quotation that such a verb follows; what speakers say of themselves they said
is their own), or close to a target; they are composed into one table, which is run over
each clause that holds an insult or threat. A negated or reported one stays so
whatever address stands beside it. Clauses end at full stops, question and
exclamation marks, semicolons and line ends outside quotations; a colon doesn't end
one, as it introduces speech. Each clause counts once for insults and once for
threats, by its strongest mark, and a logistic model weighs the counts, so a negated
or reported insult counts by what labelled rows say, with the grammar's own weights
as the prior where the rows say nothing.

The insults and threats are learned: words, and word stems (prefixes), whose
documents in a bounded sample of labelled rows are toxic far beyond chance; a few
common ones are given. A learned word that mostly follows a word of intent ("will")
is a threat, any other an insult. Scoring is a map over the scan, with the lexicon in
the task; its words each stand in at least three documents of the bounded sample,
which bounds the lexicon.

Edge cases: null and empty texts have no clause and get the score of a document
without hits; without labels of both classes the prior weights hold; of equally
strong words and stems the learned set holds all; repeated rows are scored one by
one; texts may have any length, and bytes that aren't UTF-8 are read as replacement
characters; empty tables give no rows. Only doc_id and text of documents are read,
so other columns may have any name. Labels, lang, source and ids are no inputs of
the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import SAMPLE_ROWS, distinct, remainder, sample, with_texts

MODULUS, HELD_OUT = 5, 0
THRESHOLD = 0.5
#: Words that an address, a negation, a speaker before a verb of reporting, and a mention reach.
REACH, SCOPE, OWN, NAMED = 3, 5, 2, 2
STEM = (3, 8)
PRECISION = 0.9
#: Different words that a stem must have.
FORMS = 4
#: Share of a learned word's places that follow a word of intent, from which it is a threat.
INTENDED = 0.5
CACHE_WORDS = 200_000

SEED = {
    "insult": "idiot idiots moron morons scum imbecile dumbass",
    "threat": "kill murder hurt destroy strangle stab töten umbringen tuer matar",
    "target": "you your yours u du dich dir ihr euch tu te toi vous vos usted ustedes ti",
    "negation": "not never isn't aren't don't won't kein keine nicht nie ne pas jamais no nunca jamás",
    "limit": "only just merely long nur bloß lange seulement longtemps solo sólo solamente",
    "self": "i we i've we've ich wir je j'ai nous yo nosotros",
    "mention": "word words term noun wort wörter begriff mot mots terme palabra palabras término",
    "contrast": "but aber sondern mais pero sino",
    "report": "said says say told wrote claimed quoted called sagte sagt schrieb disait dit écrit dijo dice escribió",
    "quote": '"',
}
#: Words before a learned threat.
INTENT = frozenset("will i'll we'll gonna shall werde werden vais allons voy vamos".split())
CLASSES = ("other", *SEED)
HITS = ("insult", "threat")
#: What a document is told by: clauses by their strongest mark, for insults and for threats, and log of hits.
MARKS = ("plain", "targeted", "negated", "reported")
STRENGTH = ("targeted", "plain", "reported", "negated")
PRIOR = np.array([-4.0, 6.0, 7.0, 0.5, 1.0, 1.5, 6.0, 0.2, 0.5, 0.5])
PRIOR_STRENGTH = 0.5

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|\"")
CLAUSE = re.compile(r'(?:"[^"\n]*"|[^.!?;\n])+')
_PLAIN = str.maketrans({**dict.fromkeys("“”„«»", '"'), "’": "'"})


class Negation:
    """After a negation, the next SCOPE words are in its scope, up to a contrast; a limit at once after it undoes it."""

    start = 0

    def step(self, state: int, symbol: tuple) -> tuple[int, tuple]:
        if symbol[0] == "negation":
            return SCOPE, symbol
        if symbol[0] == "contrast" or symbol[0] == "limit" and state == SCOPE:
            return 0, symbol
        if symbol[0] == "quote":
            return state, symbol
        if state and symbol[0] in HITS:
            return state - 1, (*symbol, "negated")
        return max(state - 1, 0), symbol


class Mention:
    """A hit up to NAMED words behind a word for words is named, not said."""

    start = 0

    def step(self, state: int, symbol: tuple) -> tuple[int, tuple]:
        if symbol[0] == "mention":
            return NAMED, symbol
        if symbol[0] == "quote":
            return state, symbol
        return max(state - 1, 0), (*symbol, "reported") if state and symbol[0] in HITS else symbol


class Reported:
    """A verb of reporting holds for the rest of its clause, and for a quotation just before it, unless the speakers report themselves."""

    start = (0, 0, "", 0)  # after a verb, within a quotation, the last hit of the quotation, words that a speaker still reaches

    def step(self, state: tuple[int, int, str, int], symbol: tuple) -> tuple[tuple[int, int, str, int], tuple]:
        after, within, hit, own = state
        if symbol[0] == "self":
            return (after, within, hit, OWN), symbol
        if symbol[0] == "report":
            if own:
                return (after, within, "" if not within else hit, 0), symbol
            return (1, within, "", 0), (*symbol, "back", hit) if hit and not within else symbol
        if symbol[0] == "quote":
            return (after, 1 - within, hit if within else "", own), symbol
        own = max(own - 1, 0)
        if symbol[0] in HITS:
            return (after, within, symbol[0] if within else hit, own), (*symbol, "reported") if after else symbol
        return (after, within, hit, own), symbol


class Targeted:
    """An address up to REACH words before, or at once after, an insult or threat targets it, unless it is negated or reported."""

    start = (0, "")  # words that an address still reaches, the kind of a hit just before

    def step(self, state: tuple[int, str], symbol: tuple) -> tuple[tuple[int, str], tuple]:
        before, hit = state
        if symbol[0] == "target":
            return (REACH, ""), (*symbol, "after", hit) if hit else symbol
        if symbol[0] in HITS:
            weak = "negated" in symbol or "reported" in symbol
            return (max(before - 1, 0), "" if weak else symbol[0]), (*symbol, "targeted") if before and not weak else symbol
        if symbol[0] == "quote":
            return state, symbol
        return (max(before - 1, 0), ""), symbol


class Emit:
    """The mark of a place, (kind, modifier): of a hit, of an address just after one, or of a verb that reports the quotation before it."""

    start = 0

    def step(self, state: int, symbol: tuple) -> tuple[int, tuple]:
        if symbol[0] == "target" and "after" in symbol:
            return state, (symbol[2], "targeted")
        if symbol[0] == "report" and "back" in symbol:
            return state, (symbol[2], "back")
        if symbol[0] not in HITS:
            return state, ()
        return state, (symbol[0], next((m for m in ("negated", "reported", "targeted") if m in symbol), "plain"))


def compose(machines: tuple) -> dict[tuple[int, int], tuple[int, tuple]]:
    """One table of (state, class) -> (state, emitted) that does what the machines do one after another."""
    start = tuple(m.start for m in machines)
    known, todo, table = {start: 0}, [start], {}
    while todo:
        states = todo.pop()
        for c, name in enumerate(CLASSES):
            symbol, after = (name,), []
            for m, s in zip(machines, states):
                s, symbol = m.step(s, symbol)
                after.append(s)
            after = tuple(after)
            if after not in known:
                known[after] = len(known)
                todo.append(after)
            table[known[states], c] = (known[after], symbol)
    return table


MACHINES = (Negation(), Mention(), Reported(), Targeted(), Emit())
TABLE = compose(MACHINES)


@dataclass
class Lexicon:
    """The lexical transducer: words, and stems of insults and threats, with their classes."""

    words: dict[str, int]
    stems: dict[str, int]
    cache: dict[str, int] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"words": self.words, "stems": self.stems, "cache": {}}

    def of(self, word: str) -> int:
        c = self.cache.get(word)
        if c is None:
            c = self.words.get(word, 0)
            if not c and self.stems:
                c = next((k for n in range(STEM[0], min(STEM[1], len(word)) + 1) if (k := self.stems.get(word[:n]))), 0)
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            if len(word) <= 40:
                self.cache[word] = c
        return c


def seed_words() -> dict[str, int]:
    return {w: CLASSES.index(c) for c, words in SEED.items() for w in words.split()}


def clause_marks(clause: str, lexicon: Lexicon) -> tuple[dict[str, str], int]:
    """The strongest mark of each kind in a clause, and how many hits it has."""
    state, n, emitted = 0, 0, []
    for w in TOKEN.findall(clause):
        c = lexicon.of(w)
        state, mark = TABLE[state, c]
        n += CLASSES[c] in HITS
        if mark and mark[1] == "back":  # what the quotation said is reported
            emitted = [(k, "reported" if k == mark[0] and m != "negated" else m) for k, m in emitted]
        elif mark:
            emitted.append(mark)
    return {kind: min((m for k, m in emitted if k == kind), key=STRENGTH.index) for kind in HITS if any(k == kind for k, _ in emitted)}, n


def features(text: str, lexicon: Lexicon) -> list[float]:
    """1, then numbers of clauses by strongest mark (MARKS) for insults and for threats, as logs from the third on, and log of hits."""
    text = text.translate(_PLAIN).lower()
    out = [0.0] * len(PRIOR)
    out[0] = 1.0
    hits = {w for w in set(WORD.findall(text)) if CLASSES[lexicon.of(w)] in HITS}
    if not hits:
        return out
    total = 0
    for clause in CLAUSE.findall(text):
        if hits.isdisjoint(WORD.findall(clause)):
            continue
        marks, n = clause_marks(clause, lexicon)
        total += n
        for kind, mark in marks.items():
            out[1 + len(MARKS) * HITS.index(kind) + MARKS.index(mark)] += 1
    out[1:-1] = [x if x < 2 else 1 + math.log2(x) for x in out[1:-1]]
    out[-1] = math.log1p(total)
    return out


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float]

    def score(self, text: str) -> float:
        z = sum(w * x for w, x in zip(self.weights, features(text, self.lexicon)))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _words(text: Column) -> Column:
    """The different words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+(?:'\p{L}+)?"), F.lit(0)))


def learn_lexicon(found: DataFrame) -> Lexicon:
    """Words and stems that mark toxic documents in (text, label), by counts of documents."""
    words = found.select("label", F.explode(_words(F.col("text"))).alias("word"))
    counts = words.groupBy("word").agg(F.sum("label").alias("bad"), F.count("*").alias("n")).cache()
    try:
        total = found.agg(F.sum("label"), F.count("*")).first()
        bad, n = total[0] or 0, total[1]
        lexicon = seed_words()
        if not 0 < bad < n:
            return Lexicon(lexicon, {})
        prefixes = lambda word: F.transform(F.sequence(F.lit(STEM[0]), F.least(F.lit(STEM[1]), F.length(word))), lambda k: F.substring(word, F.lit(1), k))
        forms = counts.filter(F.length("word") >= STEM[0]).select(F.explode(prefixes(F.col("word"))).alias("word")).groupBy("word").agg(F.count("*").alias("forms")).filter(F.col("forms") >= FORMS)
        # A document counts once for a stem, however many words it has of it.
        held = F.array_distinct(F.flatten(F.transform(F.filter(_words(F.col("text")), lambda w: F.length(w) >= STEM[0]), prefixes)))
        stems = found.select("label", F.explode(held).alias("word")).groupBy("word").agg(F.sum("label").alias("bad"), F.count("*").alias("n")).join(forms, "word")
        # So often toxic that chance gives no such candidate among a million.
        often = (math.log(1e6)) / -math.log(max(bad / n, 1e-9))
        strong = (F.col("bad") >= max(3, often)) & (F.col("bad") >= PRECISION * F.col("n"))
        chosen = lambda df: {r["word"] for r in df.filter(strong).select("word").collect()}
        learned, shortest = {w for w in chosen(counts) if w not in lexicon}, set()
        for s in sorted(chosen(stems), key=len):
            if not any(s[:k] in shortest for k in range(STEM[0], len(s))):
                shortest.add(s)
    finally:
        counts.unpersist()
    kinds = _kinds(found, learned, shortest)
    return Lexicon(lexicon | {w: kinds(w) for w in learned}, {s: kinds(s) for s in shortest})


def _kinds(found: DataFrame, words: set[str], stems: set[str]) -> Callable[[str], int]:
    """The class of each learned word or stem: a threat if most of its places in (text, label) follow a word of intent within REACH words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, list[int]] = {}
            for text in b.column(0).to_pylist():
                said = WORD.findall(text.translate(_PLAIN).lower())
                for k, w in enumerate(said):
                    for x in (w, *(w[:n] for n in range(STEM[0], min(STEM[1], len(w)) + 1))):
                        if x in words or x in stems:
                            held = seen.setdefault(x, [0, 0])
                            held[0] += 1
                            held[1] += not INTENT.isdisjoint(said[max(0, k - REACH) : k])
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in (0, 1))], names=["word", "n", "intended"])

    got = found.select("text").mapInArrow(run, "word string, n long, intended long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("intended").alias("intended")).filter(F.col("intended") >= INTENDED * F.col("n"))
    threats = {r["word"] for r in got.collect()}
    return lambda w: CLASSES.index("threat" if w in threats else "insult")


def fit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic weights near PRIOR, by Newton steps."""
    w = PRIOR.copy()
    if len(y) and y.min() < y.max():
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
            g = x.T @ (p - y) + PRIOR_STRENGTH * (w - PRIOR)
            h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + PRIOR_STRENGTH * np.eye(len(w))
            step = np.linalg.solve(h, g)
            w -= step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    w[1:] = np.maximum(w[1:], 0)
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    found = distinct(with_texts(docs, sample(labels, "toxic", MODULUS, HELD_OUT, rows))).cache()
    try:
        lexicon = learn_lexicon(found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                f = [features(t, lexicon) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array(f, pa.list_(pa.float64()))], names=["label", "f"])

        got = found.select("text", "label").mapInArrow(run, "label int, f array<double>").groupBy("label", "f").count().collect()
    finally:
        found.unpersist()
    x = np.array([r["f"] for r in got for _ in range(r["count"])], float).reshape(-1, len(PRIOR))
    y = np.array([r["label"] for r in got for _ in range(r["count"])], float)
    order = np.lexsort([*x.T, y])
    return Model(lexicon, fit(x[order], y[order]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, max(1, b.num_rows), 1000):
                part = b.slice(k, 1000)
                s = [model.score((t or b"").decode(errors="replace")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The op3 result: doc_id, held_out, score, predicted."""
    held = F.coalesce(remainder(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False))
    return score(docs, train(docs, labels)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
