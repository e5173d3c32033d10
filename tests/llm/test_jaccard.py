import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import graph, jaccard


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute(docs, width, percent):
    sets = [shingles(t, width) for _, t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    least = {v: min(docs[k][0] for k in range(len(docs)) if label[k] == v) for v in label}
    return sorted((d, len(s), least[v]) for (d, _), s, v in zip(docs, sets, label))


def corpus(rng):
    vocab = [f"w{k}" for k in range(400)] + ["É", "Zß", "ABC", "abc"]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    line = some(14)
    docs, bases = [], [some(rng.randint(5, 150)) for _ in range(12)]
    for _ in range(220):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 2)] = some(rng.randint(0, 2))
            w = w or ["x"]
        if rng.random() < 0.4:
            w = w + line if rng.random() < 0.5 else line + w
        docs.append(w)
    docs += [line + some(rng.randint(0, 2)) for _ in range(40)] + [some(2), some(1), ["a", "b"], ["A", "B"], ["a b"]]
    rows = [(k, rng.choice([" ", "\n", "\t "]).join(w)) for k, w in enumerate(docs)]
    rng.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, " \n"), (903, rows[0][1])]


@pytest.mark.parametrize("hot", [256, 8])
def test_components_are_those_of_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT_TEXTS", hot)
    monkeypatch.setattr(jaccard, "CELL", 300)
    docs = corpus(random.Random(hot))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("f", F.lit("x")).withColumn("component", F.lit(1)).repartition(3)
    assert sorted(tuple(r) for r in jaccard.components_of(df).collect()) == brute(docs, 4, 85)


def test_one_row_of_each_group_stays(spark):
    docs = corpus(random.Random(5))
    df = spark.createDataFrame([(d, t, "en", None) for d, t in docs] + [(None, "x", "en", 1)], "doc_id long, text string, lang string, n_chars long")
    got = sorted(r["doc_id"] for r in jaccard.keep_one(df).filter("doc_id is not null").collect())
    assert got == sorted(d for d, _, c in brute(docs, 5, 80) if d == c)


def test_one_row_stays_whatever_the_ids(spark):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    docs = [(1, a), (5, a + " more"), (5, b), (5, c), (None, d), (None, d), (None, d + " more"), (None, e), (None, e), (7, e + " more"), (8, a), (8, a), (3, ""), (3, "  "), (3, "  "), (None, None), (None, None)]
    df = spark.createDataFrame([(i, t, "en", k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, lang string, n_chars long").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(df).collect()), key=str)
    fixed = [(1, a), (5, b), (5, c), (7, e + " more"), (3, ""), (3, "  "), (3, "  "), (None, None), (None, None)]
    assert got in [sorted([*fixed, (None, x)], key=str) for x in (d, d + " more")]
    assert jaccard.keep_one(df).columns == df.columns


def test_divide_skip():
    rng = random.Random(2)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randint(0, 30))) for _ in range(rng.randint(1, 20))]
        least = rng.randint(1, 12)
        count = {r: sum(r in x for x in lists) for r in range(30)}
        assert jaccard.divide_skip(lists, least) == {r: c for r, c in count.items() if c >= least}


def test_empty_table(spark):
    assert jaccard.components_of(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + k, 1001 + k) for k in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


def test_parity_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (0, 1, 5, 900, 1100, 3000, 9000)]
    sets += [np.unique(np.concatenate([s, sets[3][:200]])) for s in sets]
    pairs = [(a, b) for a in sets for b in sets]
    got = jaccard.differing([jaccard.parity(a) for a, _ in pairs], [jaccard.parity(b) for _, b in pairs])
    true = np.array([len(np.setxor1d(a, b)) for a, b in pairs])
    assert (got <= true).all()
    alike = [min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) for a, b in pairs]
    assert all(g >= 0.2 * t for g, t, x in zip(got, true, alike) if x)
