import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import repeats


def brute(docs, length, keep="none"):
    """docs: [(id, bytes)]; covered spans by plain counting of windows."""
    seen, out = {}, []
    for d, (i, t) in enumerate(docs):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((i, d, p))
    for d, (i, t) in enumerate(docs):
        cover = [False] * len(t)
        for p in range(len(t) - length + 1):
            places = seen[t[p : p + length]]
            if len(places) > 1 and (keep == "none" or min(places) != (i, d, p)):
                cover[p : p + length] = [True] * length
        out.append((i, len(t), sum(cover), sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover)), hashlib.sha256(bytes(b for b, c in zip(t, cover) if not c)).hexdigest()))
    return sorted(out, key=str)


def corpus(rng, n=60):
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 90))) for _ in range(6)]
    docs = []
    for i in range(n):
        t = "".join(rng.choice([rng.choice(passages), "".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))]) for _ in range(rng.randint(0, 6)))
        docs.append((i, t))
    docs += [(n, None), (n + 1, ""), (n + 2, docs[5][1]), (n + 3, "xy" * 400), (n + 4, "zxy" + "xy" * 300)]
    return docs


def test_digest_is_that_of_brute_force(spark, monkeypatch):
    docs = corpus(random.Random(3))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("key", F.lit("x")).repartition(4)
    for most in (4096, 1):  # 1: every key goes the way of the frequent ones
        monkeypatch.setattr(repeats, "MAX_CLASSES", most)
        for length in (24, 40):
            got = sorted((tuple(r) for r in repeats.digests(repeats.remove(df, length)).collect()), key=str)
            assert got == brute([(i, (t or "").encode()) for i, t in docs], length)


def test_keep_first(spark):
    docs = corpus(random.Random(4))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in repeats.digests(repeats.remove(df, 30, "first")).collect()), key=str)
    assert got == brute([(i, (t or "").encode()) for i, t in docs], 30, "first")


def test_keep_first_keeps_one_of_equal_rows(spark, monkeypatch):
    rng = random.Random(6)
    passage, other, periodic = ("".join(rng.choice("abcdé ") for _ in range(90)) for _ in range(3))
    periodic = periodic[:7] * 12
    docs = [(None, passage), (None, passage), (1, other), (1, other), (1, other), (2, "x" + passage + "y" + other), (3, periodic), (3, periodic), (4, "short"), (4, "short"), (None, None), (None, None), (7, passage), (7, "z" + passage), (7, passage)]
    docs.sort(key=lambda d: (d[0] is not None, d[0] or 0))
    df = spark.createDataFrame([(i, t, "en", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, n_chars long").repartition(3)
    for most in (4096, 1):
        monkeypatch.setattr(repeats, "MAX_CLASSES", most)
        named = repeats.digests(repeats.remove(df, 30, "first", ("lang",))).fillna(-1, ["doc_id"])
        assert sorted(map(tuple, named.collect()), key=str) == brute([(-1 if i is None else i, (t or "").encode()) for i, t in docs], 30, "first")
        kept = [(r["doc_id"], r["text"]) for r in repeats.drop_repeats(df, 30).collect()]
        assert kept.count((None, passage)) == kept.count((1, other)) == 1 and kept.count((4, "short")) == kept.count((None, "")) == 2
        assert not any(i == 7 and passage in t for i, t in kept)


def test_periodic_text_repeats_itself(spark):
    docs = [(k, ("ab " * 40)[: 100 + k] + str(k) * 3 + "word" + str(k * 7919)) for k in range(6)] + [(10, "q" * 90), (11, "xyz " * 200), (12, "Of " * 30 + "are " * 30), (13, "n" * 31)]
    docs = [(k, f"{k}{t}") for k, t in docs]
    for d in range(len(docs)):
        one = [docs[d]]
        for keep in ("none", "first"):
            got = [tuple(r) for r in repeats.digests(repeats.remove(spark.createDataFrame(one, "doc_id long, text string"), 30, keep)).collect()] if d in (0, 6, 8, 9) else None
            assert got is None or got == brute([(i, t.encode()) for i, t in one], 30, keep)


def test_long_texts_are_sliced(monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 500)
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    offsets = np.array([0, 100, 2800, 3000])
    covered = {r: [] for r in range(3)}
    for part, cuts, first, place in repeats._slices(data, offsets, 50):
        row, start, n, *_ = repeats.segments(part, cuts, 50)
        for r, s, k in zip(row + first, start + place, n):
            covered[r] += range(s, s + k)
    for r in range(3):
        assert sorted(covered[r]) == list(range(offsets[r + 1] - offsets[r] - 50 + 1))


def test_longest_previous_factors():
    rng = random.Random(1)
    for _ in range(50):
        t = "".join(rng.choice("ab") for _ in range(rng.randint(1, 30)))
        order = sorted(range(len(t)), key=lambda k: t[k:])
        common = lambda a, b: next((k for k in range(min(len(a), len(b)) + 1) if a[: k + 1] != b[: k + 1] or k == min(len(a), len(b))), 0)
        want = [max([common(t[p:], t[q:]) for q in range(p)], default=0) for p in order]
        got = repeats.longest_previous_factors(np.array(order), lambda i, j: np.array([common(t[order[a] :], t[order[b] :]) for a, b in zip(i, j)]))
        assert got.tolist() == want


def test_common_prefixes_from_ranks():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    text[100:180] = text[10:90]
    levels = repeats.ranks(text, 40)
    a, b = rng.integers(0, 330, 500), rng.integers(0, 330, 500)
    a[:50], b[:50] = np.arange(10, 60), np.arange(100, 150)
    true = [next(k for k in range(41) if k == 40 or text[x + k] != text[y + k]) for x, y in zip(a, b)]
    assert repeats.common_prefixes(levels, a, b).tolist() == [k if k == 40 else k - k % 8 for k in true]


def test_a_passage_in_most_texts(spark):
    """One class has many segments in every batch; only its ends are grouped."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(120)
    docs = [(k, text(40) + passage + text(rng.randint(0, 60))) for k in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    for keep in ("none", "first"):
        got = sorted((tuple(r) for r in repeats.digests(repeats.remove(df, 50, keep)).collect()), key=str)
        assert got == brute([(i, t.encode()) for i, t in docs], 50, keep)


def test_empty_table(spark):
    assert repeats.digests(repeats.remove(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_pipeline_form_keeps_characters_and_columns(spark):
    passage = "".join("éà"[k * k * k % 7 % 2] + "abcdefg"[k * k % 7] + str(k) for k in range(40))[:120]
    size = len(passage)
    docs = spark.createDataFrame([(1, passage, "fr", size), (2, "x" + passage + "y", "fr", size + 2), (3, None, None, None), (4, passage, "fr", size)], "doc_id long, text string, lang string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in repeats.drop_repeats(docs, 100).collect()}
    assert got == {1: (passage, size), 2: ("xy", 2), 3: ("", 0)}
