"""Every stage of the pipeline against a brute-force version of it, on its own input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_jaccard import brute as components
from test_llm_operators import brute_hits, quality_brute, tokenizer_path

import corpus_pipeline
from corvane.llm import decontaminate, packing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def whole_characters(text, lo, hi):
    while lo < hi and text[lo] & 0xC0 == 0x80:
        lo += 1
    while hi > lo and hi < len(text) and text[hi] & 0xC0 == 0x80:
        hi -= 1
    return lo, hi


def without_later_copies(docs, length=200):
    """(id, text) without the windows that stand at an earlier place; equal rows: one stays."""
    seen, out = set(), []
    for i, t in sorted(((i, (t or "").encode()) for i, t in docs), key=lambda d: (d[0] is not None, d[0] or 0)):
        cover, fresh = [False] * (len(t) + 1), []
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                cover[p : p + length] = [True] * length
            seen.add(w)
        kept, at, p = b"", 0, 0
        while p < len(t):
            if cover[p]:
                q = p
                while cover[q]:
                    q += 1
                lo, hi = whole_characters(t, p, q)
                kept, at, p = kept + t[at:lo], hi, q
            p += 1
        kept += t[at:]
        if kept or not any(cover):
            out.append((i, kept.decode()))
    return sorted(out, key=str)


def pairs(df):
    return sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    text = lambda n=60: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    shared, item = text(), text()
    docs = [(k, text(), "en", "s", 0) for k in range(60)]
    docs += [(k, " ".join(["SPAM!!"] * 40), "en", "s", 0) for k in range(200, 240)]
    docs += [(80, docs[0][1] + " more", "en", "s", 0), (81, docs[1][1], "en", "s", 0), (82, text() + "\n" + shared, "en", "s", 0), (83, shared + "\n" + text(), "en", "s", 0), (84, item, "en", "s", 0), (85, text() + " " + item + " " + text(), "en", "s", 0)]
    docs += [(None, text(), None, None, None), (None, text(), None, None, None), (86, None, None, None, None), (87, "", "en", "s", 0), (88, docs[2][1], "en", "s", 0), (88, text(), "en", "s", 0), (89, text(5000), "en", "s", 0)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, item.upper())], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(k, int(k < 60), 0) for k in [*range(60), *range(200, 240)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs, item


def test_stages_against_brute_force(spark, corpus, tmp_path):
    folder, docs, item = corpus
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = now.columns, sorted(((d[0], d[1] or "") for d in docs), key=str)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        if k < 4:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/stage{k}")
        now, seen = spark.read.parquet(f"{tmp_path}/stage{k}"), now
        if k == 0:
            model = quality.train(seen, spark.read.parquet(f"{folder}/labels.parquet"))

            def good(t):
                stats = quality_brute(t)
                x = np.array([[stats[n] for n in model.names]])
                return 1 / (1 + np.exp(-model.bias - sum(w for r, w in zip(model.rules, model.weights) if r.holds(x)[0]))) >= quality.THRESHOLD

            want = [d for d in before if good(d[1])]
            assert 50 <= len(want) < len(before) and not any("SPAM" in t for _, t in want)
        elif k == 1:
            # rows get numbers of their own in the order of ids, as ids may repeat or be missing
            numbered = list(enumerate(sorted(before, key=lambda d: (d[0] is None, d[0] or 0))))
            label = components([(n, t) for n, (_, t) in numbered], 5, 80)
            want = [d for (n, d), (_, size, c) in zip(numbered, label) if n == c or not size]
            assert len(want) < len(before)
            got = pairs(now)
            assert [i for i, _ in got] == [i for i, _ in sorted(want, key=str)]
            want = got  # of rows with equal ids any may stay
            assert {80, 81}.isdisjoint(i for i, _ in got) and sum(i == 88 for i, _ in got) == 1
        elif k == 2:
            want = without_later_copies(before)
            assert sum(len(t) for _, t in want) < sum(len(t) for _, t in before)
        elif k == 3:
            hits = {(i, n): hit for i, n, hit, *_ in brute_hits([(j, t) for j, (_, t) in enumerate(before)], [(1, item)], decontaminate.WINDOW)}
            share = {j: hit / max(1, n) for (j, n), hit in hits.items()}
            want = [(i, t) for j, (i, t) in enumerate(before) if share[j] <= decontaminate.MAX_COVERAGE]
            got = pairs(now)
            assert sorted((i for i, _ in got), key=str) == sorted((i for i, _ in want), key=str)
            clean = {(i, t) for j, (i, t) in enumerate(before) if not share[j]}
            assert clean <= set(got) and not any(item in t for _, t in got)
            want = got
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(tokenizer_path())
            ids = sorted(i for _, text in before for i in [*t.encode(text, add_special_tokens=False).ids, packing.END_ID])
            got = now.collect()
            assert sorted(i for r in got for i in np.frombuffer(r["ids"], "<u4").tolist()) == ids
            break
        before = pairs(now)
        assert before == sorted(want, key=str), name
    assert corpus_pipeline.run(spark, folder).agg(F.sum("length")).first()[0] == len(ids)


def test_empty_tables(spark, tmp_path):
    for name, schema in {"documents": SCHEMA, "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
