"""Byte-level BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    lib = Tokenizer.from_file(PATH)
    lib.no_truncation()
    lib.no_padding()
    return lib


def wanted(lib, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def strange_texts():
    rng = random.Random(11)
    letters = " \n\t  a'sdltreé漢字1٣!?\x1c　\xa0 "
    some = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)]
    any_of = lambda: chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)]))
    some += ["".join(any_of() for _ in range(rng.randrange(1, 20))) for _ in range(500)]
    return some + ["", "a<|endoftext|>  b <|endoftext|>", "<|endoftext|>", "x<|endoftext", " " * 50, "   x", "x   ", "a" * 37, "a" * 36 + "b", "=" * 90, "a\n \n  b", "it's we'll DON'T", "՘֋ x", "\x00"]


@pytest.mark.parametrize(("block", "cache"), [(1 << 23, 400_000), (64, 300)])
def test_ids_are_those_of_the_library(library, monkeypatch, block, cache):
    monkeypatch.setattr(bpe, "BLOCK", block)
    monkeypatch.setattr(bpe, "CACHE", cache)
    texts = strange_texts()
    code = bpe.PairCoder(PATH)
    for _ in range(2):  # the second time from the cache
        ids = code.encode(texts)
        assert ids == wanted(library, texts)
    assert [code.decode(x) for x in ids] == [library.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in ids]
    assert len(code.spaced) + len(code.others) <= cache + len(texts) * 20 and max(map(len, code.others)) <= bpe.CACHE_LENGTH


def test_decoding_of_partial_characters(library):
    rng, code = random.Random(5), bpe.PairCoder(PATH)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert code.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_merges_against_a_search_piece_by_piece():
    rng = random.Random(3)
    for _ in range(60):
        table, size = [], 4
        pool = list(range(4))
        for _ in range(12):
            a, b = rng.choice(pool), rng.choice(pool)
            if (a, b) not in {(x, y) for x, y, _ in table}:
                table.append((a, b, size))
                pool.append(size)
                size += 1
        ranks = bpe.Ranks(table, size)
        known = {(a, b): (r, m) for r, (a, b, m) in enumerate(table)}
        pieces = [[rng.randrange(rng.choice((1, 4))) for _ in range(rng.randrange(1, 12))] for _ in range(20)]
        ends = np.cumsum([len(p) for p in pieces])
        index = bpe.PairIndex(np.concatenate([np.array(p, np.int32) for p in pieces]), np.concatenate([[0], ends[:-1]]), ranks)
        index.merge()
        want = []
        for p in pieces:
            p = list(p)
            while found := [(known[x][0], k) for k, x in enumerate(zip(p, p[1:])) if x in known]:
                r, k = min(found)
                p[k : k + 2] = [table[r][2]]
            want += p
        assert index.symbols[:-1][index.alive].tolist() == want


def test_tables_that_are_not_plain_are_refused(tmp_path):
    with pytest.raises(ValueError, match="plain"):
        bpe.PairCoder(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError, match="later"):
        bpe.Ranks([(4, 0, 5), (0, 0, 4)], 6)


def test_query_is_the_librarys(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    ids = wanted(library, [r["text"] for r in docs])
    want = sorted((r["doc_id"], len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r, x in zip(docs, ids))
    got = queries.op11_pair_index_bpe(spark, FOLDER)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_edges(spark, library):
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "null id"), (4, "long " * 5000 + "x" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("marks", F.lit(1))
    got = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted(((r["doc_id"] or 0, bytes(r["ids"]), r["text"]) for r in got.collect())) == sorted((i or 0, x, t or "") for (i, t), x in zip(rows, wanted(library, [t for _, t in rows])))
    assert bpe.digests(bpe.decode(bpe.encode(docs.limit(0), PATH), PATH)).count() == 0
    raw = spark.sql("select 1L doc_id, cast(concat(cast('a ' as binary), x'ff', cast(' b' as binary)) as string) text")
    assert bpe.decode(bpe.encode(raw, PATH), PATH).first()["text"] == "a � b"
