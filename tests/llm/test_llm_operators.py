"""Decontamination, chat formatting, packing, sharding, WARC, classifiers, and the pipeline's contract."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import chat, decontaminate, jaccard, labels, packing, quality, repeats, sharding, toxicity, warc


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# --- decontamination


def brute_hits(docs, items, window):
    out = []
    for d, text in docs:
        words = decontaminate.words_of((text or "").encode())
        hit, found = [False] * len(words), set()
        for i, t in items:
            w = decontaminate.words_of((t or "").encode())
            size = min(window, len(w))
            for k in range(len(w) - size + 1) if w else ():
                for a in range(len(words) - size + 1):
                    if words[a : a + size] == w[k : k + size]:
                        hit[a : a + size] = [True] * size
                        found.add(i)
        named = ",".join(sorted(map(str, found)))
        out.append((d, len(words), sum(hit), len(found), hashlib.sha256(named.encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [200_000, 12])
def test_decontamination_is_that_of_brute_force(spark, block):
    rng = random.Random(7)
    some = lambda n: [rng.choice("abcdeé") for _ in range(n)]
    items = [(k, " ".join(some(rng.randint(3, 14)))) for k in range(12)] + [(20, "b"), (21, None), (22, "!"), (23, "X Y z"), (24, "x y Z!")]
    docs = [(k, " ".join(some(rng.randint(0, 30)) + (items[rng.randrange(12)][1].upper().split() if rng.random() < 0.5 else []) + some(4))) for k in range(40)]
    docs += [(90, None), (91, ""), (92, "x, y - z"), (93, "xy z"), (94, "x y"), (95, docs[3][1])]
    for chosen in (items, [i for i in items if i[0] not in (20, 23, 24)]):
        d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("spans", F.lit("x"))
        b = spark.createDataFrame(chosen, "item_id long, text string")
        assert rows(decontaminate.digests(decontaminate.find(d, b, window=5, block_words=block))) == brute_hits(docs, chosen, 5)


def test_decontaminate_cuts_spans_and_drops_covered(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"A start, {item}! And an end of some words that stay as they are here, all of them.", "en", 0), (2, item, "en", 0), (3, "clean", "en", 5), (4, None, None, None)], "doc_id long, text string, lang string, n_chars long")
    got = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item.upper())], "item_id long, text string"))
    assert got.columns == docs.columns
    want = "A start, ! And an end of some words that stay as they are here, all of them."
    assert rows(got, "doc_id", "text", "n_chars") == [(1, want, len(want)), (3, "clean", 5), (4, None, None)]
    assert decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).count() == 4
    assert decontaminate.decontaminate(docs.limit(0), docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    raw = spark.sql(f"select 1L doc_id, concat(cast('{item} ' as binary), x'ff', cast(' and some more words here that stay for good, twelve of them' as binary)) text").select("doc_id", F.col("text").cast("string").alias("text"))
    left = decontaminate.decontaminate(raw, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert bytes(left.select(F.col("text").cast("binary")).first()[0]).startswith(b" \xff and some")


# --- chat formatting


def chat_brute(data):
    """Per conversation: turns sorted, and the formatted string with its loss spans (bytes), block by block."""
    esc = lambda t: t.replace("\\", "\\0").replace("<", "\\1").replace("[", "\\2")
    out = {}
    for conv in {x[0] for x in data}:
        own = sorted((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in data if x[0] == conv)
        text, spans = "<s>", []
        for role, run in itertools.groupby(own, lambda t: t[2]):
            first, more, end = {"user": ("[INST]", "[INST+]", "[/INST]"), "assistant": ("[OUT]", "[OUT+]", "</s>"), "system": ("[SYS]", "[SYS+]", "[/SYS]")}.get(role, (f"[ROLE]{esc(role)}[TEXT]", f"[ROLE+]{esc(role)}[TEXT]", "[/ROLE]"))
            for k, (*_, said) in enumerate(run):
                text += more if k else first
                if role == "assistant":
                    spans.append((len(text.encode()), len(esc(said).encode())))
                text += esc(said)
            text += end
        out[conv] = ([t[2:] for t in own], text, spans)
    return out


@pytest.mark.parametrize("run", [256, 2])
def test_chat_round_trip(spark, monkeypatch, run):
    monkeypatch.setattr(chat, "RUN", run)
    data = [(1, 2, "assistant", "b[\\1]"), (1, 1, "user", "</s>[INST] x <s>"), (1, 3, "assistant", "\\0\\[/OUT]"), (2, 1, None, None), (2, 1, "tool [x]", "[TEXT]<"), (2, None, "system", "[SYS]"), (3, 1, "user", ""), (None, 1, "user", "é\n\n"), (3, 1, "user", "")]
    data += [(4, k, ["user", "assistant", "assistant", "assistant", "tool"][k % 5], f"é{k}<") for k in range(23)] + [(5, k, "assistant", f"ж{k}") for k in range(9)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("formatted", F.lit("x"))
    formatted = chat.format_conversations(df)
    want = chat_brute(data)
    for r in chat.read_back(formatted).collect():
        turns, text, spans = want[r["conv_id"]]
        assert r["formatted"] == text and [(s["start"], s["size"]) for s in r["mask"]] == spans
        assert [tuple(t[1:]) for t in r["turns"]] == turns
    for r in chat.digests(formatted).collect():
        turns, text, _ = want[r["conv_id"]]
        loss = "".join(said for role, said in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["formatted_chars"]) == (len(turns), len(loss), len(text))
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0
    assert "Python" not in chat.digests(formatted)._jdf.queryExecution().executedPlan().toString()


# --- packing


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_word_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    e = packing.WordEncoder(tokenizer_path())
    texts = ["", " ", "Hello, World!! it's 42,5% <|endoftext|>x y\tz\r\n", "été İstanbul ΣΑΣ straße ÀÉÎ... don't 'S", "a" * 300 + " " + "é," * 50, "日本語 text ,.!", "x​y \x1c q", "Ünï,cödé; foo|bar&&& ###", "  two  spaces \n\n"]
    texts += ["".join(random.Random(s).choice("abcÉß .,'!\n\té̀|&<>|0 ") for _ in range(200)) for s in range(40)]
    for text, got in zip(texts, e.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_word_encoder_survives_an_emptied_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    e = packing.WordEncoder(tokenizer_path())
    first = e.encode(["one two three four five"])
    assert e.encode(["five six one"])[0][: 4] == first[0][-4:]


def assigned(lengths, limit):
    """The cheapest of all sequences with room, by looking at each; without one the cheapest with any room."""
    pieces, rests, n = [], [], 0
    for d, length in enumerate(lengths):
        for start in range(0, length - limit + 1, limit):
            pieces.append((n, 0, d, start, limit))
            n += 1
        if length % limit:
            rests.append((length % limit, d, length - length % limit))
    total = sum(r[0] for r in rests)
    size = [limit] * (total // limit) + [total % limit] * (total % limit > 0)
    room, costs = list(size), [0.0] * len(size)
    for length, d, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        while length:
            fits = [k for k in range(len(size)) if room[k] >= length] or [k for k in range(len(size)) if room[k]]
            k = min(fits, key=lambda k: (costs[k], k))
            take = min(length, room[k])
            pieces.append((n + k, size[k] - room[k], d, start, take))
            room[k], costs[k], length, start = room[k] - take, costs[k] + packing.cost(take), length - take, start + take
    return sorted(pieces)


def test_assign_takes_the_cheapest_sequence_with_room():
    rng = random.Random(0)
    for n in (0, 1, 5, 300):
        for limit in (4096, 16, 7):
            lengths = [rng.choice([1, 2, 30, 400, 4095, 4096, 4097, 9000]) % (limit * 3) + 1 for _ in range(n)]
            pieces = packing.assign(lengths, limit)
            assert pieces == assigned(lengths, limit)
            filled = {}
            for s, offset, *_, length in pieces:
                assert offset == filled.get(s, 0) and length > 0
                filled[s] = offset + length
            assert sorted(filled.values(), reverse=True)[:-1] == [limit] * (len(filled) - 1 if filled else 0)


@pytest.mark.parametrize("group", [4_000_000, 3000])
def test_packing_keeps_every_token(spark, monkeypatch, group):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "GROUP_TOKENS", group)
    docs = [(k, " ".join(["word"] * (k * 97 % 6000)) + " end") for k in range(20)] + [(50, None), (51, ""), (None, "x"), (3, "again"), (60, "y" * 5000), (61, "y" * 5000 + " z")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit(1)).coalesce(2)
    df = df.unionByName(spark.sql("select 70L doc_id, cast(x'61ff62' as string) text, 1 ids"))
    packed = packing.pack(df, tokenizer_path())
    got = packed.collect()
    t = Tokenizer.from_file(tokenizer_path())
    want = sorted((str(d), t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x in [*docs, (70, "a\ufffdb")])
    whole = {}
    for r in sorted(got, key=lambda r: r["start"]):
        ids = whole.setdefault((str(r["doc_id"]), r["doc_tokens"]), [])
        assert r["start"] == len(ids) and r["length"] * 4 == len(r["ids"])
        ids.extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert sorted((d, ids) for (d, _), ids in whole.items()) == want
    spans = {}
    for r in got:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(s, s[1:])) and sum(b for _, b in s) <= 4096
    padded = [s for s in spans.values() if sum(b for _, b in s) < 4096]
    assert len(padded) <= df.rdd.getNumPartitions()
    # the digest, from the tokenizer's ids
    plain = {d: ids for d, ids in want if d not in ("3",)}
    for r in packing.digests(packed).collect():
        if (ids := plain.get(str(r["doc_id"]))) is not None:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert (r["ids_crc32"], r["doc_tokens"], r["length"]) == (zlib.crc32(part), len(ids), len(part) // 4)
    assert packing.pack(df.limit(0), tokenizer_path()).count() == 0


def test_long_stretches_are_not_kept():
    e = packing.WordEncoder(tokenizer_path())
    first = e.encode(["x" * 3000 + " " + "é" * 100 + "!! short"])
    assert max(map(len, e.words)) <= packing.CACHE_LENGTH and max(map(len, e.letters), default=0) <= packing.CACHE_LENGTH
    assert e.encode(["x" * 3000 + " " + "é" * 100 + "!! short"]) == first


def test_encoder_with_more_new_words_than_its_cache(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    enc = packing.WordEncoder(tokenizer_path())
    for texts in (["one two three four five"], ["one six seven", "eight nine ten. 11"], ["", "one ten"]):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_latin_words_go_to_the_model_once_and_nothing_else_of_the_tokenizer_runs(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    e = packing.WordEncoder(tokenizer_path())
    e.encode(["x. x, x!"])
    texts = ["Anblewh sttible thonre. anblewh, STTIBLE! ÀÿÂ ñandú. Straße", "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)), "ÿ" * 60 + ", anblewh."]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    asked, model = [], e.tokenize
    e.tokenize = lambda word: asked.append(word) or model(word)
    monkeypatch.setattr(e, "_encode", lambda text: pytest.fail(text))
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == want
    assert len(asked) == len(set(asked)) == 8
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts[:1])] == want[:1] and len(asked) == 8


# --- sharding


def test_lookup_table_is_balanced_and_stable():
    names = [f"s{k}" for k in range(10)]
    a = sharding.lookup_table(names, 1009)
    counts = np.bincount(a)
    assert counts.max() - counts.min() <= 1
    b = sharding.lookup_table(names[:-1], 1009)
    moved = sum(x != y for x, y in zip(a, b) if x != 9)
    assert moved < 0.25 * 1009
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_placement(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (1, "d")], "k long, shard string")
    got = sharding.place(df, F.col("k"), ["x", "y", "z"], 101)
    owners = sharding.lookup_table(["x", "y", "z"], 101)
    for r in got.collect():
        slot = int(hashlib.md5(("" if r["k"] is None else str(r["k"])).encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, "xyz"[owners[slot]])
    assert got.count() == 4 and "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_placement_by_a_column_that_is_replaced(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "shard string, slot int")
    got = {(r["shard"], r["slot"]) for r in sharding.place(df, F.col("shard"), ["x", "y"], 101).collect()}
    slot = lambda k: int(hashlib.md5(k.encode()).hexdigest()[:15], 16) % 101
    owners = sharding.lookup_table(["x", "y"], 101)
    assert got == {("xy"[owners[slot(k)]], slot(k)) for k in ("a", "b", "")}
    assert sharding.place(df.limit(0), F.col("slot"), ["x", "y"], 101).count() == 0


# --- WARC


def test_warc_round_trip_over_any_split(spark, tmp_path):
    rng = random.Random(1)
    pages = [(k, f"http://e.org/{k}", rng.choice(["same", "other é", None, "x" * rng.randint(0, 3000), "\x1f\x8b\x08" * 40])) for k in range(60)]
    pages += [(None, None, "same"), (70, "http://e.org/a\r\nb", "same"), (70, "http://e.org/c", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record_type", F.lit(1)).repartition(3)
    manifest = warc.write_archives(df, f"file://{tmp_path}/a", file_bytes=2000)
    assert manifest.count() > 3
    largest = {}
    for i, _, h in pages:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", -1))
    want = sorted(((i, len((h or "").encode()), warc.digest((h or "").encode()), "response" if i == largest[h or ""] else "revisit", None if i == largest[h or ""] else largest[h or ""]) for i, _, h in pages), key=str)
    for split in (37, 1000, 1 << 20):
        got = warc.read_archives(spark, manifest, split)
        assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert {r[0] for r in rows(got.filter("page_id = 70"), "url")} == {"http://e.org/a%0D%0Ab", "http://e.org/c"}
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_reader_passes_over_false_and_broken_members(tmp_path):
    good = [warc.record(k, "http://e.org", b"p%d" % k, None) for k in range(3)]
    data = good[0] + b"\x1f\x8b\x08junk" + good[1][:-9] + b"...." + good[2]
    (tmp_path / "f").write_bytes(data)
    with pa.OSFile(str(tmp_path / "f")) as source:
        got = [r for _, r in warc.read_range(source, 0, len(data))]
    assert [r.get("page_id") for r in got if r["record_type"] != "broken"] == [0, 2]
    assert sum(r["record_type"] == "broken" for r in got) == 1


def test_a_broken_archive_fails_the_round_trip(spark, tmp_path):
    member = warc.record(1, "http://e.org", b"x" * 5000, None)
    (tmp_path / "f.warc.gz").write_bytes(member[:-6])
    manifest = spark.createDataFrame([(f"file://{tmp_path}/f.warc.gz", len(member) - 6)], "file string, bytes long")
    assert [r["record_type"] for r in warc.read_archives(spark, manifest).collect()] == ["broken"]


def test_archives_are_read_in_parallel(spark, tmp_path):
    rng = random.Random(3)
    pages = [(k, f"http://e.org/{k}", "".join(rng.choice("abcdefgh") for _ in range(3000))) for k in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    manifest = warc.write_archives(df, f"file://{tmp_path}/a")
    total = manifest.agg(F.sum("bytes")).first()[0]
    got = warc.read_archives(spark, manifest, total // 20)
    tasks = got.select(F.spark_partition_id().alias("p"), "page_id").groupBy("p").count().collect()
    assert len(tasks) >= min(20, spark.sparkContext.defaultParallelism) - 1 and sum(r["count"] for r in tasks) == 300
    assert warc.read_archives(spark, manifest, payloads=False).filter("payload is not null").count() == 0


# --- classifiers


def test_quality_rules(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(rng.randint(20, 80))) + "."
    bad = lambda: rng.choice([lambda: " | ".join(good().split()), lambda: good().upper().replace(" ", "!! "), lambda: " ".join(["spam"] * 40)])()
    docs = [(k, bad() if k % 5 == 0 else good(), "en", "s", 1) for k in range(800)]
    d = spark.createDataFrame(docs + [(9000, None, None, None, None), (9001, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, score int")
    y = spark.createDataFrame([(k, int(k % 5 != 0), None) for k in range(800)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(d, y).collect()}
    assert len(got) == 802 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [r for k, r in got.items() if r["held_out"] and k < 9000]
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 != 0) for r in held]) > 0.95
    kept = quality.keep_good(d, y)
    assert kept.columns == d.columns and kept.filter("doc_id < 800").select("score").distinct().collect() == [(1,)] and kept.filter("doc_id < 800 and doc_id % 5 = 0").count() < 10
    assert {r["score"] for r in quality.classify(d, y.limit(0)).collect()} == {0.5}
    assert len({r["score"] for r in quality.classify(d, y.filter("doc_id < 12")).collect()}) == 1
    assert quality.classify(d.limit(0), y).count() == 0


def test_toxicity_grammar(spark):
    rng = random.Random(3)
    plain = lambda: [f"w{''.join(rng.choice('aeiou') for _ in range(3))}" for _ in range(rng.randint(5, 40))]

    def toxic():
        w = plain()
        w.insert(rng.randrange(len(w)), "grubbl" + rng.choice(["er", "ig", "isch", "an", "el", "on"]))
        return w
    docs = [(k, " ".join(toxic() if k % 6 == 0 else plain())) for k in range(1200)] + [(9000, None), (9001, ""), (9002, "a grubblustration sit.")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1))
    y = spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(1200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(d, y).collect()}
    held = [r for k, r in got.items() if r["held_out"] and k < 9000]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held]) > 0.98
    assert got[9002]["predicted"] == 1 and got[9000]["predicted"] == got[9001]["predicted"] == 0
    assert toxicity.classify(d.limit(0), y).count() == 0 and toxicity.classify(d, y.limit(0)).count() == len(docs)


MARKED = {
    "a moron stood": {"insult": "plain"},
    "not long ago you moron": {"insult": "targeted"},
    "you are not only a moron": {"insult": "plain"},
    "you are not only never a moron": {"insult": "negated"},
    "i told you, you are a moron": {"insult": "targeted"},
    "as we have said you are a moron": {"insult": "targeted"},
    "i know he said you are a moron": {"insult": "reported"},
    "the word moron comes from greek": {"insult": "reported"},
    "the very word moron": {"insult": "reported"},
    "you moron, mind the word": {"insult": "targeted"},
    f'"you moron {"and so on " * 200}" he said': {"insult": "reported"},
    "you are a moron": {"insult": "targeted"},
    "moron you": {"insult": "targeted"},
    "he is not a moron": {"insult": "negated"},
    "do not call him a moron you know": {"insult": "negated"},
    "he is not here but you moron": {"insult": "targeted"},
    "she said that he is a moron": {"insult": "reported"},
    "she said moron you": {"insult": "reported"},
    "He said: you are a moron": {"insult": "reported"},
    '"You are a moron!" he said': {"insult": "reported"},
    "“You moron”, she wrote": {"insult": "reported"},
    "i will kill you": {"threat": "targeted"},
    "i will not hurt you": {"threat": "negated"},
    "they say i will kill you": {"threat": "reported"},
    "they kill time": {"threat": "plain"},
    "you moron, i will kill you": {"insult": "targeted", "threat": "targeted"},
    "Du bist kein Idiot, sondern ein Moron": {"insult": "plain"},
    "a fine day": {},
}


def test_grammar_marks_clauses():
    lex = toxicity.Lexicon(toxicity.seed_words() | {"idiot": 1}, {})
    for text, want in MARKED.items():
        clauses = toxicity.CLAUSE.findall(text.translate(toxicity._PLAIN).lower())
        assert [toxicity.clause_marks(c, lex)[0] for c in clauses] == [want], text
    score = lambda t: toxicity.Model(lex, toxicity.PRIOR.tolist()).score(t)
    assert min(score("you are a moron"), score("i will kill you")) > 0.9
    assert max(score(t) for t in ("he is not a moron", "She said moron you", "i will not hurt you", "He said: i will kill you", "")) < 0.1
    two = toxicity.features("he is not here. a moron is", lex)
    assert two[1] == 1 and sum(two[2:-1]) == 0


def test_composed_table_does_what_the_machines_do():
    rng = random.Random(4)
    for _ in range(400):
        classes = [rng.randrange(len(toxicity.CLASSES)) for _ in range(rng.randint(1, 14))]
        states, state = [m.start for m in toxicity.MACHINES], 0
        for c in classes:
            symbol = (toxicity.CLASSES[c],)
            for k, m in enumerate(toxicity.MACHINES):
                states[k], symbol = m.step(states[k], symbol)
            state, mark = toxicity.TABLE[state, c]
            assert mark == symbol


def test_a_stem_needs_documents_not_words(spark):
    plain = [(f"some words of a fine day {k} in the town", 0) for k in range(60)]
    one = [(" ".join(f"zor{a}{b}" for a in "abcdef" for b in "ghijkl"), 1)]
    several = [(f"plok{x} it was", 1) for x in ("ab", "bc", "cd", "de", "ef", "fg", "gh", "hi", "ij", "jk")]
    learned = lambda rows: toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int")).stems
    assert learned(plain + one) == {}
    assert list(learned(plain + one + several)) == ["plo"]


def test_threats_and_insults_are_learned(spark):
    rng = random.Random(9)
    plain = lambda: [f"w{''.join(rng.choice('aeiou') for _ in range(3))}" for _ in range(rng.randint(5, 40))]

    def toxic(k):
        w, at = plain(), 3
        w[at:at] = ["i", "will", "zorgle", "you"] if k % 2 else ["plonkhead"]
        return w

    found = spark.createDataFrame([(" ".join(toxic(k // 4) if k % 4 == 0 else plain()), int(k % 4 == 0)) for k in range(400)], "text string, label int")
    lexicon = toxicity.learn_lexicon(found)
    assert toxicity.CLASSES[lexicon.of("zorgle")] == "threat" and toxicity.CLASSES[lexicon.of("plonkhead")] == "insult"


def test_toxicity_of_awkward_rows(spark):
    rows_ = [(1, None), (1, None), (2, ""), (3, "moron " * 200_000), (4, "x" * 300_000), (None, "you moron")]
    d = spark.createDataFrame(rows_, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("label", F.lit(1))
    d = d.unionByName(spark.sql("select 9L doc_id, cast(x'6d6f726f6eff' as string) text, 'x' score, 1 label"))
    got = [(r["doc_id"], r["predicted"]) for r in toxicity.classify(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (1, 0), (2, 0), (3, 1), (4, 0), (None, 1), (9, 1)], key=str)


def quality_brute(text):
    """The statistics of quality.statistics() with Python's own string functions."""
    import re

    text = text or ""
    words = text.count(" ") + text.count("\n") + 1
    n = lambda p: len(re.findall(p, text, re.A)) / words
    return {
        "log_chars": np.log1p(len(text)),
        "word_chars": (len(text) - words) / words,
        "upper_words": n(r"[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ]+"),
        "shouts": n(r"!+"),
        "bars": text.count("|") / words,
        "symbols": n(r"[#*$%&|@~^=+<>{}\\_]+"),
        "digits": n(r"[0-9]+"),
        "sentence_ends": n(r"[.?](?=\s|$)"),
        "commas": text.count(",") / words,
        "lines": text.count("\n") / words,
        "repeats": n(r"(?<!\S)(\S++)(?=\s\1(?!\S))"),
        "long_words": n(r"\S{20,}"),
    }


def test_quality_column_is_the_rules_by_hand(spark):
    rng = random.Random(12)
    make = lambda: " ".join(rng.choice(["alpha", "BETA", "a|b", "x!!", "é,", "12", "dup dup", "long" * 7, "end.\n", "#$%"]) for _ in range(rng.randint(0, 60)))
    docs = [(k, make()) for k in range(300)] + [(900, None), (901, ""), (901, ""), (902, "word " * 60_000), (None, "x y"), (903, " ")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("log_chars", F.lit(1)).withColumn("score", F.lit(2))
    y = spark.createDataFrame([(k, int((t or "").count("!") < 2), 0) for k, t in docs[:300]], "doc_id long, quality int, toxic int")
    model = quality.train(d, y)
    assert model.rules
    got = sorted((str(r["doc_id"]), round(r["score"], 9)) for r in quality.classify(d, y).collect())
    want = []
    for i, t in docs:
        stats = quality_brute(t)
        x = np.array([[stats[n] for n in model.names]])
        z = model.bias + sum(w for rule, w in zip(model.rules, model.weights) if rule.holds(x)[0])
        want.append((str(i), round(1 / (1 + np.exp(-z)), 9)))
    assert got == sorted(want)


def test_distinct_texts(spark):
    base = " ".join(f"w{k}" for k in range(200))
    docs = [(k, base + f" tail{k}", 1) for k in range(30)] + [(100, "something else here", 0)]
    found = spark.createDataFrame(docs, "doc_id long, text string, label int").select("text", "label", "doc_id")
    assert labels.distinct(found).count() <= 4


CLASHING = ("__quality", "__partition", "__log_chars", "__row", "__one", "__turn", "o0", "o1", "row", "one", "score", "barrier", "component", "turn", "s0", "part", "key", "h1")


def test_columns_of_any_name_pass_through_the_stages(spark):
    """What a stage keeps of a row it keeps as it was, whatever the names of other columns."""
    words = "the of and a to in is you that it he was for on are as with his they at".split()
    rng = random.Random(9)
    texts = [" ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(60)) for _ in range(60)]
    texts += texts[:6] + [texts[7] + " and more"]
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in CLASHING}).withColumn("a.b`c", F.lit(1))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    untouched = lambda df: all(r[c] == f"{c} of {r['doc_id']}" for r in df.collect() for c in CLASHING)
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns and untouched(good) and good.count() == len(texts)
    one = jaccard.keep_one(docs)
    assert one.columns == docs.columns and untouched(one) and one.count() == 60
    model = quality.train(docs, labels)
    assert quality.score(docs, model, "o1").columns == [c for c in docs.columns if c != "o1"] + ["o1"]
    plain = docs.drop("a.b`c")
    cut = repeats.drop_repeats(plain)
    assert cut.columns == plain.columns and untouched(cut)
    clean = decontaminate.decontaminate(plain, spark.createDataFrame([(1, texts[3])], "item_id long, text string"))
    assert clean.columns == plain.columns and untouched(clean) and {r["doc_id"] for r in clean.select("doc_id").collect()} == set(range(len(texts))) - {3, 63}


def test_many_blocks_hold_the_words_of_a_slice_only(spark, monkeypatch):
    rng = random.Random(12)
    some = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(k, some(30)) for k in range(150)]
    texts = [some(120) + " " + items[k % 150][1] * (k % 9 == 0) for k in range(3000)]
    seen, original = [], decontaminate.match
    monkeypatch.setattr(decontaminate, "match", lambda a, t: (seen.append(sum(map(len, t))), original(a, t))[1])
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 50_000)
    # The task's function, run here: what it hands to the automata at once is bounded, however many there are.
    held = {}
    real = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema, *a: (held.setdefault("run", f) if "n_words" in schema else None, real(self, f, schema, *a))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.find(docs, spark.createDataFrame(items, "item_id long, text string"), block_words=90)
    files = next(c.cell_contents for c in held["run"].__closure__ if isinstance(c.cell_contents, list) and any("automata" in str(x) for x in c.cell_contents))
    assert len(files) >= 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([t.encode() for t in texts])], names=["k0", "text"])
    out = pa.Table.from_batches(list(held["run"](iter([batch])))).to_pydict()
    assert max(seen) <= 50_000 and out["k0"] == list(range(3000))
    hit = [k for k, s in enumerate(out["spans"]) if s]
    assert hit == [k for k in range(3000) if k % 9 == 0] and all(out["items"][k] == [k % 150] for k in hit)


def test_records_of_other_writers(tmp_path):
    """Types, header names in any case, continued lines, responses without a length, and blocks that are cut off."""
    import gzip

    def member(fields, block, size=None):
        head = "\r\n".join(["WARC/1.0", *fields, f"content-length: {len(block) if size is None else size}"])
        return gzip.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\ncontent-length: 4\r\n\r\nbody"
    parts = [
        member(["WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields"], b"software: x\r\n"),
        member(["warc-type: request", "warc-record-id: <urn:uuid:2>", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\n\r\n"),
        member(["WARC-TYPE: Response", "WARC-Record-ID: <urn:uuid:3>", "WARC-Target-URI: http://e.org/a", "Content-Type: application/http;", "\tmsgtype=response"], http),
        member(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:4>", "Content-Type: text/dns"], b"20240101 e.org. 1.2.3.4"),
        member(["WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:5>", "Content-Type: application/http"], b"HTTP/1.1 304 Not Modified\r\n\r\n"),
        member(["WARC-Type: metadata", "WARC-Record-ID: <urn:uuid:6>"], b""),
        member(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:7>"], http, size=9000),
        member(["WARC-Record-ID: <urn:uuid:8>"], b"no type"),
    ]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(parts))
    with pa.OSFile(str(path)) as source:
        for step in (path.stat().st_size, 50):
            found = [f for start in range(0, path.stat().st_size, step) for f in warc.read_range(source, start, start + step)]
            got = [(f["record_type"], f.get("payload"), f.get("payload_bytes")) for _, f in found]
            assert got == [("warcinfo", b"software: x\r\n", 13), ("request", b"GET / HTTP/1.1\r\n\r\n", 18), ("response", b"body", 4), ("response", b"20240101 e.org. 1.2.3.4", 23), ("revisit", None, None), ("metadata", b"", 0), ("broken", None, None), ("broken", None, None)]
            assert found[2][1]["url"] == "http://e.org/a" and found[2][1]["payload_digest"] == warc.digest(b"body") and found[4][1]["payload_digest"] is None
