"""Canonical forms by a dictionary of stretches against the form of whole texts."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corvane.functions import canonical as C
from corvane.operators import stretches
from corvane.vectors import DENIED

PARTS = ["a", "%41", "%2541", "%252541", "&#65;", "&amp;", "&percnt;34", "&#x25;2f", "%C3%A9", "%ff", "%e2%80", "&#x110000;", "é", "е", "ﬁ", "－", "́", "​", "\x01", "\t", "\n", "\x85", " ", "%20", "&sol;", "/", ":", "½", "ʼn", "ŉ", "%", "&", "%4", "1", "Å", "가", "ᅡ", "漢", "。", "«x»", "—", "drafts/x", "acme%2Fvault", "%01"]


def texts():
    rng = random.Random(6)
    out = ["".join(rng.choice([*PARTS, " ", " ", " "]) for _ in range(rng.randrange(1, 14))) for _ in range(2500)]
    deep = "%41"
    for _ in range(11):
        deep = deep.replace("%", "%25")
        out += [deep, f"x {deep} %ff", f"{deep} &#x110000;"]
    return [*out, "", " ", "plain text", "plain\n", "plain\x85", "plain ", " ".join(["%41"] * 300)]


def test_inert_characters_stay_as_they_are():
    pattern = re.compile(stretches.INERT.replace(r"\z", r"\Z"))
    known = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and pattern.match(chr(c))]
    assert len(known) > 21_000 and all(C.canonical(c) == c and not unicodedata.combining(c) for c in known)
    some = random.Random(1).sample(known, 400)
    assert all(C.skeleton(a + b) == a + b for a in some for b in some)


def test_forms_and_errors_are_those_of_whole_texts(spark):
    given = texts()
    df = spark.createDataFrame([*enumerate(given), (None, "%41 x"), (None, None), (-1, None)], "id int, text string").withColumn("at", F.lit("x")).withColumn("hash", F.lit(1))
    got = stretches.canonical_texts(df, "id", "text")
    assert got.columns == [*df.columns, "value", "error"]
    found = {r["id"]: (r["value"], r["error"]) for r in got.filter("id is not null").collect()}
    want = dict(enumerate(C._outcome(C.canonical, t) for t in given)) | {-1: (None, None)}
    assert {k: (given[k], found[k], want[k]) for k in want if found[k] != want[k]} == {}
    assert sorted(str(r["value"]) for r in got.filter("id is null").collect()) == ["A x", "None"]
    assert stretches.canonical_texts(df.limit(0), "id", "text").count() == 0


def test_leaks_are_those_of_whole_texts(spark):
    given = texts()
    df = spark.createDataFrame(list(enumerate(given)), "id int, text string")
    for wanted in (C.PROSE, C.READ_FRAGMENT):
        found = {r["id"]: r["leak"] for r in stretches.leaks(df, "id", "text", DENIED, wanted).collect()}
        assert {k: (t, found[k]) for k, t in enumerate(given) if found[k] != C.leak(t, DENIED, wanted)} == {}


@pytest.mark.parametrize("copies", [1, 50])
def test_python_sees_each_stretch_once(spark, copies):
    docs = spark.range(40 * copies).select("id", F.concat(F.lit("some words caf%C3%A9 and é&#65; "), F.lit("t%41"), (F.col("id") % 40).cast("string")).alias("text"))
    found = stretches.places(docs, "id", "text")
    assert found.count() == 3 * 40 * copies and stretches.distinct_stretches(found).count() == 42
    assert stretches.canonical_texts(docs, "id", "text").filter("value like 'some words café and éA tA%'").count() == 40 * copies


def test_given_tables(spark):
    for table, key, text in (("documents", "doc_id", "text"), ("pages", "page_id", "html")):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").select(F.col(key).alias("k"), F.col(text).alias("t"))
        whole = df.select("k", C.canonical_text(F.col("t")).alias("c")).select("k", "c.value", "c.error")
        parts = stretches.canonical_texts(df, "k", "t").select("k", "value", "error")
        assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0
