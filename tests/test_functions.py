"""Column functions against tables of expected values."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import canonical as C
from corvane.functions import digests, paths
from corvane.functions import text as T


def values(spark, rows, column, schema="a string, b string, c string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_with_base(spark):
    rows = [("x", "/b/", None), ("/b/x", "/b", None), ("/bx", "b", None), ("//x", "/", None), ("/b", "//b//", None), ("", "b", None)]
    assert values(spark, rows, paths.with_base(F.col("a"), F.col("b"))) == ["/b/x", "/b/x", "/b/bx", "/x", "/b", "/b/"]


def test_locales(spark):
    rows = [("/b/en/x/", "/b/", "en"), ("/b/en", "/b", "ru"), ("/english/", "/", "en"), ("/b/x/?q=/en#f", "/b", "en"), ("/404.html", "/", "en"), ("/en/404/", "/", "ru"), ("?q", "/", "en"), ("/en/x/", "/", "ru")]
    assert values(spark, rows, paths.locale_of(F.col("a"), F.col("b"))) == ["en", "en", "ru", "ru", "ru", "en", "ru", "en"]
    assert values(spark, rows, paths.localize(F.col("a"), F.col("c"), F.col("b"))) == ["/b/en/x/", "/b/", "/en/english/", "/b/en/x/?q=/en#f", "/en/404/", "/404.html", "/en/?q", "/x/"]


def test_paths(spark):
    rows = [(p, None, None) for p in ("a\\b/../c", "/a/./b//c", "//host/x/../y", "C:\\u\\..\\v", "../x", "a/../../b", "")]
    assert values(spark, rows, paths.resolve_segments(F.col("a"))) == ["a/c", "/a/b/c", "//host/y", "C:/v", "../x", "../b", ""]
    assert [C.resolve(r[0]) for r in rows] == ["a/c", "/a/b/c", "//host/y", "C:/v", "../x", "../b", ""]
    rows = [(p, None, None) for p in ("a/b", "a//b", "./a", "a/../b", "..", "a%20", "a\\b", "", "/a")]
    assert values(spark, rows, paths.is_normal(F.col("a"))) == [True, False, False, False, True, False, False, False, True]
    c, i = paths.CONTENT_ROOT, paths.IMAGE_ROOT
    rows = [(p, None, None) for p in (f"{c}/entries/chapter-01.md", f"{c}/entries/chapter-1.md", f"{c}/notes/note-a.json", f"{i}/a.webp", f"{i}/a..b.svg", "x")]
    assert values(spark, rows, paths.payload_kind(F.col("a"))) == ["entry", None, "note", "image", None, None]
    rows = [(p, None, None) for p in ("a-b", "a--b", "object-x", "objects", "A")]
    assert values(spark, rows, paths.is_neutral_slug(F.col("a"))) == [True, False, False, True, False]
    rows = [(p, None, None) for p in ("x/y", "", "/x", "..", "../x", "..x", "C:\\x")]
    assert values(spark, rows, paths.is_inside(F.col("a"))) == [True, False, False, False, False, True, False]


def test_text(spark):
    rows = [("it's a co-op, naïve 42 – ok", None, None), ("", None, None)]
    assert values(spark, rows, T.word_count(F.col("a"))) == [6, 0]
    assert [r[0] for r in spark.sql("select n from values (0), (220), (221) t(n)").select(T.reading_minutes(F.col("n"))).collect()] == [1, 1, 2]
    rows = [("a\u200bb", None, None), ("a\tb\r\n", None, None), ("\x07", None, None)]
    assert values(spark, rows, T.has_forbidden_control(F.col("a"))) == [True, False, True]
    rows = [("a b!'()*~é", None, None)]
    assert values(spark, rows, T.encode_component(F.col("a"))) == ["a%20b!'()*~%C3%A9"]
    rows = [("java\nscript:x", None, None), ("metadata: x", None, None), ("see data:x", None, None)]
    assert values(spark, rows, T.has_dangerous_scheme(F.col("a"))) == [True, False, True]
    rows = [("2026-07-17", None, None), ("2026-02-30", None, None), ("2026-7-17", None, None), (None, None, None)]
    assert values(spark, rows, T.is_iso_date(F.col("a"))) == [True, False, False, False]
    rows = [("https://u:p@Ex.org:443/x", None, None), ("http://e:8080?x", None, None), ("ftp://e/", None, None)]
    assert values(spark, rows, T.origin_of(F.col("a"))) == ["https://ex.org", "http://e:8080", None]
    assert values(spark, [("7", None, None), ("123", None, None)], T.pad_left(F.col("a"), 2)) == ["07", "123"]


def test_code_unit_order(spark):
    rows = [("\U00010000", None, None), ("\ufffd", None, None), ("a", None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    assert [r[0] for r in df.orderBy(T.code_unit_key(F.col("a"))).select("a").collect()] == ["a", "\U00010000", "\ufffd"]


def test_frame_is_length_then_bytes(spark):
    for text in ("", "word", "é" * 300):
        data = text.encode()
        got = spark.createDataFrame([(text,)], "a string").select(digests.frame(F.col("a"))).first()[0]
        assert bytes(got) == len(data).to_bytes(8, "big") + data


def test_ordered_digest_follows_code_units(spark):
    import hashlib

    files = [("β.bin", b"\x00\x01\xff"), ("a.txt", b"A"), ("\U00010000", b""), ("\ufffd", b"x")]
    df = spark.createDataFrame(files, "path string, content binary")
    got = df.agg(digests.ordered_digest(F.collect_list(F.struct("path", "content")), "domain\n")).first()[0]
    h = hashlib.sha256(b"domain\n")
    for p, c in sorted(files, key=lambda f: f[0].encode("utf-16-be")):
        for part in (p.encode(), c):
            h.update(len(part).to_bytes(8, "big") + part)
    assert got == h.hexdigest()


@pytest.mark.parametrize(
    ("text", "want"),
    [("a%2Fb", "a/b"), ("&#x2f;&sol;", "//"), ("%252e", "."), ("a+b", "a+b"), ("ａ‑ｂ", "a-b"), ("&amp;", "&amp;"), ("x∖y", "x\\y")],
)
def test_canonical(text, want):
    assert C.canonical(text) == want


@pytest.mark.parametrize("text", ["%ff", "&#xd800;", "a\u202eb", "%E2%80%8B", "&#99999999;"])
def test_canonical_rejects(text):
    with pytest.raises(C.Unsafe):
        C.canonical(text)


def test_canonical_stops(spark):
    nested = "%2525252525252525252541"
    with pytest.raises(C.Unsafe):
        C.canonical("%25" * 1 + "25" * 12 + "41")
    assert C.tolerant("%ff%41")[0] == "%ff%41" and C.tolerant("%25" + "25" * 12 + "41")[1]
    df = spark.createDataFrame([("a%2Fb",), ("%ff",), (None,), (nested,)], "a string")
    got = [tuple(r[0]) for r in df.select(C.canonical_text(F.col("a"))).collect()]
    assert got[0] == ("a/b", None) and got[1][0] is None and got[1][1] and got[2] == (None, None)


def test_leaks():
    d = C.Denied(organisation="acme", repository="vault", roots=("drafts",))
    assert C.leak("see acme/vault/x", d) == "repository coordinate"
    assert C.leak("see acme%2F.%2Fvault", d) == "repository coordinate"
    assert C.leak("acme/vaults", d) is None and C.leak("xacme/vault", d) is None
    assert C.leak("the object-ring", d) == "internal identifier"
    assert C.leak("in /home/me/x", d) == "local path" and C.leak("C:\\x", d) == "local path" and C.leak("drafts/a", d) == "local path"
    assert C.leak("https://example.org/home/me/", d) is None
    assert C.leak("and/or", d) is None


@pytest.mark.parametrize("url", ["#note-001", "/book/", "/book/objects/ring/", "/book/read/a-b/#part-1", "https://example.org/x?q=1"])
def test_safe_urls(url):
    assert C.safe_url(url) == url


@pytest.mark.parametrize("url", ["", "http://example.org/", "https://u@example.org/", "javascript:x", "//example.org/", "/book/objects/../x/", "/book/objects/object-x/", "#A", "https://e.org/a b", "https://e.org/%", "https://e.org/\\x", "/other/"])
def test_unsafe_urls(url):
    with pytest.raises(C.Unsafe):
        C.safe_url(url)


def test_canonical_json():
    got = C.canonical_json(C.strict_json('{"b":[1,2.0,{}],"\\ud800\\udc00":null,"\ufffd":"é\\n","a":[]}'))
    assert got == '{\n  "a": [],\n  "b": [\n    1,\n    2,\n    {}\n  ],\n  "\U00010000": null,\n  "\ufffd": "é\\n"\n}\n'
    for bad in ('{"a":1,"a":2}', '{"x":{"a":1,"\\u0061":2}}', "{", "[NaN]", "{'a':1}"):
        with pytest.raises(C.Unsafe):
            C.strict_json(bad)


def test_a_scan_decodes_once_and_looks_for_nothing_that_a_text_cannot_hold(monkeypatch):
    denied, work = C.Denied(organisation="acme", repository="vault", roots=("drafts",)), []
    for owner, name in ((C, "_settled"), (C, "_layers"), (C.Denied, "coordinate"), (C.Denied, "path"), (C.Denied, "identifier")):
        monkeypatch.setattr(owner, name, lambda *a, name=name, before=getattr(owner, name): work.append(name) or before(*a))
    assert C.artefact_leak("acme vault drafts", denied, strict=False) is None
    assert work == ["_settled"]
    work.clear()
    assert C._leak("object ring, acme drafts", denied, C.READ_FRAGMENT) is None and work == ["_settled"]
    assert C._leak("acme%2Fvault", denied, C.PROSE) == "repository coordinate"
    assert C.artefact_leak("acme/<!---->vault", denied) is None and C.artefact_leak("x*/acme/vault", denied) == "repository coordinate"
    assert [C.has_control(t, b) for t in ("a\tb\n", "a\x07", "é\n", "é\x07", "é­") for b in (False, True)] == [False, False, True, False, False, False, True, False, True, True]
