"""Joins, overlays, checks, snapshots and extractors on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.functions.canonical import Denied
from corvane.operators import checks, extract, links, overlay, reports, snapshots
from corvane.plans import release
from corvane.sources import collections
from corvane.streaming import Latch


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_links(spark):
    records = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", []), ("c", ["z"])], "id string, refs array<string>")
    targets = spark.createDataFrame([("x",), ("y",), ("w",)], "key string")
    edges = links.edges(records, "id", "refs")
    assert rows(edges) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("c", 1, "z")]
    assert rows(links.resolve(edges, "reference", targets, "key"), "id", "position", "key") == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x")]
    assert rows(links.missing(edges, "reference", targets, "key"), "id", "reference") == [("c", "z")]
    assert rows(links.orphans(targets, "key", edges, "reference")) == [("w",)]
    assert rows(links.bijection(edges, "reference", targets, "key")) == [("w", "extra"), ("z", "missing")]
    assert rows(links.cardinality(targets, "key", edges, "reference")) == [("w", 0), ("x", 2), ("y", 1)]
    assert rows(links.multiset_difference(edges.select("reference"), targets.select(F.col("key").alias("reference")), ["reference"])) == [("w", -1), ("x", 1), ("z", 1)]


def test_overlay(spark):
    records = spark.createDataFrame([("a", "один", None), ("b", "два", "т")], "id string, title string, note string")
    texts = overlay.explode_overlay(spark.createDataFrame([({"c": {"a": {"title": "one"}, "b": {"title": "two", "note": " "}}},)], "m map<string,map<string,map<string,string>>>"), "m")
    assert rows(overlay.localize(records, texts, ["title"], "en")) == [("a", "one", None), ("b", "two", "т")]
    assert overlay.localize(records, texts, ["title"], "ru") is records
    assert rows(overlay.gaps(records, texts, ["title", "note"])) == [("b", "note")]
    with pytest.raises(Exception, match="no en text of note for b"):
        overlay.localize(records, texts, ["title", "note"], "en").collect()


def test_reports(spark):
    df = spark.createDataFrame([("a", 2000, "é"), ("b", None, "z"), ("c", 2000, "f"), ("d", 1990, "a"), ("e", None, "A")], "id string, year int, title string")
    assert [r["id"] for r in df.orderBy(*reports.newest_first(F.col("year"), F.col("title"))).collect()] == ["a", "c", "d", "e", "b"]
    got = reports.grouped(df, "year", ["2000", "1980"]).collect()
    assert [(r["ordinal"], r["n"], r["padded"]) for r in got] == [(0, 2, "02")]
    assert rows(reports.layers(df, "id", ["year", "title"])).__len__() == 8


def test_checks(spark):
    df = spark.createDataFrame([(1, 5), (2, 3), (3, 3), (4, None)], "id long, v long")
    found = checks.violations(df, F.col("id"), [("big", "v", F.col("v") > 3, "small")])
    assert rows(found) == [("big", "2", "v", "small"), ("big", "3", "v", "small"), ("big", "4", "v", "small")]
    assert rows(checks.fail_first(found, F.col("record_id")), "record_id") == [("2",)]
    assert rows(checks.out_of_order(df, [], F.col("id"), F.col("v")), "id") == [(2,), (3,)]
    assert rows(checks.over_budget(df, [], F.col("id"), F.col("v"), 8), "id", "running") == [(3, 11), (4, 11)]
    js = spark.createDataFrame([('{"a":1}',), ('{"a":1,"b":2}',), ("{",), ('{"a":1,"a":2}',), (None,)], "j string")
    assert [tuple(r) for r in js.select(checks.json_problem(F.col("j")), checks.unknown_keys(F.col("j"), ["a"])).collect()][:4] == [(None, []), (None, ["b"]), ("syntax", []), ("repeated key", [])]


def test_snapshots(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "z")], "k int, v string")
    assert rows(snapshots.diff(a, b, ["k"], ["v"])) == [(3, "removed"), (4, "added")]
    latch = Latch(a, ["k", "v"])
    assert latch.unchanged(a) and not latch.unchanged(b) and not latch.unchanged(a)


def test_html():
    page = extract.read_html('<p>a<b>b</b><br>c</p><script>var x="s"</script><style>p{}</style><template>no</template><iframe srcdoc="&lt;a href=javascript:x&gt;q&lt;/a&gt;"></iframe><img src="i.png" srcset="j.png 2x, k.png" alt="t"><object data="o"></object><meta http-equiv="refresh" content="0; url=/r">')
    assert page["runs"] == ["ab", "c"] and page["urls"] == ["i.png", "j.png", "k.png", "o", "/r"] and page["readable"] == ["t"]
    assert page["scripts"] == ['var x="s"'] and page["style_blocks"] == ["p{}"]
    d = Denied(organisation="acme", repository="vault")
    assert extract.scan_html('<iframe srcdoc="&lt;a href=&quot;java&#10;script:x&quot;&gt;"></iframe>', d) == [("srcdoc.text", "dangerous scheme"), ("srcdoc.urls", "dangerous scheme")]
    assert extract.scan_html("<style>p::before{content:'acme' '/vault'}</style>", d) == [("styles", "repository coordinate")]
    assert extract.scan_html("<script>// acme/vault\n</script>", d) == [("text", "repository coordinate"), ("scripts", "repository coordinate")]


def test_all_links_and_public_metas_are_scanned(spark):
    d = Denied(organisation="acme", repository="vault", roots=("drafts",))
    parts = lambda html, page="": [f for f in extract.scan_html(html, d, page_path=page) if f[0] != "text"]
    link = lambda u, page="": parts(f'<a href="{u}">x</a>', page)
    for url, problem in {
        "/acme/vault": "repository coordinate",
        "#acme%2Fvault": "repository coordinate",
        "?q=acme/vault": "repository coordinate",
        "/drafts/x": "local path",
        "#/drafts/x": "local path",
        "//h/x": "network path",
        "../../x": "leads out of the site",
        "java%73cript:x": "dangerous scheme",
        "/a%20b": "control, blank or backslash",
        "/a\\b": "control, blank or backslash",
    }.items():
        assert link(url) == [("urls", problem)], url
    for url in ("/", "#a", "?q=a", "/a/b.html", "a/../b", "https://e.org/a", "mailto:a@b", ""):
        assert link(url) == [], url
    assert link("../../x", "en/notes/a.html") == [] and link("../../../x", "en/notes/a.html") == [("urls", "leads out of the site")]
    for meta in ('property="og:title"', 'name="Description"', 'itemprop="name description"'):
        assert parts(f'<meta {meta} content="acme/vault">') == [("metas", "repository coordinate")]
    assert parts('<meta name="viewport" content="acme/vault">') == []
    df = spark.createDataFrame([("<a href='../x'>", "a/b"), ("<a href='../x'>", "b"), (None, None)], "t string, page string")
    assert [len(r[0]) for r in df.select(extract.problems(F.col("t"), d, "html", F.col("page"))).collect()] == [0, 1, 0]


def test_markdown(spark):
    text = "# Title\n\nSee [a *b*](https://e.org/x_(y) \"t\") and `:x[y]` and <https://f.org>.\n\n```js\n::note{a}\n```\n![i](j.png)\n\n:::box\n"
    got = extract.read_markdown(text)
    assert got["links"] == ["https://e.org/x_(y)", "https://f.org"] and got["images"] == 1 and got["html"] == 0
    assert got["directives"] == [":::box"] and got["headings"] == ["Title"]
    assert ":x[y]" in got["text"] and "::note{a}" in got["text"] and "a b" in got["text"]
    assert extract.scan_markdown("plain [x](#a)", Denied()) == []
    assert {w for w, _ in extract.scan_markdown("<b>x</b> ![i](j) [l](mailto:x)", Denied())} == {"html", "images", "links"}
    df = spark.createDataFrame([(text,), (None,)], "t string").select(extract.markdown_parts(F.col("t")).alias("p"))
    assert [len(r[0]) for r in df.select("p.links").collect()] == [2, 0]


def test_collections(spark, tmp_path):
    record = {"title": "t", "authors": ["a"], "publicationYear": None, "publisher": "p", "url": "https://e.org", "region": "asia", "kind": "book", "accessed": "2026-01-01"}
    for folder in ("sources", "myths"):
        (tmp_path / folder).mkdir()
    (tmp_path / "sources" / "one.json").write_text(json.dumps(record))
    (tmp_path / "myths" / "m.json").write_text(json.dumps({"title": "x", "extra": 1, "citations": ["one"]}))
    assert rows(collections.collection(spark, str(tmp_path), "sources"), "id", "kind") == [("one", "book")]
    assert rows(collections.collection(spark, str(tmp_path), "myths"), "id", "title") == [("m", "x")]
    (tmp_path / "sources" / "two.json").write_text(json.dumps(record | {"more": 1}))
    with pytest.raises(Exception, match="unknown keys in two"):
        collections.collection(spark, str(tmp_path), "sources").collect()


def test_release_graph(spark):
    make = lambda data, schema: spark.createDataFrame(data, schema)
    t = {
        "entries": make([("chapter-01", "one", "chapter", "Title", "A long subtitle", 1, 1, 1, ["note-a"], ["object-x"], [], None)], release.ENTRY),
        "notes": make([("note-a", "note-a", "s" * 20, "high", "l" * 20, ["source-a"]), ("note-b", "note-a", "s", "low", "l" * 20, ["source-q"])], release.NOTE),
        "sources": make([("source-a", ["x"], "t", 2000, "book", "p", None, None, None, None, None, "https://e.org/", [])], release.SOURCE),
        "objects": make([("object-x", "t", "c", "d", "m", "q", "a", "c", "b", ("published", "7", None), [], ["source-a"], ["media-m"])], release.OBJECT),
        "media": make([("media-m", "m.svg", "a", "c", "c", "l", release.OPEN_LICENSE_URL, None, "authored-diagram", None, None, None)], release.MEDIA),
    }
    assert rows(release.check_rows(t), "check_id", "record_id") == [("note.confidence", "note-b"), ("note.statement", "note-b")]
    images = spark.createDataFrame([("n.svg",)], "name string")
    assert rows(release.check_graph(t, images), "check_id", "record_id") == [
        ("graph.anchor", "note-a"),
        ("graph.images", "m.svg"),
        ("graph.images", "n.svg"),
        ("graph.notes.orphan", "note-b"),
        ("graph.notes.sourceIds", "note-b"),
    ]


def test_release_manifest(spark):
    import hashlib

    path, content = "src/content/book-release/entries/prologue.md", b"text"
    h = hashlib.sha256(b"reader-payload-v1\n")
    for part in (path.encode(), content):
        h.update(len(part).to_bytes(8, "big") + part)
    a, b = "a" * 40, "b" * 40
    file = (path, "text", 4, hashlib.sha256(content).hexdigest())
    attest = (3, "cycle-01", a, b, ("reader-v1", "reader-markdown-v1", h.hexdigest()), None)
    row = (4, "reader-v1", "reader-markdown-v1", "cycle-01", a, b, f"release-reader-v1-{a}", h.hexdigest(), ["prologue"], (1, 0, 0, 0, 0), [file], attest)
    manifest = spark.createDataFrame([row], release.MANIFEST)
    files = spark.createDataFrame([(path, content)], "path string, content binary")
    assert rows(release.check_manifest(manifest)) == []
    assert rows(release.check_integrity(manifest, files)) == []
    bad = spark.createDataFrame([(*row[:8], ["chapter-01"], (2, 0, 0, 0, 0), [file, file], attest)], release.MANIFEST)
    assert {r[0] for r in rows(release.check_manifest(bad), "check_id")} == {"manifest.unique", "manifest.order"}
    wrong = spark.createDataFrame([(path, b"\xff\xff\xff")], "path string, content binary")
    assert {r[0] for r in rows(release.check_integrity(manifest, wrong), "check_id")} == {"integrity.length", "integrity.sha256", "integrity.utf8", "integrity.payload"}


def test_awkward_rows(spark):
    """Nulls, repeated rows, ties, clashing names and empty tables."""
    a = spark.createDataFrame([(1, "x"), (None, "y"), (1, "x"), (3, None)], "n long, key string")
    b = spark.createDataFrame([("x",), (None,)], "n string")
    assert rows(links.cardinality(b, "n", a, "key", name="links")) == [("x", 2), (None, 0)]
    assert rows(links.duplicates(a, "n", name="times")) == [(1, 2)]
    assert rows(links.missing(a, "key", b, "n"), "n", "key") == [(3, None), (None, "y")]
    assert rows(links.orphans(b, "n", a, "key")) == [(None,)]
    assert rows(links.bijection(a.limit(0), "key", b, "n")) == [("x", "extra"), (None, "extra")]
    texts = spark.createDataFrame([("c", "x", "key", "B"), ("c", "x", "key", "A"), ("c", "x", "key", " "), ("d", "x", "key", "0")], "collection string, id string, field string, text string")
    got = overlay.localize(spark.createDataFrame([("x", "k"), ("x", "k"), (None, None)], "id string, key string"), texts, ["key"], "en", collection="c")
    assert rows(got) == [("x", "A"), ("x", "A"), (None, None)]
    assert overlay.localize(got.limit(0), texts, ["key"], "en").count() == 0
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "k int, v string")
    assert rows(reports.attributes(twice, "k", ["v"], [1, 2])) == [("v", "a", None)]
    assert rows(checks.violations(a, F.col("key"), [("c", "n", F.col("n") > 0, "m")]), "record_id") == [("y",)]
    assert checks.violations(a.limit(0), F.col("key"), [("c", "n", F.col("n") > 0, "m")]).count() == 0
    assert rows(snapshots.diff(twice.limit(0), twice.filter("k = 2"), ["k"], ["v"])) == [(2, "added")]
    places = rows(reports.positioned(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("n")), F.col("n")), "n", "position")
    assert sorted(places) == [(k, k + 1) for k in range(1000)]
    assert reports.positioned(a.limit(0), F.col("n")).count() == 0
    assert [len(r[0]) for r in spark.createDataFrame([(None,), ("",), ("a:b" * 50_000,)], "t string").select(extract.residual(F.col("t"))).collect()] == [0, 0, 0]


def test_streamed_digests_are_ordered_digests(spark):
    from corvane.functions import digests

    files = spark.createDataFrame([(r, p, (p + str(r)).encode() * 50) for r in "ab" for p in ("β.bin", "a.txt", "\U00010000", "\ufffd", "")] + [("c", "x", None)], "release string, path string, content binary")
    want = files.groupBy("release").agg(digests.ordered_digest(F.collect_list(F.struct("path", F.coalesce("content", F.lit(b"")).alias("content"))), "d\n").alias("digest"))
    assert rows(digests.streamed_digests(files, "d\n")) == rows(want)
    assert digests.streamed_digests(files.limit(0), "d\n").count() == 0


def test_release_binding_and_svg(spark):
    import hashlib

    frame = lambda b: len(b).to_bytes(8, "big") + b
    path, content = "public/images/book-release/a.svg", b"<svg/>"
    a, b, none = "a" * 40, "b" * 40, "0" * 64
    file = (path, "binary", len(content), hashlib.sha256(content).hexdigest())
    make = lambda binding: (4, "reader-v1", "reader-markdown-v1", "cycle-01", a, b, f"release-reader-v1-{a}", hashlib.sha256(b"reader-payload-v1\n" + frame(path.encode()) + frame(content)).hexdigest(), ["prologue"], (1, 0, 0, 0, 0), [file], (3, "cycle-01", a, b, ("reader-v1", "reader-markdown-v1", none), binding))
    m = make(None)
    data = {"version": 4, "projection": m[1], "transformer": m[2], "cycleId": m[3], "targetCommit": a, "reviewEvidenceCommit": b, "releaseId": m[6], "readerPayloadDigest": m[7], "readingOrder": ["prologue"]}
    data |= {"counts": {"entries": 1, "notes": 0, "sources": 0, "objects": 0, "media": 0}, "files": [dict(zip(("path", "kind", "byteLength", "sha256"), file))]}
    data["reviewAttestation"] = {"schemaVersion": 3, "cycleId": "cycle-01", "targetCommit": a, "reviewEvidenceCommit": b, "reviewedPayload": {"projection": "reader-v1", "transformer": "reader-markdown-v1", "digest": none}}
    text = (json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()
    whole = hashlib.sha256(b"reader-release-v1\n" + frame(text) + frame(path.encode()) + frame(content)).hexdigest()
    files = spark.createDataFrame([(path, content)], "path string, content binary")
    check = lambda binding, *svg: rows(release.check_integrity(spark.createDataFrame([make(("sha256", "v1", binding))], release.MANIFEST), files, approved_svg=svg), "check_id")
    assert check(whole) == [] and check(none) == [("integrity.binding",)]
    assert check(whole, file[3]) == [] and check(whole, none) == [("integrity.svg",)]


def test_urls_of_records_are_judged_by_their_references(spark):
    d = Denied(organisation="acme", repository="vault", roots=("drafts",))
    urls = {"https://e.org/a?b=c#d": True, "https://e.org:8080/": True, "http://e.org/": False, "https://u@e.org/": False, "https://e.org/acme/vault": False, "https://e.org/%61cme%2Fvault": False, "https://e.org/ACME/vaults": True, "https://e.org/%zz": False, "https://e.org/caf%C3%A9": True, "x": False}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r[0]: r[1] for r in df.select("url", release.public_url(F.col("url"), d)).collect()} == urls
    broken = lambda denied: {r["record_id"] for r in release.check_rows({"sources": source_rows(spark, urls)}, denied).filter("check_id = 'source.url'").collect()}
    assert len(broken(d)) == sum(not ok for ok in urls.values()) and len(broken(Denied())) == len(broken(d)) - 2


def source_rows(spark, urls):
    return spark.createDataFrame([(f"source-{k}", ["x"], "t", 2000, "book", "p", None, None, None, None, None, u, []) for k, u in enumerate(urls)], release.SOURCE)


def test_a_page_is_read_once_for_its_parts_and_its_code(monkeypatch):
    read, feed = [], extract.HTMLParser.feed
    monkeypatch.setattr(extract.HTMLParser, "feed", lambda self, text: read.append(text) or feed(self, text))
    page = "<p title=' onclick=a'>x</p>\n<style>li::marker{content:'a'}</style>\n<p onclick=\"f('x:javascript:1')\">x</p><script>g()</script>"
    assert extract.scan_html(page, Denied()) == [("scripts", "dangerous scheme")]
    assert read == [page]
    assert [(kind, page[a:b]) for kind, a, b in extract.html_ranges(page)] == [("handler", "a"), ("style", "li::marker{content:'a'}"), ("handler", "f('x:javascript:1')"), ("script", "g()")]
    read.clear()
    assert extract.html_ranges("<p>x:data:y ::note{a}</p>") == [] and read == []
    assert extract.scan_html("<p>x data:y</p>", Denied()) == [("text", "dangerous scheme"), ("runs", "dangerous scheme")]
    assert len(read) == 1
