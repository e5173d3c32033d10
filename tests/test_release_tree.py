"""The release tree as a data source and sink, its budgets, captured scopes and sitemaps."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.operators import reports, snapshots
from corvane.plans import capture, layers
from corvane.sources import collections, release_tree, sinks, tree

FILES = {"a/x.json": b"{}", "a/y.json": b'{"k":1}', "a/deep/er/z.json": b"[]", "b/w.json": b"{", "top.txt": "é\0".encode(), "empty": b""}


@pytest.fixture
def root(tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize(("levels", "slices"), [(0, 1), (1, 1), (1, 3), (5, 2)])
def test_all_files_and_folders_once(spark, root, levels, slices):
    found = release_tree.read(spark, root, levels=levels, slices=slices)
    assert {r["path"]: bytes(r["content"]) for r in found.filter("kind = 'file'").collect()} == FILES
    assert rows(found.filter("kind = 'directory'"), "path") == [("a",), ("a/deep",), ("a/deep/er",), ("b",)]
    assert found.filter("problem is not null").count() == 0 and found.count() == len(FILES) + 4
    assert rows(found.filter("path = 'a/x.json'"), "size", "nlink") == [(2, 1)]
    assert release_tree.read(spark, root / "nowhere").count() == 0


def test_plain_and_uri_roots(spark, root):
    assert release_tree.read(spark, f"file://{root}").count() == release_tree.read(spark, str(root)).count()
    other = release_tree.ObjectStore(*release_tree.pafs.FileSystem.from_uri(f"file://{root}"))
    local = release_tree.LocalStore(str(root))
    assert sorted(other.names("a")) == sorted(local.names("a")) and other.look("nowhere") is None
    for path, data in FILES.items():
        kind, identity = other.look(path)
        assert (kind, identity[4], identity[5]) == ("file", len(data), local.look(path)[1][5])
        assert other.read(path, identity) == (data, None)
    assert other.read("a/x.json", other.look("a/y.json")[1]) == (None, release_tree.CHANGED)
    other.write("new/f", b"1")
    other.replace("new/f", b"22")
    assert other.get("new/f") == b"22" and local.names("new") == [("f", False)]
    with pytest.raises(FileExistsError):
        other.write("new/f", b"3")
    other.delete("new")
    assert other.get("new/f") is None


class Counted(release_tree.LocalStore):
    opened, read_files = Counter(), Counter()

    def names(self, folder):
        Counted.opened[folder] += 1
        return super().names(folder)

    def read(self, path, expected):
        Counted.read_files[path] += 1
        return super().read(path, expected)


@pytest.mark.parametrize(
    ("filters", "opened", "read"),
    [
        ([release_tree.StringStartsWith(("path",), "a/deep/")], {"", "a", "a/deep", "a/deep/er"}, {"a/deep/er/z.json"}),
        ([release_tree.StringStartsWith(("path",), "a/x")], {"", "a"}, {"a/x.json"}),
        ([release_tree.EqualTo(("path",), "b/w.json"), release_tree.IsNotNull(("path",))], {"", "b"}, {"b/w.json"}),
        ([release_tree.In(("path",), ("top.txt", "b/none"))], {"", "b"}, {"top.txt"}),
        ([release_tree.GreaterThan(("size",), 2), release_tree.EqualTo(("kind",), "file")], {"", "a", "a/deep", "a/deep/er", "b"}, {"a/y.json", "top.txt"}),
        ([release_tree.EqualTo(("kind",), "directory")], {"", "a", "a/deep", "a/deep/er", "b"}, set()),
    ],
)
@pytest.mark.parametrize("levels", [0, 1])
def test_pushed_filters_open_nothing_else(root, monkeypatch, filters, opened, read, levels):
    monkeypatch.setattr(release_tree, "store_of", lambda where: Counted(str(where)))
    Counted.opened, Counted.read_files = Counter(), Counter()
    reader = release_tree.TreeReader({"path": str(root), "levels": str(levels)})
    other = release_tree.LessThan(("mtime_ns",), 5)
    assert list(reader.pushFilters([*filters, other])) == [other]
    list(b for p in reader.partitions() for b in reader.read(p))
    assert set(Counted.opened) == opened and set(Counted.read_files) == read and set(Counted.read_files.values()) <= {1}


def test_filters_reach_the_source(spark, root):
    found = release_tree.read(spark, root)
    for condition in ("path like 'a/%'", "path = 'b'", "path in ('a/x.json', 'empty')", "size >= 2 and size < 4 and kind = 'file'", "startswith(path, 'a/deep') and nlink > 0", "size is null", "path = 'a' or size = 1"):
        want = sorted(r["path"] for r in found.collect() if eval_condition(spark, r, condition))
        assert [p for (p,) in rows(found.filter(condition), "path")] == want


def eval_condition(spark, row, condition):
    return spark.createDataFrame([row], release_tree.SCHEMA).filter(condition).count() == 1


def test_links_and_limits_are_problems(spark, root):
    (root / "link").symlink_to(root / "a")
    os.link(root / "top.txt", root / "b" / "second")
    os.mkfifo(root / "b" / "pipe")
    (root / "big").write_bytes(b"x" * 100)
    found = release_tree.read(spark, root, limit=50)
    bad = {r["path"]: (r["kind"], r["problem"], r["content"]) for r in found.filter("problem is not null").collect()}
    assert bad == {"link": ("link", "link", None), "top.txt": ("file", "linked more than once", None), "b/second": ("file", "linked more than once", None), "b/pipe": ("other", "not a plain file", None), "big": ("file", "beyond the limit", None)}
    assert release_tree.violations(found).count() == 5
    assert rows(tree.budgets(tree.tree(spark, root), max_files=3, max_bytes=50, max_extra=1), "check_id") == [("tree.bytes",), ("tree.entries",), ("tree.files",)]
    assert tree.budgets(tree.tree(spark, root)).count() == 0


def test_names_and_depth(spark, tmp_path):
    os.makedirs(os.fsencode(tmp_path) + b"/d\xff")
    (tmp_path / os.fsdecode(b"d\xff") / "f").write_bytes(b"1")
    folder = tmp_path.joinpath(*["n"] * 70)
    folder.mkdir(parents=True)
    (folder / "f").write_bytes(b"1")
    found = release_tree.read(spark, tmp_path)
    assert rows(found.filter("problem is not null"), "kind", "problem") == [("directory", "name isn't UTF-8"), ("directory", "too deep"), ("file", "name isn't UTF-8")]
    assert found.count() == 3 + 63


def test_what_changes_after_the_listing_is_a_problem(spark, root):
    listed = tree.tree(spark, root).filter("kind = 'file'").cache()
    assert listed.count() == len(FILES)
    (root / "a" / "x.json").write_bytes(b"[]")  # as long as before
    (root / "b" / "w.json").unlink()
    (root / "empty").unlink()
    (root / "empty").symlink_to(root / "top.txt")
    read = release_tree.contents(listed, root)
    assert rows(read.filter("problem is not null"), "path", "problem") == [("a/x.json", release_tree.CHANGED), ("b/w.json", release_tree.GONE), ("empty", release_tree.CHANGED)]
    assert {r["path"]: bytes(r["content"]) for r in read.filter("problem is null").collect()} == {k: FILES[k] for k in ("a/y.json", "a/deep/er/z.json", "top.txt")}
    listed.unpersist()


# --- writing


def test_round_trip_append_and_overwrite(spark, tmp_path):
    where = f"file://{tmp_path}/out"
    one = spark.createDataFrame([(k, v) for k, v in FILES.items()], "path string, content binary").repartition(3)
    assert rows(sinks.write_files(one, where), "path", "bytes") == sorted((k, len(v)) for k, v in FILES.items())
    assert {r["path"]: bytes(r["content"]) for r in release_tree.read(spark, where, slices=2).collect()} == FILES
    assert release_tree.verify(spark, where).count() == 0
    sinks.write_files(spark.createDataFrame([("c/new", None), ("a/x.json", "again")], "path string, content string"), where)
    assert rows(release_tree.read(spark, where), "path") == sorted([(k,) for k in FILES] + [("a/x.json",), ("c/new",)])
    assert rows(release_tree.repeated(release_tree.read(spark, where)), "path", "n") == [("a/x.json", 2)]
    assert rows(release_tree.read(spark, where).filter("startswith(path, 'c/')"), "path", "size") == [("c/new", 0)]
    sinks.write_files(one.limit(0), where, overwrite=True)
    assert release_tree.read(spark, where).count() == 0 and os.listdir(tmp_path / "out" / "_parts") != []
    assert sum(len(f) for _, _, f in os.walk(tmp_path / "out" / "_parts")) == 0


def test_damage_is_found(spark, tmp_path):
    where = str(tmp_path / "out")
    release_tree.write(spark.createDataFrame([(f"d/{k}", f"text {k}") for k in range(40)], "path string, content string").repartition(4), where)
    parts = [p["name"] for p in release_tree.commit_of(release_tree.store_of(where))["parts"]]
    files = sorted((tmp_path / "out" / "_parts" / parts[0] / "d").iterdir())
    files[0].write_text(files[0].read_text()[::-1])
    for f in (tmp_path / "out" / "_parts" / parts[1] / "d").iterdir():
        f.unlink()
    assert rows(release_tree.verify(spark, where), "part", "problem") == sorted([(parts[0], "differs from its commit"), (parts[1], "missing")])


def test_a_failed_job_leaves_nothing_visible(spark, tmp_path):
    where = str(tmp_path / "out")
    good = spark.createDataFrame([("a", "1")], "path string, content string")
    for bad in (["x", None], ["x", "../y"], ["x", "/y"], ["x", "_parts/y"], ["x", ""]):
        with pytest.raises(Exception, match="not a path"):
            release_tree.write(spark.createDataFrame([(p, "2") for p in bad], "path string, content string").coalesce(1), where)
    with pytest.raises(Exception, match="FileExists"):
        release_tree.write(spark.createDataFrame([("x", "2"), ("x", "3")], "path string, content string").coalesce(1), where)
    assert release_tree.read(spark, where).count() == 0
    release_tree.write(good, where)
    with pytest.raises(Exception, match="not a path"):
        release_tree.write(spark.createDataFrame([("y", "2"), (None, "2")], "path string, content string").coalesce(1), where, overwrite=True)
    assert rows(release_tree.read(spark, where), "path") == [("a",)]


def test_killed_and_doubled_attempts_are_not_seen(tmp_path, monkeypatch):
    """Two attempts of a task write; one is killed on its way, one is never reported: the commit names the third only."""
    where = str(tmp_path / "out")
    writer = release_tree.TreeWriter({"path": where}, overwrite=False)
    attempt = {"id": 0}

    class Context:
        partitionId = staticmethod(lambda: 0)
        taskAttemptId = staticmethod(lambda: attempt["id"])

    monkeypatch.setattr(release_tree.TaskContext, "get", staticmethod(lambda: Context))
    batch = release_tree.pa.RecordBatch.from_pydict({"path": ["a", "b"], "content": [b"1", b"2"]})

    def killed():
        yield batch.slice(0, 1)
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(killed())
    attempt["id"] = 1
    writer.write(iter([batch]))
    attempt["id"] = 2
    message = writer.write(iter([batch]))
    seen = lambda: sorted(p for r in [release_tree.TreeReader({"path": where})] for q in r.partitions() for b in r.read(q) for p in b.column("path").to_pylist())
    assert seen() == []  # nothing before the commit
    writer.commit([message])
    assert seen() == ["a", "b"] and len(list((tmp_path / "out" / "_parts" / writer.job).iterdir())) == 1
    release_tree.TreeWriter({"path": where}, overwrite=False).abort([None])
    assert seen() == ["a", "b"]


def test_collections_of_a_committed_tree(spark, tmp_path):
    where = f"file://{tmp_path}/c"
    made = [("myths/m.json", '{"title":"t","citations":["a"]}'), ("sources/s.json", "{broken"), ("entries/e.md", "---\n{}\n---\nbody"), ("entries/skip.txt", "x")]
    sinks.write_files(spark.createDataFrame(made, "path string, content string"), where)
    assert rows(collections.collection(spark, where, "myths"), "id", "title") == [("m", "t")]
    assert rows(collections.entries(spark, f"{where}/entries", "id string"), "id", "body") == [("e", "body")]
    assert rows(collections.summary(collections.raw_files(spark, where), "c"), "collection", "n") == [("entries", 2), ("myths", 1), ("sources", 1)]


# --- scopes


def test_scopes_are_gated_before_bytes_are_read(spark, tmp_path):
    files = {"good/a.json": "{}", "good/b.json": '{"a":1,"a":2}', "good/c.json": "nope", "good/d.json": b"\xff", "large/a.json": "x" * 200, "heavy/a.json": '"' + "x" * 70 + '"', "heavy/b.json": '"' + "x" * 70 + '"', "odd/a.json": "{}", "odd/b.txt": "", "none": "x"}
    files |= {f"many/{k}.json": "1" for k in range(6)}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    (tmp_path / "linked").mkdir()
    (tmp_path / "linked" / "l.json").symlink_to(tmp_path / "good" / "a.json")
    scope = F.nullif(F.regexp_extract("path", "^([^/]+)/", 1), F.lit(""))
    limits = capture.Limits(files=5, file_bytes=100, total_bytes=120)
    got = capture.capture(spark, str(tmp_path), scope, limits)
    refused = {"large": "file beyond the limit", "heavy": "beyond the byte budget", "odd": "unexpected entry", "many": "too many files", "linked": "not plain files only"}
    assert {r["scope"]: r["refused"] for r in got.scopes.collect()} == refused | {"good": None}
    # What is refused can't be read any more; were it tried, it would be a problem of that file.
    for name in files:
        if name.split("/")[0] in refused:
            (tmp_path / name).unlink()
    assert {(r["path"], r["problem"], r["text"]) for r in got.files.collect()} == {("good/a.json", None, "{}"), ("good/b.json", "repeated key", '{"a":1,"a":2}'), ("good/c.json", "syntax", "nope"), ("good/d.json", "not UTF-8", None)}
    assert rows(got.violations(), "check_id", "record_id") == sorted([("scope.gate", k) for k in refused] + [("scope.file", f"good/{k}.json") for k in "bcd"])
    assert capture.capture(spark, str(tmp_path / "nowhere"), scope).violations().count() == 0


def test_scan_of_a_tree_with_links(spark, root):
    (root / "dist").mkdir()
    (root / "dist" / "l").symlink_to(root / "a")
    got = layers.scan_tree(spark, root, layers.Denied())
    assert rows(got, "check_id", "record_id", "message") == [("tree.entry", "dist/l", "link")]
    before = layers.snapshot(spark, root, [("a/", "a")])
    (root / "a" / "y.json").write_bytes(b"0000000")
    after = layers.snapshot(spark, root, [("a/", "a")])
    assert rows(snapshots.diff(before, after, ["path"], list(release_tree.IDENTITY)), "path", "change") == [("a/y.json", "changed")]


# --- sitemaps


def test_sitemaps_are_split_with_an_index(spark):
    routes = spark.createDataFrame([(f"/{k:03d}/",) for k in range(23)], "route string")
    entries = reports.sitemap(routes, "https://e.org", ("ru", "en"))
    whole = sinks.sitemap_text(entries).first()[0]
    assert rows(sinks.sitemap_files(entries, "https://e.org"), "path", "content") == [("sitemap.xml", whole)]
    inner = lambda text, kind: text.removeprefix(sinks.HEADS[kind]).removesuffix(f"</{kind}>")
    files = {r["path"]: r["content"] for r in sinks.sitemap_files(entries, "https://e.org", limit=10).collect()}
    assert sorted(files) == ["sitemap-1.xml", "sitemap-2.xml", "sitemap-3.xml", "sitemap-4.xml", "sitemap-5.xml", "sitemap.xml"]
    assert "".join(inner(files[f"sitemap-{k}.xml"], "urlset") for k in range(1, 6)) == inner(whole, "urlset")
    assert inner(files["sitemap.xml"], "sitemapindex") == "".join(f"<sitemap><loc>https://e.org/sitemap-{k}.xml</loc></sitemap>" for k in range(1, 6))
    nested = {r["path"]: r["content"] for r in sinks.sitemap_files(entries, "https://e.org", limit=4).collect()}
    assert len([p for p in nested if p.startswith("sitemap-index-")]) == 3 and nested["sitemap.xml"].count("<sitemap>") == 3
    assert "".join(inner(nested[f"sitemap-index-{k}.xml"], "sitemapindex") for k in (1, 2, 3)).count("sitemap-") == 12
    assert rows(sinks.sitemap_files(entries.limit(0), "https://e.org"), "path") == [("sitemap.xml",)]


def test_sitemaps_beyond_one_index_stand_without_any(spark):
    routes = spark.range(25).select(F.concat(F.lit("/r"), F.format_string("%02d", "id"), F.lit("/")).alias("route"))
    entries = reports.sitemap(routes, "https://e.org", ("ru", "en"))
    files = {r["path"]: r["content"] for r in sinks.sitemap_files(entries, "https://e.org", limit=4, nested=False).collect()}
    assert sorted(files) == sorted(f"sitemap-{k}.xml" for k in range(1, 14))
    assert sum(c.count("<url>") for c in files.values()) == 50
    assert "sitemap.xml" in {r["path"] for r in sinks.sitemap_files(entries, "https://e.org", limit=10, nested=False).collect()}
