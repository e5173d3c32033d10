import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import canonical as C
from corvane.operators import reports
from corvane.plans import layers
from corvane.sources import sinks

DENIED = C.Denied(organisation="acme", repository="vault", roots=("drafts",))


def test_tree_scan(spark, tmp_path):
    files = {
        "src/content/notes/a.md": b"fine [x](#a)",
        "src/content/notes/b.md": b"<b>no</b>",
        "src/app.ts": b"location = 'javascript:x'",
        "dist/index.html": b"<p>acme/vault</p>",
        "dist/bad.txt": b"\xff",
        "dist/images/i.svg": b"<svg/>",
        "dist/images/j.svg": b"<svg></svg>",
        "public/images/i.svg": b"<svg/>",
        "public/images/j.svg": b"<svg />",
        "other/x": b"",
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = sorted((r["check_id"], r["record_id"]) for r in layers.scan_tree(spark, tmp_path, DENIED).collect())
    assert got == [("layer.html", "dist/index.html"), ("layer.html", "dist/index.html"), ("layer.image", "j.svg"), ("layer.markdown", "src/content/notes/b.md"), ("layer.scheme", "src/app.ts"), ("layer.source", "src/app.ts"), ("layer.utf8", "dist/bad.txt")]


def test_components_and_built_files_are_scanned_as_a_whole():
    leak = lambda path, text, layer: layers.file_leak(text, path, DENIED, layer)
    shown = "---\nconst x = 1;\n---\n<p>{x} drafts/y</p>"
    assert leak("src/a.astro", shown, "runtime") == "local path"
    assert leak("src/a.astro", "---\nconst x = 'java\\x73cript:y';\n---\n<p>fine</p>", "runtime") == "dangerous scheme"
    assert leak("src/a.astro", "<p data-x='acme/vault'>", "runtime") == "repository coordinate"
    assert leak("src/a.astro", "---\nimport X from '../x';\n---\n<X a={1}>fine</X>", "runtime") is None
    assert leak("dist/a.js", "f(acme/vault)", "built") == "repository coordinate" and leak("src/a.js", "f(acme/vault)", "runtime") is None
    assert leak("dist/a.css", "p::before{color:red}", "built") is None and leak("dist/a.css", "p{} /* ::note{x} */", "built") == "raw directive"
    assert leak("dist/a.js", "x = {javascript: 1}", "built") is None


@pytest.mark.parametrize(
    ("url", "want"),
    [("/a/../b", None), ("../../x", "leads out of the site"), ("//h/x", "network path"), ("java\tscript:x", "dangerous scheme"), ("https://e.org/acme%252Fvault", "repository coordinate"), ("#a", None), ("mailto:a@b", None), ("x.html", None)],
)
def test_built_urls(url, want):
    got = C.built_url_problem(url, "en/index.html", DENIED)
    assert got == want or want == "repository coordinate" and got == "private reference"


def test_reference_scan():
    assert C.reference_scan("/acme/vault", DENIED) == "private"
    assert C.reference_scan("/acme%2Fvault.git", DENIED) == "private"
    assert C.reference_scan("/x%zz", DENIED) == "invalid" and C.reference_scan("/%ff", DENIED) == "invalid"
    assert C.reference_scan("/100%25", DENIED) == "safe" and C.reference_scan("/acme/vaults", DENIED) == "safe"
    assert C.reference_scan("/%" + "25" * 12 + "41", DENIED) == "invalid"


def test_unit_index():
    text = "aé\U00010000b"
    assert [C.unit_index(text, k) for k in (0, 1, 3, 7, 8)] == [0, 1, 2, 4, 5]


def test_sinks(spark, tmp_path):
    routes = spark.createDataFrame([("/b/",), ("/a/",)], "route string")
    text = sinks.sitemap_text(reports.sitemap(routes, "https://e.org", ("ru", "en"))).first()[0]
    assert text.count("<url>") == 4 and text.index("/a/") < text.index("/b/") and text.endswith("</urlset>")
    sinks.write_json_lines(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), f"file://{tmp_path}/out")
    assert sorted(json.loads(r[0]).get("b", "") for r in spark.read.text(f"file://{tmp_path}/out").collect()) == ["", "x"]
    assert spark.read.text(f"file://{tmp_path}/out").filter(F.col("value").contains("\n")).count() == 0
