"""Scan of a release tree by layers: what is run, what is generated, what is built.

Tasks list the tree and read and scan its files (sources.release_tree); it is listed again at
the end: a change in between is a violation, not an error, and so are links, special
files, and files beyond the limits.

Edge cases: null contents are files without text; bytes that aren't UTF-8 are a violation
for text files; files that repeat a path are judged one by one; empty trees have none.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import canonical, digests
from corvane.functions import text as T
from corvane.functions.canonical import Denied
from corvane.operators import checks, digest_tree, extract, snapshots
from corvane.sources import release_tree, tree
from corvane.sources.scratch import stored

#: (prefix, layer) in order; the first that matches holds.
LAYERS = [("src/content/", "content"), ("public/images/", "image"), ("dist/images/", "built-image"), ("dist/", "built"), ("src/", "runtime")]
HTML, MARKDOWN = r"(?i)\.html?$", r"(?i)\.md$"
SCRIPTS = frozenset({"js", "mjs", "cjs", "jsx", "ts", "mts", "cts", "tsx"})
TEXT = r"(?i)\.(?:html?|md|css|astro|[cm]?[jt]sx?|json|xml|svg|txt|csv|webmanifest)$"


def snapshot(spark: SparkSession, root: str | Path, layers: list[tuple[str, str]] = LAYERS) -> DataFrame:
    """The tree's rows with their layer, stored; nothing outside the layers."""
    listed = tree.tree(spark, root)
    return stored(listed.withColumn("layer", snapshots.layer_of(F.col("path"), layers)).filter("layer is not null"), "layers")


def scan(files: DataFrame, denied: Denied) -> DataFrame:
    """Violations in (path, layer, content): names, encodings, controls, schemes, pages and entries."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    named = files.withColumn("is_text", F.col("path").rlike(TEXT)).withColumn("text", F.when(F.col("is_text"), text))

    @F.pandas_udf("string")
    def of_path(p):
        return p.map(lambda x: canonical.path_leak(x, denied))

    scripts = F.col("layer").isin("runtime", "built") & ~F.col("path").rlike(HTML)
    rules = [
        ("layer.utf8", "content", ~F.col("is_text") | F.col("text").isNotNull(), "not UTF-8"),
        ("layer.control", "content", F.col("text").isNull() | ~T.has_forbidden_control(F.col("text")), "control or format character"),
        ("layer.scheme", "content", F.col("text").isNull() | ~scripts | ~T.has_dangerous_scheme(F.col("text")), "dangerous scheme"),
    ]
    simple = checks.violations(named, F.col("path"), rules)
    paths = checks.violations(named.withColumn("leak", of_path("path")), F.col("path"), [("layer.path", "path", F.col("leak").isNull(), "leak in the name")])

    def parsed(kind: str, pattern: str, check: str) -> DataFrame:
        found = named.filter(F.col("path").rlike(pattern) & F.col("text").isNotNull()).select("path", F.explode(extract.problems(F.col("text"), denied, kind, F.regexp_replace("path", "^[^/]*/", ""))).alias("p"))
        return found.select(F.lit(check).alias("check_id"), F.col("path").alias("record_id"), F.col("p.where").alias("path"), F.col("p.problem").alias("message"))

    # All other text files: the strings and comments of scripts, the generated texts of style sheets, the keys and values of JSON, else the whole text.
    others = named.filter(~F.col("path").rlike(HTML) & ~F.col("path").rlike(MARKDOWN) & F.col("text").isNotNull())
    leaks = others.select("path", canonical.judged(lambda t, p, layer: file_leak(t, p, denied, layer), F.col("text"), F.col("path"), F.col("layer")).alias("message")).filter("message is not null")
    source = leaks.select(F.lit("layer.source").alias("check_id"), F.col("path").alias("record_id"), F.lit("content").alias("path"), "message")
    return checks.all_of(simple, paths, parsed("html", HTML, "layer.html"), parsed("markdown", MARKDOWN, "layer.markdown"), source)


def file_leak(text: str, path: str, denied: Denied, layer: str | None = None) -> str | None:
    """The first leak in a text file that is no page and no entry, by its kind; of what is built, in its whole text too."""
    end = path.rsplit(".", 1)[-1].lower()
    try:
        if layer == "built":
            styles = extract.masked(text, extract.pseudo_ranges(text)) if end == "css" else None
            if found := canonical.artefact_leak(text, denied, strict=False, directives=styles, scan_schemes=end not in SCRIPTS):
                return found
        if end in ("json", "webmanifest"):
            return canonical.json_leak(text, denied)
        if end == "css":
            found = [canonical.leak(t, denied, canonical.READ_FRAGMENT) for t in extract.css_parts(text)["content"]]
        elif end == "astro":
            found = extract.template_leaks(text, denied)
        elif end in SCRIPTS:
            found = extract.script_leaks(text, None, denied, jsx=end in ("jsx", "tsx"))
        else:
            return canonical.artefact_leak(text, denied, strict=False)
    except canonical.Unsafe as e:
        return str(e)
    return next((p for p in found if p), None)


def scan_tree(spark: SparkSession, root: str | Path, denied: Denied, layers: list[tuple[str, str]] = LAYERS) -> DataFrame:
    """All violations of a tree: entries that aren't plain files, budgets, scans, built images that aren't the generated ones, and changes while it ran."""
    before = snapshot(spark, root, layers)
    files = release_tree.contents(before.filter("kind <> 'directory'"), root)
    unread = release_tree.violations(files).unionByName(release_tree.violations(before.filter("kind = 'directory'")))
    files = files.filter("problem is null").select("path", "layer", "content")
    name = lambda layer: files.filter(F.col("layer") == layer).select(F.element_at(F.split("path", "/"), -1).alias("name"), digests.sha256(F.col("content")).alias("content"))
    copies = snapshots.copies(name("built-image"), name("image"))
    images = copies.select(F.lit("layer.image").alias("check_id"), F.col("name").alias("record_id"), F.lit("content").alias("path"), F.col("problem").alias("message"))
    # Stored, so that the second listing comes after all reading.
    found = stored(checks.all_of(scan(files, denied), images, unread, tree.budgets(before)), "scanned")
    after = snapshot(spark, root, layers)
    compared = ["kind", *release_tree.IDENTITY]
    changed = digest_tree.diff(digest_tree.take(before, "path", compared, "before"), digest_tree.take(after, "path", compared, "after"))
    return found.unionByName(checks.rows_of(changed, "layer.changed", F.col("path"), "path", "changed while it was scanned"))


def url_problem(url: Column, page: Column, denied: Denied) -> Column:
    """What is wrong with a link on a built page, or null."""

    @F.pandas_udf("string")
    def run(u, p):
        import pandas as pd

        return pd.Series([None if a is None else canonical.built_url_problem(a, b or "", denied) for a, b in zip(u, p)], dtype=object)

    return run(url, page)
