"""Registered queries over the driver's tables: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import batches, canonical, digests, paths
from corvane.functions import text as T
from corvane.operators import checks, extract, links, overlay, reports, snapshots

LANGS = ["en", "fr", "de", "es", "ru"]
LOCALES = ("ru", "en")
BASE = "/site/"
BUDGET = 50_000
DOMAIN = "payload-v1\n"
DENIED = canonical.Denied(organisation="src1", repository="the", roots=("drafts",))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+(.*)$", 1)


@query
def resolved_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their ordered references to parts, each with its position."""
    lines = links.ordinal(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    orders = load(spark, sf_dir, "orders").select("o_orderkey")
    cited = links.resolve(links.resolve(lines, "l_partkey", load(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey"), "l_orderkey", orders, "o_orderkey")
    return cited.select("o_orderkey", "ordinal", "p_partkey", "p_name")


@query
def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.missing(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", load(spark, sf_dir, "labels"), "doc_id")


@query
def reverse_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = links.orphans(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", load(spark, sf_dir, "orders"), "o_custkey")
    b = links.orphans(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", load(spark, sf_dir, "documents"), "doc_id")
    c = links.orphans(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", load(spark, sf_dir, "labels"), "doc_id")
    named = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return named(a, "customer", "c_custkey").unionByName(named(b, "label", "doc_id")).unionByName(named(c, "document", "doc_id"))


@query
def bijection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.bijection(load(spark, sf_dir, "documents"), "doc_id", load(spark, sf_dir, "labels"), "doc_id")


@query
def overlay_localised(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    texts = docs.select(F.lit("documents").alias("collection"), "id", F.lit("source").alias("field"), F.upper("source").alias("text"))
    return overlay.localize(docs, texts, ["source"], "en")


@query
def overlay_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    texts = load(spark, sf_dir, "labels").select(F.lit("documents").alias("collection"), F.col("doc_id").alias("id"), F.lit("source").alias("field"), F.col("quality").cast("string").alias("text"))
    return overlay.gaps(docs, texts, ["source"])


@query
def grouped_bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.grouped(load(spark, sf_dir, "documents"), "lang", LANGS, F.count_if(F.col("n_chars") > 2000).alias("n_long"))


@query
def year_desc_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    joined = docs.join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    placed = reports.numbered(joined, *reports.newest_first(F.col("quality"), T.pad_left(F.col("doc_id"), 12)), partition=["lang"])
    return placed.select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), "position", "label")


@query
def top4_chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 4, F.desc("o_totalprice"), F.col("o_orderkey"))


@query
def code_unit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    return reports.numbered(rows, reports.by_code_units(F.col("p_name")), F.col("p_partkey"), partition=["p_brand"]).select("p_partkey", "position")


@query
def route_locale_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = load(spark, sf_dir, "nation").select(F.concat(F.lit("/"), F.lower("n_name"), F.lit("/")).alias("route"))
    return reports.sitemap(routes, "https://example.org", LOCALES)


@query
def attribute_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.attributes(load(spark, sf_dir, "region"), "r_regionkey", ["r_name", "r_regionkey"], [0, 1, 2, 3, 4])


@query
def layer_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.layers(load(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_type"])


@query
def exact_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.cardinality(load(spark, sf_dir, "orders"), "o_orderkey", load(spark, sf_dir, "lineitem"), "l_orderkey")


@query
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.duplicates(load(spark, sf_dir, "documents").select(digests.sha256(F.col("text")).alias("sha256")), "sha256")


@query
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return roles.select("conv_id", links.same_set(F.col("roles"), F.array(F.lit("user"), F.lit("assistant"))).alias("same"))


@query
def multiset_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return links.multiset_difference(a, load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")), ["nation"])


@query
def adjacent_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.out_of_order(load(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], F.col("event_id"), F.col("value"), strict=False).select("event_id", "user_id", "previous", "value")


@query
def running_byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.over_budget(load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), ["lang", "source"], F.col("doc_id"), F.col("n_chars"), BUDGET).select("doc_id", "running")


@query
def count_vs_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = load(spark, sf_dir, "documents").groupBy(F.col("lang").alias("collection")).agg(F.count("*").alias("n"))
    return snapshots.manifest_counts(reports.key_table(observed, "collection", LANGS).withColumn("n", F.lit(100)), observed)


@query
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    before = orders.filter("o_orderpriority <> '5-LOW'")
    after = orders.filter("o_orderstatus <> 'P'").withColumn("o_orderpriority", F.when(F.col("o_orderstatus") == "O", None).otherwise(F.col("o_orderpriority")))
    return snapshots.diff(before, after, ["o_orderkey"], ["o_orderstatus", "o_orderpriority", "o_totalprice"])


@query
def copies_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("n_chars").alias("content"))
    return snapshots.copies(built, load(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), F.col("quality").cast("long").alias("content")))


@query
def payload_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered digest per thousand ids: groups are bounded by the key."""
    docs = load(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 1000).alias("bucket"), F.struct(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")).alias("f"))
    return docs.groupBy("bucket").agg(digests.ordered_digest(F.collect_list("f"), DOMAIN).alias("digest"))


@query
def framed_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", digests.sha256(digests.frame(F.col("text"))).alias("sha256"))


@query
def reading_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = load(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))
    return words.select("doc_id", "words", T.reading_minutes(F.col("words")).alias("minutes"))


@query
def control_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.has_forbidden_control(F.col("text")).alias("flagged"))


@query
def base_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(F.col("url"))
    return load(spark, sf_dir, "pages").select("page_id", paths.with_base(path, F.lit(BASE)).alias("based"), paths.without_base(paths.with_base(path, F.lit(BASE)), F.lit(BASE)).alias("bare"))


@query
def locale_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(F.col("url"))
    return load(spark, sf_dir, "pages").select("page_id", paths.locale_of(path, F.lit("/")).alias("locale"), *[paths.localize(path, F.lit(x), F.lit(BASE)).alias(f"path_{x}") for x in LOCALES])


@query
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return load(spark, sf_dir, "pages").select("page_id", url.rlike(r"^https://[^\s/?#@:]+(?::\d+)?(?:[/?#]\S*)?$").alias("https"), T.has_dangerous_scheme(url).alias("dangerous"), T.origin_of(url).alias("origin"))


@query
def safe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL in canonical form, or what is wrong with it."""
    return load(spark, sf_dir, "pages").select("page_id", canonical.checked_url(F.col("url")).alias("u")).select("page_id", "u.value", "u.error")


@query
def slug_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    return load(spark, sf_dir, "part").select("p_partkey", T.pad_left(F.col("p_partkey"), 4).alias("padded"), T.numbered(F.col("p_partkey")).alias("numbered"), paths.is_neutral_slug(slug).alias("neutral"))


@query
def payload_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit(paths.CONTENT_ROOT + "/notes/note-"), F.lower(F.col("source")), F.when(F.col("lang") == "en", ".json").otherwise(".md"))
    return load(spark, sf_dir, "documents").select("doc_id", paths.payload_kind(path).alias("kind"), paths.is_normal(path).alias("normal"), paths.stem(path).alias("stem"))


@query
def text_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.encode_component(F.col("url")).alias("encoded"), T.escape_html(F.col("url")).alias("escaped"))


@query
def code_unit_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.code_units(F.col("text")).alias("units"))


@query
def masked_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 2), (3, 4))])
    return load(spark, sf_dir, "part").select("p_partkey", T.mask_ranges(F.col("p_name"), spans).alias("masked"))


@query
def clamped_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, n = F.col("p_size"), F.lit(50)
    return load(spark, sf_dir, "part").select("p_partkey", T.clamp(F.col("p_retailprice") / 20).alias("clamped"), T.neighbour(size, F.lit(1), n).alias("next"), T.wrapped(size, F.lit(1), n).alias("wrapped"))


@query
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderstatus") == "F", day).when(F.col("o_orderstatus") == "O", F.replace(day, F.lit("-"), F.lit("/"))).otherwise(F.concat(F.substring(day, 1, 8), F.lit("32")))
    return load(spark, sf_dir, "orders").select("o_orderkey", T.is_iso_date(text).alias("valid"))


@query
def evidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("quality") == 1, "clinical").when(F.col("toxic") == 1, "none").otherwise("traditional")
    return load(spark, sf_dir, "labels").select("doc_id", *[T.label(level, T.EVIDENCE_LABELS, F.lit(x)).alias(f"label_{x}") for x in LOCALES])


@query
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    b = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    tag = lambda df, name: df.distinct().select(F.lit(name).alias("op"), "nation")
    return tag(a.union(b), "union").union(tag(a.subtract(b), "difference")).union(tag(a.filter(F.col("nation").isin(1, 2, 3)), "member"))


@query
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.col("props")
    return load(spark, sf_dir, "events").select("event_id", checks.json_problem(props).alias("problem"), F.size(checks.unknown_keys(props, ["k"])).alias("unknown"))


@query
def row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        ("doc.short", "n_chars", F.col("n_chars") >= 100, "too short"),
        ("doc.lang", "lang", F.col("lang").isin(LANGS), "unknown"),
        ("doc.length", "text", F.length("text") == F.col("n_chars"), "another length"),
    ]
    return checks.violations(load(spark, sf_dir, "documents"), F.col("doc_id"), rules)


@query
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "documents").select("doc_id", canonical.canonical_text(F.col("text")).alias("c"))
    return c.select("doc_id", digests.sha256(F.col("c.value")).alias("sha256"), "c.error")


@query
def private_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", canonical.leak_of(F.col("text"), DENIED).alias("leak"))


@query
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", canonical.canonical_json_text(F.col("props")).alias("j")).select("event_id", "j.value", "j.error")


@query
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches.small_batches(spark)
    parts = load(spark, sf_dir, "pages").select("page_id", extract.html_parts(F.col("html")).alias("p"))
    return parts.select("page_id", F.length("p.text").alias("chars"), F.size("p.runs").alias("runs"), F.size("p.scripts").alias("scripts"), F.size("p.style_blocks").alias("styles"))


@query
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches.small_batches(spark)
    parts = load(spark, sf_dir, "pages").select("page_id", extract.html_parts(F.col("html"))["urls"].alias("urls"))
    return parts.select("page_id", F.size("urls").alias("n_links"))


#: What html_problems plants in the pages it scans, by page_id: text that ends a page, and what the scan says of it.
PLANTED = {
    1: ("<!-- src1/the -->", (("text", "repository coordinate"),)),
    2: ('<p title="drafts/x">x</p>', (("text", "local path"), ("readable", "local path"))),
    3: ("<style>p{background:url(/drafts/x.png)}</style>", (("text", "local path"),)),
    4: ("<p>java&#115;cript:x</p>", (("text", "dangerous scheme"), ("runs", "dangerous scheme"))),
    5: ("<p>a ::box{b} c</p>", (("text", "raw directive"), ("runs", "raw directive"))),
    6: ("<script>f('src1\\x2fthe')</script>", (("scripts", "repository coordinate"),)),
    7: ("<p>note claim-7</p>", (("runs", "internal identifier"),)),
    8: ('<a href="../../../../../x">y</a>', (("urls", "leads out of the site"),)),
}
PLANTED_STEPS = 11


@query
def html_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of whole pages, most of which have one planted at their end."""
    batches.small_batches(spark)
    page = F.regexp_extract(_path(F.col("url")), r"^/*([^?#]*)", 1)
    planted = F.lit("")
    for k, (html, _) in PLANTED.items():
        planted = F.when(F.col("page_id") % PLANTED_STEPS == k, F.lit(html)).otherwise(planted)
    html = F.concat(F.coalesce("html", F.lit("")), planted)
    found = load(spark, sf_dir, "pages").select("page_id", F.explode(extract.problems(html, DENIED, "html", page)).alias("p"))
    return found.groupBy("page_id", "p.where", "p.problem").agg(F.count("*").alias("n"))


@query
def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches.small_batches(spark)
    parts = load(spark, sf_dir, "documents").select("doc_id", extract.markdown_parts(F.col("text")).alias("p"))
    return parts.select("doc_id", F.size("p.links").alias("n_links"), F.size("p.directives").alias("n_directives"), F.size("p.headings").alias("n_headings"), T.word_count(F.col("p.text")).alias("words"))
