"""Release checks: row schemas, the record graph, routes, the manifest and its digests.

A release is a handful of DataFrames (entries, notes, sources, objects, media,
files) and one manifest row. Every check gives violation rows (checks.COLUMNS);
nothing raises, and the first violation only is a matter of fail_first().
Identities that are one project's own (release name, order of entries, routes)
are parameters.

Edge cases: a null field breaks the rules that need it; records that repeat an id are
reported, and judged one by one; empty tables break nothing but what a manifest or a
reference demands of them; extra columns are ignored, and those whose names start with
two underscores are reserved.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import canonical, digests, paths
from corvane.functions import text as T
from corvane.functions.canonical import Denied
from corvane.operators import checks, links, snapshots
from corvane.sources import collections, tree
from corvane.sources.scratch import stored

#: Fixed value lists.
SOURCE_TYPES = ("journal-article", "book", "book-chapter", "museum-record", "museum-page", "institutional-page", "archive", "dataset")
CONFIDENCE = ("high", "medium", "contested")
INVENTORY = ("published", "not-published")
MEDIA_KINDS = ("authored-diagram", "generative", "documentary")
OPEN_LICENSE_URL = "https://creativecommons.org/licenses/by/4.0/"
DISCLOSURE = r"(?iu)недокументальн"
DOI = r"^10\.\d{4,9}/\S+$"

ENTRY = "id string, slug string, kind string, title string, subtitle string, `order` int, part int, readingMinutes int, noteIds array<string>, objectIds array<string>, mediaIds array<string>, readingSequence struct<interludeId:string,portalAnchor:string,returnAnchor:string>"
NOTE = "id string, anchor string, statement string, confidence string, limitation string, sourceIds array<string>"
SOURCE = "id string, authors array<string>, title string, year int, type string, publisher string, containerTitle string, volume string, issue string, pages string, doi string, url string, locators array<string>"
OBJECT = "id string, title string, culture string, date string, material string, materialQualification string, materialAttribution string, collection string, provenanceBoundary string, inventory struct<status:string,number:string,statement:string>, credits array<string>, sourceIds array<string>, mediaIds array<string>"
MEDIA = "id string, outputName string, alt string, caption string, credit string, license string, licenseUrl string, sourceUrl string, kind string, author string, changeNote string, nondocumentaryDisclosure string"
FILE = "path string, kind string, byteLength long, sha256 string"
MANIFEST = f"version int, projection string, transformer string, cycleId string, targetCommit string, reviewEvidenceCommit string, releaseId string, readerPayloadDigest string, readingOrder array<string>, counts struct<entries:int,notes:int,sources:int,objects:int,media:int>, files array<struct<path:string,kind:string,byteLength:bigint,sha256:string>>, reviewAttestation struct<schemaVersion:int,cycleId:string,targetCommit:string,reviewEvidenceCommit:string,reviewedPayload:struct<projection:string,transformer:string,digest:string>,contentBinding:struct<algorithm:string,format:string,digest:string>>"


@dataclass(frozen=True)
class Project:
    """What is one project's own."""

    version: int = 4
    attestation_version: int = 3
    projection: str = "reader-v1"
    transformer: str = "reader-markdown-v1"
    release_prefix: str = "release-reader-v1-"
    payload_domain: str = "reader-payload-v1\n"
    release_domain: str = "reader-release-v1\n"


def _id(kind: str, column: str = "id") -> Column:
    return F.col(column).rlike(paths.ID_PATTERNS[kind])


def _long(column: str, least: int) -> Column:
    return F.length(F.trim(column)) >= least


def _filled(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (F.length(F.trim(F.col(c))) > 0)
    return F.coalesce(out, F.lit(False))


def https(url: Column) -> Column:
    """https, a host, no credentials."""
    return url.rlike(r"^https://[^\s/?#@:]+(?::\d+)?(?:[/?#]\S*)?$")


def public_url(url: Column, denied: Denied) -> Column:
    """https() without a reference to a denied place; addresses of plain letters that don't name the organisation stay in the JVM."""
    named = F.contains(F.lower(url), F.lit(denied.organisation.lower())) if denied.organisation else F.lit(False)
    asked = F.when(https(url) & (~url.rlike(r"^[A-Za-z0-9:/?#=._~-]*$") | named), url)
    return https(url) & canonical.judged(lambda u: canonical.public_url_problem(u, denied), asked).isNull()


Rules = list[tuple[str, str, Column, str]]


def entry_rules() -> Rules:
    kind = F.when(F.col("id") == "prologue", "prologue").when(F.col("id").startswith("chapter-"), "chapter").otherwise("interlude")
    sequence = F.col("readingSequence")
    return [
        ("entry.id", "id", _id("entry"), "not an entry id"),
        ("entry.slug", "slug", paths.is_neutral_slug(F.col("slug")), "not a neutral slug"),
        ("entry.kind", "kind", F.col("kind") == kind, "kind must follow from the id"),
        ("entry.title", "title", _long("title", 3), "too short"),
        ("entry.subtitle", "subtitle", _long("subtitle", 10), "too short"),
        ("entry.order", "order", F.col("order") >= 0, "negative"),
        ("entry.part", "part", F.col("part").between(0, 5), "not 0 to 5"),
        ("entry.minutes", "readingMinutes", F.col("readingMinutes") > 0, "not positive"),
        ("entry.notes", "noteIds", T.unique_array(F.col("noteIds"), 1) & F.forall("noteIds", lambda n: n.rlike(paths.ID_PATTERNS["note"])), "unique note ids, one at least"),
        ("entry.objects", "objectIds", T.unique_array(F.col("objectIds")), "not unique"),
        ("entry.media", "mediaIds", T.unique_array(F.col("mediaIds")), "not unique"),
        ("entry.sequence", "readingSequence", sequence.isNull() | ((F.col("kind") == "chapter") & (sequence["interludeId"] != F.col("id"))), "only a chapter has one, and not to itself"),
    ]


def note_rules() -> Rules:
    return [
        ("note.id", "id", _id("note"), "not a note id"),
        ("note.anchor", "anchor", _id("anchor", "anchor"), "not an anchor"),
        ("note.statement", "statement", _long("statement", 20), "too short"),
        ("note.confidence", "confidence", F.col("confidence").isin(*CONFIDENCE), "unknown"),
        ("note.limitation", "limitation", _long("limitation", 20), "too short"),
        ("note.sources", "sourceIds", T.unique_array(F.col("sourceIds"), 1), "unique, one at least"),
    ]


def source_rules(denied: Denied = Denied()) -> Rules:
    has = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    return [
        ("source.id", "id", _id("source"), "not a source id"),
        ("source.title", "title", _filled("title", "publisher"), "title and publisher"),
        ("source.authors", "authors", F.size("authors") > 0, "one at least"),
        ("source.year", "year", F.col("year").isNull() | F.col("year").between(1, 2100), "not 1 to 2100"),
        ("source.type", "type", F.col("type").isin(*SOURCE_TYPES), "unknown"),
        ("source.place", "doi", has("doi") | has("url"), "doi or url"),
        ("source.doi", "doi", F.col("doi").isNull() | F.col("doi").rlike(DOI), "not a doi"),
        ("source.url", "url", F.col("url").isNull() | public_url(F.col("url"), denied), "not a safe https url"),
        ("source.article", "containerTitle", (F.col("type") != "journal-article") | (has("containerTitle") & has("volume") & has("pages")), "container, volume and pages"),
        ("source.chapter", "containerTitle", (F.col("type") != "book-chapter") | (has("containerTitle") & has("pages")), "container and pages"),
    ]


def object_rules() -> Rules:
    i = F.col("inventory")
    return [
        ("object.id", "id", _id("object"), "not an object id"),
        ("object.text", "title", _filled("title", "culture", "date", "material", "collection", "provenanceBoundary"), "empty field"),
        ("object.inventory", "inventory", ((i["status"] == "published") & (F.length(i["number"]) > 0)) | ((i["status"] == "not-published") & (F.length(F.trim(i["statement"])) >= 20)), "a number if published, else a statement"),
        ("object.sources", "sourceIds", T.unique_array(F.col("sourceIds"), 1), "unique, one at least"),
        ("object.media", "mediaIds", T.unique_array(F.col("mediaIds")), "not unique"),
    ]


def media_rules(denied: Denied = Denied()) -> Rules:
    return [
        ("media.id", "id", _id("media"), "not a media id"),
        ("media.name", "outputName", F.col("outputName").rlike(f"^{paths.IMAGE_NAME}$"), "not an svg or webp name"),
        ("media.text", "alt", _filled("alt", "caption", "credit", "license"), "empty field"),
        ("media.license", "licenseUrl", public_url(F.col("licenseUrl"), denied), "not a safe https url"),
        ("media.kind", "kind", F.col("kind").isin(*MEDIA_KINDS), "unknown"),
        ("media.diagram", "licenseUrl", (F.col("kind") != "authored-diagram") | (F.col("licenseUrl") == OPEN_LICENSE_URL), "a diagram has the open license"),
        ("media.generative", "nondocumentaryDisclosure", (F.col("kind") != "generative") | F.col("nondocumentaryDisclosure").rlike(DISCLOSURE), "a disclosure"),
    ]


def file_rules() -> Rules:
    kind = paths.payload_kind(F.col("path"))
    return [
        ("file.path", "path", paths.is_normal(F.col("path")) & kind.isNotNull(), "not a payload path in normal form"),
        ("file.kind", "kind", F.col("kind") == F.when(kind == "image", "binary").otherwise("text"), "kind must follow from the path"),
        ("file.size", "byteLength", F.col("byteLength").between(0, tree.MAX_FILE_BYTES), "beyond the limit"),
        ("file.sha256", "sha256", F.col("sha256").rlike(paths.ID_PATTERNS["sha256"]), "not a digest"),
    ]


RULES = {"entries": entry_rules, "notes": note_rules, "sources": source_rules, "objects": object_rules, "media": media_rules}


def check_rows(tables: dict[str, DataFrame], denied: Denied = Denied()) -> DataFrame:
    """Row rules and key uniqueness of the record tables."""
    found = []
    with_urls = (source_rules, media_rules)
    for name, rules in RULES.items():
        if name in tables:
            found.append(checks.violations(tables[name], F.col("id"), rules(denied) if rules in with_urls else rules()))
            found.append(checks.rows_of(links.duplicates(tables[name], "id"), f"{name}.unique", F.col("id"), "id", "repeated id"))
    return checks.all_of(*found)


def _one_form(paths_text: str) -> str | None:
    """Whether different paths (one a line) have one composed form."""
    own = set(paths_text.split("\n"))
    return None if len({unicodedata.normalize("NFC", p) for p in own}) == len(own) else "collision"


def check_manifest(manifest: DataFrame, project: Project = Project()) -> DataFrame:
    """Identities, order, counts and budgets of manifest rows."""
    m, a = F.col, F.col("reviewAttestation")
    names = F.transform("files", lambda f: f["path"])
    keys = F.transform(names, lambda p: F.encode(p, "UTF-16BE"))
    count = lambda folder: F.size(F.filter(names, lambda p: p.startswith(f"{paths.CONTENT_ROOT}/{folder}/")))
    prefix = f"{paths.CONTENT_ROOT}/entries/"
    entry_ids = F.transform(F.filter(names, lambda p: p.startswith(prefix)), lambda p: F.regexp_extract(p, r"([^/]+)\.md$", 1))
    total = F.aggregate("files", F.lit(0).cast("long"), lambda s, f: s + f["byteLength"])
    rules: Rules = [
        ("manifest.version", "version", m("version") == project.version, "version"),
        ("manifest.projection", "projection", (m("projection") == project.projection) & (m("transformer") == project.transformer), "projection or transformer"),
        ("manifest.cycle", "cycleId", _id("cycle", "cycleId"), "not a cycle id"),
        ("manifest.commits", "targetCommit", _id("commit", "targetCommit") & _id("commit", "reviewEvidenceCommit") & (m("targetCommit") != m("reviewEvidenceCommit")), "two different commits"),
        ("manifest.release", "releaseId", m("releaseId") == F.concat(F.lit(project.release_prefix), m("targetCommit")), "must contain the target commit"),
        ("manifest.digest", "readerPayloadDigest", _id("sha256", "readerPayloadDigest"), "not a digest"),
        ("manifest.files", "files", F.size("files").between(1, tree.MAX_FILES), "too few or too many"),
        ("manifest.bytes", "files", total <= tree.MAX_TOTAL_BYTES, "beyond the budget"),
        ("manifest.sorted", "files", keys == F.array_sort(keys), "not in UTF-16 order"),
        ("manifest.unique", "files", T.unique_array(names), "repeated path"),
        ("manifest.forms", "files", canonical.judged(_one_form, F.array_join(names, "\n")).isNull(), "paths that differ in normal form only"),
        ("manifest.order", "readingOrder", T.unique_array(m("readingOrder"), 1) & (F.size("readingOrder") == m("counts.entries")) & links.same_set(m("readingOrder"), entry_ids), "must list every entry once"),
        ("attestation.version", "reviewAttestation", a["schemaVersion"] == project.attestation_version, "version"),
    ]
    rules += [(f"manifest.count.{k}", f"counts.{k}", m(f"counts.{k}") == count(k), "must match the files") for k in paths.FOLDERS.values()]
    pairs = {"cycleId": "cycleId", "targetCommit": "targetCommit", "reviewEvidenceCommit": "reviewEvidenceCommit", "reviewedPayload.projection": "projection", "reviewedPayload.transformer": "transformer", "reviewedPayload.digest": "readerPayloadDigest"}
    rules += [("attestation.identity", f"reviewAttestation.{x}", F.col(f"reviewAttestation.{x}").eqNullSafe(F.col(y)), "must equal the manifest's") for x, y in pairs.items()]
    files = manifest.select(F.explode("files").alias("f")).select("f.*")
    return checks.all_of(checks.violations(manifest, F.col("releaseId"), rules), checks.violations(files, F.col("path"), file_rules()))


def check_graph(tables: dict[str, DataFrame], images: DataFrame | None = None) -> DataFrame:
    """References exist, everything is referred to, images and media names match, anchors are unique."""
    plan = [("entries", "noteIds", "notes"), ("entries", "objectIds", "objects"), ("entries", "mediaIds", "media"), ("notes", "sourceIds", "sources"), ("objects", "sourceIds", "sources"), ("objects", "mediaIds", "media")]
    found, to = [], {}
    for a, column, b in plan:
        e = links.edges(tables[a], "id", column)
        found.append(checks.rows_of(links.missing(e, "reference", tables[b], "id"), f"graph.{a}.{column}", F.col("id"), column, "no such record"))
        to[b] = to[b].unionByName(e) if b in to else e
    for b, e in to.items():
        found.append(checks.rows_of(links.orphans(tables[b], "id", e, "reference"), f"graph.{b}.orphan", F.col("id"), "id", "nothing refers to it"))
    anchors = tables["notes"].select("anchor").unionByName(tables["entries"].select(F.explode(F.array("readingSequence.portalAnchor", "readingSequence.returnAnchor")).alias("anchor")).filter("anchor is not null"))
    found.append(checks.rows_of(links.duplicates(anchors, "anchor"), "graph.anchor", F.col("anchor"), "anchor", "repeated anchor"))
    found.append(checks.rows_of(links.duplicates(tables["media"], "outputName"), "graph.media.name", F.col("outputName"), "outputName", "repeated name"))
    if images is not None:
        found.append(checks.rows_of(links.bijection(tables["media"], "outputName", images, "name"), "graph.images", F.col("key"), "outputName", "declared and present images differ"))
    return checks.all_of(*found)


def check_body_links(entries: DataFrame, declared: DataFrame, body_links: DataFrame) -> DataFrame:
    """Each declared (entry, route) stands exactly once in the entry's body, and no other record route does. body_links: (entry, url)."""
    found = body_links.filter(F.col("url").rlike(r"^(?:#note-|/book/(?:objects|media)/)")).groupBy("entry", "url").agg(F.count("*").alias("n"))
    both = declared.select("entry", F.col("route").alias("url"), F.lit(True).alias("wanted")).distinct().join(found, ["entry", "url"], "full_outer")
    message = F.when(F.col("wanted").isNull(), "not declared").when(F.coalesce("n", F.lit(0)) != 1, "must stand exactly once")
    return both.filter(message.isNotNull()).select(F.lit("body.links").alias("check_id"), F.col("entry").alias("record_id"), F.col("url").alias("path"), message.alias("message"))


def check_routes(entries: DataFrame, contract: DataFrame) -> DataFrame:
    """Entries are exactly those of the ordered contract (position, id, slug, kind)."""
    c = contract.select(F.col("position"), F.col("id"), F.col("slug").alias("c_slug"), F.col("kind").alias("c_kind"))
    both = c.join(entries.select("id", "slug", "kind", F.col("order").alias("at")), "id", "full_outer")
    message = (
        F.when(F.col("position").isNull(), "not in the contract")
        .when(F.col("slug").isNull(), "missing")
        .when(~(F.col("slug").eqNullSafe(F.col("c_slug")) & F.col("kind").eqNullSafe(F.col("c_kind")) & F.col("at").eqNullSafe(F.col("position"))), "slug, kind or order differ")
    )
    return both.filter(message.isNotNull()).select(F.lit("routes").alias("check_id"), F.col("id").alias("record_id"), F.lit("route").alias("path"), message.alias("message"))


def unbound(manifest: DataFrame) -> DataFrame:
    """(release, json): each manifest as JSON without the binding of its attestation and without absent fields."""
    bare = manifest.withColumn("reviewAttestation", F.col("reviewAttestation").dropFields("contentBinding"))
    return bare.select(F.col("releaseId").alias("release"), F.to_json(F.struct(*manifest.columns)).alias("json"))


def check_integrity(manifest: DataFrame, files: DataFrame, project: Project = Project(), approved_svg: tuple[str, ...] = ()) -> DataFrame:
    """The manifests' files against those found (path, content, and release where there are several manifests).

    Judged are paths, lengths, digests, text encoding, the digest of all files and, where a manifest binds one, that of
    its own canonical JSON and the files; with approved_svg, which images may be SVG. Bytes are streamed, never gathered.
    """
    only = "release" not in files.columns
    release = F.lit("") if only else F.col("release")
    files = files.select(release.alias("release"), "path", "content")
    named = manifest.withColumn("__r", F.lit("") if only else F.col("releaseId"))
    declared = named.select(F.col("__r").alias("release"), F.explode("files").alias("f")).select("release", "f.*")
    found = files.select("release", "path", F.octet_length("content").alias("found_length"), digests.sha256(F.col("content")).alias("found_sha256"), F.is_valid_utf8(F.col("content").cast("string")).alias("found_utf8"))
    paired = declared.join(found, ["release", "path"])
    key = lambda df: df.select(F.struct("release", "path").alias("k"))
    out = [
        checks.rows_of(links.bijection(key(declared), "k", key(found), "k"), "integrity.paths", F.col("key.path"), "path", "declared and present files differ"),
        checks.violations(
            paired,
            F.col("path"),
            [
                ("integrity.length", "byteLength", F.col("found_length") == F.col("byteLength"), "another length"),
                ("integrity.sha256", "sha256", F.col("found_sha256") == F.col("sha256"), "another digest"),
                ("integrity.utf8", "content", (F.col("kind") != "text") | F.col("found_utf8"), "not UTF-8"),
            ],
        ),
    ]
    if approved_svg:
        svg = found.filter(F.col("path").rlike(r"\.svg$") & ~F.col("found_sha256").isin(*approved_svg))
        out.append(checks.rows_of(svg, "integrity.svg", F.col("path"), "content", "not an approved SVG"))
    payload = digests.streamed_digests(files, project.payload_domain).select(F.col("release").alias("__r"), F.col("digest").alias("payload"))
    json = unbound(manifest).join(named.select(F.col("releaseId").alias("release"), "__r"), "release").select(F.col("__r").alias("release"), canonical.canonical_json_text(F.col("json"))["value"].alias("content"))
    whole = digests.streamed_digests(files, project.release_domain, json).select(F.col("release").alias("__r"), F.col("digest").alias("whole"))
    bound = named.join(payload, "__r", "left").join(whole, "__r", "left")
    binding = F.col("reviewAttestation.contentBinding.digest")
    rules = [
        ("integrity.payload", "readerPayloadDigest", F.col("payload") == F.col("readerPayloadDigest"), "another payload digest"),
        ("integrity.binding", "reviewAttestation.contentBinding", binding.isNull() | (F.col("whole") == binding), "another release digest"),
    ]
    out.append(checks.violations(bound, F.col("releaseId"), rules))
    return checks.all_of(*out)


def check_relations(entries: DataFrame, body_links: DataFrame) -> DataFrame:
    """The reading sequence of a chapter: one link to the interlude's portal and one to its own return; no other link to a reader route anywhere.

    entries (id, slug, readingSequence), body_links (entry, url). A sequence must name an existing interlude.
    """
    s = F.col("readingSequence")
    owners = entries.filter(s.isNotNull()).select("id", s["interludeId"].alias("target"), s["portalAnchor"].alias("portal"), s["returnAnchor"].alias("back"))
    slugs = entries.select(F.col("id").alias("target"), F.col("slug").alias("target_slug"))
    resolved = owners.join(slugs, "target", "left")
    lost = resolved.filter(F.col("target_slug").isNull())
    wanted = resolved.filter(F.col("target_slug").isNotNull()).select(
        F.col("id").alias("entry"),
        F.explode(F.array(F.concat(F.lit("/book/read/"), "target_slug", F.lit("/#"), "portal"), F.concat(F.lit("/book/read/"), "id", F.lit("/#"), "back"))).alias("url"),
        F.lit(True).alias("wanted"),
    )
    found = body_links.filter(F.col("url").startswith("/book/read/")).groupBy("entry", "url").agg(F.count("*").alias("times"))
    both = wanted.distinct().join(found, ["entry", "url"], "full_outer")
    message = F.when(F.col("wanted").isNull(), "not declared").when(F.coalesce("times", F.lit(0)) != 1, "must stand exactly once")
    out = both.filter(message.isNotNull()).select(F.lit("relations.links").alias("check_id"), F.col("entry").alias("record_id"), F.col("url").alias("path"), message.alias("message"))
    return checks.all_of(out, checks.rows_of(lost, "relations.target", F.col("id"), "readingSequence", "no such interlude"))


def check_note_marks(entries: DataFrame, notes: DataFrame, body_links: DataFrame) -> DataFrame:
    """Anchor links in bodies: a #note- link without a note is dangling, one to a note that its entry doesn't list is undeclared."""
    marks = body_links.filter(F.col("url").startswith("#")).select("entry", "url", F.substr("url", F.lit(2)).alias("anchor")).distinct()
    known = marks.join(notes.select("anchor", F.col("id").alias("note")), "anchor", "left").join(entries.select(F.col("id").alias("entry"), "noteIds"), "entry", "left")
    message = F.when(F.col("note").isNull() & F.col("url").startswith("#note-"), "dangling").when(F.col("note").isNotNull() & ~F.coalesce(F.array_contains("noteIds", F.col("note")), F.lit(False)), "not declared")
    return known.filter(message.isNotNull()).select(F.lit("body.notes").alias("check_id"), F.col("entry").alias("record_id"), F.col("url").alias("path"), message.alias("message"))


#: Fields of the records that readers see as prose, and those that hold URLs.
PROSE = {
    "notes": ("statement", "limitation"),
    "sources": ("authors", "title", "publisher", "locators", "containerTitle", "volume", "issue", "pages", "doi"),
    "objects": ("title", "culture", "date", "material", "materialQualification", "materialAttribution", "collection", "provenanceBoundary", "credits"),
    "media": ("alt", "caption", "credit", "license"),
}
URLS = {"sources": ("url",), "media": ("licenseUrl", "sourceUrl")}


def prose_of(records: DataFrame, name: str) -> DataFrame:
    """(id, field, text) of a record table's prose; fields that belong to one kind of record count for that kind only."""
    kinds = dict(records.dtypes)
    fields = [(f, F.col(f) if kinds[f].startswith("array") else F.array(F.col(f))) for f in PROSE[name]]
    if name == "objects":
        i = F.col("inventory")
        published = i["status"] == "published"
        fields += [("inventory.number", F.array(F.when(published, i["number"]))), ("inventory.statement", F.array(F.when(~published, i["statement"])))]
    if name == "media":
        drawn = (F.col("kind") == "authored-diagram") & F.col("author").isNotNull() & F.col("changeNote").isNotNull()
        fields += [("author", F.array(F.when(drawn, F.col("author")))), ("changeNote", F.array(F.when(drawn, F.col("changeNote"))))]
        fields.append(("nondocumentaryDisclosure", F.array(F.when(F.col("kind") == "generative", F.col("nondocumentaryDisclosure")))))
    named = lambda field: lambda t: F.struct(F.lit(field).alias("field"), t.alias("text"))
    each = F.flatten(F.array(*[F.transform(values, named(field)) for field, values in fields]))
    return records.select("id", F.explode(each).alias("p")).select("id", "p.field", "p.text").filter("text is not null and text <> ''")


def check_prose(tables: dict[str, DataFrame], denied: canonical.Denied) -> DataFrame:
    """Leaks in the prose of records, and URLs that readers may not get."""
    found = []
    for name in PROSE:
        if name in tables:
            judged = prose_of(tables[name], name).withColumn("message", canonical.leak_of(F.col("text"), denied)).filter("message is not null")
            found.append(judged.select(F.lit(f"{name}.prose").alias("check_id"), F.col("id").alias("record_id"), F.col("field").alias("path"), "message"))
        for field in URLS.get(name, ()):
            if name in tables:
                judged = tables[name].filter(F.col(field).isNotNull()).select("id", canonical.checked_url(F.col(field), denied)["error"].alias("message")).filter("message is not null")
                found.append(judged.select(F.lit(f"{name}.url").alias("check_id"), F.col("id").alias("record_id"), F.lit(field).alias("path"), "message"))
    return checks.all_of(*found)


def check_collections(manifest: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The one manifest against the loaded records: sizes of the collections, and entries as in the reading order."""
    declared = manifest.select(F.explode(F.array(*[F.struct(F.lit(k).alias("collection"), F.col(f"counts.{k}").alias("n")) for k in paths.FOLDERS.values()])).alias("c")).select("c.*")
    observed = checks.all_of(*[t.agg(F.count("*").alias("n")).select(F.lit(k).alias("collection"), "n") for k, t in tables.items() if k in paths.FOLDERS.values()])
    sizes = snapshots.manifest_counts(declared, observed)
    order = manifest.select(F.explode("readingOrder").alias("id"))
    loaded = checks.rows_of(links.bijection(order, "id", tables["entries"], "id"), "collections.order", F.col("key"), "readingOrder", "entries and reading order differ")
    return checks.all_of(checks.rows_of(sizes, "collections.size", F.col("collection"), "counts", "another number of records"), loaded)


def check_loaded(manifests: DataFrame, payload: DataFrame) -> DataFrame:
    """Exactly one manifest, or none and no payload file (path) either."""
    n, files = manifests.agg(F.count("*").alias("n")), payload.agg(F.count("*").alias("files"))
    message = F.when((F.col("n") == 0) & (F.col("files") > 0), "payload without a manifest").when(F.col("n") > 1, "more than one manifest")
    both = n.crossJoin(files).select(message.alias("message")).filter("message is not null")
    return both.select(F.lit("loaded.manifest").alias("check_id"), F.lit("manifest").alias("record_id"), F.lit("manifest").alias("path"), "message")


#: Schemas of the folders of records; entries have bodies and are read by collections.entries().
SCHEMAS = {"notes": NOTE, "sources": SOURCE, "objects": OBJECT, "media": MEDIA}


def load_records(spark: SparkSession, root: str, names: tuple[str, ...] = tuple(SCHEMAS)) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, violations): the records in the folders of a release tree, and the files that hold none.

    A file must be strict JSON in UTF-8 and bear its record's id as its name; one that is not JSON is in no table, one with
    another name is in its table all the same.
    """
    tables, found = {}, []
    for name in names:
        files = collections.raw_files(spark, f"{root}/{paths.CONTENT_ROOT}/{name}", "*.json")
        read = files.select("path", F.col("id").alias("stem"), F.col("text").alias("raw"), F.from_json("text", SCHEMAS[name], {"allowSingleQuotes": "false"}).alias("record"))
        broken = F.when(F.col("raw").isNull(), "not UTF-8").otherwise(checks.json_problem(F.col("raw")))
        read = stored(read.withColumn("broken", broken), f"records-{name}")  # so that each file is read once
        tables[name] = read.filter("broken is null").select("record.*")
        wrong = read.filter("broken is not null").select(F.lit("record.json").alias("check_id"), F.col("stem").alias("record_id"), F.lit(name).alias("path"), F.col("broken").alias("message"))
        named = read.filter("broken is null and not (stem <=> record.id)").select(F.lit("file.id").alias("check_id"), F.coalesce("record.id", "stem").alias("record_id"), F.lit("id").alias("path"), F.lit("not the name of its file").alias("message"))
        found += [wrong, named]
    return tables, checks.all_of(*found)


def check_file_ids(records: DataFrame, path: str = "path", record_id: str = "id") -> DataFrame:
    """A record's id is the stem of its file's name, and the file is one of the payload."""
    kind = paths.payload_kind(F.col(path))
    rules = [
        ("file.id", record_id, paths.stem(F.col(path)) == F.col(record_id), "not the name of its file"),
        ("file.place", path, kind.isNotNull() & (kind != "image"), "not a payload path"),
    ]
    return checks.violations(records, F.col(record_id), rules)


def check_minutes(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """Declared reading minutes against the words of the visible text (id, text)."""
    minutes = T.reading_minutes(T.word_count(F.col("text")))
    joined = entries.join(texts.select(F.col("id").alias("t"), "text"), F.col("id") == F.col("t"), "left")
    return checks.violations(joined, F.col("id"), [("entry.minutes.words", "readingMinutes", F.col("readingMinutes") == minutes, "doesn't follow from the words")])


def load_state(manifests: int, payload_files: int) -> str | None:
    """What a release tree may look like: no release at all, or one manifest."""
    if manifests == 0:
        return "payload without a manifest" if payload_files else None
    return None if manifests == 1 else "more than one manifest"
