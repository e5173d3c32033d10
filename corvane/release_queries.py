"""Registered queries of the release checks, over records that are derived from the driver's tables.

What the records say is written once, in expressions that Spark and DuckDB both
read (RECORDS); the checks are Spark operators, and the SQL states independently
which rows break which rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import batches, canonical, digests, paths
from corvane.operators import checks, links, reports, snapshots
from corvane.plans import layers, release
from corvane.queries import load
from corvane.sources import collections, scratch, sinks
from corvane.vectors import DENIED

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ROOT = paths.CONTENT_ROOT
#: table, then column expressions that both engines read.
RECORDS: dict[str, tuple[str, dict[str, str]]] = {
    "entries": (
        "documents",
        {
            "n": "doc_id",
            "id": "CASE WHEN doc_id % 41 = 0 THEN 'entry-' || doc_id ELSE 'interlude-' || doc_id END",
            "slug": "CASE WHEN doc_id % 7 = 0 THEN 'media-' || doc_id WHEN doc_id % 7 = 1 THEN 'a--' || doc_id ELSE 'd-' || doc_id END",
            "kind": "CASE WHEN doc_id % 11 = 0 THEN 'chapter' ELSE 'interlude' END",
            "title": "CASE WHEN doc_id % 13 = 0 THEN ' x ' ELSE 'Title ' || doc_id END",
            "subtitle": "CASE WHEN doc_id % 17 = 0 THEN 'too short' ELSE 'A long subtitle ' || lang END",
            "order": "CAST(doc_id % 100 - CASE WHEN doc_id % 19 = 0 THEN 200 ELSE 0 END AS INT)",
            "part": "CAST(doc_id % 7 AS INT)",
            "readingMinutes": "CAST(doc_id % 23 AS INT)",
            "second": "doc_id + CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END",
            "target": "CASE WHEN doc_id % 29 = 0 THEN 'interlude-' || doc_id WHEN doc_id % 22 = 0 THEN 'interlude-0' END",
        },
    ),
    "notes": (
        "documents",
        {
            "n": "doc_id",
            "id": "CASE WHEN doc_id % 31 = 0 THEN 'Note-' || doc_id ELSE 'note-' || doc_id END",
            "anchor": "CASE WHEN doc_id % 9 = 0 THEN 'note ' || doc_id ELSE 'note-' || doc_id END",
            "statement": "CASE WHEN doc_id % 8 = 0 THEN 'short   ' ELSE 'A statement of enough letters by ' || source END",
            "confidence": "CASE doc_id % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'contested' END",
            "limitation": "CASE WHEN doc_id % 10 = 0 THEN lang ELSE 'A limitation of enough letters' END",
            "a": "doc_id % 30",
            "b": "doc_id % 45",
        },
    ),
    "sources": (
        "part",
        {
            "n": "p_partkey",
            "id": "'source-' || p_partkey",
            "title": "CASE WHEN p_partkey % 12 = 0 THEN ' ' ELSE p_name END",
            "year": "CAST(CASE WHEN p_partkey % 6 = 0 THEN 2200 WHEN p_partkey % 6 = 1 THEN 1990 END AS INT)",
            "type": "CASE p_partkey % 5 WHEN 0 THEN 'journal-article' WHEN 1 THEN 'book' WHEN 2 THEN 'book-chapter' WHEN 3 THEN 'dataset' ELSE 'poster' END",
            "containerTitle": "CASE WHEN p_partkey % 2 = 0 THEN 'Container' END",
            "volume": "CASE WHEN p_partkey % 3 = 0 THEN '7' END",
            "pages": "CASE WHEN p_partkey % 4 <> 0 THEN '1-9' END",
            "doi": "CASE p_partkey % 7 WHEN 0 THEN '10.1234/x' WHEN 1 THEN 'doi:1' END",
            "url": "CASE p_partkey % 3 WHEN 0 THEN 'https://example.org/' || p_partkey WHEN 1 THEN 'http://example.org/' || p_partkey END",
        },
    ),
    "objects": (
        "part",
        {
            "n": "p_partkey",
            "id": "CASE WHEN p_partkey % 10 = 0 THEN 'thing-' || p_partkey ELSE 'object-' || p_partkey END",
            "material": "CASE WHEN p_partkey % 9 = 0 THEN '  ' ELSE p_type END",
            "status": "CASE p_partkey % 3 WHEN 0 THEN 'published' WHEN 1 THEN 'not-published' ELSE 'lost' END",
            "number": "CASE WHEN p_partkey % 2 = 0 THEN 'No ' || p_partkey END",
            "statement": "CASE WHEN p_partkey % 5 = 0 THEN 'short' ELSE 'Stated at enough length here' END",
        },
    ),
    "media": (
        "part",
        {
            "n": "p_partkey",
            "id": "'media-' || p_partkey",
            "outputName": "CASE p_partkey % 6 WHEN 0 THEN 'a..b.svg' WHEN 1 THEN 'A.webp' ELSE 'm' || p_partkey || '.webp' END",
            "alt": "CASE WHEN p_partkey % 8 = 0 THEN '' ELSE p_name END",
            "licenseUrl": "CASE p_partkey % 3 WHEN 0 THEN 'https://creativecommons.org/licenses/by/4.0/' WHEN 1 THEN 'https://u@e.org/' ELSE 'https://e.org/' || p_partkey END",
            "kind": "CASE p_partkey % 4 WHEN 0 THEN 'authored-diagram' WHEN 1 THEN 'generative' WHEN 2 THEN 'documentary' ELSE 'film' END",
            "disclosure": "CASE WHEN p_partkey % 5 <> 0 THEN 'НЕДОКУМЕНТАЛЬНАЯ картина' END",
        },
    ),
    "files": (
        "documents",
        {
            "n": "doc_id",
            "path": f"CASE doc_id % 6 WHEN 0 THEN '{ROOT}/entries/interlude-' || doc_id || '.md' WHEN 1 THEN '{ROOT}/notes/note-' || doc_id || '.json' WHEN 2 THEN '{paths.IMAGE_ROOT}/i' || doc_id || '.webp' WHEN 3 THEN '{ROOT}/notes/../notes/note-1.json' WHEN 4 THEN 'other/' || doc_id ELSE '{ROOT}/sources/source-' || doc_id || '.json' END",
            "kind": "CASE WHEN doc_id % 6 = 2 OR doc_id % 12 = 1 THEN 'binary' ELSE 'text' END",
            "byteLength": "CAST(CASE WHEN doc_id % 14 = 0 THEN 70000000 ELSE n_chars END AS BIGINT)",
            "sha256": "CASE WHEN doc_id % 15 = 0 THEN 'ABC' ELSE sha256_of END",
        },
    ),
}


def record_sql(name: str) -> str:
    """The records as a DuckDB table."""
    table, columns = RECORDS[name]
    given = ", ".join(f'{e.replace("sha256_of", "sha256(text)")} AS "{c}"' for c, e in columns.items())
    return f"(SELECT {given} FROM {table})"


def records(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = RECORDS[name]
    return load(spark, sf_dir, table).selectExpr(*[f"{e.replace('sha256_of', 'sha2(text, 256)')} AS `{c}`" for c, e in columns.items()])


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = records(spark, sf_dir, "entries")
    note = lambda c: F.concat(F.lit("note-"), F.col(c).cast("string"))
    sequence = F.when(F.col("target").isNotNull(), F.struct(F.col("target").alias("interludeId"), F.lit("portal").alias("portalAnchor"), F.lit("back").alias("returnAnchor")))
    return e.withColumns({"noteIds": F.array(note("n"), note("second")), "objectIds": F.array(F.lit("object-1")), "mediaIds": F.array(F.lit("media-1"), F.lit("media-2")), "readingSequence": sequence})


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = lambda c: F.concat(F.lit("source-"), F.col(c).cast("string"))
    return records(spark, sf_dir, "notes").withColumn("sourceIds", F.array(source("a"), source("b")))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.array(F.lit("An author"))
    return records(spark, sf_dir, "sources").withColumns({"authors": F.slice(one, 1, F.when(F.col("n") % 8 == 0, 0).otherwise(1)), "publisher": F.lit("Press"), "issue": F.lit(None).cast("string"), "locators": F.array(F.lit("p. 1"))})


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = records(spark, sf_dir, "objects")
    text = {c: F.lit(c) for c in ("title", "culture", "date", "collection", "provenanceBoundary", "materialQualification", "materialAttribution")}
    inventory = F.struct("status", "number", "statement")
    return o.withColumns({**text, "inventory": inventory, "credits": F.array(F.lit("Credit")), "sourceIds": F.array(F.lit("source-1")), "mediaIds": F.array(F.lit("media-1"), F.concat(F.lit("media-"), (F.col("n") % 4).cast("string")))})


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = records(spark, sf_dir, "media")
    text = {c: F.lit(c) for c in ("caption", "credit", "license")}
    none = F.lit(None).cast("string")
    return m.withColumns({**text, "nondocumentaryDisclosure": F.col("disclosure"), "sourceUrl": none, "author": F.lit("A. Author"), "changeNote": F.when(F.col("n") % 2 == 0, "drafts/changed")})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "files")


#: Rules as SQL conditions that must hold, by record table: (check, path, condition, message).
RULES_SQL: dict[str, list[tuple[str, str, str, str]]] = {
    "entries": [
        ("entry.id", "id", "n % 41 <> 0", "not an entry id"),
        ("entry.slug", "slug", "n % 7 > 1", "not a neutral slug"),
        ("entry.kind", "kind", "n % 11 <> 0", "kind must follow from the id"),
        ("entry.title", "title", "length(trim(title)) >= 3", "too short"),
        ("entry.subtitle", "subtitle", "length(trim(subtitle)) >= 10", "too short"),
        ("entry.order", "order", '"order" >= 0', "negative"),
        ("entry.part", "part", "part BETWEEN 0 AND 5", "not 0 to 5"),
        ("entry.minutes", "readingMinutes", '"readingMinutes" > 0', "not positive"),
        ("entry.notes", "noteIds", "second <> n", "unique note ids, one at least"),
        ("entry.sequence", "readingSequence", "target IS NULL OR (kind = 'chapter' AND target <> id)", "only a chapter has one, and not to itself"),
    ],
    "notes": [
        ("note.id", "id", "n % 31 <> 0", "not a note id"),
        ("note.anchor", "anchor", "n % 9 <> 0", "not an anchor"),
        ("note.statement", "statement", "n % 8 <> 0", "too short"),
        ("note.confidence", "confidence", "confidence <> 'low'", "unknown"),
        ("note.limitation", "limitation", "n % 10 <> 0", "too short"),
        ("note.sources", "sourceIds", "a <> b", "unique, one at least"),
    ],
    "sources": [
        ("source.title", "title", "n % 12 <> 0", "title and publisher"),
        ("source.authors", "authors", "n % 8 <> 0", "one at least"),
        ("source.year", "year", "year IS NULL OR year <= 2100", "not 1 to 2100"),
        ("source.type", "type", "n % 5 <> 4", "unknown"),
        ("source.place", "doi", "doi IS NOT NULL OR url IS NOT NULL", "doi or url"),
        ("source.doi", "doi", "doi IS NULL OR doi LIKE '10.%'", "not a doi"),
        ("source.url", "url", "url IS NULL OR url LIKE 'https:%'", "not a safe https url"),
        ("source.article", "containerTitle", "type <> 'journal-article' OR (\"containerTitle\" IS NOT NULL AND volume IS NOT NULL AND pages IS NOT NULL)", "container, volume and pages"),
        ("source.chapter", "containerTitle", "type <> 'book-chapter' OR (\"containerTitle\" IS NOT NULL AND pages IS NOT NULL)", "container and pages"),
    ],
    "objects": [
        ("object.id", "id", "n % 10 <> 0", "not an object id"),
        ("object.text", "title", "n % 9 <> 0", "empty field"),
        ("object.inventory", "inventory", "(status = 'published' AND number IS NOT NULL) OR (status = 'not-published' AND length(statement) >= 20)", "a number if published, else a statement"),
        ("object.media", "mediaIds", "n % 4 <> 1", "not unique"),
    ],
    "media": [
        ("media.name", "outputName", "n % 6 > 1", "not an svg or webp name"),
        ("media.text", "alt", "alt <> ''", "empty field"),
        ("media.license", "licenseUrl", "n % 3 <> 1", "not a safe https url"),
        ("media.kind", "kind", "kind <> 'film'", "unknown"),
        ("media.diagram", "licenseUrl", "kind <> 'authored-diagram' OR n % 3 = 0", "a diagram has the open license"),
        ("media.generative", "nondocumentaryDisclosure", "kind <> 'generative' OR disclosure IS NOT NULL", "a disclosure"),
    ],
    "files": [
        ("file.path", "path", "n % 6 NOT IN (3, 4)", "not a payload path in normal form"),
        ("file.kind", "kind", "kind = CASE WHEN n % 6 = 2 THEN 'binary' ELSE 'text' END", "kind must follow from the path"),
        ("file.size", "byteLength", '"byteLength" BETWEEN 0 AND 67108864', "beyond the limit"),
        ("file.sha256", "sha256", "length(sha256) = 64", "not a digest"),
    ],
}
BUILT = {"entries": entries, "notes": notes, "sources": sources, "objects": objects, "media": media, "files": files}


def _rules(name: str) -> Callable[[SparkSession, str], DataFrame]:
    rules = {**release.RULES, "files": release.file_rules}[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return checks.violations(BUILT[name](spark, sf_dir), F.col("path" if name == "files" else "id"), rules())

    return run


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


for _name in BUILT:
    QUERIES[f"release_{_name}"] = _rules(_name)
    _id = "path" if _name == "files" else "id"
    SQL[f"release_{_name}"] = _union([f"SELECT '{c}' AS check_id, {_id} AS record_id, '{p}' AS path, '{m}' AS message FROM {record_sql(_name)} WHERE NOT coalesce({holds}, false)" for c, p, holds, m in RULES_SQL[_name]])


def query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


# --- manifests: one for each language and thousand documents, so that their size is bounded

_BUCKET = "lang || '-' || CAST(floor(doc_id / 1000) AS INT)"
_KIND = f"CASE doc_id % 3 WHEN 0 THEN '{ROOT}/entries/interlude-' || doc_id || '.md' WHEN 1 THEN '{ROOT}/notes/note-' || doc_id || '.json' ELSE '{ROOT}/sources/source-' || doc_id || '.json' END"


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").selectExpr("doc_id", "text", "lang", f"{_BUCKET} AS release", f"{_KIND} AS path")
    file = F.struct(F.encode("path", "UTF-16BE").alias("key"), F.struct("path", F.lit("text").alias("kind"), F.octet_length("text").cast("long").alias("byteLength"), digests.sha256(F.col("text")).alias("sha256")).alias("f"))
    m = docs.groupBy("release", "lang").agg(F.sort_array(F.collect_list(file)).alias("sorted"), F.sort_array(F.collect_list(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("interlude-"), F.col("doc_id").cast("string"))))).alias("readingOrder"))
    listed = F.transform("sorted", lambda x: x["f"])
    m = m.withColumns({"files": F.when(F.col("lang") == "fr", F.reverse(listed)).otherwise(listed), "targetCommit": F.sha1("release"), "reviewEvidenceCommit": F.sha1(F.concat("release", F.lit("x")))})
    count = lambda folder: F.size(F.filter("files", lambda f: f["path"].contains(f"/{folder}/")))
    zero = F.lit(0)
    m = m.withColumn("counts", F.struct((count("entries") + F.when(F.col("lang") == "de", 1).otherwise(0)).alias("entries"), count("notes").alias("notes"), count("sources").alias("sources"), zero.alias("objects"), zero.alias("media")))
    odd = F.substring_index("release", "-", -1).cast("int") % 2 == 1
    own = F.when((F.col("lang") == "en") & odd, F.col("reviewEvidenceCommit")).otherwise(F.col("targetCommit"))
    payload = F.sha2(F.col("release").cast("binary"), 256)
    m = m.withColumns({"version": F.when(F.col("lang") == "es", 3).otherwise(4), "projection": F.lit("reader-v1"), "transformer": F.lit("reader-markdown-v1"), "cycleId": F.lit("cycle-01"), "releaseId": F.concat(F.lit("release-reader-v1-"), own), "readerPayloadDigest": payload})
    reviewed = F.struct(F.lit("reader-v1").alias("projection"), F.lit("reader-markdown-v1").alias("transformer"), payload.alias("digest"))
    cycle = F.when(F.col("lang") == "es", "cycle-02").otherwise("cycle-01")
    none = F.lit(None).cast("struct<algorithm:string,format:string,digest:string>")
    attestation = F.struct(F.lit(3).alias("schemaVersion"), cycle.alias("cycleId"), "targetCommit", "reviewEvidenceCommit", reviewed.alias("reviewedPayload"), none.alias("contentBinding"))
    return m.withColumn("reviewAttestation", attestation).select("version", "projection", "transformer", "cycleId", "targetCommit", "reviewEvidenceCommit", "releaseId", "readerPayloadDigest", "readingOrder", "counts", "files", "reviewAttestation")


_M = f"(SELECT lang, {_BUCKET} AS release, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS e, any_value(CAST(floor(doc_id / 1000) AS INT) % 2 = 1) AS odd FROM documents GROUP BY ALL)"
_RELEASE = "'release-reader-v1-' || CASE WHEN lang = 'en' AND odd THEN sha1(release || 'x') ELSE sha1(release) END"


@query(
    _union(
        [
            f"SELECT '{c}' AS check_id, {_RELEASE} AS record_id, '{p}' AS path, '{m}' AS message FROM {_M} WHERE {broken}"
            for c, p, broken, m in [
                ("manifest.version", "version", "lang = 'es'", "version"),
                ("manifest.release", "releaseId", "lang = 'en' AND odd", "must contain the target commit"),
                ("manifest.sorted", "files", "lang = 'fr' AND n > 1", "not in UTF-16 order"),
                ("manifest.order", "readingOrder", "lang = 'de' OR e = 0", "must list every entry once"),
                ("manifest.count.entries", "counts.entries", "lang = 'de'", "must match the files"),
                ("attestation.identity", "reviewAttestation.cycleId", "lang = 'es'", "must equal the manifest''s"),
            ]
        ]
    )
)
def release_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.check_manifest(manifests(spark, sf_dir))


def _framed(path: str, content: str) -> str:
    return f"lpad(hex(strlen({path})), 16, '0') || hex({path}) || lpad(hex(strlen({content})), 16, '0') || hex({content})"


_JSON = """'{' || chr(10) || '  "name": "' || release || '"' || chr(10) || '}' || chr(10)"""


@query(
    f"""WITH g AS (SELECT {_BUCKET} AS release, string_agg({_framed('path', 'text')}, '' ORDER BY path COLLATE C) AS body FROM (SELECT *, {_KIND} AS path FROM documents) GROUP BY 1)
    SELECT release, sha256(unhex(hex('payload-v1' || chr(10)) || body)) AS payload,
           sha256(unhex(hex('release-v1' || chr(10)) || lpad(hex(strlen({_JSON})), 16, '0') || hex({_JSON}) || body)) AS whole FROM g"""
)
def release_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all files of a release, and of its canonical JSON with them."""
    found = load(spark, sf_dir, "documents").selectExpr(f"{_BUCKET} AS release", f"{_KIND} AS path", "text AS content")
    json = found.select("release").distinct().select("release", canonical.canonical_json_text(F.to_json(F.struct(F.col("release").alias("name"))))["value"].alias("content"))
    payload = digests.streamed_digests(found, "payload-v1\n").withColumnRenamed("digest", "payload")
    return payload.join(digests.streamed_digests(found, "release-v1\n", json).withColumnRenamed("digest", "whole"), "release")


@query(
    f"""WITH d AS (SELECT *, {_BUCKET} AS release, {_KIND} AS path FROM documents)
    SELECT 'integrity.paths' AS check_id, path AS record_id, 'path' AS path, 'declared and present files differ' AS message FROM d WHERE doc_id % 103 = 0
    UNION ALL SELECT 'integrity.length', path, 'byteLength', 'another length' FROM d WHERE doc_id % 101 = 0 AND doc_id % 103 <> 0
    UNION ALL SELECT 'integrity.sha256', path, 'sha256', 'another digest' FROM d WHERE doc_id % 101 = 0 AND doc_id % 103 <> 0
    UNION ALL SELECT 'integrity.payload', {_RELEASE}, 'readerPayloadDigest', 'another payload digest' FROM {_M}"""
)
def release_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some files are missing and some changed; no manifest has its payload's digest."""
    m = manifests(spark, sf_dir)
    named = m.select(F.col("releaseId"), F.explode("files.path").alias("path"))
    found = load(spark, sf_dir, "documents").filter("doc_id % 103 <> 0").selectExpr(f"{_KIND} AS path", "CASE WHEN doc_id % 101 = 0 THEN text || '!' ELSE text END AS content")
    return release.check_integrity(m, found.join(named, "path").select(F.col("releaseId").alias("release"), "path", "content"))


# --- the graph of records

_GRAPH = {
    "e": "(SELECT doc_id, 'interlude-' || doc_id AS id FROM documents)",
    "n": "(SELECT doc_id, 'note-' || doc_id AS id, 'a-' || (doc_id - doc_id % 50) AS anchor FROM labels)",
}


@query(
    """WITH e AS (SELECT doc_id AS d, 'interlude-' || doc_id AS id FROM documents), n AS (SELECT DISTINCT doc_id AS d FROM labels),
    s AS (SELECT p_partkey AS d FROM part WHERE p_partkey <= 50), o AS (SELECT n_nationkey AS d FROM nation), m AS (SELECT p_partkey AS d FROM part WHERE p_partkey <= 45),
    note_ref AS (SELECT id, d AS r FROM e UNION ALL SELECT id, d + 1 FROM e), object_ref AS (SELECT id, d % 40 AS r FROM e), e_media AS (SELECT id, d % 44 AS r FROM e),
    n_source AS (SELECT 'note-' || d AS id, d % 60 AS r FROM n), o_source AS (SELECT 'object-' || d AS id, d + 40 AS r FROM o), o_media AS (SELECT 'object-' || d AS id, d + 25 AS r FROM o)
    SELECT 'graph.entries.noteIds' AS check_id, id AS record_id, 'noteIds' AS path, 'no such record' AS message FROM note_ref WHERE r NOT IN (SELECT d FROM n)
    UNION ALL SELECT 'graph.entries.objectIds', id, 'objectIds', 'no such record' FROM object_ref WHERE r NOT IN (SELECT d FROM o)
    UNION ALL SELECT 'graph.entries.mediaIds', id, 'mediaIds', 'no such record' FROM e_media WHERE r NOT IN (SELECT d FROM m)
    UNION ALL SELECT 'graph.notes.sourceIds', id, 'sourceIds', 'no such record' FROM n_source WHERE r NOT IN (SELECT d FROM s)
    UNION ALL SELECT 'graph.objects.sourceIds', id, 'sourceIds', 'no such record' FROM o_source WHERE r NOT IN (SELECT d FROM s)
    UNION ALL SELECT 'graph.objects.mediaIds', id, 'mediaIds', 'no such record' FROM o_media WHERE r NOT IN (SELECT d FROM m)
    UNION ALL SELECT 'graph.notes.orphan', 'note-' || d, 'id', 'nothing refers to it' FROM n WHERE d NOT IN (SELECT r FROM note_ref)
    UNION ALL SELECT 'graph.objects.orphan', 'object-' || d, 'id', 'nothing refers to it' FROM o WHERE d NOT IN (SELECT r FROM object_ref)
    UNION ALL SELECT 'graph.media.orphan', 'media-' || d, 'id', 'nothing refers to it' FROM m WHERE d NOT IN (SELECT r FROM e_media UNION SELECT r FROM o_media)
    UNION ALL SELECT 'graph.sources.orphan', 'source-' || d, 'id', 'nothing refers to it' FROM s WHERE d NOT IN (SELECT r FROM n_source UNION SELECT r FROM o_source)
    UNION ALL SELECT 'graph.anchor', 'a-' || (d - d % 50), 'anchor', 'repeated anchor' FROM n GROUP BY d - d % 50 HAVING count(*) > 1
    UNION ALL SELECT 'graph.media.name', 'm' || d % 44 || '.svg', 'outputName', 'repeated name' FROM m GROUP BY d % 44 HAVING count(*) > 1
    UNION ALL SELECT 'graph.images', 'm' || k || '.svg', 'outputName', 'declared and present images differ' FROM (
      SELECT coalesce(a.k, b.k) AS k FROM (SELECT DISTINCT d % 44 AS k FROM m) a FULL JOIN (SELECT p_partkey AS k FROM part WHERE p_partkey <= 60) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL)"""
)
def release_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda kind, *es: "array(" + ", ".join(f"'{kind}-' || ({e})" for e in es) + ")"
    no = "CAST(NULL AS STRUCT<interludeId: STRING, portalAnchor: STRING, returnAnchor: STRING>) AS readingSequence"
    part = load(spark, sf_dir, "part")
    tables = {
        "entries": load(spark, sf_dir, "documents").selectExpr("'interlude-' || doc_id AS id", f"{ids('note', 'doc_id', 'doc_id + 1')} AS noteIds", f"{ids('object', 'doc_id % 40')} AS objectIds", f"{ids('media', 'doc_id % 44')} AS mediaIds", no),
        "notes": load(spark, sf_dir, "labels").select("doc_id").distinct().selectExpr("'note-' || doc_id AS id", "'a-' || (doc_id - doc_id % 50) AS anchor", f"{ids('source', 'doc_id % 60')} AS sourceIds"),
        "sources": part.filter("p_partkey <= 50").selectExpr("'source-' || p_partkey AS id"),
        "objects": load(spark, sf_dir, "nation").selectExpr("'object-' || n_nationkey AS id", f"{ids('source', 'n_nationkey + 40')} AS sourceIds", f"{ids('media', 'n_nationkey + 25')} AS mediaIds"),
        "media": part.filter("p_partkey <= 45").selectExpr("'media-' || p_partkey AS id", "'m' || p_partkey % 44 || '.svg' AS outputName"),
    }
    return release.check_graph(tables, part.filter("p_partkey <= 60").selectExpr("'m' || p_partkey || '.svg' AS name"))


def _body_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").selectExpr("doc_id", "'interlude-' || doc_id AS entry")
    some = lambda when, url: docs.filter(when).selectExpr("entry", f"{url} AS url")
    return checks.all_of(some("true", "'#note-' || doc_id"), some("true", "'/book/objects/o' || doc_id % 50 || '/'"), some("doc_id % 7 = 0", "'/book/objects/o' || doc_id % 50 || '/'"), some("doc_id % 11 = 0", "'/book/media/x/'"), some("doc_id % 17 = 0", "'#part'"))


@query(
    """SELECT 'body.links' AS check_id, 'interlude-' || doc_id AS record_id, '/book/objects/o' || doc_id % 50 || '/' AS path, 'must stand exactly once' AS message FROM documents WHERE doc_id % 7 = 0
    UNION ALL SELECT 'body.links', 'interlude-' || doc_id, '/book/media/x/', 'not declared' FROM documents WHERE doc_id % 11 = 0
    UNION ALL SELECT 'body.links', 'interlude-' || doc_id, '/book/media/m/', 'must stand exactly once' FROM documents WHERE doc_id % 13 = 0
    UNION ALL SELECT 'body.notes', 'interlude-' || doc_id, '#note-' || doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'not declared' ELSE 'dangling' END FROM documents
      WHERE doc_id % 5 = 0 OR doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def release_body_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id").distinct()
    e = docs.selectExpr("'interlude-' || doc_id AS id", "CASE WHEN doc_id % 5 = 0 THEN array('other') ELSE array('note-' || doc_id) END AS noteIds")
    route = lambda when, r: docs.filter(when).selectExpr("'interlude-' || doc_id AS entry", f"{r} AS route")
    declared = checks.all_of(route("true", "'#note-' || doc_id"), route("true", "'/book/objects/o' || doc_id % 50 || '/'"), route("doc_id % 13 = 0", "'/book/media/m/'"))
    n = load(spark, sf_dir, "labels").select("doc_id").distinct().selectExpr("'note-' || doc_id AS id", "'note-' || doc_id AS anchor")
    found = _body_links(spark, sf_dir)
    return checks.all_of(release.check_body_links(e, declared, found), release.check_note_marks(e, n, found))


@query(
    """WITH c AS (SELECT doc_id AS d, doc_id + 1 IN (SELECT doc_id FROM documents) AS there FROM documents WHERE doc_id % 10 = 0)
    SELECT 'relations.target' AS check_id, 'interlude-' || d AS record_id, 'readingSequence' AS path, 'no such interlude' AS message FROM c WHERE NOT there
    UNION ALL SELECT 'relations.links', 'interlude-' || d, '/book/read/s' || (d + 1) || '/#p' || d, CASE WHEN there THEN 'must stand exactly once' ELSE 'not declared' END FROM c WHERE d % 20 = 0 OR NOT there
    UNION ALL SELECT 'relations.links', 'interlude-' || d, '/book/read/interlude-' || d || '/#r' || d, CASE WHEN there THEN 'must stand exactly once' ELSE 'not declared' END FROM c WHERE (d % 30 = 0 AND there) OR (d % 30 <> 0 AND NOT there)
    UNION ALL SELECT 'relations.links', 'interlude-' || doc_id, '/book/read/other/', 'not declared' FROM documents WHERE doc_id % 17 = 0"""
)
def release_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id").distinct()
    sequence = "CASE WHEN doc_id % 10 = 0 THEN named_struct('interludeId', 'interlude-' || (doc_id + 1), 'portalAnchor', 'p' || doc_id, 'returnAnchor', 'r' || doc_id) END AS readingSequence"
    e = docs.selectExpr("'interlude-' || doc_id AS id", "'s' || doc_id AS slug", sequence)
    some = lambda when, url: docs.filter(when).selectExpr("'interlude-' || doc_id AS entry", f"{url} AS url")
    portal, back = "'/book/read/s' || (doc_id + 1) || '/#p' || doc_id", "'/book/read/interlude-' || doc_id || '/#r' || doc_id"
    found = checks.all_of(some("doc_id % 10 = 0", portal), some("doc_id % 20 = 0", portal), some("doc_id % 10 = 0 and doc_id % 30 <> 0", back), some("doc_id % 17 = 0", "'/book/read/other/'"), some("true", "'#a'"))
    return release.check_relations(e, found)


@query(
    """SELECT 'routes' AS check_id, 'interlude-' || doc_id AS record_id, 'route' AS path,
      CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'not in the contract' ELSE 'slug, kind or order differ' END AS message
    FROM documents WHERE (doc_id % 9 = 0 AND doc_id % 10 <> 1) OR (doc_id % 9 <> 0 AND (doc_id % 10 = 1 OR doc_id % 8 = 0))"""
)
def release_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id").distinct()
    contract = docs.filter("doc_id % 10 <> 1").selectExpr("CAST(doc_id AS INT) AS position", "'interlude-' || doc_id AS id", "'s' || doc_id AS slug", "'interlude' AS kind")
    e = docs.filter("doc_id % 9 <> 0").selectExpr("'interlude-' || doc_id AS id", "CASE WHEN doc_id % 8 = 0 THEN 'x' ELSE 's' || doc_id END AS slug", "'interlude' AS kind", "CAST(doc_id AS INT) AS `order`")
    return release.check_routes(e, contract)


@query(
    """WITH sizes AS (SELECT 'entries' AS collection, 25 AS declared, (SELECT count(*) FROM nation) AS observed UNION ALL SELECT 'notes', 0, (SELECT count(*) FROM labels)
      UNION ALL SELECT 'sources', 200, (SELECT count(*) FROM part) UNION ALL SELECT 'objects', 5, (SELECT count(*) FROM region) UNION ALL SELECT 'media', 11, (SELECT count(*) FROM supplier))
    SELECT 'collections.size' AS check_id, collection AS record_id, 'counts' AS path, 'another number of records' AS message FROM sizes WHERE declared <> observed
    UNION ALL SELECT 'collections.order', 'interlude-25', 'readingOrder', 'entries and reading order differ'"""
)
def release_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.transform(F.sequence(F.lit(0), F.lit(25)), lambda k: F.concat(F.lit("interlude-"), k.cast("string")))
    counts = F.struct(*[F.lit(n).alias(k) for k, n in {"entries": 25, "notes": 0, "sources": 200, "objects": 5, "media": 11}.items()])
    manifest = spark.range(1).select(order.alias("readingOrder"), counts.alias("counts"))
    tables = {"entries": load(spark, sf_dir, "nation").selectExpr("'interlude-' || n_nationkey AS id")}
    tables |= {k: load(spark, sf_dir, t) for k, t in {"notes": "labels", "sources": "part", "objects": "region", "media": "supplier"}.items()}
    return release.check_collections(manifest, tables)


@query("SELECT * FROM (VALUES ('none', 'payload without a manifest'), ('two', 'more than one manifest')) t(state, message)")
def release_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of states with no, one and two manifests, with and without payload: which are wrong."""
    payload = load(spark, sf_dir, "documents").select("doc_id")
    states = {"none": (0, payload), "empty": (0, payload.limit(0)), "one": (1, payload), "two": (2, payload.limit(0))}
    return checks.all_of(*[release.check_loaded(spark.range(n), found).select(F.lit(k).alias("state"), "message") for k, (n, found) in states.items()])


@query(
    f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'interlude-x' || doc_id ELSE 'interlude-' || doc_id END AS id FROM documents)
    SELECT 'file.id' AS check_id, id AS record_id, 'id' AS path, 'not the name of its file' AS message FROM d WHERE doc_id % 6 = 0
    UNION ALL SELECT 'file.place', id, 'path', 'not a payload path' FROM d WHERE doc_id % 7 = 0"""
)
def release_file_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return release.check_file_ids(docs.selectExpr("CASE WHEN doc_id % 6 = 0 THEN 'interlude-x' || doc_id ELSE 'interlude-' || doc_id END AS id", f"CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE '{ROOT}/entries' END || '/interlude-' || doc_id || '.md' AS path"))


@query(
    f"""SELECT 'notes.prose' AS check_id, id AS record_id, 'statement' AS path, 'repository coordinate' AS message FROM {record_sql("notes")} WHERE n % 9 = 0
    UNION ALL SELECT 'objects.prose', id, 'inventory.statement', 'internal identifier' FROM {record_sql("objects")} WHERE status = 'not-published'
    UNION ALL SELECT 'media.prose', id, 'changeNote', 'local path' FROM {record_sql("media")} WHERE kind = 'authored-diagram'
    UNION ALL SELECT 'sources.url', id, 'url', 'local path' FROM {record_sql("sources")} WHERE url LIKE 'http:%'
    UNION ALL SELECT 'media.url', id, 'licenseUrl', 'scheme, host or credentials' FROM {record_sql("media")} WHERE n % 3 = 1"""
)
def release_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir).withColumn("statement", F.when(F.col("n") % 9 == 0, "see acme/vault").otherwise(F.col("statement")))
    o = objects(spark, sf_dir).withColumn("inventory", F.struct("status", F.lit("7").alias("number"), F.lit("as claim-7 says").alias("statement")))
    o = o.withColumn("inventory", F.when(F.col("status") == "lost", F.struct(F.lit("published").alias("status"), F.lit("8").alias("number"), F.lit("claim-8").alias("statement"))).otherwise(F.col("inventory")))
    return release.check_prose({"notes": n, "sources": sources(spark, sf_dir), "objects": o, "media": media(spark, sf_dir)}, DENIED)


@query(
    """WITH d AS (SELECT doc_id, n_chars FROM documents)
    SELECT 'entry.minutes.words' AS check_id, 'interlude-' || doc_id AS record_id, 'readingMinutes' AS path, 'doesn''t follow from the words' AS message FROM d WHERE doc_id % 4 = 0"""
)
def release_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.functions import text as T

    docs = load(spark, sf_dir, "documents").select(F.concat(F.lit("interlude-"), F.col("doc_id").cast("string")).alias("id"), "doc_id", "text")
    minutes = T.reading_minutes(F.size(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0))))
    declared = docs.select("id", (minutes + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).alias("readingMinutes"))
    return release.check_minutes(declared, docs.select("id", "text"))


# --- layers, snapshots, collections on disk, reports

_LAYERED = "CASE doc_id % 6 WHEN 0 THEN 'src/content/d' || doc_id || '.md' WHEN 1 THEN 'dist/p' || doc_id || '.html' WHEN 2 THEN 'src/a' || doc_id || '.ts' WHEN 3 THEN 'dist/t' || doc_id || '.txt' WHEN 4 THEN 'drafts/x' || doc_id || '.json' ELSE 'dist/d' || doc_id || '.json' END"


@query(
    f"""WITH d AS (SELECT doc_id % 6 AS k, doc_id % 12 AS j, {_LAYERED} AS p FROM documents)
    SELECT 'layer.markdown' AS check_id, p AS record_id, 'html' AS path, 'not allowed' AS message FROM d WHERE k = 0
    UNION ALL SELECT 'layer.html', p, unnest(['runs', 'text']), 'repository coordinate' FROM d WHERE k = 1
    UNION ALL SELECT 'layer.scheme', p, 'content', 'dangerous scheme' FROM d WHERE k = 2
    UNION ALL SELECT 'layer.source', p, 'content', 'dangerous scheme' FROM d WHERE k = 2
    UNION ALL SELECT 'layer.utf8', p, 'content', 'not UTF-8' FROM d WHERE k = 3
    UNION ALL SELECT 'layer.path', p, 'path', 'leak in the name' FROM d WHERE k = 4
    UNION ALL SELECT 'layer.source', p, 'content', 'repeated key' FROM d WHERE j = 5"""
)
def release_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = "CASE doc_id % 6 WHEN 0 THEN CAST('<b>x</b>' AS BINARY) WHEN 1 THEN CAST('<p>acme/vault</p>' AS BINARY) WHEN 2 THEN CAST('f(\"javascript:x\")' AS BINARY) WHEN 3 THEN X'FF' ELSE CAST(CASE WHEN doc_id % 12 = 5 THEN '{\"a\":1,\"a\":2}' ELSE '{}' END AS BINARY) END"
    found = load(spark, sf_dir, "documents").selectExpr(f"{_LAYERED} AS path", f"{content} AS content")
    return layers.scan(found.withColumn("layer", F.coalesce(snapshots.layer_of(F.col("path"), layers.LAYERS), F.lit("content"))), DENIED)


_STAT = "p_partkey AS ino, p_size AS size, p_partkey * 7 AS mtime_ns, p_partkey * 9 AS ctime_ns, 33188 AS mode, 1 AS nlink, 5 AS dev"


@query("SELECT 'f' || p_partkey AS path, CASE WHEN p_partkey % 11 = 0 THEN 'removed' WHEN p_partkey % 13 = 0 THEN 'added' ELSE 'changed' END AS change FROM part WHERE p_partkey % 143 <> 0 AND (p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR p_partkey % 10 = 0)")
def snapshot_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of files in two listings: seven fields, any of which tells a change."""
    rows = load(spark, sf_dir, "part").filter("p_partkey % 143 <> 0").selectExpr("p_partkey", "'f' || p_partkey AS path", *_STAT.split(", "))
    after = rows.filter("p_partkey % 11 <> 0").withColumn("ctime_ns", F.when(F.col("p_partkey") % 10 == 0, F.lit(0)).otherwise(F.col("ctime_ns")))
    return snapshots.diff(rows.filter("p_partkey % 13 <> 0"), after, ["path"], ["ino", "size", "mtime_ns", "ctime_ns", "mode", "nlink", "dev"])


@query(
    """WITH s AS (SELECT 'a' || p_partkey % 5 || '/b' || p_partkey % 7 || '/c' || p_partkey AS path, 'file' AS kind FROM part),
    g AS (SELECT DISTINCT regexp_replace(path, '/.*', '') AS path FROM s UNION SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') FROM s)
    SELECT path, kind, row_number() OVER (ORDER BY len(string_split(path, '/')), path COLLATE C) AS position FROM (SELECT * FROM s UNION ALL SELECT path, 'guard' FROM g)"""
)
def scope_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.scope_table(load(spark, sf_dir, "part").selectExpr("'a' || p_partkey % 5 || '/b' || p_partkey % 7 || '/c' || p_partkey AS path", "'file' AS kind"))


@query(
    """SELECT 'found' AS asked, * FROM (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7)
    UNION ALL SELECT 'fallback', * FROM (SELECT n_nationkey, n_name FROM nation ORDER BY n_name LIMIT 1)"""
)
def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record by its key: there, not there with the first as a fallback, not there without one."""
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    ask = lambda name, key, fallback: reports.lookup(nation, "n_nationkey", key, F.col("n_name"), fallback=fallback).select(F.lit(name).alias("asked"), "*")
    return checks.all_of(ask("found", 7, True), ask("fallback", -1, True), ask("none", -1, False))


@query(
    """SELECT conv_id, bool_or(role = 'assistant') AS some_answer, bool_and(coalesce(length(text), 0) > 0) AS all_filled,
      list_sort(list_concat(flatten(list(regexp_extract_all(coalesce(text, ''), '[0-9]+'))), [])) AS numbers FROM conversations GROUP BY conv_id"""
)
def array_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantifiers over an array, and captures of a pattern from all its texts, those without a match left out."""
    turns = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("t"))
    numbers = F.sort_array(F.flatten(F.transform("t", lambda x: F.regexp_extract_all(x["text"], F.lit("([0-9]+)"), F.lit(1)))))
    return turns.select("conv_id", F.exists("t", lambda x: x["role"] == "assistant").alias("some_answer"), F.forall("t", lambda x: F.length(x["text"]) > 0).alias("all_filled"), numbers.alias("numbers"))


@query(
    """SELECT p_partkey, p_brand || ', ' || p_type || ', ' || p_name || ', ' || CASE WHEN p_partkey % 3 = 0 THEN 'n.d.' ELSE (1900 + p_size)::VARCHAR END || CASE WHEN p_partkey % 4 = 0 THEN ', p. ' || p_partkey ELSE '' END AS line FROM part"""
)
def citation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") + 1900)
    locator = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("p. "), F.col("p_partkey").cast("string"))).otherwise("")
    return load(spark, sf_dir, "part").select("p_partkey", reports.citation(F.array("p_brand", "p_type"), F.col("p_name"), year, locator).alias("line"))


@query(
    """SELECT '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:xhtml="http://www.w3.org/1999/xhtml">' || string_agg('<url><loc>https://example.org' || pre || route
      || '</loc><xhtml:link rel="alternate" hreflang="ru" href="https://example.org' || route || '"/><xhtml:link rel="alternate" hreflang="en" href="https://example.org/en' || route || '"/></url>', '' ORDER BY route COLLATE C, locale) || '</urlset>' AS value
    FROM (SELECT '/' || lower(n_name) || '/' AS route FROM nation), (SELECT unnest(['ru', 'en']) AS locale, unnest(['', '/en']) AS pre)"""
)
def sitemap_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = load(spark, sf_dir, "nation").select(F.concat(F.lit("/"), F.lower("n_name"), F.lit("/")).alias("route"))
    return sinks.sitemap_text(reports.sitemap(routes, "https://example.org", ("ru", "en")))


@query("SELECT 'note.statement' AS check_id, 'note-' || min(doc_id) FILTER (doc_id % 8 = 0 AND doc_id % 31 <> 0) AS record_id, 'statement' AS path, 'too short' AS message FROM documents")
def first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [r for r in release.note_rules() if r[0] == "note.statement"]
    found = checks.violations(notes(spark, sf_dir).filter("n % 31 <> 0"), F.col("id"), rules)
    return checks.fail_first(found, F.regexp_extract("record_id", r"(\d+)$", 1).cast("long"))


@query("SELECT name, least(n, 1000) AS n, n > 1000 AS truncated FROM (SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders)")
def bounded_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each table a reader with a limit of 1000 gets, and whether that is all."""
    return checks.all_of(*[checks.truncated(load(spark, sf_dir, t), 1000).select(F.lit(t).alias("name"), F.col("n").cast("long").alias("n"), "truncated") for t in ("documents", "nation", "orders")])


@query("SELECT p_partkey, round(least(100.0, greatest(0.0, (p_retailprice - 900) / 400 * 100)), 2) AS position FROM part")
def percent_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.functions import text as T

    return load(spark, sf_dir, "part").select("p_partkey", T.percent_position(F.col("p_retailprice"), F.lit(900.0), F.lit(1300.0)).alias("position"))


@query(
    """SELECT 'myths' AS kind, 'm' || s_suppkey AS id, s_name AS value FROM supplier
    UNION ALL SELECT 'sources', 's' || s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END FROM supplier
    UNION ALL SELECT 'body', 'e' || s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'no front matter' ELSE '# ' || s_name END FROM supplier
    UNION ALL SELECT 'summary', 'myths', count(*)::VARCHAR FROM supplier UNION ALL SELECT 'summary', 'sources', count(*)::VARCHAR FROM supplier UNION ALL SELECT 'summary', 'entries', count(*)::VARCHAR FROM supplier
    UNION ALL SELECT 'overlay', 'm' || s_suppkey, upper(s_name) FROM supplier"""
)
def collections_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a record, written by tasks and read back as typed collections; broken files have no record."""
    s = batches.dealt(load(spark, sf_dir, "supplier").select("s_suppkey", "s_name"))
    key = F.col("s_suppkey").cast("string")
    myth = F.to_json(F.struct(F.col("s_name").alias("title"), F.lit("x").alias("unknown"), F.array(F.lit("s1")).alias("citations")))
    source = F.when(F.col("s_suppkey") % 3 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("s_name").alias("title"))))
    entry = F.when(F.col("s_suppkey") % 4 == 0, F.lit("no front matter")).otherwise(F.concat(F.lit('---\n{"id":"e"}\n---\n# '), F.col("s_name")))
    made = lambda folder, prefix, extension, content: s.select(F.concat(F.lit(f"{folder}/{prefix}"), key, F.lit(extension)).alias("path"), content.alias("content"))
    overlay = s.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("m"), key), F.create_map(F.lit("title"), F.upper("s_name")))))).alias("content")).select(F.lit("overlay/en.json").alias("path"), "content")
    folder = scratch.scratch_path(spark, "collections")
    scratch.make_folder(spark, folder)
    sinks.write_files(checks.all_of(made("myths", "m", ".json", myth), made("sources", "s", ".json", source), made("entries", "e", ".md", entry), overlay), folder)
    row = lambda kind, df, value: df.select(F.lit(kind).alias("kind"), "id", value.alias("value"))
    found = collections.entries(spark, f"{folder}/entries", "id string")
    every = collections.raw_files(spark, folder).filter("path not like '%/overlay/%'")
    counts = collections.summary(every, folder.rsplit("/", 1)[1]).select(F.col("collection").alias("id"), F.col("n").cast("string").alias("n"))
    texts = collections.raw_files(spark, f"{folder}/overlay").select(F.explode(F.from_json("text", "map<string,map<string,string>>")).alias("id", "fields"))
    return checks.all_of(
        row("myths", collections.collection(spark, folder, "myths"), F.col("title")),
        row("sources", collections.json_records(spark, f"{folder}/sources", "title string"), F.col("record.title")),
        row("body", found, F.coalesce("problem", "body")),
        row("summary", counts, F.col("n")),
        row("overlay", texts, F.col("fields")["title"]),
    )


def _from_files() -> str:
    rules = {name: SQL[f"release_{name}"] for name in ("sources", "objects", "media")}
    whole = [f"SELECT '{c}' AS check_id, id AS record_id, '{p}' AS path, '{m}' AS message FROM {record_sql('notes')} WHERE n % 59 <> 0 AND NOT coalesce({holds}, false)" for c, p, holds, m in RULES_SQL["notes"]]
    broken = f"SELECT 'record.json' AS check_id, id AS record_id, 'notes' AS path, CASE WHEN n % 2 = 0 THEN 'syntax' ELSE 'repeated key' END AS message FROM {record_sql('notes')} WHERE n % 59 = 0"
    named = f"SELECT 'file.id' AS check_id, id AS record_id, 'id' AS path, 'not the name of its file' AS message FROM {record_sql('notes')} WHERE n % 61 = 0 AND n % 59 <> 0"
    return _union([*rules.values(), *whole, broken, named])


@query(_from_files())
def release_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as files of a committed tree, loaded from its folders and judged; some files are broken and some have another name."""
    root = scratch.scratch_path(spark, "records")
    made = []
    for name, schema in release.SCHEMAS.items():
        columns = [c.strip("`") for c in spark.createDataFrame([], schema).columns]
        rows = batches.dealt(BUILT[name](spark, sf_dir))
        content, stem = F.to_json(F.struct(*columns)), F.col("id")
        if name == "notes":
            content = F.when(F.col("n") % 59 == 0, F.when(F.col("n") % 2 == 0, F.lit('{"id": ')).otherwise(F.lit('{"id":1,"id":2}'))).otherwise(content)
            stem = F.when((F.col("n") % 61 == 0) & (F.col("n") % 59 != 0), F.concat(F.lit("other-"), "id")).otherwise(stem)
        made.append(rows.select(F.concat(F.lit(f"{ROOT}/{name}/"), stem, F.lit(".json")).alias("path"), content.alias("content")))
    sinks.write_files(checks.all_of(*made), root)
    tables, unread = release.load_records(spark, root)
    judged = [checks.violations(tables[name], F.col("id"), release.RULES[name]()) for name in tables]
    return checks.all_of(unread, *judged)
