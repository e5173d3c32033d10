"""Typed collections: one file per record, the file name's stem is its id.

Edge cases: a file that isn't UTF-8 or isn't JSON gives a record of nulls, or a problem
for entries; keys that a schema has and a file lacks are null; files of one name in
several folders are records of their own; an empty folder gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.paths import stem
from corvane.operators import checks, links
from corvane.operators.checks import unknown_keys
from corvane.sources import release_tree, scratch
from corvane.sources.store import Published, Store

#: Fixed schemas of the content collections; a strict one rejects keys it doesn't have.
SCHEMAS = {
    "sources": "title string, authors array<string>, publicationYear int, publisher string, locator string, url string, region string, kind string, license string, accessed string",
    "eras": "title string, date string, `order` double, summary string, detail string, place string, image string, imageAlt string, citations array<string>",
    "myths": "title string, culture string, legend string, context string, confirmed string, citations array<string>",
    "materials": "name string, family string, chemistry string, hardness string, structure string, toughness string, note string, citations array<string>",
    "medicine": "title string, tradition string, assessment string, evidence string, safety string, citations array<string>",
}
STRICT = frozenset({"sources"})
REGIONS, KINDS = ("asia", "west", "global"), ("paper", "museum", "book", "institution")
EVIDENCE = ("traditional", "laboratory", "clinical", "none")
#: Fixed: fields that a record may lack, arrays that must hold something, and fields with a list of values.
OPTIONAL = frozenset({"publicationYear", "locator", "license", "image", "imageAlt"})
FILLED = frozenset({"authors", "citations"})
ALLOWED = {"region": REGIONS, "kind": KINDS, "evidence": EVIDENCE}


def raw_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, id, length, text) of whole files below a folder; the content column is pruned where it isn't used.

    A folder that is a committed release tree, or lies in one, is read by its commit.
    """
    root, under = folder.rstrip("/"), ""
    while root and not root.endswith((":", "/")) and not scratch.exists(spark, f"{root}/{release_tree.COMMIT}"):
        root, _, last = root.rpartition("/")
        under = f"{last}/{under}"
    if root and not root.endswith((":", "/")):
        wanted = F.col("path").startswith(under) & F.col("path").like(pattern.replace("*", "%"))
        found = release_tree.read(spark, root).filter(wanted).filter("kind = 'file'")
        files = found.select(F.concat(F.lit(f"{root}/"), "path").alias("path"), F.col("size").alias("length"), "content")
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select("path", stem(F.col("path")).alias("id"), "length", "content", text.alias("text"))


def json_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(id, raw, record struct) of JSON files; broken ones have a null record."""
    files = raw_files(spark, folder, "*.json")
    return files.select("id", F.col("text").alias("raw"), F.from_json("text", schema, {"allowSingleQuotes": "false"}).alias("record"))


def collection(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A collection with its columns and id; a strict one fails on unknown keys when it is read."""
    records = json_records(spark, f"{folder}/{name}", SCHEMAS[name])
    if name in STRICT:
        known = [x.strip().split(" ")[0] for x in SCHEMAS[name].split(",")]
        extra = unknown_keys(F.col("raw"), known)
        record = F.when(F.size(extra) == 0, F.col("record")).otherwise(F.raise_error(F.concat(F.lit("unknown keys in "), F.col("id"))).cast(records.schema["record"].dataType))
        records = records.withColumn("record", record)
    return records.select("id", "record.*")


def record_rules(name: str) -> list:
    """Rules of (id, raw, record) rows: strict JSON, known keys and types, required fields, allowed values."""
    fields = [x.strip().split(" ")[0].strip("`") for x in SCHEMAS[name].split(",")]
    has = lambda f: F.get_json_object("raw", f"$.{f}").isNotNull()
    value = lambda f: F.col(f"record.`{f}`")
    out = [(f"{name}.json", "content", F.coalesce(F.col("raw").isNotNull() & checks.json_problem(F.col("raw")).isNull(), F.lit(False)), "not strict JSON")]
    if name in STRICT:
        out.append((f"{name}.keys", "content", F.size(unknown_keys(F.col("raw"), fields)) == 0, "unknown keys"))
    for f in fields:
        out.append((f"{name}.type.{f}", f, value(f).isNotNull() | ~has(f), "another type"))
        if f not in OPTIONAL:
            out.append((f"{name}.required.{f}", f, has(f), "missing"))
        if f in ALLOWED:
            out.append((f"{name}.allowed.{f}", f, value(f).isNull() | value(f).isin(*ALLOWED[f]), "not an allowed value"))
        if f in FILLED:
            out.append((f"{name}.filled.{f}", f, value(f).isNull() | (F.size(value(f)) > 0), "empty"))
    if "publicationYear" in fields:
        present = F.array_contains(F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>")), "publicationYear")
        out.append((f"{name}.year", "publicationYear", present & F.coalesce(value("publicationYear").between(1, 2100), F.lit(True)), "missing or out of range"))
    if "accessed" in fields:
        out.append((f"{name}.accessed", "accessed", value("accessed").isNull() | value("accessed").rlike(r"^\d{4}-\d{2}-\d{2}$"), "not a date"))
    return out


def register(spark: SparkSession, folder: str, store: Store, names: tuple[str, ...] = tuple(SCHEMAS), expected: dict[str, int] | None = None) -> dict[str, Published]:
    """Publish each collection in a store, with a temporary view of its name; a broken one is refused and the name keeps what it had.

    References of a collection must stand among the sources that are published, so sources come first. expected gives
    the declared numbers of records.
    """
    out = {}
    for name in sorted(names, key=lambda n: n != "sources"):
        records = json_records(spark, f"{folder}/{name}", SCHEMAS[name])
        cites = "citations array<string>" in SCHEMAS[name]

        def references(written: DataFrame, name: str = name) -> DataFrame:
            known = store.table("sources")
            known = written.select("id").limit(0) if known is None else known.select("id")
            edges = links.edges(written.select("id", F.col("record.citations").alias("citations")), "id", "citations")
            return checks.rows_of(links.missing(edges, "reference", known, "id"), f"{name}.citations", F.col("id"), "citations", "no such source")

        out[name] = store.publish(name, records, "id", record_rules(name), (expected or {}).get(name), references if cites else None)
        if out[name].accepted:
            store.table(name).select("id", "record.*").createOrReplaceTempView(name)
    return out


def entries(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(id, record, body, problem) of Markdown files with JSON front matter between --- lines."""
    pattern = r"(?s)^---\n(.*?)\n---\n(.*)$"
    files = raw_files(spark, folder, "*.md")
    head = F.regexp_extract("text", pattern, 1)
    record = F.from_json(head, schema, {"allowSingleQuotes": "false"})
    problem = F.when(F.col("text").isNull(), "not UTF-8").when(~F.col("text").rlike(pattern), "no front matter").when(F.try_parse_json(head).isNull(), "front matter isn't strict JSON")
    return files.select("id", record.alias("record"), F.regexp_extract("text", pattern, 2).alias("body"), problem.alias("problem"))


def summary(files: DataFrame, root: str) -> DataFrame:
    """(collection, n, ids) by the folder under root."""
    name = F.regexp_extract("path", rf"{root}/([^/]+)/", 1)
    return files.filter(name != "").groupBy(name.alias("collection")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))
