"""The validated store, and collections registered in it."""

import json
import os

from pyspark.sql import functions as F

from corvane.operators import checks
from corvane.sources import collections, scratch
from corvane.sources.store import Store


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def rules():
    return [("t.size", "size", F.col("size") > 0, "not positive")]


def test_the_name_moves_only_to_what_holds(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", keep=2)
    make = lambda data: spark.createDataFrame(data, "id string, size int")
    assert store.table("t") is None and store.rows("t") is None
    refused = store.publish("t", make([("a", 0), ("a", 2), (None, 3), ("b", None)]), "id", rules())
    assert not refused.accepted and refused.broken == {"t.key": 1, "t.size": 2, "t.unique": 1}
    assert sorted(map(str, rows(refused.violations, "check_id", "record_id", "message"))) == sorted(map(str, [("t.key", None, "no key"), ("t.size", "a", "not positive"), ("t.size", "b", "not positive"), ("t.unique", "a", "repeated key")]))
    assert store.table("t") is None and [n for n in os.listdir(tmp_path / "s" / "t")] == []
    first = store.publish("t", make([("a", 1), ("b", 2)]), "id", rules(), expected=2, view=True)
    assert first.accepted and first.rows == 2 and first.violations.count() == 0
    assert rows(spark.table("t"), "id", "size") == [("a", 1), ("b", 2)]
    assert store.publish("t", make([("c", 1)]), "id", rules(), expected=2).broken == {"t.count": 1}
    audit = lambda written: checks.rows_of(written.filter("id = 'c'"), "t.audit", F.col("id"), "id", "not wanted")
    assert store.publish("t", make([("c", 1), ("d", 1)]), "id", rules(), audit=audit).broken == {"t.audit": 1}
    assert rows(store.table("t"), "id") == [("a",), ("b",)] and store.rows("t") == 2
    for k in range(3):
        held = store.table("t")
        assert store.publish("t", make([("x", k + 5)]), "id", rules(), audit=audit).accepted
        assert held.count() == (2 if k == 0 else 1)  # a reader of the version before finishes
        assert rows(store.table("t"), "size") == [(k + 5,)]
    assert len([n for n in os.listdir(tmp_path / "s" / "t") if n.startswith("v-")]) == 2
    assert store.publish("t", make([]), "id", rules()).accepted and store.table("t").count() == 0
    spark.catalog.dropTempView("t")


def test_counts_of_a_stage_that_ran_twice_are_taken_again(spark, tmp_path, monkeypatch):
    from corvane.sources import store as module

    class Doubled(module.Observation):
        @property
        def get(self):
            return {k: 2 * v for k, v in super().get.items()}

    monkeypatch.setattr(module, "Observation", Doubled)
    done = Store(spark, f"file://{tmp_path}/s").publish("t", spark.createDataFrame([("a", 0), ("b", 1)], "id string, size int"), "id", rules())
    assert done.rows == 2 and done.broken == {"t.size": 1}


def test_small_files_are_replaced_as_a_whole(spark, tmp_path):
    place = f"file://{tmp_path}/x/p.json"
    assert scratch.read_text(spark, place) is None
    for text in ("é" * 3000, ""):
        scratch.replace_text(spark, place, text)
        assert scratch.read_text(spark, place) == text
    assert [n for n in os.listdir(tmp_path / "x") if not n.endswith(".crc")] == ["p.json"]
    scratch.delete(spark, f"file://{tmp_path}/x")
    assert not scratch.exists(spark, place)


SOURCE = {"title": "t", "authors": ["a"], "publicationYear": None, "publisher": "p", "url": "https://e.org", "region": "asia", "kind": "book", "accessed": "2026-01-01"}
MYTH = {"title": "x", "culture": "c", "legend": "l", "context": "c", "confirmed": "c", "citations": ["one"]}


def put(folder, records):
    for path, record in records.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(record if isinstance(record, str) else json.dumps(record))


def test_a_broken_collection_keeps_the_registered_one(spark, tmp_path):
    put(tmp_path / "a", {"sources/one.json": SOURCE, "sources/two.json": SOURCE | {"publicationYear": 1999, "locator": "p. 1"}, "myths/m.json": MYTH | {"more": 1}})
    store = Store(spark, f"file://{tmp_path}/store")
    names = ("myths", "sources")
    done = collections.register(spark, f"file://{tmp_path}/a", store, names, {"sources": 2})
    assert {k: v.accepted for k, v in done.items()} == {"sources": True, "myths": True}
    assert sorted((r["id"], r["publicationYear"]) for r in spark.table("sources").collect()) == [("one", None), ("two", 1999)]
    bad = {
        "sources/a.json": SOURCE | {"more": 1},
        "sources/b.json": SOURCE | {"kind": "poster", "authors": []},
        "sources/c.json": {k: v for k, v in SOURCE.items() if k != "publicationYear"},
        "sources/d.json": SOURCE | {"publicationYear": 3000, "accessed": "2026-1-1"},
        "sources/e.json": SOURCE | {"publisher": None},
        "sources/f.json": '{"title":"x","title":"y"}',
        "sources/g.json": SOURCE | {"authors": "a"},
        "myths/m.json": MYTH | {"citations": ["one", "gone"]},
        "myths/n.json": MYTH | {"citations": []},
    }
    put(tmp_path / "b", bad)
    done = collections.register(spark, f"file://{tmp_path}/b", store, names, {"sources": 6})
    assert not any(v.accepted for v in done.values())
    found = {(r["record_id"], r["check_id"].removeprefix("sources.")) for r in done["sources"].violations.collect() if r["record_id"] != "f"}
    assert found == {("a", "keys"), ("b", "allowed.kind"), ("b", "filled.authors"), ("c", "year"), ("d", "year"), ("d", "accessed"), ("e", "required.publisher"), ("g", "type.authors"), ("sources", "count")}
    assert ("f", "sources.json") in {(r["record_id"], r["check_id"]) for r in done["sources"].violations.collect()}
    assert rows(done["myths"].violations, "check_id", "record_id") == [("myths.citations", "m"), ("myths.filled.citations", "n")]
    assert rows(spark.table("sources"), "id") == [("one",), ("two",)] and store.rows("sources") == 2
    assert rows(spark.table("myths"), "id") == [("m",)]
    for name in names:
        spark.catalog.dropTempView(name)
