"""Strict JSON in the JVM against Python's parser."""

import json
import random

from pyspark.sql import functions as F

from corvane.functions import canonical as C
from corvane.operators import checks, json_values
from corvane.vectors import DENIED, VECTORS

TEXTS = [
    '{"a":["x",{"b":"y","c":null}],"d":1.50,"e":{}}', '"s"', "null", " [true] ", "[1] x", "1],[2", "1,2", "1", '{"a":1,"a":2}', '[{"z":[{"y":1,"y":2}]}]', "[1e400]", "[NaN]", "[-Infinity]", "[01]",
    "﻿[]", "['a']", '["a\tb"]', "", "  ", "[1,]", '{"a":"\\q"}', "[-0, 1E5, 123456789012345678901234567890123456789012]", "[" * 300 + "]" * 300, '{"a\\u0062":1,"ab":2}', '{"a":1,"A":2}', "{a:1}", "// x\n1", '"a" "b"',
    '{"":1,"":2}', '["\\ud83d\\ude00", "é漢"]', "tru", "[1 2]", '{"a" 1}', "}", '"\\u00e9"', '","', '[]"', '{"v":[1]}',
]


def want(text):
    """(problem, nodes, keys, strings, depth) by Python's parser."""
    try:
        todo, nodes, keys, strings, deepest = [(C.strict_json(text), 0)], 0, 0, 0, 0
    except C.Unsafe as e:
        return ("repeated key" if str(e) == "repeated key" else "syntax", None, None, None, None)
    while todo:
        x, depth = todo.pop()
        nodes, strings, deepest = nodes + 1, strings + isinstance(x, str), max(deepest, depth)
        if isinstance(x, dict):
            keys += len(x)
            todo += [(v, depth + 1) for v in x.values()]
        elif isinstance(x, list):
            todo += [(v, depth + 1) for v in x]
    return (None, nodes, keys, strings, deepest)


def fuzzed(rng):
    def make(depth):
        kind = rng.randrange(7 if depth < 4 else 4)
        if kind < 4:
            return rng.choice(["x", "é", 1, -2.5, True, None, "", "a b"])
        if kind == 4:
            return [make(depth + 1) for _ in range(rng.randrange(4))]
        return {rng.choice("abcdé"): make(depth + 1) for _ in range(rng.randrange(4))}

    text = json.dumps(make(0), ensure_ascii=rng.random() < 0.5)
    if rng.random() < 0.4:
        at = rng.randrange(len(text) + 1)
        text = text[:at] + rng.choice(['"', ",", "]", "}", "{", "1", ":", " ", "\n"]) + text[at + rng.randrange(2) :]
    return text


def test_texts_are_judged_and_counted_as_by_a_parser(spark):
    rng = random.Random(8)
    texts = TEXTS + [fuzzed(rng) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    got = {r[0]: tuple(r)[1:] for r in json_values.summary(df.withColumn("value", F.lit(1)), "id", "j").collect()}
    assert {k: (t, got[k]) for k, t in enumerate(texts) if got[k] != want(t)} == {}
    assert "Python" not in json_values.summary(df, "id", "j")._jdf.queryExecution().executedPlan().toString()


def test_walk(spark):
    df = spark.createDataFrame([("r", TEXTS[0]), ("n", None), ("b", "{")], "id string, j string")
    rows = [(None if r["name"] is None else r["name"], r["depth"], r["kind"], r["text"]) for r in json_values.walk(df, "id", "j").collect()]
    assert sorted(rows, key=str) == sorted([(None, 0, "object", None), ("a", 1, "array", None), (None, 2, "string", "x"), (None, 2, "object", None), ("b", 3, "string", "y"), ("c", 3, "null", None), ("d", 1, "number", None), ("e", 1, "object", None)], key=str)
    assert [tuple(r) for r in json_values.summary(df.filter("id = 'n'"), "id", "j").collect()] == [("n", None, None, None, None, None)]
    assert json_values.walk(df.limit(0), "id", "j").count() == 0
    assert [r[0] for r in df.orderBy("id").select(checks.json_problem(F.col("j"))).collect()] == ["syntax", "syntax", None]


def test_nodes_have_a_limit_and_rows_none(spark, monkeypatch):
    monkeypatch.setattr(json_values, "MAX_NODES", 1000)
    df = spark.range(3).select("id", F.to_json(F.sequence(F.lit(1), F.when(F.col("id") == 1, 400_000).otherwise(5).cast("int"))).alias("j"))
    assert sorted((r["id"], r["problem"], r["nodes"]) for r in json_values.summary(df, "id", "j").collect()) == [(0, None, 6), (1, "too many nodes", 400_001), (2, None, 6)]
    assert json_values.walk(spark.range(4).select("id", F.to_json(F.sequence(F.lit(1), F.lit(300_000))).alias("j")), "id", "j").count() == 1_200_004


def test_leaks_are_those_of_the_vectors(spark):
    vectors = [(k, text.replace("{n}", "7"), leak) for k, (text, leak) in enumerate(VECTORS["json_leaks"].rows)]
    extra = ['{"a":"acme/vault","b":"acme/vault"}', '["javascript:x", {"drafts/x": 1}]', '"plain - text"', '["%61cme/vault"]']
    df = spark.createDataFrame([(k, t) for k, t, _ in vectors] + [(100 + k, t) for k, t in enumerate(extra)], "id int, j string")
    found = sorted(tuple(r) for r in json_values.leaks(df, "id", "j", DENIED).collect())
    assert found == sorted([(k, leak) for k, _, leak in vectors if leak] + [(100, "repository coordinate"), (101, "dangerous scheme"), (101, "local path"), (103, "repository coordinate")])
    assert found == sorted({(k, p) for k, t in df.collect() for p in json_problems(t)})


def json_problems(text):
    try:
        todo, out = [C.strict_json(text)], set()
    except C.Unsafe as e:
        return {str(e)}
    while todo:
        x = todo.pop()
        out |= {C.leak(x, DENIED, C.FRAGMENT)} - {None} if isinstance(x, str) else set()
        todo += [*x, *x.values()] if isinstance(x, dict) else x if isinstance(x, list) else []
    return out
