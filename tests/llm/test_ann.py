import numpy as np
from pyspark.sql import functions as F

from corvane.llm import ann


def exact(ids, x, queries, k):
    out = {}
    norm = np.sqrt((x * x).sum(1))
    for q in queries:
        r = ids.tolist().index(q)
        s = (x * x[r]).sum(1) / (norm * norm[r])
        s[r] = -np.inf
        o = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[q] = [(int(ids[j]), float(s[j])) for j in o]
    return out


def test_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 3000)] + 0.5 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:400] = x[100]  # many equal vectors
    ids = np.arange(3000)
    bad = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (5200, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)] + bad, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("score", F.lit("x"))
    got = ann.search(df, df.filter("vec_id % 50 = 0"), sample_rows=1500, part_rows=180).collect()
    want = exact(ids, x.astype(float), range(0, 3000, 50), 5)
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(by) == set(want)
    assert all(len(v) == 5 for v in by.values())
    hits = sum(len({i for i, _ in by[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    assert [i for i, _ in by[150]] == [100, 101, 102, 103, 104]
    for q in want:
        s = dict(want[q])
        assert all(abs(s[i] - v) < 1e-12 for i, v in by[q] if i in s)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, df.filter("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert ann.search(df.filter("vec_id < 0"), df).count() == 0


def test_vectors_of_each_length_are_searched_among_themselves(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(c) for c in rng.normal(size=8)]) for k in range(60)]
    rows += [(100 + k, [float(c) for c in rng.normal(size=9 + k)]) for k in range(20)]  # one of these is first by hash
    rows += [(200 + k, [float(c) for c in rng.normal(size=3)]) for k in range(400)] + [(700, [1.0] * 2), (701, [1.0] * 2), (750, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.filter("vec_id % 50 = 0").unionByName(spark.createDataFrame([(50_000, [1.0] * 77)], df.schema)), part_rows=64)
    by = {}
    for r in got.collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {0, 50, *range(200, 600, 50), 700, 750}
    hits = 0
    for q, found in by.items():
        size = len(dict(rows)[q])
        own = [(i, np.array(v)) for i, v in rows if len(v) == size]
        want = exact(np.array([i for i, _ in own]), np.array([v for _, v in own]), [q], 5)[q]
        assert len(found) == len(want) and {i for _, i, _ in found} <= {i for i, _ in own}
        hits += len({i for _, i, _ in found} & {i for i, _ in want}) / len(want)
    assert hits / len(by) >= 0.9


def test_ids_with_several_vectors_stand_once_in_an_answer(spark):
    rng = np.random.default_rng(6)
    rows = [(k % 12, [float(c) for c in rng.normal(size=6)]) for k in range(60)] + [(3, [1.0] * 6)] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.filter("vec_id = 0"), k=5).collect()
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    best = {i: max(unit(v) @ unit(q) for q in (x for j, x in rows if j == 0) for v in (x for j, x in rows if j == i)) for i in range(1, 12)}
    want = sorted(best, key=lambda i: (-best[i], i))[:5]
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == want and len(got) == 5


def test_recall_on_the_table_of_embeddings(spark):
    """At least 0.9 against brute force; what the router spares is printed with -s."""
    folder = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    queries = [int(i) for i in ids if i % 50 == 0]
    want = exact(ids, x, queries, 5)
    by = {}
    for r in ann.search(df, df.filter("vec_id % 50 = 0")).collect():
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = sum(len(by[q] & {i for i, _ in want[q]}) for q in queries) / (5 * len(queries))
    router = ann.fit(x, k=5)
    parts = router.w2.shape[1]
    print(f"recall {recall:.3f}, {router.probes} of {parts} parts visited")
    assert recall >= 0.9 and parts == len(x) // ann.PART_ROWS and router.probes < parts
