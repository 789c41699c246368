"""The two vector searches against brute force."""
import numpy as np
from pyspark.sql import functions as F

from tablecraft.llm import ann, kdtree, vectors


def brute(rows, score, k=5):
    """{query: [(vec_id, score)]} for queries divisible by 50, ties to the smaller id."""
    out = {}
    for q, v in rows:
        if q is not None and q % 50 == 0:
            found = [(score(v, w), i) for i, w in rows if i is not None and i != q and len(w) == len(v)]
            out[q] = [(i, s) for s, i in sorted(found, key=lambda x: (-x[0], x[1]))[:k]]
    return {q: v for q, v in out.items() if v}


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def frame(spark, rows, kind):
    return spark.createDataFrame(rows, f"id long, v array<{kind}>")


def test_kdtree_is_exact_with_ties_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in rng.integers(-4, 5, 6)]) for i in range(700)] + [(i, [3, 3, 3, 3, 3, 3]) for i in range(700, 1000)]
    rows += [(1000, [2**61, 5, 0, 0, 0, -(2**60)]), (1001, [1, 2, 3]), (1050, [3, 2, 1]), (1100, [7])]
    df = frame(spark, rows, "long")
    want = brute(rows, lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1))
    for shard in (64, 8192):
        assert got(kdtree.search(df, df.where("id % 50 = 0"), shard_rows=shard, query_rows=8)) == want


def test_kdtree_odd_inputs(spark):
    rows = [(0, [1, 2]), (0, [1, 2]), (1, None), (2, []), (3, [None, 1]), (None, [5, 5]), (5, [1, 1]), (50, [0, 0]), (5, [1, 1])]
    df = frame(spark, rows, "long")
    assert got(kdtree.search(df, df.where("id % 50 = 0"))) == {0: [(5, 3), (5, 3), (50, 0)], 50: [(0, 0), (0, 0), (5, 0), (5, 0)]}
    assert kdtree.search(df.limit(0), df.limit(0)).collect() == []
    assert kdtree.search(df, df.limit(0)).collect() == []
    odd = spark.createDataFrame([(0, [float("nan"), 1.0]), (1, [1e300, -1e300]), (50, [0.5, -0.001])], "vec_id long, embedding array<double>")
    one = odd.select(kdtree.scaled(F.col("embedding")).alias("v")).collect()
    assert one[2]["v"] == [128, -1] and one[1]["v"] == [2**63 - 1, -(2**63)]


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def test_ann_recall_and_scores(spark):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    df = frame(spark, rows, "double")
    want = brute(rows, cosine)
    for shard in (300, 8192):
        found = got(ann.search(df, df.where("id % 50 = 0"), shard_rows=shard, query_rows=16))
        hits = sum(len({i for i, _ in found[q]} & {i for i, _ in best}) for q, best in want.items())
        assert hits >= 0.95 * sum(map(len, want.values()))
        vectors = dict(rows)
        assert all(abs(s - cosine(vectors[q], vectors[i])) < 1e-12 for q, x in found.items() for i, s in x)


def test_ann_odd_inputs(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (6, [0.0, 0.0]), (None, [5.0, 5.0]), (9, [2.0, 4.0]), (7, [1.0, 2.0]), (50, [-1e300, 1e300]), (100, [1.0, 2.0, 3.0])]
    rows += [(200 + i, [1.0, 2.0]) for i in range(1, 40)]
    df = frame(spark, rows, "double")
    found = got(ann.search(df, df.where("id % 50 = 0")))
    assert [i for i, _ in found[0]] == [7, 9, 201, 202, 203] and {s for _, s in found[0]} == {found[0][0][1]}
    assert sorted(found) == [0, 50] and len(found[50]) == 5
    assert ann.search(df.limit(0), df.limit(0)).collect() == []


def test_rows_of_one_id_are_spread(spark):
    """A third of all rows under one id: no shard holds much more than its share, and results stay exact."""
    rows = [(1, [i % 7, i % 11, i % 13]) for i in range(1000)] + [(i, [i % 5, i % 3, -i % 17]) for i in range(2, 2002)]
    df = spark.createDataFrame(rows, "id long, v array<long>").repartition(3)
    per_shard = [r["count"] for r in vectors.sharded(df, 10, 1).groupBy("shard").count().collect()]
    assert len(per_shard) == 10 and max(per_shard) < 2 * 300
    big = 1 << 60
    far = spark.createDataFrame([(big + i, [big + i % 2]) for i in range(40)] + [(20, [1])], "id long, v array<long>")
    got = kdtree.search(far, far.where("id = 20"), k=3, shard_rows=4).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(big + i, big + 1) for i in (1, 3, 5)]
