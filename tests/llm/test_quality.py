"""Quality classifier: held-out accuracy, determinism, odd inputs."""
import numpy as np
from pyspark.sql import functions as F

from tablecraft.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("predicted", "quality", "score").collect()
    y, p = np.array([r["quality"] for r in rows]), np.array([r["predicted"] for r in rows])
    assert len(rows) > 300
    assert (y == p).mean() > 0.97
    assert p[y == 1].mean() > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_the_held_out_fold_do_not_matter(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs.repartition(5), flipped.repartition(3))
    x = np.random.default_rng(0).random((50, len(quality.FEATURES)))
    assert np.allclose(a.score(x), b.score(x), atol=1e-12)


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert {3, 7} in [{f, g} for f, g, *_ in model.pairs]


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (4, "w! " * 100_000, "q"), (4, "w! " * 100_000, "q")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert {r["score"] for r in quality.score(docs, model).collect()} == {0.5}
    one = spark.createDataFrame([(1, None), (2, 1), (4, 1), (4, 7), (None, 0)], "doc_id long, quality int")
    kept = quality.keep(docs, one)
    assert kept.columns == docs.columns and kept.count() == 5
    assert quality.score(docs.limit(0), model).collect() == []
    assert quality.keep(docs.limit(0), one).collect() == []


def _bin(edges, value):
    return sum(e <= value for e in edges)


def _plain_tree(rows, bins):
    """Bin values of a tree over ``rows`` (bin, residual, weight), each cut found by trying them all."""
    def sums(a, b):
        inside = [(g, h) for i, g, h in rows if a <= i < b]
        return sum(g for g, _ in inside), sum(h for _, h in inside)

    def worth(a, b):
        g, h = sums(a, b)
        return g * g / (h + quality.RIDGE)

    runs = [(0, bins)]
    while len(runs) < quality.LEAVES:
        gain, a, at, b = max((worth(a, at) + worth(at, b) - worth(a, b), a, at, b) for a, b in runs for at in range(a + 1, b))
        if gain <= 1e-9:
            break
        runs[runs.index((a, b))] = (a, at)
        runs.append((at, b))
    values = {(a, b): sums(a, b) for a, b in runs}
    return [next(g / (h + quality.RIDGE) for (a, b), (g, h) in values.items() if a <= i < b) for i in range(bins)]


def test_boosting_against_brute_force():
    rng = np.random.default_rng(3)
    x = rng.random((300, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] + 0.2 * rng.random(300) > 0.8).astype(float)
    model = quality.fit(x, y, rounds=3, pairs=0)
    start = float(np.log(y.mean() / (1 - y.mean())))
    totals, tables = [start] * len(y), [[0.0] * (len(c) + 1) for c in model.cuts]
    for _ in range(3):
        for f, cuts in enumerate(model.cuts):
            at, p = [_bin(cuts, v) for v in x[:, f]], [1 / (1 + np.exp(-t)) for t in totals]
            tree = _plain_tree([(i, b - q, q * (1 - q)) for i, b, q in zip(at, y, p, strict=True)], len(cuts) + 1)
            tables[f] = [v + quality.RATE * t for v, t in zip(tables[f], tree, strict=True)]
            totals = [t + quality.RATE * tree[i] for t, i in zip(totals, at, strict=True)]
    assert not model.pairs and all(np.allclose(a, b, atol=1e-9) for a, b in zip(model.tables, tables, strict=True))
    assert np.allclose(model.score(x), [1 / (1 + np.exp(-t)) for t in totals], atol=1e-9)


def test_query_against_table_lookups_row_by_row(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model, expected = quality.train(docs, labels), {}
    for r in docs.select("doc_id", "text").collect():
        x, total = quality.features(r["text"]), model.intercept
        total += sum(table[_bin(cuts, v)] for cuts, table, v in zip(model.cuts, model.tables, x, strict=True))
        total += sum(table[_bin(at_f, x[f])][_bin(at_g, x[g])] for f, g, at_f, at_g, table in model.pairs)
        expected[r["doc_id"]] = 1 / (1 + np.exp(-total))
    got = {r["doc_id"]: r for r in quality.op5_quality(spark, sf).collect()}
    assert set(got) == set(expected) and len(model.pairs) > 0
    assert all(abs(got[i]["score"] - s) < 1e-9 and got[i]["predicted"] == int(got[i]["score"] >= 0.3) for i, s in expected.items())
