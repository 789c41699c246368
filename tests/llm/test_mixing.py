"""Source mixing: targets by hand, copies by systematic sampling, odd inputs."""
from pyspark.sql import functions as F

from tablecraft.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)


def taken(df, **options):
    rows = mixing.plan(df, mixing.word_count(F.col("text")), **options).collect()
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["source_size"], round(r["target"], 6), r["copies"]) for r in rows)


def by_hand(sizes, weights, share, cap):
    """Give out by weight, cap, share what is left again, until no source is above its cap."""
    total, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        trial = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if trial[i] > cap * sizes[i]]
        if not over:
            for i, t in trial.items():
                out[i] = t
            break
        for i in over:
            out[i] = cap * sizes[i]
            open_.discard(i)
    return out


def test_targets_follow_the_rule(spark):
    rows, i = [], 0
    for s, n in (("a", 3), ("b", 40), ("c", 25), ("d", 60), (None, 30)):
        for _ in range(n):
            rows.append((i, "w " * (1 + i % 7), s))
            i += 1
    got = {(r[2], r[3]) for r in taken(docs(spark, rows))}
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = ["a", "b", "c", "d", None]
    want = by_hand([sizes[s] for s in order], [5, 2, 1, 5, 2], 1.5, 2.0)
    assert got == {(sizes[s], round(t, 6)) for s, t in zip(order, want)}


def test_copies_come_near_the_target(spark):
    rows = [(i, "w " * (1 + (i * 37) % 50), f"s{i % 7 % 4}") for i in range(4000)]
    out = taken(docs(spark, rows), block_rows=16)
    assert out == taken(docs(spark, rows[::-1]).repartition(7), block_rows=900)
    words, target = {}, {}
    for _, size, source, goal, copies in out:
        words[source, goal] = words.get((source, goal), 0) + size * copies
        target[source, goal] = goal
        assert 0 <= copies <= 2
    for s, goal in target.items():
        assert abs(words[s] - goal) <= 0.02 * goal


def test_odd_inputs(spark):
    assert taken(docs(spark, [])) == []
    rows = [(1, None, None), (2, "", ""), (None, "a b", "x"), (4, "word " * 30000, "x"), (4, "word " * 30000, "x"), (5, "\u00a0\x1c", "x")]
    out = taken(docs(spark, rows))
    assert [(r[0], r[1]) for r in out] == [(-1, 2), (1, 0), (2, 0), (4, 30000), (4, 30000), (5, 1)]
    assert mixing.mix(docs(spark, [])).collect() == []


def test_mix_keeps_columns(spark):
    df = docs(spark, [(i, "a b c", "s") for i in range(10)]).withColumns({"size": F.lit("x"), "copies": F.lit(9), "_src": F.lit(1), "_size": F.lit(2)})
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert out.count() == 15
    assert {r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {1, 2}
    assert out.select("size", "copies").distinct().collect() == [("x", 9)]


def test_rows_of_one_id(spark):
    """Many rows under one id: reruns take the same texts, words stay near the target, and no block holds them all."""
    rows = [(7, f"{i} " + "w " * 5, "s") for i in range(3000)] + [(i, "a b c", "s") for i in range(100, 700)]
    runs = [sorted(r["text"] for r in mixing.mix(docs(spark, order).repartition(n), weights=(1,), share=0.5, block_rows=64).collect()) for order, n in ((rows, 3), (rows[::-1], 5))]
    assert runs[0] == runs[1]
    words = sum(len(t.split()) for t in runs[0])
    assert abs(words - 0.5 * sum(len(t.split()) for _, t, _ in rows)) <= 0.02 * words
    same = docs(spark, [(1, "x y", "s")] * 1000)
    assert mixing.mix(same, weights=(1,), share=0.5, block_rows=16).count() == 500
