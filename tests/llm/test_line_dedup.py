"""Line dedup against a plain Python version, odd inputs, long texts."""
import time
from collections import defaultdict

from pyspark.sql import functions as F

from tablecraft.llm import common, line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def by_hand(rows, min_chars=40, min_docs=5):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key := low(line.strip(SPACE))) >= min_chars:
                held[key].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(k := low(x.strip(SPACE))) >= min_chars and len(held[k]) >= min_docs and max(held[k]) != (-1 if i is None else i) for x in lines]
        out.append((-1 if i is None else i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out)


def got(df, **options):
    rows = line_dedup.dedup(df, **options).collect()
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in rows)


A = "This line is part of the License and repeats everywhere."
ROWS = [
    *[(i, f"own line of document {i} that nobody else has at all\n  {A.upper() if i % 2 else A}\t\r\n\ntail") for i in range(6)],
    (6, A + "\x0b\n" + A + "\n" + A), (6, A), (None, A + "\nnull"), (None, A), (7, None), (8, ""), (9, "\n\n"), (10, " " + A), (11, "Ä" * 40), (12, "ä" * 40),
    *[(20 + i, "É" + "x" * 39 + "\n" + "y" * 39) for i in range(5)], (30, "é" + "X" * 39),
]


def test_by_hand(spark):
    assert got(frame(spark, ROWS)) == by_hand(ROWS)
    assert got(frame(spark, ROWS[::-1]).repartition(5)) == by_hand(ROWS)
    assert got(frame(spark, ROWS), min_chars=3, min_docs=2) == by_hand(ROWS, 3, 2)


def test_repeated_rows_are_one_document(spark):
    rows = [(1, A)] * 10 + [(2, A)] * 2
    assert got(frame(spark, rows)) == by_hand(rows) == sorted([(1, 1, 0, A)] * 10 + [(2, 1, 0, A)] * 2)
    rows += [(3, A), (4, A + "\n" + A), (0, A + "\nb")]
    assert got(frame(spark, rows)) == by_hand(rows)
    assert (0, 2, 1, "b") in got(frame(spark, rows))


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "within_bytes", lambda table: False)
    assert got(frame(spark, ROWS)) == by_hand(ROWS)


def test_columns_and_empty_tables(spark):
    assert got(frame(spark, [])) == []
    df = frame(spark, ROWS).withColumns({"n_lines": F.lit("x"), "t1": F.lit(1), "h1": F.lit(2), "k": F.lit(3), "dropped": F.lit(4), "a.b": F.lit(5)})
    out = line_dedup.dedup(df)
    assert out.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "t1", "h1", "k", "dropped", "a.b", "n_lines", "n_dropped"]
    assert got(df) == by_hand(ROWS)


def test_long_texts_in_proportion(spark):
    def run(n):
        rows = [(i, "\n".join([A, f"line {j} of this very long text, document {i}"][j % 2] for j in range(n))) for i in range(5)]
        began = time.time()
        assert [(r[1], r[2]) for r in got(frame(spark, rows))] == [(n, n // 2)] * 4 + [(n, 0)]
        return time.time() - began

    run(100)
    small, large = run(10_000), run(50_000)
    assert large < 12 * max(small, 0.5)
