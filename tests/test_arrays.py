"""INSERT statements decoded by arrays: the same values as the parsers that go tuple by tuple."""
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.plans import load
from tablecraft.sources import inserts

PLAIN = ["NULL", "null", "1", "-2.5", "+3.", ".5", "1.0E7", "TRUE", "'abc'", "'it''s'", "''''", "''", "'x, (y);'", "'é😀'", "'\"q\"'", "'NULL'", "' s '"]
ODD = ["x'41'", "0xFF", "b'1'", "1-2", "1e", ".", "-", "nul", "'a' 'b'", "'a'x", "E'x'", "\"d\"", "'a\\\\b'", "'\x01z'", "DEFAULT", "'a'::text", "_utf8 'x'", ""]
ENDS = ["", ";", ";\n", "; ", " x", ";;", ",", ")", " ON DUPLICATE KEY UPDATE a = VALUES(a);"]


def parsed(stmt, dialect, **options):
    try:
        got = inserts.parse_upsert(stmt, dialect, **options)
    except ValueError as e:
        return str(e), False
    arrays = isinstance(got.rows, pa.Array)
    return (got.columns, got.rows.to_pylist() if arrays else got.rows, got.mode, got.updates), arrays


@pytest.mark.parametrize("dialect", ["mysql", "postgres"])
def test_arrays_as_parsed(dialect, monkeypatch):
    monkeypatch.setattr(inserts, "ARRAY_BYTES", 0)
    rng, used = random.Random(3), 0
    space = lambda: rng.choice(["", " ", "\n ", "\t"]) if rng.random() < 0.3 else ""
    for i in range(4000):
        width, odd = rng.randint(1, 4), 0.1 * (i % 2)
        value = lambda: rng.choice(ODD if rng.random() < odd else PLAIN)  # noqa: E731, B023
        tuples = [f"{space()}({','.join(space() + value() + space() for _ in range(width + (rng.random() < odd / 5)))}){space()}" for _ in range(rng.randint(1, 4))]
        stmt = rng.choice(["INSERT INTO t VALUES ", "REPLACE INTO t (a, `b`) VALUES "]) + ",".join(tuples) + rng.choice(ENDS if odd else ENDS[:4])
        want, got = parsed(stmt, dialect), parsed(stmt, dialect, arrays=True)
        assert got[0] == want[0], stmt
        assert odd or got[1], stmt  # a plain statement needs no other parser
        used += got[1]
    assert 2000 < used < 4000


def test_load_long_statements(spark, tmp_path):
    """Long statements, plain ones and such with marks, hex and errors, load to the same rows as short ones."""
    values = ["'plain'", "X'416200'", "'\\\\'", "'it''s'", "NULL", "'\x01z'", "b'101'"]
    rows = [f"({i}, {values[i % len(values)] if i >= 400 else values[0]}, {i}.5)" for i in range(800)]
    long_, short = tmp_path / "long", tmp_path / "short"
    for folder, n in ((long_, 200), (short, 1)):
        folder.mkdir()
        (folder / "a.sql").write_text("".join(f"INSERT INTO t VALUES {','.join(rows[i : i + n])};\n" for i in range(0, len(rows), n)))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.DoubleType())])
    got, want = (sorted(map(tuple, load.load_dump(spark, str(p), schemas={"t": schema}).tables["t"].collect())) for p in (long_, short))
    assert got == want and len(got) == 800 and got[1] == (1, "plain", 1.5)
    bad = schema.fields[:1] + [T.StructField("b", T.LongType()), schema.fields[2]]
    with pytest.raises(ValueError, match="failed at statement 0: value does not convert"):
        load.load_dump(spark, str(long_), schemas={"t": T.StructType(bad)})


def test_forms_need_no_sort_of_rows(spark, tmp_path, monkeypatch):
    """The last statement of each form, over files and statements; rows are not sorted for it."""
    for f, n in (("a", 3), ("b", 2)):
        (tmp_path / f"{f}.sql").write_text("".join(f"INSERT INTO t VALUES ({i});\n" for i in range(n)))
    raw = inserts.decode_raw(load.read_statements(spark, str(tmp_path), "mysql"))
    (form,) = load._forms(raw)
    assert (form["table"], form["rows"], form["at"]["_file"][-5:], form["at"]["_stmt_no"]) == ("t", 5, "b.sql", 1)
    plans = []
    monkeypatch.setattr(type(raw), "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or [])
    load._forms(raw.withColumn("_stmt_no", F.col("_stmt_no") + 0))
    below = plans[0][plans[0].rindex("_file"):] if plans else ""
    assert plans and plans[0].count("SortAggregate") <= 2 and "HashAggregate" in plans[0] and below
