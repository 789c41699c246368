import os
import random
import tempfile

import pytest
from seqsplit import split_bytes

from tablecraft.sources.splitter import split_all
from tablecraft.sources.statements import read_statements, read_statements_lines, split_lines

ALPHABET = [b"'", b'"', b"\\", b";", b"-", b"#", b"/", b"*", b"\n", b"a", b"b c", b"`"]


def rnd(seed, n=300):
    r = random.Random(seed)
    return b"".join(r.choice(ALPHABET) for _ in range(r.randint(0, n)))


@pytest.mark.parametrize("dialect", ["mysql", "postgres"])
def test_automaton_matches_byte_reference(dialect):
    for seed in range(400):
        data = rnd(seed)
        assert split_all(data, dialect) == split_bytes(data, dialect), (seed, data)


def test_rules():
    data = b"SELECT 1--x\nFROM t; INSERT 'a;b' /* c; */ ;# z\nUSE `x;y`;"
    got = [t for _, _, t in split_all(data)]
    assert got == [b"SELECT 1 FROM t;", b" INSERT 'a;b'   ;", b" USE `x;y`;"]
    assert [t for _, _, t in split_all(b"x 'it''s; ok'; y")] == [b"x 'it''s; ok';", b" y"]
    assert [t for _, _, t in split_all(b"a '\\';' b;")] == [b"a '\\';' b;"]
    # postgres: backslash is no escape and # is no comment
    assert [t for _, _, t in split_all(b"a '\\'; b #c;", "postgres")] == [b"a '\\';", b" b #c;"]


@pytest.mark.parametrize("dialect", ["mysql", "postgres"])
def test_parallel_reader_equals_sequential(spark, dialect):
    root = tempfile.mkdtemp(prefix="split-")
    for seed in range(4):
        data = rnd(1000 + seed, 300)
        d = os.path.join(root, f"{dialect}{seed}")
        os.makedirs(d)
        with open(os.path.join(d, "x.sql"), "wb") as f:
            f.write(data)
        exp = [(s, e, t.decode()) for s, e, t in split_all(data, dialect)]
        for chunk in (5, 64, 1 << 20):
            got = sorted((r.byte_start, r.byte_end, r.stmt) for r in read_statements(spark, d, dialect, chunk_bytes=chunk).collect())
            assert got == exp, (seed, chunk)


def test_statement_numbers_are_global(spark):
    d = tempfile.mkdtemp(prefix="split-")
    data = b"".join(b"INSERT INTO t VALUES ('x;\n', %d);\n" % i for i in range(200))
    with open(os.path.join(d, "a.sql"), "wb") as f:
        f.write(data)
    rows = read_statements(spark, d, chunk_bytes=100).orderBy("byte_start").collect()
    assert [r.stmt_no for r in rows] == list(range(len(rows)))


def test_max_statement_size(spark):
    d = tempfile.mkdtemp(prefix="split-")
    with open(os.path.join(d, "a.sql"), "wb") as f:
        f.write(b"SELECT '" + b"x" * 5000 + b"';")
    with pytest.raises(Exception):
        read_statements(spark, d, max_stmt_bytes=1000).collect()


def test_line_mode_delimiter():
    text = "-- header\n\nDELIMITER //\nCREATE PROCEDURE p()\nBEGIN\n  SELECT 1;\nEND //\nDELIMITER ;\nSELECT 'a;\nb';\n"
    got = list(split_lines(text.splitlines(keepends=True)))
    assert got == [(4, "CREATE PROCEDURE p()\nBEGIN\n  SELECT 1;\nEND"), (9, "SELECT 'a;\nb'")]


def test_line_mode_reader(spark):
    d = tempfile.mkdtemp(prefix="lines-")
    with open(os.path.join(d, "a.sql"), "w") as f:
        f.write("SELECT 1;\n# c\nSELECT 2\n;\n")
    rows = read_statements_lines(spark, d).orderBy("stmt_no").collect()
    assert [(r.start_line, r.stmt) for r in rows] == [(1, "SELECT 1"), (3, "SELECT 2")]


@pytest.mark.parametrize("dialect", ["mysql", "postgres"])
def test_chunks_inside_long_multiline_strings(spark, dialect):
    """Chunk starts inside a string (rescan path) and clean files (one-scan path) in one read."""
    root = tempfile.mkdtemp(prefix="split-")
    body = "\n".join(f"line {i}; -- not a comment ' still text" if i % 7 else f"# {i} /* x" for i in range(400))
    texty = f"INSERT INTO t VALUES (1, '{body.replace(chr(39), chr(39) * 2)}');\nSELECT 2;\n".encode()
    clean = b"".join(b"INSERT INTO t VALUES (%d, 'a\\nb');\n" % i for i in range(300))
    for name, data in (("a.sql", texty), ("b.sql", clean)):
        with open(os.path.join(root, name), "wb") as f:
            f.write(data)
    for chunk in (97, 1000):
        got = sorted((r.file.rsplit("/", 1)[-1], r.byte_start, r.byte_end, r.stmt) for r in read_statements(spark, root, dialect, chunk_bytes=chunk).collect())
        exp = sorted((n, s, e, t.decode()) for n, d in (("a.sql", texty), ("b.sql", clean)) for s, e, t in split_all(d, dialect))
        assert got == exp
