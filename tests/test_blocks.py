"""Compressed files read in parts, files without line feeds, and cuts at any byte."""
import gzip
import lzma
import os
import random
import shutil
import subprocess
import tempfile

import pytest
import zstandard
from test_splitter import rnd

from tablecraft.sources import blocks, fs, statements
from tablecraft.sources.splitter import N, Automaton, split_all
from tablecraft.sources.statements import LineState, _possible, _Runner, read_statements, read_statements_lines, split_lines


def packed(parts, codec):
    """``parts`` each in its own frame, stream or member."""
    if codec == "zst":
        c = zstandard.ZstdCompressor(write_checksum=True)
        odd = [zstandard.ZstdCompressor(write_content_size=False).compress, lambda p: c.compress(p), lambda p: b"\x50\x2a\x4d\x18\x03\0\0\0abc" + c.compress(p)]
        return b"".join(odd[i % 3](p) for i, p in enumerate(parts))
    one = {"gz": lambda p: gzip.compress(p, mtime=0), "xz": lzma.compress}[codec]
    return b"".join(one(p) + (b"\0" * 4 * (i % 3) if codec == "xz" else b"") for i, p in enumerate(parts))


def pieces(seed, n):
    r = random.Random(seed)
    return [bytes(r.choices(b"abc;'\n", k=r.choice([0, 1, 50, 200_000]))) for _ in range(n)]


def put(tmp_path, data, name):
    p = tmp_path / name
    p.write_bytes(data)
    return str(p), len(data)


def test_zstd_frames(tmp_path):
    parts = pieces(1, 9)
    path, size = put(tmp_path, packed(parts, "zst"), "a.zst")
    frames = list(blocks.zstd_frames(path, size))
    assert len(frames) == 9 and frames[-1][1] == size
    for i, (lo, hi) in enumerate(frames):
        assert b"".join(blocks.unpacked(path, "zstd", size, lo, hi)) == parts[i]
        assert b"".join(blocks.unpacked(path, "zstd", size, lo, size)) == b"".join(parts[i:])
    cut, n = put(tmp_path, packed(parts, "zst")[:-5], "cut.zst")
    with pytest.raises(ValueError, match="cut short"):
        list(blocks.zstd_frames(cut, n))


def test_xz_blocks(tmp_path):
    parts = pieces(2, 7)
    path, size = put(tmp_path, packed(parts, "xz"), "a.xz")
    found = blocks.xz_blocks(path, size)
    assert len(found) == len([p for p in parts if p])
    for (lo, hi, head, stop), i in zip(found, [i for i, p in enumerate(parts) if p]):
        assert b"".join(blocks.unpacked(path, "xz", size, lo, hi, head, stop)) == parts[i]
        assert b"".join(blocks.unpacked(path, "xz", size, lo, size, head, stop)) == b"".join(parts[i:])


@pytest.mark.skipif(shutil.which("xz") is None, reason="no xz program")
def test_xz_blocks_of_one_stream(tmp_path):
    data = b"".join(pieces(3, 12))
    plain, _ = put(tmp_path, data, "b")
    subprocess.run(["xz", "-k", "--block-size=100000", plain], check=True)
    path, size = plain + ".xz", os.path.getsize(plain + ".xz")
    found = blocks.xz_blocks(path, size)
    assert len(found) == -(-len(data) // 100_000)
    for i, (lo, hi, head, stop) in enumerate(found):
        assert b"".join(blocks.unpacked(path, "xz", size, lo, hi, head, stop)) == data[i * 100_000 : (i + 1) * 100_000]
    lo, _, head, stop = found[2]
    assert b"".join(blocks.unpacked(path, "xz", size, lo, size, head, stop)) == data[200_000:]


def test_gzip_members(tmp_path):
    parts = pieces(4, 8) + [b"\x1f\x8b\x08 not a member \x1f\x8b\x08\0"]
    path, size = put(tmp_path, packed(parts, "gz"), "a.gz")
    whole = blocks.gzip_members(path, size, 0, size)
    assert len(whole) == 9 and whole[-1][1] == size
    step = 1000
    assert [m for at in range(0, size, step) for m in blocks.gzip_members(path, size, at, min(at + step, size))] == whole
    for i, (lo, hi) in enumerate(whole):
        assert b"".join(blocks.unpacked(path, "gzip", size, lo, hi)) == parts[i]
        assert b"".join(blocks.unpacked(path, "gzip", size, lo, size)) == b"".join(parts[i:])


@pytest.mark.parametrize("dialect", ["mysql", "postgres"])
def test_states_compose_at_any_cut(dialect):
    """Cutting anywhere, feeding any blocks: the state behind the cut is among those tried, and leads to the same end."""
    aut, rng = Automaton(dialect), random.Random(6)
    for seed in range(300):
        data = rnd(seed, 120)
        if len(data) < 2:
            continue
        whole = _Runner(aut, N)
        whole.feed(data)
        end = whole.end()
        cut = rng.randrange(1, len(data))
        first = _Runner(aut, N)
        for at in range(0, cut, 3):
            first.feed(data[at : min(at + 3, cut)])
        code = first.end()
        assert code in _possible(data[cut - 1], aut.executable), (data, cut)
        second = _Runner(aut, code)
        second.feed(data[cut:])
        assert (second.end(), first.semis + second.semis) == (end, whole.semis), (data, cut, code)


def same(spark, path, data, dialect, chunk):
    want = [(n, s, e, t.decode()) for n, (s, e, t) in enumerate(split_all(data, dialect))]
    got = sorted((r.stmt_no, r.byte_start, r.byte_end, r.stmt) for r in read_statements(spark, path, dialect, chunk_bytes=chunk).collect())
    assert got == want, (dialect, chunk, data)


@pytest.mark.parametrize("dialect", ["mysql", "postgres"])
def test_files_without_line_feeds(spark, tmp_path, dialect):
    for seed in range(2):
        data = rnd(50 + seed, 300).replace(b"\n", b" ") + b"; INSERT '\\\\';--;/*;*/;"
        path, _ = put(tmp_path, data, f"{seed}.sql")
        same(spark, path, data, dialect, 3 + 40 * seed)


@pytest.mark.parametrize("codec", ["zst", "xz", "gz"])
def test_compressed_files_by_parts(spark, tmp_path, codec):
    rng = random.Random(8)
    for seed, dialect in enumerate(["mysql", "postgres"] if codec == "zst" else ["mysql"]):
        data = rnd(70 + seed, 400) + b"';\n--;\n*/ INSERT 1;INSERT 'a;"
        cuts = sorted(rng.sample(range(len(data)), 12))
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        path, _ = put(tmp_path, packed(parts, codec), f"{seed}.sql.{codec}")
        same(spark, path, data, dialect, 4)
    # one part, larger than a chunk: a stream
    data = b"INSERT INTO t VALUES ('%d;');\n" * 300
    path, _ = put(tmp_path, packed([data], codec), f"one.sql.{codec}")
    same(spark, path, data, "mysql", 8)


def test_broken_gzip_is_an_error(spark, tmp_path):
    data = packed([b"INSERT 1;\n" * 50, b"INSERT 2;\n" * 50], "gz")
    for name, bad in (("cut", data[:-9]), ("garbage", data + b"xyz"), ("none", b"INSERT 1;" * 9)):
        path, _ = put(tmp_path, bad, f"{name}.sql.gz")
        with pytest.raises(Exception):
            read_statements(spark, path, chunk_bytes=8).count()


def test_large_files_have_many_tasks(spark):
    d = tempfile.mkdtemp(prefix="many-")
    rng = random.Random(9)
    text = b"".join(b"INSERT INTO t VALUES (%d,'x;%x');" % (i, rng.getrandbits(200)) for i in range(20_000))
    for name, data in (("a.sql", text), ("a.sql.zst", packed([text[i : i + 50_000] for i in range(0, len(text), 50_000)], "zst"))):
        path = os.path.join(d, name)
        with open(path, "wb") as f:
            f.write(data)
        st = read_statements(spark, path, chunk_bytes=100_000)
        assert st.rdd.getNumPartitions() > 4
        assert st.count() == 20_000 == st.select("stmt_no").distinct().count()


def line_file(seed, n):
    r = random.Random(seed)
    words = ["SELECT 1", "'", '"', "`", "\\", ";", "//", "-- c", "# c", "DELIMITER //", "delimiter ;", "DELIMITER $$", "$$", "", "  ", "é", "a;b"]
    return "\n".join(r.choice(["", " "]) + r.choice(words) + r.choice(["", ";", "//", "$$", " ;", "'x'", "\\"]) for _ in range(n))


def test_line_states_compose():
    for seed in range(200):
        lines = line_file(seed, 30).split("\n")
        want = list(split_lines(lines))
        for cut in range(0, 30, 7):
            state, opened = LineState(), 0
            for line in lines[:cut]:
                state, opens, _ = state.after(line)
                opened += opens
            first = list(split_lines(lines, own=cut)) if cut else []
            rest = [(no + cut, t) for no, t in split_lines(lines[cut:], state=state, own=len(lines) - cut)]
            assert first + rest == want and len(first) == opened, (seed, cut)


def test_line_mode_by_chunks(spark, tmp_path):
    for seed in range(2):
        text = line_file(300 + seed, 60) + "\nlast 'open"
        path, _ = put(tmp_path, text.encode(), f"{seed}.sql")
        want = [(no, line, t) for no, (line, t) in enumerate(split_lines(text.split("\n")))]
        got = sorted((r.stmt_no, r.start_line, r.stmt) for r in read_statements_lines(spark, path, chunk_bytes=20 + 70 * seed).collect())
        assert got == want


def test_small_chunks_read_little_and_share_tasks(spark, tmp_path, monkeypatch):
    text = b"".join(b"INSERT INTO t VALUES (%d,'%s');\n" % (i, b"x" * 80) for i in range(60_000)).rstrip()
    path, size = put(tmp_path, text, "many.sql")
    st = read_statements(spark, path, chunk_bytes=10_000)
    assert st.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism  # 600 chunks
    assert st.count() == 60_000 == st.select("stmt_no").distinct().count()
    read, whole = [], fs.read_range
    monkeypatch.setattr(fs, "read_range", lambda p, at, n: read.append(len(b := whole(p, at, n))) or b)
    lo = statements._cut(path, size, 1_000_000)
    hi = statements._cut(path, size, 1_010_000)
    row = {"path": path, "size": size, "codec": None, "j": 1, "lo": lo, "hi": hi, "head": None, "stop": None, "base": lo, "raw": hi - lo, "code": 0, "own": True, "stmt_offset": 7}
    import pyarrow as pa

    got = [x for b in statements._pass2("mysql", None)([pa.RecordBatch.from_pylist([row])]) for x in b.to_pylist()]
    assert got[0]["stmt_no"] == 7 and "".join(x["stmt"] for x in got).encode() == text[lo : got[-1]["byte_end"]]
    assert sum(read) < 300_000


def test_resume_of_many_files_is_one_plan(spark, tmp_path):
    starts, want = {}, []
    for k in range(12):
        stmts = [f"INSERT INTO t VALUES ({k},{i},'{'y' * i}');\n" for i in range(40)]
        path, _ = put(tmp_path, "".join(stmts).encode(), f"{k:02d}.sql")
        starts[path] = len("".join(stmts[: k * 3]))
        want += [x.strip() for x in stmts[k * 3 :]]
    st = read_statements(spark, str(tmp_path), start_byte=starts, chunk_bytes=500)
    assert sorted(x for r in st.collect() if (x := r.stmt.strip())) == sorted(want)
    plan = st._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") < 12
