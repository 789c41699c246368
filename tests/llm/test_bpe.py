"""BPE against the tokenizers library, and exact round trips."""
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
from tablecraft.llm import bpe  # noqa: E402

ATOMS = [" ", "  ", "\n", "\t", "a", "b", "don't", "'s", "'", "!", "\u00e9", "\u00a0", "\u3000", "9", "<|endoftext|>", "x" * 60, "\U0001f600", "ab", "\x1c", "\x00", "\x85", "\r\n", "<|", "\u017f", "'LL", "\u0301", "\n\u00ab", "a\nb"]
LIBRARY = tokenizers.Tokenizer.from_file(bpe.vocabulary())
OWN = bpe.Bpe(bpe.vocabulary())


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(ATOMS), max_size=14).map("".join)))
def test_same_ids_and_text_as_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == want
    assert OWN.decode(want) == LIBRARY.decode(want, skip_special_tokens=False) == text


def test_forced_boundaries_are_pairs_in_no_token():
    tokens = [t for i, t in OWN.bytes_of.items() if i not in OWN.special.values()]
    assert all(not any((t[i], t[i + 1]) == (ord("e"), ord(" ")) for i in range(len(t) - 1)) for t in tokens)
    assert OWN.cut_at_space and OWN.cut_at_line
    assert b"".join(OWN._pieces(b" zq\xf0\x9f\x98\x80xj")) == b" zq\xf0\x9f\x98\x80xj"


def test_small_cache_gives_the_same(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    own = bpe.Bpe(bpe.vocabulary())
    text = "One two, three! one two; three's\nfour " * 20
    assert own.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_documents(spark, sf):
    rows = {r["doc_id"]: r for r in bpe.op10_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d["text"] or "", add_special_tokens=False).ids
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        r = rows[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_odd_inputs(spark):
    long = "q" * 100_000 + " " * 50_000 + "word " * 20_000
    df = spark.createDataFrame([(1, None), (2, ""), (3, long), (3, long)], "ids long, text string").withColumn("coded", F.lit("x"))
    out = bpe.encode(df, out="tokens").collect()
    assert [r["tokens"] for r in out[:2]] == [[], []] and out[2]["tokens"] == out[3]["tokens"] == LIBRARY.encode(long, add_special_tokens=False).ids
    assert [r["coded"] for r in out] == ["x"] * 4
    back = bpe.decode(bpe.encode(df, out="tokens"), ids="tokens", out="back").collect()
    assert [r["back"] for r in back] == ["", "", long, long]
    odd = spark.createDataFrame([(None,), ([],), ([None, 10**6, 64],)], "ids array<int>")
    assert [r["text"] for r in bpe.decode(odd).collect()] == [None, "", "a"]
    assert bpe.encode(df.limit(0), out="tokens").collect() == []
    assert bpe.digests(df).columns == ["ids", "text", "coded"]
