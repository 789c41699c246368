"""Collocations against a plain Python version; small blocks, slices, filters and ranges; odd inputs."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tablecraft.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, "s", 0) for i, (la, t) in enumerate(rows)], SCHEMA)


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counted(rows):
    f, n = defaultdict(Counter), Counter()
    for la, t in rows:
        n[la or "und"] += 0
        for ws in pieces(t):
            n[la if la is not None else "und"] += len(ws)
            for m in range(1, 5):
                f[la if la is not None else "und"].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    return f, n


def by_hand(rows, min_count=30, top=2000):
    f, n = counted(rows)
    out = []
    for lang, c in f.items():
        found = []
        many = {w: a for w, a in c.items() if a >= min_count}
        for w, a in many.items():
            if len(w) < 2:
                continue
            if any(len(x) > len(w) and 100 * b >= 80 * a and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1)) for x, b in many.items()):
                continue
            score, _, le, r = min((2_000_000 * a // (c[w[:k]] + c[w[k:]]), k, c[w[:k]], c[w[k:]]) for k in range(1, len(w)))
            found.append((-score, -a, " ".join(w).encode(), le, r))
        out += [(lang, i, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in co.collocations(df, **options).collect())


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = ["New", "york", "the", "of", "É", "日本", "a\x01b", "a", "x-y", " ", "\x1cq"]
    glue = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randrange(0, 40)))
        rows.append((rng.choice(["en", "de", None, ""]), text + rng.choice(["", "New York City hall", "new york city Hall!", "in the house of"])))
    return rows


def test_by_hand(spark):
    rows = corpus(250)
    assert got(frame(spark, rows)) == by_hand(rows)
    # filters of 16 bits let everything pass, ranges of five phrases need their first phrase's beginnings
    assert got(frame(spark, rows[::-1]).repartition(3), min_count=4, top=25, filter_bits=4, range_rows=5) == by_hand(rows, 4, 25)


def test_odd_inputs(spark):
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [("en", None), (None, ""), ("en", ".,;")])) == []
    rows = [("en", "same words here")] * 30 + [(None, "a a a a a " * 20)]
    clash = frame(spark, rows).withColumns({"word": F.lit("w"), "n": F.lit(1), "hash": F.lit(2), "at": F.lit(3), "a.b": F.lit(4)})
    assert got(clash) == by_hand(rows)


def batches(rows):
    return [pa.RecordBatch.from_pydict({"lang": [la or "und" for la, _ in rows], "text": [t or "" for _, t in rows]})]


def phrases_of(rows, order):
    out = defaultdict(Counter)
    for b in co.blocks(batches(rows)):
        at, n = b.counts(co.alive(b, order, [], 27)[0], order)
        out[b.lang].update({tuple(w.decode() for w in b.words[i : i + order]): int(c) for i, c in zip(at, n)})
    return {k: v for k, v in out.items() if v}


def test_blocks_and_slices_lose_nothing(monkeypatch):
    rows = [(la or "und", t) for la, t in corpus(30)] + [("en", "one two three four five " * 50 + "x" * 100), ("en", "nospace" * 9)]
    want = counted(rows)[0]
    for block, size in ((1 << 20, 1 << 20), (7, 1 << 20), (5, 9), (1, 1)):
        monkeypatch.setattr(co, "BLOCK", block)
        monkeypatch.setattr(co, "SLICE", size)
        for order in range(1, 5):
            one = {la: Counter({w: c for w, c in f.items() if len(w) == order}) for la, f in want.items()}
            assert phrases_of(rows, order) == {la: f for la, f in one.items() if f}


class Sent:
    def __init__(self, value):
        self.value = value


def test_a_task_passes_on_each_phrase_once(monkeypatch):
    rows = [(la or "und", t) for la, t in corpus(60)]
    want = {(la, " ".join(w)): c for la, f in counted(rows)[0].items() for w, c in f.items() if len(w) > 1}
    monkeypatch.setattr(co, "BLOCK", 50)
    everything = [Sent(b"\xff" * 2)] * 3
    for held, step in ((500_000, 100_000), (20, 7)):
        monkeypatch.setattr(co, "HELD", held)
        monkeypatch.setattr(co, "STEP", step)
        out = [tuple(r.values()) for b in co._phrase_rows(everything, 4)(iter(batches(rows))) for r in b.to_pylist()]
        got = Counter()
        for la, phrase, n in out:
            got[la, phrase] += n
        assert got == want
        assert held < 500_000 or len(out) == len(want)
    for held in (1 << 20, 40):
        monkeypatch.setattr(co, "HELD_HASHES", held)
        for order in (2, 3):
            out = [(r["hash"], r["n"]) for b in co._hash_rows(order, everything[: order - 1], 4)(iter(batches(rows))) for r in b.to_pylist()]
            kinds = [w for w in want if w[1].count(" ") == order - 1]
            assert len({h for h, _ in out}) == len(kinds) and sum(n for _, n in out) == sum(want[w] for w in kinds)
            assert held < 1 << 20 or len(out) == len(kinds)


def test_phrases_are_spelled_once(spark, monkeypatch):
    rows = corpus(250)
    want = by_hand(rows, 6)
    # no task spells phrases, however many tasks read them
    monkeypatch.setattr(co, "_phrase_rows", None)
    assert got(frame(spark, rows).repartition(7), min_count=6) == want


def test_words_of_one_hash_are_counted_apart(spark, monkeypatch):
    words = spark.createDataFrame([("en", "a", 1), ("de", "a", 2), ("en", "b", 3)], "lang string, word string, hash long")
    assert not co.shared_hash(words) and co.shared_hash(words.union(words.where("hash = 3")))
    rows = corpus(250)
    monkeypatch.setattr(co, "shared_hash", lambda words: True)
    assert got(frame(spark, rows).repartition(3), min_count=6) == by_hand(rows, 6)


def test_hashes_of_all_words_name_a_phrase(monkeypatch):
    rows = [(la or "und", t) for la, t in corpus(60)]
    want = {(la, w): c for la, f in counted(rows)[0].items() for w, c in f.items()}
    names = {int(h): (b.lang, w.decode()) for b in co.blocks(batches(rows)) for h, w in zip(b.hashes.view(np.int64), b.names) if w != co.CUT}
    for block, held in ((50, 1 << 20), (50, 40), (1 << 20, 1 << 20)):
        monkeypatch.setattr(co, "BLOCK", block)
        monkeypatch.setattr(co, "HELD_HASHES", held)
        for order in (2, 3, 4):
            counts = co._hash_rows(order, [Sent(b"\xff" * 2)] * (order - 1), 4)(iter(batches(rows)))
            out = Counter()
            for r in (r for b in co._word_hashes(order)(counts) for r in b.to_pylist()):
                out[names[r["hashes"][0]][0], tuple(names[h][1] for h in r["hashes"])] += r["n"]
            assert out == {k: c for k, c in want.items() if len(k[1]) == order}
    # phrases whose hashes are the same are told apart by their first words
    same = [np.array([7, 7, 7], np.uint64), np.array([1, 2, 1], np.uint64)]
    (hashes, firsts), n = co._added([(same, np.array([1, 5, 2]))])
    sums = Counter()
    for first, x in zip(firsts.tolist(), n.tolist()):
        sums[first] += x
    assert sums == {1: 3, 2: 5} and set(hashes.tolist()) == {7}


def test_filters_never_miss(spark):
    hashes = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 500, dtype=np.int64)
    bits = np.frombuffer(co.bitmap(spark.createDataFrame([(int(h),) for h in hashes], "hash long"), 17), np.uint8)
    at = hashes.view(np.uint64) >> np.uint64(64 - 17)
    want = np.zeros(1 << 17, np.uint8)
    want[at.astype(np.int64)] = 1
    assert (np.unpackbits(bits, bitorder="little") == want).all()
    assert len(co.bitmap(spark.createDataFrame([], "hash long"), 5)) == 4
