"""Source divergence against a plain Python version, small tiles and blocks, odd inputs."""
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tablecraft.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, s, 0) for i, (la, s, t) in enumerate(rows)], SCHEMA)


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def by_hand(rows, min_docs=10, top=10):
    n, docs = defaultdict(Counter), defaultdict(Counter)
    for la, s, t in rows:
        n[la or "", s or ""].update(terms(t))
        docs[la or ""].update(set(terms(t)))
    out = []
    for lang in {la for la, _ in n}:
        kept = [t for t, c in docs[lang].items() if c >= min_docs]
        groups = {s: c for (la, s), c in n.items() if la == lang}

        def shares(count):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // total for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in groups:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s))
            best = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            for part, items in (("pair", pairs), ("term", best)):
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(items, 1)]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in divergence.audit(df, **options).collect())


def corpus(n, seed=5):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "dö", "É", "é", "ß", "日本", "x", "y'z", "a1b", "\U0001f600k", "İ"] + [f"w{chr(97 + i)}" for i in range(20)]
    return [(rng.choice(["en", "de", None, ""]), rng.choice([*"abcdefg", None, ""]), " ".join(rng.choices(words, k=rng.randrange(0, 12)))) for _ in range(n)]


def test_by_hand(spark):
    rows = corpus(150)
    assert got(frame(spark, rows)) == by_hand(rows)
    assert got(frame(spark, rows[::-1]).repartition(4), min_docs=3, top=2, block_terms=5, tile=2) == by_hand(rows, 3, 2)


def test_odd_inputs(spark):
    assert got(frame(spark, [])) == []
    few = [("en", "a", None), ("en", "b", ""), (None, None, None), ("en", "c", "1 2 3"), ("de", "a", "x")]
    assert got(frame(spark, few)) == by_hand(few) == sorted(("en", s, "pair", o, 0, r) for s in "abc" for r, o in enumerate(sorted(set("abc") - {s}), 1))
    same = [("en", "a", "Same same")] * 12 + [("en", "b", "other same")] * 3 + [("en", "none", "-")]
    clash = frame(spark, same).withColumns({"term": F.lit("t"), "n": F.lit(1), "docs": F.lit(2), "idx": F.lit(3), "a.b": F.lit(4)})
    assert got(clash) == by_hand(same)


def test_slices_of_long_texts(monkeypatch):
    text = "aé,b C" * 1000 + "longword" * 50
    whole = divergence.count_terms(text.encode())
    monkeypatch.setattr(divergence, "SLICE", 7)
    assert divergence.count_terms(text.encode()) == whole == Counter(t.encode() for t in terms(text))
    assert divergence.count_terms(b"") == Counter()
