"""URL filters: parsing, rules, the template tree (also against brute force), odd inputs."""
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tablecraft.llm import url_filter

LABELS = "doc_id long, bad boolean"


def judge(spark, rows, labels=()):
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = url_filter.judge(pages, spark.createDataFrame(list(labels), LABELS), F.col("page_id")).collect()
    return {r["page_id"]: tuple(r)[2:] for r in out}


def test_parts_and_rules(spark):
    urls = {
        1: "http://A.Example.COM/en/1?x#y", 2: "https://www.example.com/en/", 3: "http://x.net/es/a", 4: "http://net/fr/", 5: "http://notcom/", 6: "http://b.com", 7: "x://h?q://z/", 8: None, 9: "no host", 10: "://\u00c4.org/p#f?g", 11: "http://com#/",
    }
    assert judge(spark, list(urls.items())) == {
        1: ("a.example.com", "/en/1", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 3: ("x.net", "/es/a", "net/es/", "block"),
        4: ("net", "/fr/", "net/fr/", "block"), 5: ("notcom", "/", None, "allow"), 6: ("b.com", "", None, "allow"), 7: ("h", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("", "", None, "allow"), 10: ("\u00c4.org", "/p", None, "allow"), 11: ("com", "", None, "allow"),
    }
    assert judge(spark, []) == {}


def test_bad_branches_are_found_and_similar_ones_merge(spark):
    rows, labels = [], []
    for i in range(600):
        section = ("news", "blog", "spam")[i % 3]
        rows.append((i, f"http://h.org/{section}/{i}.html"))
        if i % 2:
            labels.append((i, section == "spam"))
    out = judge(spark, rows, labels)
    assert all((out[i][3] == "block") == (i % 3 == 2) for i in range(600))
    pages = spark.createDataFrame(rows, "_doc long, url string")
    host, path = url_filter.host_and_path(F.col("url"))
    segs = {f"s{i}": s for i, s in enumerate(url_filter.patterns(path))}
    tree = url_filter.templates(pages.withColumns({"_host": host, **segs}), spark.createDataFrame(labels, "_doc long, bad boolean"))
    assert {r["tpl"].split("/")[1] for r in tree.collect()} == {"spam", "*"}


def test_smoothing_spares_rare_templates(spark):
    rows = [(i, f"http://h{i}.org/a") for i in range(100)]
    out = judge(spark, rows, [(i, i == 0) for i in range(100)])
    assert {v[3] for v in out.values()} == {"allow"}


def test_odd_inputs(spark):
    long = "http://h.org/" + "/".join(["seg"] * 5000)
    rows = [(1, long), (1, long), (None, "http://h.org//a///b"), (2, "http://h.org/" + "a" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"verdict": F.lit("x"), "tpl": F.lit("t"), "s0": F.lit(1), "_host": F.lit(2)})
    out = url_filter.judge(pages, spark.createDataFrame([(None, True), (1, None), (1, True), (1, False), (1, False)], LABELS), F.col("page_id"))
    assert out.columns == ["page_id", "url", "tpl", "s0", "_host", "host", "path", "rule", "verdict"]
    assert out.count() == 4 and {r["verdict"] for r in out.collect()} == {"allow"}


def test_clean_branches_among_mostly_bad_ones(spark):
    rows = [(10 * b + i, f"http://h.org/{'abcdefghij'[b]}/x") for b in range(10) for i in range(10)]
    out = judge(spark, rows, [(i, i < 80) for i, _ in rows])
    assert {i for i, v in out.items() if v[3] == "block"} == set(range(80))


def test_bad_branches_below_the_first_segments(spark):
    rows, labels = [], []
    for i in range(600):
        section = ("news", "blog/x", "spam", "")[i % 4]
        rows.append((i, f"http://h.org/a/b/c/d/e/{section}/{i}.html"))
        labels.append((i, section == "spam"))
    rows += [(1000 + i, f"http://h.org/a/b/c/d/e/{'spam' * (i % 2)}") for i in range(4)]
    out = judge(spark, rows, labels[::2] + labels[1::4])
    assert all((out[i][3] == "block") == (i % 4 == 2) for i in range(600))
    sub = [(i, f"http://h.org/1/2/3/4/{'xy'[i // 30 % 2]}/6/{'pq'[i // 60]}/8") for i in range(120)]
    out = judge(spark, sub, [(i, i < 90) for i in range(120)])
    assert {i for i, v in out.items() if v[3] == "block"} == set(range(90))


def _differs(l, b, all_l, all_b, signed=False):
    if l == 0 or l == all_l:
        return False
    p, gap = all_b / all_l, b / l - (all_b - b) / (all_l - l)
    return (gap if signed else abs(gap)) > url_filter.DIFFERENT * (p * (1 - p) * (1 / l + 1 / (all_l - l))) ** 0.5


def _branch(pages, segment):
    """The pages of a node, gathered by the names that their branches get."""
    sums = defaultdict(lambda: [0, 0])
    for p in pages:
        sums[segment(p)][0] += p["l"]
        sums[segment(p)][1] += p["b"]
    total = [sum(x) for x in zip(*sums.values(), strict=True)]
    others = {s: x for s, x in sums.items() if not _differs(*x, *total, signed=True)}
    rest = [sum(x[i] for x in others.values()) for i in (0, 1)]
    out = defaultdict(list)
    for p in pages:
        s = segment(p)
        out[s if len(sums) == 1 or s not in others or _differs(*sums[s], *rest) else "*"].append(p)
    return out


def _leaves(pages, level=0):
    """Lists of pages that share a template, found by going down from one node, segment by segment."""
    if level < url_filter.DEPTH - 1:
        for group in _branch(pages, lambda p: (p["segs"][level:] or [""])[0]).values():
            yield from _leaves(group, level + 1)
        return
    l, b, rests = sum(p["l"] for p in pages), sum(p["b"] for p in pages), [p["segs"][level:] for p in pages]
    if not 0 < b < l or l <= url_filter.DIFFERENT**2 or all(r == rests[0] for r in rests):
        yield pages
        return
    while all(r[:1] == rests[0][:1] for r in rests):
        level, rests = level + 1, [r[1:] for r in rests]
    for group in _branch(pages, lambda p: (p["segs"][level:] or [""])[0]).values():
        yield from _leaves(group, level + 1)


def _brute_force(rows, labels):
    """page id -> verdict, for pages that no rule fits."""
    marks, hosts = defaultdict(list), defaultdict(list)
    for doc, bad in labels:
        if bad is not None:
            marks[doc].append(bad)
    for i, url in rows:
        host, _, path = url.split("://")[1].partition("/")
        names = [re.sub("[0-9]+", "{n}", re.sub("[0-9a-f]{16,}", "{x}", s)) for s in path.split("/") if s]
        hosts[host].append({"id": i, "segs": names, "l": len(marks[i]), "b": sum(marks[i])})
    every = [p for pages in hosts.values() for p in pages]
    share, out = sum(p["b"] for p in every) / sum(p["l"] for p in every), {}
    for pages in hosts.values():
        for group in _leaves(pages):
            l, b = (sum(p[c] for p in group) for c in ("l", "b"))
            purity = (b + url_filter.PRIOR_WEIGHT * share) / (l + url_filter.PRIOR_WEIGHT)
            out |= {p["id"]: "block" if purity >= url_filter.REJECT else "allow" for p in group}
    return out


def test_random_deep_urls_against_brute_force(spark):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(6000):
        host = r.choice(["h0", "h0", "h1", "h2"])
        segs = ["a" if r.random() < 0.8 else r.choice("bc") for _ in range(r.randrange(5))] + [r.choice(["p", "q", "s", "x7", "0123456789abcdef0"]) for _ in range(r.randrange(5))]
        # what is bad differs by host: one branch at any level, the end of the path, hardly anything
        bad = {"h0": "s" in segs[3:6], "h1": segs[-1:] == ["q"], "h2": len(segs) > 7}[host] != (r.random() < 0.08)
        rows.append((i, f"http://{host}.org/{'/'.join(segs)}{'/' * r.randrange(2)}"))
        labels += [(i, bad if r.random() < 0.95 else None) for _ in range(r.choice([0, 0, 1, 1, 2]))]
    expected = _brute_force(rows, labels)
    deep = {v for i, v in expected.items() if rows[i][1].count("/") > 8}
    assert deep == {"allow", "block"} and 300 < sum(v == "block" for v in expected.values()) < 4000
    assert {i: v[3] for i, v in judge(spark, rows, labels).items()} == expected
