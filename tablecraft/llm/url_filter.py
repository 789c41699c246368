"""URL filters: rules first, then a path-template tree with smoothed labelled purity.

Rules name a host (all its subdomains count) and the beginning of a path; the longest fitting one decides. All
other urls are judged by their template. For each host a tree over all path segments is built level
by level: numbers and long hex strings are wildcards from the start, and at each node similar branches merge into
the wildcard ``*``. Branches whose labelled rate of bad pages is significantly above that of their siblings keep
their name, and so do those of the others that differ from the others, in either direction; single branches too.
A template is rejected when its share of bad pages
among the labelled ones, smoothed towards the share of all pages, reaches REJECT.

At scale: pages are first counted by pattern, the levels work on these counts, and pages meet the tree again in a
lookup that is broadcast while small and a salted join beyond, so a host that holds a third of all pages is
shared out. Only DataFrame functions.

Defined results: a null url and one without ``://`` have an empty host and path, which form a host of their own;
null labels count as no label; pages with several labels count each; repeated rows are judged alike; without any
label nothing is rejected; an empty table gives an empty result; input columns other than ``page_id`` and ``url``
are kept, those with a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, read, stage

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Columns of a pattern; the last holds all segments from there on.
DEPTH = 4
#: Standard errors by which a branch's rate differs from its siblings'.
DIFFERENT = 2.6
#: Labelled pages that the share of all pages weighs in a template's purity, and the purity that rejects.
PRIOR_WEIGHT, REJECT = 10.0, 0.5
RESULT = ("host", "path", "rule", "verdict")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path as one string), and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def patterns(path: Column, depth: int = DEPTH) -> list[Column]:
    """The patterns of a path's segments in ``depth`` columns; '' where there is none, the last holds all that follow."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    names = F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(s, "[0-9a-f]{16,}", "{x}"), "[0-9]+", "{n}"))
    rest = F.array_join(F.slice(names, depth, F.greatest(F.size(names), F.lit(1))), "/")
    return [*[F.coalesce(F.get(names, F.lit(i)), F.lit("")) for i in range(depth - 1)], rest]


def _differs(l: Column, b: Column, all_l: Column, all_b: Column, different: float, measure=F.abs) -> Column:
    """Whether the rate of ``b`` in ``l`` differs significantly from that of the rest, by ``measure`` of the difference."""
    rest_l, rest_b, p = all_l - l, all_b - b, F.try_divide(all_b, all_l)
    error = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), l) + F.try_divide(F.lit(1.0), rest_l)))
    differs = (l > 0) & (rest_l > 0) & (measure(F.try_divide(b, l) - F.try_divide(rest_b, rest_l)) > different * error)
    return F.coalesce(differs, F.lit(False))


def _grown(rows: DataFrame, seg: str, different: float) -> DataFrame:
    """One level down: ``tpl`` of each row gets its segment's name, or ``*`` if its branch merged."""
    l, b, at = F.col("l"), F.col("b"), ["_host", "tpl"]
    children = rows.groupBy(*at, seg).agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
    nodes = children.groupBy(*at).agg(F.sum("l").alias("all_l"), F.sum("b").alias("all_b"), F.count("*").alias("n"))
    both = lookup(stage(children, "url-children"), stage(nodes, "url-nodes"), at)
    both = stage(both.withColumn("worse", _differs(l, b, F.col("all_l"), F.col("all_b"), different, lambda d: d)), "url-worse")
    others = both.groupBy(*at).agg(*[F.coalesce(F.sum(F.when(~F.col("worse"), c)), F.lit(0)).alias(f"other_{n}") for n, c in (("l", l), ("b", b))])
    both = lookup(both, stage(others, "url-others"), at)
    differs = F.col("worse") | _differs(l, b, F.col("other_l"), F.col("other_b"), different)
    name = F.when((F.col("n") == 1) | differs, F.col(seg)).otherwise(F.lit("*"))
    names = stage(both.select(*at, seg, name.alias("name")), "url-names")
    return lookup(rows, names, [*at, seg]).withColumn("tpl", F.concat("tpl", F.lit("/"), "name")).drop("name")


def _deepened(rows: DataFrame, seg: str, different: float) -> DataFrame:
    """``rows`` (_host, tpl, l, b) with ``tpl`` grown through all segments that ``seg`` holds.

    Nodes that cannot split are done: those of one pattern, those whose labelled pages are all bad or all good, and
    those of too few labels, as no branch of ``l`` labels differs by more than sqrt(l) standard errors. The others
    go down to the first segment in which their patterns differ, and one level further.
    """
    at, columns = ["_host", "tpl"], [c for c in rows.columns if c != "tpl"]
    left, done = rows.withColumn("_rest", F.array_remove(F.split(seg, "/"), "")), None
    while True:
        nodes = left.groupBy(*at).agg(F.sum("l").alias("all_l"), F.sum("b").alias("all_b"), F.min("_rest").alias("_lo"), F.max("_rest").alias("_hi"))
        splits = (F.col("_lo") != F.col("_hi")) & (F.col("all_b") > 0) & (F.col("all_b") < F.col("all_l")) & (F.col("all_l") > different**2)
        same = F.array_position(F.zip_with("_lo", "_hi", lambda x, y: x.eqNullSafe(y)), False).cast("int") - 1
        nodes = stage(nodes.select(*at, F.when(splits, same).alias("_same")), "url-open")
        left = stage(lookup(left, nodes, at), "url-deep")
        closed = left.where("_same IS NULL").select(*columns, "tpl")
        done = closed if done is None else done.unionByName(closed)
        left = left.where("_same IS NOT NULL")
        if not left.take(1):
            return done
        shared = F.array_join(F.concat(F.array("tpl"), F.slice("_rest", 1, F.col("_same"))), "/")
        tail = F.slice("_rest", F.col("_same") + 2, F.greatest(F.size("_rest"), F.lit(1)))
        down = left.select(*columns, shared.alias("tpl"), F.coalesce(F.get("_rest", F.col("_same")), F.lit("")).alias("_seg"), tail.alias("_rest"))
        left = stage(_grown(down, "_seg", different).drop("_seg"), "url-level")


def templates(pages: DataFrame, labels: DataFrame, depth: int = DEPTH, different: float = DIFFERENT, prior_weight: float = PRIOR_WEIGHT) -> DataFrame:
    """The template of every (host, pattern): _host, s0.., tpl, purity (smoothed share of bad labelled pages).

    ``pages``: _host, s0.. and _doc; ``labels``: _doc, bad (boolean).
    """
    segs = [f"s{i}" for i in range(depth)]
    marked = pages.join(labels.where("_doc IS NOT NULL AND bad IS NOT NULL"), "_doc", "left")
    rows = stage(marked.groupBy("_host", *segs).agg(F.count("bad").alias("l"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("b")), "url-patterns")
    grown = rows.withColumn("tpl", F.lit(""))
    for seg in segs[:-1]:
        grown = stage(_grown(grown, seg, different), "url-level")
    grown = stage(_deepened(grown, segs[-1], different), "url-grown")
    total = rows.agg(F.coalesce(F.try_divide(F.sum("b"), F.sum("l")), F.lit(0.0)).alias("share")).collect()[0]["share"]
    purity = grown.groupBy("_host", "tpl").agg(((F.sum("b") + prior_weight * total) / (F.sum("l") + prior_weight)).alias("purity"))
    return lookup(grown.select("_host", *segs, "tpl"), stage(purity, "url-purity"), ["_host", "tpl"])


def judge(pages: DataFrame, labels: DataFrame, doc: Column, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, reject: float = REJECT, **options) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict (allow or block).

    ``labels``: doc_id, bad. ``doc``: the document that a page's label goes by.
    """
    kept = [c for c in pages.columns if c not in RESULT or c == url]
    at = {c: f"c{i}" for i, c in enumerate(kept)}
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(*[F.col(f"`{c}`").alias(at[c]) for c in kept], doc.alias("_doc"), host.alias("_host"), path.alias("_path"))
    names = patterns(F.col("_path"), options.get("depth", DEPTH))
    rows = rows.withColumns({f"s{i}": s for i, s in enumerate(names)})
    segs = [f"s{i}" for i in range(len(names))]
    tree = templates(rows.select("_doc", "_host", *segs), labels.select(F.col("doc_id").alias("_doc"), "bad"), **options)
    rule, verdict = matched_rule(F.col("_host"), F.col("_path"), rules)
    judged = lookup(rows, stage(tree, "url-tree"), ["_host", *segs])
    method = F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(*[F.col(at[c]).alias(c) for c in kept if c not in RESULT], F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """All pages judged. A page's label is that of the document whose number its path holds."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    labels = read(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    doc = F.regexp_extract(host_and_path(F.col("url"))[1], "/([0-9]{1,18})", 1)
    return judge(pages, labels, F.when(doc != "", doc.cast("long"))).select("page_id", *RESULT)


def _level_sql(i: int) -> str:
    seg = f"s{i}"
    return f"""
n{i} AS (SELECT host, tpl, {seg}, sum(l) AS l, sum(b) AS b FROM g{i} GROUP BY ALL),
w{i} AS (SELECT *, sum(l) OVER q AS al, sum(b) OVER q AS ab, count(*) OVER q AS n FROM n{i} WINDOW q AS (PARTITION BY host, tpl)),
k{i} AS (SELECT host, tpl, {seg}, CASE WHEN n = 1 OR (l > 0 AND al > l AND b / l - (ab - b) / (al - l) > {DIFFERENT}::DOUBLE * sqrt((ab / al) * (1 - ab / al) * (1.0::DOUBLE / l + 1.0::DOUBLE / (al - l)))) THEN {seg} ELSE '*' END AS name FROM w{i}),
g{i + 1} AS (SELECT g.* REPLACE (g.tpl || '/' || k.name AS tpl) FROM g{i} g JOIN k{i} k ON g.host = k.host AND g.tpl = k.tpl AND g.{seg} = k.{seg}),"""


_RULE_SQL = lambda pick: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(v, h, p)}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
_SEG_SQL = lambda i: f"coalesce(regexp_replace(regexp_replace(segs[{i + 1}], '[0-9a-f]{{16,}}', '{{x}}', 'g'), '[0-9]+', '{{n}}', 'g'), '')" + (f" || CASE WHEN len(segs) > {DEPTH} THEN '/+' ELSE '' END" if i == DEPTH - 1 else "")
OP7_SQL = rf"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
s AS (
  SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})', 1), '') AS BIGINT) AS doc FROM h),
p AS (
  SELECT page_id, host, path, doc, {', '.join(f'{_SEG_SQL(i)} AS s{i}' for i in range(DEPTH))} FROM s),
m AS (
  SELECT doc_id, quality = 0 OR toxic = 1 AS bad FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL),
g0 AS (
  SELECT host, {', '.join(f's{i}' for i in range(DEPTH))}, '' AS tpl, CAST(count(bad) AS DOUBLE) AS l, CAST(coalesce(sum(bad::INT), 0) AS DOUBLE) AS b
  FROM p LEFT JOIN m ON p.doc = m.doc_id GROUP BY ALL),{''.join(_level_sql(i) for i in range(DEPTH))}
t AS (SELECT coalesce(sum(b) / nullif(sum(l), 0), 0) AS share FROM g0),
u AS (SELECT host, tpl, (sum(b) + {PRIOR_WEIGHT}::DOUBLE * any_value(t.share)) / (sum(l) + {PRIOR_WEIGHT}::DOUBLE) AS purity FROM g{DEPTH}, t GROUP BY host, tpl),
v AS (SELECT g.host, {', '.join(f'g.s{i}' for i in range(DEPTH))}, u.purity FROM g{DEPTH} g JOIN u ON g.host = u.host AND g.tpl = u.tpl)
SELECT p.page_id, p.host, p.path, {_RULE_SQL(lambda v, h, q: h + q).replace('host', 'p.host').replace('path', 'p.path')} AS rule,
       coalesce({_RULE_SQL(lambda v, h, q: v).replace('host', 'p.host').replace('path', 'p.path')}, CASE WHEN v.purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN v ON p.host = v.host AND {' AND '.join(f'p.s{i} = v.s{i}' for i in range(DEPTH))}
"""
