"""Mixing sources to target weights by systematic sampling.

Every source has a weight and a size (the sum of its documents' sizes). Its target is its share of the mix by
weight, at most ``cap`` times its size; what a capped source cannot take is shared again by weight. Each
document of a source expects ``target / source size`` copies. These expectations are prefix-summed in a fixed
order, one random offset for the source is added, and the document is emitted once for every integer boundary
that its interval crosses. So copies differ by at most one within a source, and as the order goes by classes of
size (an eighth of a power of two wide), words taken stay near the target as well.

At scale: a prefix sum needs a rank within the source, and one source may hold a third of all rows. Rows are
therefore dealt into blocks (source, size class, range of the hashed id) of about ``block_rows`` rows. A block that
holds several times as many, as an id repeats in many rows, is cut further by a hash of whole rows. Ranks are counted
inside a block, and blocks are offset by a running sum over one row per block.

Defined results: null or empty sources form a source each, the null one sorts last; null sizes count as 0; a
source of size 0 has target 0 and takes nothing; rows with the same id are told apart by size, then by a hash of all
their columns (but maps), so reruns agree, and identical rows share their copies in any order; an empty table gives an empty mix; all other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, lookup, read, stage

#: A word is a run of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
BLOCK_ROWS = 1024
#: A block of so many times its rows is cut; blocks of ids that differ never come near it.
LARGE = 4
RESULT = ("size", "source_size", "target", "copies")


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hex32(digest: Column) -> Column:
    """The first 8 hex digits of a digest as a number below 2**32."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")


def _size_class(size: Column) -> Column:
    """A number that grows with ``size`` and keeps its four leading bits."""
    shift = F.greatest(F.length(F.bin(size)) - 4, F.lit(0))
    return (shift * 16 + F.floor(size / F.pow(F.lit(2.0), shift))).cast("long")


def targets(sources: DataFrame, key: str, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Add ``target`` to one row per source (``key``, ``source_size``).

    Weights repeat over the sources in the order of ``key``. The level at which sources fill is found in
    closed form: sorted by cap over weight, the first source that stays below its cap fixes it.
    """
    order = Window.orderBy(key)
    whole = Window.partitionBy()
    fill = Window.orderBy("_ratio", key).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(fill), F.lit(0.0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("_w", weight).withColumn("_cap", F.lit(float(cap)) * F.col("source_size").cast("double"))
    rows = rows.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    rest = F.lit(float(share)) * F.sum("source_size").over(whole).cast("double") - before("_cap")
    rows = rows.withColumn("_level", rest / (F.sum("_w").over(whole) - before("_w")))
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(whole)
    rows = rows.withColumn("_level", level)
    capped = F.col("_level").isNull() | (F.col("_ratio") < F.col("_level"))
    target = F.when(capped, F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w")))
    return rows.select(*sources.columns, target.alias("target"))


def plan(docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` (its source's) and ``copies`` (how often it is taken).

    Input columns of these names are replaced.
    """
    s, c, t, n, b = (fresh([*docs.columns, *RESULT], x) for x in ("_src", "_class", "_tie", "_size", "_block"))
    rate, start, before, parts = (fresh([*docs.columns, *RESULT], x) for x in ("_rate", "_start", "_before", "_parts"))
    whole, cut, cuts = (fresh([*docs.columns, *RESULT], x) for x in ("_whole", "_cut", "_cuts"))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    base = docs.withColumn(n, F.coalesce(size.cast("long"), F.lit(0)))
    base = base.withColumns({
        s: F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("t")),
        c: _size_class(F.col(n)),
        t: F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))),
        whole: F.xxhash64(*hashed),
    })
    narrow = stage(base.select(s, c, t, n, whole), "mix-sizes")
    classes = stage(narrow.groupBy(s, c).agg(F.count("*").alias("_rows"), F.sum(n).alias("_sum")), "mix-classes")
    sources = classes.groupBy(s).agg(F.sum("_sum").alias("source_size"))
    goal = targets(sources, s, weights, share, cap)
    split = stage(classes.select(s, c, F.ceil(F.col("_rows") / block_rows).cast("double").alias(parts)), "mix-parts")
    block = F.floor(_hex32(F.col(t)) * F.col(parts) / F.lit(4294967296.0)).cast("long")

    placed = lookup(narrow, split, [s, c]).withColumn(b, block)
    large = stage(placed.groupBy(s, c, b).count().where(F.col("count") > LARGE * block_rows).select(s, c, b, F.ceil(F.col("count") / block_rows).cast("long").alias(cuts)), "mix-large")
    some = bool(large.take(1))

    def dealt_out(rows: DataFrame) -> DataFrame:
        """Rows with their block, and its cut."""
        if not some:
            return rows.withColumn(cut, F.lit(0).cast("long"))
        rest = rows.join(large, [s, c, b], "left_anti").withColumn(cut, F.lit(0).cast("long"))
        return rest.unionByName(lookup(rows, large, [s, c, b]).withColumn(cut, F.pmod(F.col(whole), F.col(cuts))).drop(cuts))

    counts = dealt_out(placed).groupBy(s, c, b, cut).count()
    running = Window.partitionBy(s).orderBy(c, b, cut).rowsBetween(Window.unboundedPreceding, -1)
    u = _hex32(F.md5(F.concat(F.lit(seed), F.col(s)))) / F.lit(4294967296.0)
    blocks = counts.withColumn(before, F.coalesce(F.sum("count").over(running), F.lit(0))).join(goal, s).select(
        s, c, b, cut, before, "source_size", "target", u.alias(start),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias(rate),
    )
    keep = [x for x in docs.columns if x not in RESULT]
    dealt = dealt_out(lookup(base.drop(*RESULT), split, [s, c]).withColumn(b, block))
    ranked = dealt.join(stage(blocks, "mix-blocks"), [s, c, b, cut])
    rank = F.row_number().over(Window.partitionBy(s, c, b, cut).orderBy(t, n, whole)) + F.col(before)
    edge = lambda r: F.floor(F.col(rate) * r.cast("double") + F.col(start))
    return ranked.withColumn(before, rank).select(
        *[F.col(f"`{x}`") for x in keep], F.col(n).alias("size"), "source_size", "target",
        (edge(F.col(before)) - edge(F.col(before) - 1)).cast("long").alias("copies"),
    )


def mix(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as it is taken, with its own columns only."""
    names = [fresh(docs.columns, f"_{x}") for x in RESULT]
    renamed = docs.select(*[F.col(f"`{x}`").alias(f"c{i}") for i, x in enumerate(docs.columns)])
    at = {x: f"c{i}" for i, x in enumerate(docs.columns)}
    taken = plan(renamed, word_count(F.col(at[text])), source=at["source"], key=at["doc_id"], **options)
    out = taken.where("copies > 0").withColumn(names[0], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(at[x]).alias(x) for x in docs.columns])


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: what each one gives to it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    taken = plan(stage(docs, "mix-documents"), F.col("words"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS tie,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
c AS (
  SELECT *, greatest(length(bin(size)) - 4, 0) AS sh FROM d),
k AS (
  SELECT s, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY s),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY s) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         2.0::DOUBLE * source_size AS cap FROM k),
r AS (
  SELECT *, cap / w AS ratio FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS lv
  FROM r WINDOW f AS (ORDER BY ratio, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (
  SELECT *, max(CASE WHEN lv <= ratio THEN lv END) OVER () AS lev FROM l),
g AS (
  SELECT s, source_size, CASE WHEN lev IS NULL OR ratio < lev THEN cap ELSE least(cap, lev * w) END AS target,
         CAST('0x' || substr(md5('mix-1' || s), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM m),
n AS (
  SELECT c.doc_id, c.size, g.source_size, g.target, g.u,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST(row_number() OVER (PARTITION BY c.s ORDER BY c.sh * 16 + (c.size >> c.sh), c.tie, c.size) AS DOUBLE) AS i
  FROM c JOIN g ON c.s = g.s)
SELECT doc_id, size, source_size, target, CAST((floor(rate * i + u) - floor(rate * (i - 1) + u)) AS BIGINT) * size AS taken FROM n
"""
