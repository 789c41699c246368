"""How far the sources of a language are apart in their words.

Terms are runs of letters (A-Z in either case, and everything beyond ASCII). A translate table lowers letters and
blanks all separators of a text's bytes in one pass, ``bytes.split`` gives the terms and a Counter per document their
frequencies. Counts are summed sparsely: a task adds up its documents by (language, source), Spark the tasks.

Each language keeps the terms that enough of its documents hold (V of them). A group (a source of a language, or the
language as a whole) with N occurrences of kept terms gives each of them p = 1 + floor(10**9 * (count + 2) / (N + 2V)),
also those it does not hold. The triangular discrimination of two groups sums floor((p - q)**2 / (p + q)) over the kept
terms; it is reported for every pair of sources of a language, and term by term against the whole language.

At scale: partial counts are shuffled by (language, term), where a term has one row per source and flush. Pairs are
computed on blocks of terms and tiles of sources as integer matrices, so a task holds BLOCK_TERMS x TILE numbers
twice, whatever the tables hold, and gives one sum per pair; the result itself has a row per pair of sources.

Defined results: null language, source or text is ''; a document is a row, so repeated rows count each; groups without
terms take part with counts of 0; a language without kept terms has pairs of value 0 and no terms; texts of any length
are read in slices; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import measured_lookup, read, small_batches, stage

MIN_DOCS, TOP_TERMS = 10, 10
#: Terms a task holds before it passes them on; bytes of a text that are split at once.
FLUSH_TERMS, SLICE = 300_000, 4 << 20
#: Terms and sources of one matrix.
BLOCK_TERMS, TILE = 4096, 64
#: Letters lowered, other ASCII blanked, bytes beyond ASCII kept.
TABLE = bytes(b if b >= 128 else b | 32 if chr(b).isalpha() else 32 for b in range(256))

PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
PARTIAL_DDL = "lang string, source string, term string, n long, docs long"
SUMS_DDL = "lang string, a int, b int, part long, seen long"


def count_terms(text: bytes) -> Counter:
    """The terms of one document and their frequencies."""
    clean, out, at = text.translate(TABLE), Counter(), 0
    while at < len(clean):
        end = len(clean) if len(clean) - at <= SLICE else clean.find(b" ", at + SLICE)
        end = len(clean) if end < 0 else end
        out.update(clean[at:end].split())
        at = end
    return out


def _partials(batches):
    """Terms with their frequency and document frequency by (lang, source); a row without term for each group met."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def flush():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            cols = [pa.array([lang] * (len(terms) + 1)), pa.array([source] * (len(terms) + 1)), pa.array([None, *terms], pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, terms)], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, schema=PARTIAL)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found = count_terms(text)
            n.update(found)
            docs.update(found.keys())
            if sum(len(x) for x, _ in held.values()) >= FLUSH_TERMS:
                yield from flush()
    yield from flush()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, all_n): kept terms with their counts in the source and the language; a row with null term per group."""
    named = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(as_) for c, as_ in ((lang, "lang"), (source, "source"), (text, "text"))])
    # one exchange by (lang, term) serves the sums by source and the sums over all sources
    sums = named.mapInArrow(_partials, PARTIAL_DDL).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    rows = sums.withColumns({"all_n": F.sum("n").over(term), "all_docs": F.sum("docs").over(term)})
    return rows.where(F.col("term").isNull() | (F.col("all_docs") >= min_docs)).select("lang", "source", "term", "n", "all_n")


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a term with ``n`` of ``total`` occurrences among ``terms`` kept terms."""
    top = (n.cast("decimal(20,0)") + F.lit(2)) * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", top, total.cast("decimal(20,0)") + terms.cast("decimal(20,0)") * F.lit(2)).cast("long")


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _matrix(cells: pd.DataFrame, base: pd.DataFrame, terms: pd.Index) -> tuple[np.ndarray, np.ndarray]:
    """Sources (sorted) and their shares by term: that of an absent term, unless a cell says otherwise."""
    base = base.sort_values("idx")
    m = np.repeat(base["p"].to_numpy(np.int64)[:, None], len(terms), axis=1)
    m[np.searchsorted(base["idx"].to_numpy(), cells["idx"].to_numpy()), terms.get_indexer(cells["term"])] = cells["p"].to_numpy(np.int64)
    return base["idx"].to_numpy(), m


def _block(tile: int):
    """One block of terms and two tiles of sources: the sum over its terms for each pair of sources."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        cells, base = pdf[pdf["term"].notna()], pdf[pdf["term"].isna()]
        terms = pd.Index(cells["term"].unique())
        of = lambda f, t: f[f["idx"] // tile == t]
        rows, left = _matrix(of(cells, i), of(base, i), terms)
        cols, right = _matrix(of(cells, j), of(base, j), terms)
        out = []
        for a, p in zip(rows, left):
            ahead = cols > a
            if ahead.any() and len(terms):
                q = right[ahead]
                out.append((np.full(len(q), a), cols[ahead], ((p - q) ** 2 // (p + q)).sum(axis=1)))
        if not out:
            return pd.DataFrame({c: [] for c in ("lang", "a", "b", "part", "seen")})
        a, b, part = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "a": a, "b": b, "part": part, "seen": len(terms)})

    return run


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block_terms: int = BLOCK_TERMS, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: every pair of sources, and the terms a source has more of than its language."""
    spark = docs.sparkSession
    with small_batches(spark):
        counts = stage(term_counts(docs, lang, source, text, min_docs), "divergence-counts")
    terms = counts.where("term IS NOT NULL")
    whole = terms.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_distinct("term").alias("v"))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(whole, "lang", "left").fillna(0, ["lang_n", "v"])
    groups = stage(groups.withColumn("idx", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "divergence-groups")
    p = share(F.col("n"), F.col("total"), F.col("v"))
    cells = stage(measured_lookup(terms, groups, ["lang", "source"]).select("lang", "source", "idx", "term", "v", p.alias("p"), share(F.col("all_n"), F.col("lang_n"), F.col("v")).alias("q")), "divergence-cells")

    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    high = ranked(cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))).where(F.col("rank") <= top)

    # groups in the matrices: (lang, block of terms, tile i, tile j with i <= j); every source is in each with its share of an absent term
    base = groups.where("v > 0").select("lang", "idx", F.lit(None).cast("string").alias("term"), "v", share(F.lit(0), F.col("total"), F.col("v")).alias("p"))
    tiles = groups.groupBy("lang").agg(F.floor(F.max("idx") / tile).alias("tiles"))
    blocks = F.ceil(F.col("v") / block_terms)
    in_block = cells.select("lang", "idx", "term", "v", "p", F.pmod(F.xxhash64("term"), blocks).alias("block"))
    in_all = base.select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    rows = measured_lookup(in_block.unionByName(in_all), stage(tiles, "divergence-tiles"), ["lang"])
    own = F.floor(F.col("idx") / tile)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles")))).select("lang", "block", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), "idx", "term", "p")
    sums = rows.groupBy("lang", "block", "i", "j").applyInPandas(_block(tile), SUMS_DDL).groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"))

    side = lambda n: groups.select("lang", "v", F.col("source").alias(f"s{n}"), F.col("idx").alias(f"x{n}"), F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))).alias(f"p{n}"))
    pairs = side(1).join(side(2).drop("v"), "lang").where("x1 <> x2").withColumns({"a": F.least("x1", "x2"), "b": F.greatest("x1", "x2")}).join(sums, ["lang", "a", "b"], "left")
    # terms that neither tile holds differ by the shares of absent terms
    absent = (F.col("v") - F.coalesce("seen", F.lit(0))) * F.coalesce(apart(F.col("p1"), F.col("p2")), F.lit(0))
    value = F.coalesce("part", F.lit(0)) + absent
    far = ranked(pairs.select("lang", F.col("s1").alias("source"), F.lit("pair").alias("part"), F.col("s2").alias("item"), value.alias("value")))
    return far.unionByName(high)


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    """Every source of ``documents`` against the other sources of its language, and its most distinctive terms."""
    return audit(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS body FROM documents),
t AS (
  SELECT rid, lang, source, translate(unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (
  SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
v AS (
  SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
c AS (
  SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term),
g AS (
  SELECT x.lang, x.source, coalesce(sum(c.c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c ON x.lang = c.lang AND x.source = c.source GROUP BY x.lang, x.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         CAST(1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (g.n + 2 * v.v) AS HUGEINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (k.c + 2)) // (v.n + 2 * v.v) AS HUGEINT) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE c > 0 AND p > q),
o AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
"""
