"""Removing lines that repeat over many documents (boilerplate, license lines, menus).

Texts are exploded into lines at line feeds. A line's key is the line without ASCII white space at its ends and with
A-Z lower-cased; keys of at least ``min_chars`` code points are hashed (128 bits) and the distinct documents of each
hash counted. The lines of a key that at least ``min_docs`` documents hold are dropped, but for those in the largest
document id that holds it, and the rest of each text is put together again by position. DataFrame functions only.

At scale: only hashes and positions are exploded and shuffled, never lines. A line that a third of all documents hold
is combined on the map side (distinct documents first, then the count); it meets the decided keys in a broadcast
whose bytes were measured, or in a join where its rows are salted. Positions are gathered per text, so a group is at
most the lines of one text, and texts are put together in time linear to their lines. Texts that are too short to
hold a key go past the join.

Defined results: a document is an id; rows that repeat an id count once, all rows of the largest id keep their lines,
and null ids are one document, below all others. Null and empty texts are one empty line. Keys are counted however
often a document repeats them, once. An empty table gives an empty result. Other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import measured_lookup, read, stage

MIN_CHARS, MIN_DOCS = 40, 5
#: The ASCII white space.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _without(text: Column, n_lines: Column, dropped: Column) -> Column:
    """``text`` without the lines at the positions (from 0, sorted) in ``dropped``.

    Flags are built stretch by stretch between dropped positions and zipped with the lines, so that no lambda refers to
    an array from outside and the work is linear.
    """
    edges, ends = F.concat(F.array(F.lit(-1)), dropped), F.concat(dropped, F.array(n_lines.cast("int")))
    stretch = lambda e: F.concat(F.array_repeat(F.lit(True), e["b"] - e["a"] - 1), F.array(F.lit(False)))
    stays = F.flatten(F.transform(F.arrays_zip(edges.alias("a"), ends.alias("b")), stretch))
    return F.array_join(F.array_compact(F.zip_with(F.split(text, "\n"), stays, lambda line, flag: F.when(flag, line))), "\n")


def repeated_lines(docs: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(``key``, t1, t2, dropped): the positions of lines to drop, for each id and text (its two hashes) that has any."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # hashed before the explosion, as what stands beside a generator is computed for each of its rows
    split = docs.where(F.length(text) >= min_chars).select(key, F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit(1), whole).alias("t2"), F.split(whole, "\n").alias("lines"))
    long = split.select(key, "t1", "t2", F.posexplode("lines").alias("pos", "line")).where(F.length("line") >= min_chars)
    keyed = long.withColumn("line", line_key(F.col("line"))).where(F.length("line") >= min_chars)
    lines = stage(keyed.select(key, "t1", "t2", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2")), "line-keys")
    counted = lines.groupBy("h1", "h2").agg(F.count_distinct(F.struct(key)).alias("n"), F.max(key).alias("last"))
    decided = stage(counted.where(F.col("n") >= min_docs).select("h1", "h2", "last"), "line-decided")
    met = measured_lookup(lines, decided, ["h1", "h2"])
    # a set, as rows that repeat an id and text give the same positions
    return met.where(~F.col(key).eqNullSafe(F.col("last"))).groupBy(key, "t1", "t2").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` as it is kept, and ``n_lines`` (before), ``n_dropped``; input columns of these names are replaced."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    at = {c: f"c{i}" for i, c in enumerate(names)}
    k, t = at[key], at[text]
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in at.items()])
    dropped = repeated_lines(rows, k, t, min_chars, min_docs).withColumnsRenamed({k: "k", "t1": "k1", "t2": "k2"})
    whole = F.coalesce(F.col(t), F.lit(""))
    feeds = (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"))) + 1).cast("long")
    long = rows.where(F.length(t) >= min_chars).withColumns({"t1": F.xxhash64(whole), "t2": F.xxhash64(F.lit(1), whole)})
    met = long.join(dropped, F.col(k).eqNullSafe(F.col("k")) & (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")), "left")
    kept = F.when(F.col("dropped").isNull(), F.col(t)).otherwise(_without(F.col(t), feeds, F.col("dropped")))
    own = lambda text: [(text if c == t else F.col(c)).alias(name) for name, c in at.items()]
    out = met.select(*own(kept), feeds.alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
    short = rows.where(F.coalesce(F.length(t), F.lit(0)) < min_chars)
    return out.unionByName(short.select(*own(F.col(t)), feeds.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")))


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat in other documents."""
    out = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'null')) >= 5),
f AS (
  SELECT k.*, m.key IS NOT NULL AND k.doc_id IS DISTINCT FROM m.last AS gone FROM k LEFT JOIN m ON k.key = m.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY rid
"""
