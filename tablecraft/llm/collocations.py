"""Phrase collocations: which phrases of 2 to 4 words hold together more than their parts.

Counting. Texts are cut into pieces at punctuation and line ends, pieces into words. A phrase that occurs ``min_count``
times has no part that occurs less often, so phrases are counted order by order: words first, then only pairs of
frequent words, then triples of frequent pairs, then phrases of four. What is frequent is passed to the next order as a
bitmap of hashes of a fixed size (``filter_bits``). A hash collision lets a rare phrase be counted, never a frequent one
be missed. Phrases are counted by the 64-bit hashes of all their words: a row holds the words before the last one and the
hash of the phrase, from which the last word follows (``last_hash``). The words of the texts are searched for two with the
same hash, so all counts are exact; if two have, the phrases are counted by their words instead (``by_words``). Only
phrases found frequent are spelled, each once, by a lookup of their words.

Streams. The frequent phrases are kept in two orders: by their words (prefix order) and by their words from the last
one (suffix order). In prefix order the beginnings of a phrase stand right before it, so one pass with a stack reads off
the counts of all its beginnings, and for each phrase its most frequent extension by a word to the right; suffix order
gives the endings and the extensions to the left. No table is looked up by hash; at last the two streams are merged.
(A phrase inside any longer candidate is also inside one that is longer by one word and at least as frequent.)

At scale: texts are never shuffled. A task counts blocks of about BLOCK words, adds the counts of its blocks up and
passes on one row per phrase that it has read (more only if these pass HELD_HASHES), and Spark adds these up with its own
aggregation. The streams are range-partitioned by the whole phrase, so a
word that begins a third of all phrases is spread; a range gets the beginnings of its first phrase (at most three) from
the ranges before it. The driver sees the bitmaps only.

Defined results: null language is ``und``, null text empty; every row is a text of its own, so repeated rows count each;
texts of any length are read in slices that overlap by three words; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import measured_lookup, read, small_batches, stage

MIN_COUNT, TOP, WORDS = 30, 2000, 4
#: A phrase goes if a longer one that holds it occurs at least KEEP percent as often.
KEEP = 80
#: Words of a block, bytes of a text that are split at once, log2 of the bits of a filter, phrases of a range.
BLOCK, SLICE, FILTER_BITS, RANGE_ROWS = 1 << 20, 4 << 20, 27, 100_000
#: Phrases, and hashes, that a task adds up over its blocks before it passes them on, and phrases that are cut out at once.
HELD, HELD_HASHES, STEP = 500_000, 1 << 20, 100_000
#: Ends a piece; a byte that UTF-8 never uses.
CUT = b"\xff"
#: A-Z lowered, ends of pieces cut, tabs blanked, everything else kept.
TABLE = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b | 32 if 65 <= b <= 90 else b for b in range(256))

WORD_ROWS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("hash", pa.int64()), ("n", pa.int64())])
HASH_ROWS = pa.schema([*((c, pa.int64()) for c in ("hash", "a", "b", "c", "n"))])
HASH_DDL = "hash long, a long, b long, c long, n long"
PHRASE_ROWS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
STREAM_DDL = "lang string, words array<string>, n long, parts array<long>, longer long"


class _Ids(dict):
    def __missing__(self, word):
        self[word] = at = len(self)
        return at


class Block:
    """Words of one language in order, with cuts between pieces; ``new`` marks those that an earlier slice did not have."""

    def __init__(self, lang: str, words: list[bytes], seen: list[tuple[int, int]]):
        ids = _Ids({CUT: 0})
        self.lang, self.words = lang, words
        self.ids = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        self.kinds = len(ids)
        self.names = list(ids)
        self.new = np.ones(len(words), bool)
        for a, b in seen:
            self.new[a:b] = False
        seed = xxhash.xxh64_intdigest(lang.encode())
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.names), np.uint64, self.kinds)

    def counts(self, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """A position and the number of each distinct phrase of ``order`` words that begins at ``at``; exact, by word ids."""
        code = self.ids[at]
        for k in range(1, order):
            code = np.unique(code * self.kinds + self.ids[at + k], return_inverse=True)[1]
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        return at[first], n


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The words and cuts of a text, slice by slice."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > SLICE:
            # cut behind white space or the end of a piece, whichever comes first
            ends = [e for c in (b" ", b"\t", b".", b"\n", b",") if (e := text.find(c, at + SLICE)) >= 0]
            end = min(ends, default=len(text) - 1) + 1
        yield text[at:end].translate(TABLE).replace(CUT, b" " + CUT + b" ").split()
        at = end


def blocks(batches) -> Iterator[Block]:
    """Blocks of the texts (columns lang, text) of Arrow batches."""
    words, seen, total = defaultdict(list), defaultdict(list), 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            for part in _slices(text):
                words[lang] += part
                total += len(part)
                if total >= BLOCK:
                    yield from (Block(k, w, seen[k]) for k, w in words.items() if w)
                    tail = words[lang][1 - WORDS :]  # the words before the next slice of this text
                    words, seen, total = defaultdict(list), defaultdict(list), 0
                    words[lang] += tail
                    seen[lang].append((0, len(tail)))
            words[lang].append(CUT)
    yield from (Block(k, w, seen[k]) for k, w in words.items() if w)


#: Odd numbers that mix hashes.
SPREAD, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def _longer(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    x = hashes * np.uint64(SPREAD) + more
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(32))


def last_hash(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The last words' hashes of phrases, from the hashes of the phrases and of all their words but the last."""
    x = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(pow(MIX, -1, 1 << 64))
    x = x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(58))
    return x - before * np.uint64(SPREAD)


def alive(block: Block, order: int, filters: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a phrase of ``order`` words may be frequent (and not all of it was seen before), and its hashes.

    ``filters`` are the bitmaps of orders 1, 2, ...; they may end before ``order``.
    """
    by_word = block.hashes[block.ids]
    at, hashes = block.ids != 0, by_word
    for k in range(1, order + 1):
        if k > 1:
            at = at[:-1] & at[1:]
            hashes = _longer(hashes[:-1], by_word[k - 1 :])
        if k <= len(filters):
            bit = hashes >> np.uint64(64 - bits)
            at = at & ((filters[k - 1][(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    at = np.flatnonzero(at & block.new[order - 1 :])
    return at, hashes[at]


def _word_rows(batches):
    for b in blocks(batches):
        n = np.bincount(b.ids[b.new], minlength=b.kinds)[1:]
        met = np.flatnonzero(n)
        names = [None, *(b.names[i + 1] for i in met)]  # no word: the number of all words
        cols = [pa.array([b.lang] * len(names)), pa.array(names, pa.binary()).cast(pa.string()), pa.array(np.concatenate([[0], b.hashes[met + 1].view(np.int64)])), pa.array(np.concatenate([[n.sum()], n[met]]))]
        yield pa.RecordBatch.from_arrays(cols, schema=WORD_ROWS)


def _added(counts: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows (hash, then the words before the last) of several counts, and their sums; equal first words in a row.

    Rows are sorted by halves of two columns, so one may come more than once where these halves do not tell it apart.
    """
    columns = [np.concatenate(c) for c in zip(*(c for c, _ in counts))]
    by = np.argsort((columns[1] & np.uint64(0xFFFFFFFF << 32)) | (columns[0] >> np.uint64(32)))
    columns = [c[by] for c in columns]
    new = np.ones(len(by), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(np.concatenate([n for _, n in counts])[by], at) if len(at) else np.zeros(0, np.int64)


def _hash_rows(order: int, filters, bits: int):
    def batch(columns, n):
        columns = [pa.array(c.view(np.int64)) for c in columns] + [pa.nulls(len(n), pa.int64())] * (WORDS - order)
        return pa.RecordBatch.from_arrays([*columns, pa.array(n)], schema=HASH_ROWS)

    def run(batches):
        maps = [np.frombuffer(f.value, np.uint8) for f in filters]
        held = []
        for b in blocks(batches):
            at, hashes = alive(b, order, maps, bits)
            held.append(_added([([hashes, *(b.hashes[b.ids[at + k]] for k in range(order - 1))], np.ones(len(at), np.int64))]))
            if sum(len(n) for _, n in held) >= HELD_HASHES:
                held = [_added(held)]
                if 2 * len(held[0][1]) >= HELD_HASHES:
                    yield batch(*held.pop())
        if held:
            yield batch(*_added(held))

    return run


def _word_hashes(order: int):
    """The hashes of all words of phrases from HASH_ROWS."""

    def run(batches):
        for b in batches:
            phrase, *heads = (b.column(c).to_numpy().view(np.uint64) for c in ("hash", "a", "b", "c")[:order])
            before = heads[0]
            for more in heads[1:]:
                before = _longer(before, more)
            flat = np.stack([*heads, last_hash(phrase, before)], axis=1).ravel().view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, order, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([lists, b.column("n")], names=["hashes", "n"])

    return run


def _phrase_batches(held: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
    for lang, counts in held.items():
        phrases = list(counts)
        for i in range(0, len(phrases), STEP):
            some = phrases[i : i + STEP]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([counts[p] for p in some], pa.int64())], schema=PHRASE_ROWS)


def _phrase_rows(filters, bits: int):
    def run(batches):
        maps = [np.frombuffer(f.value, np.uint8) for f in filters]
        held: dict[str, dict[bytes, int]] = defaultdict(dict)
        for b in blocks(batches):
            for order in range(2, WORDS + 1):
                at, n = b.counts(alive(b, order, maps, bits)[0], order)
                for i in range(0, len(at), STEP):
                    counts = held[b.lang]
                    for k, x in zip(at[i : i + STEP].tolist(), n[i : i + STEP].tolist()):
                        phrase = b" ".join(b.words[k : k + order])
                        counts[phrase] = counts.get(phrase, 0) + x
                    if sum(map(len, held.values())) >= HELD:
                        yield from _phrase_batches(held)
                        held.clear()
        yield from _phrase_batches(held)

    return run


def bitmap(hashes: DataFrame, bits: int) -> bytes:
    """The bits that the hashes (column hash) set by their first ``bits`` bits: 2**bits / 8 bytes, whatever the table holds."""
    slot = F.shiftrightunsigned("hash", 64 - bits) + 1
    rows = hashes.groupBy(F.call_function("bitmap_bucket_number", slot).alias("bucket")).agg(F.bitmap_construct_agg(F.call_function("bitmap_bit_position", slot)).alias("bits")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        start = (r["bucket"] - 1) * 4096
        out[start : start + 4096] = np.frombuffer(r["bits"], np.uint8)[: len(out) - start]
    return out.tobytes()


def shared_hash(words: DataFrame) -> bool:
    """Whether two of the distinct ``words`` (column hash) have the same hash."""
    return not words.groupBy("hash").count().where("count > 1").isEmpty()


def by_words(docs: DataFrame, filters: list, min_count: int, filter_bits: int) -> DataFrame:
    """Frequent phrases of 2 words and more (lang, words, n) that pass the filters, counted by their words."""
    phrases = docs.mapInArrow(_phrase_rows(filters, filter_bits), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return phrases.where(F.col("n") >= min_count).select("lang", F.split("phrase", " ").alias("words"), "n")


def spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, words, n) of ``phrases`` (hashes, n) by ``words`` (hash, lang, word), which has each of their words once."""
    each = phrases.select("hashes", "n", F.posexplode("hashes").alias("at", "hash"))
    found = measured_lookup(each, words, ["hash"]).groupBy("hashes", "n").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    return found.select("lang", F.col("words.word").alias("words"), "n")


def frequent(docs: DataFrame, min_count: int = MIN_COUNT, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """From (lang, text): frequent phrases of 1 to 4 words (lang, words, n), and the number of words by language (lang, total)."""
    spark: SparkSession = docs.sparkSession
    send = spark.sparkContext.broadcast
    many = F.col("n") >= min_count
    with small_batches(spark):
        met = stage(docs.mapInArrow(_word_rows, "lang string, word string, hash long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.min("hash").alias("hash")), "collocations-words")
        every, words = met.where("word IS NOT NULL"), met.where(F.col("word").isNotNull() & many)
        clash = shared_hash(every)
        filters, phrases = [send(bitmap(words, filter_bits))], []
        for order in range(2, WORDS if clash else WORDS + 1):
            counts = docs.mapInArrow(_hash_rows(order, list(filters), filter_bits), HASH_DDL).groupBy("hash", "a", "b", "c").agg(F.sum("n").alias("n"))
            found = stage(counts.where(many), f"collocations-{order}")
            phrases.append(found.mapInArrow(_word_hashes(order), "hashes array<long>, n long"))
            if order < WORDS:
                filters.append(send(bitmap(found, filter_bits)))
        longer = by_words(docs, filters, min_count, filter_bits) if clash else spelled(reduce(DataFrame.unionByName, phrases), words.select("hash", "lang", "word"))
        single = words.select("lang", F.array("word").alias("words"), "n")
        result = stage(single.unionByName(longer), "collocations-phrases")
    for f in filters:
        f.unpersist()
    return result, met.where("word IS NULL").select("lang", F.col("n").alias("total"))


def _lockstep(pdf: pd.DataFrame) -> pd.DataFrame:
    """One range of a stream, in order: for each phrase the counts of its beginnings, and its most frequent extension."""
    rows = sorted(zip(pdf["lang"], map(tuple, pdf["words"]), pdf["n"].tolist(), pdf["carried"].tolist()))
    out, open_ = [], []  # open_: the rows that begin the present one, shortest first, as indexes into out
    for lang, words, n, carried in rows:
        while open_ and (out[open_[-1]][0] != lang or words[: len(out[open_[-1]][1])] != out[open_[-1]][1]):
            open_.pop()
        if open_ and len(words) == len(out[open_[-1]][1]) + 1:
            out[open_[-1]][4] = max(out[open_[-1]][4], n)
        parts = None if carried else [out[i][2] for i in open_]
        open_.append(len(out))
        out.append([lang, words, n, parts, 0])
    return pd.DataFrame({"lang": [r[0] for r in out], "words": [list(r[1]) for r in out], "n": [r[2] for r in out], "parts": [r[3] for r in out], "longer": [r[4] for r in out]})


def stream(phrases: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``phrases`` (lang, words, n) in the order of their words, with the counts of all beginnings (``parts``, shortest first)
    and of the most frequent extension by one word (``longer``, 0 without one). A beginning that other ranges extend has a
    row for each of them, without ``parts``."""
    ranges = max(1, -(-phrases.count() // range_rows))
    placed = stage(phrases.repartitionByRange(ranges, "lang", "words").withColumn("at", F.spark_partition_id()), "collocations-stream")
    first = placed.groupBy("at").agg(F.min(F.struct("lang", "words")).alias("first"))
    lengths = F.sequence(F.lit(1), F.size("first.words") - 1)
    begun = first.where(F.size("first.words") > 1).select("at", "first.lang", F.explode(F.transform(lengths, lambda k: F.slice("first.words", 1, k))).alias("words"))
    # three rows a range at most
    carried = placed.drop("at").join(F.broadcast(begun), ["lang", "words"]).select("at", "lang", "words", "n", F.lit(True).alias("carried"))
    rows = placed.select("at", "lang", "words", "n", F.lit(False).alias("carried")).unionByName(carried)
    return rows.groupBy("at").applyInPandas(_lockstep, STREAM_DDL)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT, top: int = TOP, keep: int = KEEP,
                 filter_bits: int = FILTER_BITS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """lang, rank, phrase, a (its count), l and r (its parts at the weakest cut), n (words of the language), score."""
    named = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    phrases, totals = frequent(named, min_count, filter_bits)
    before = stream(phrases, range_rows).withColumnRenamed("parts", "left").withColumn("right", F.lit(None).cast("array<long>"))
    behind = stream(phrases.withColumn("words", F.reverse("words")), range_rows).withColumnRenamed("parts", "right").withColumns({"left": F.lit(None).cast("array<long>"), "words": F.reverse("words")})
    merged = before.unionByName(behind).groupBy("lang", "words").agg(*[F.max(c).alias(c) for c in ("n", "left", "right", "longer")])
    wide = lambda c: c.cast("decimal(20,0)")
    score = lambda x: F.call_function("div", wide(F.col("n")) * F.lit(2_000_000).cast("decimal(7,0)"), wide(x["l"]) + wide(x["r"])).cast("long")
    cuts = F.transform(F.arrays_zip(F.col("left").alias("l"), F.reverse("right").alias("r")), lambda x, k: F.struct(score(x).alias("score"), k.alias("k"), x["l"].alias("l"), x["r"].alias("r")))
    own = F.lit(100) * wide(F.col("longer")) < F.lit(keep) * wide(F.col("n"))
    scored = merged.where((F.size("words") > 1) & own).select("lang", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), F.array_min(cuts).alias("cut"))
    flat = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    return measured_lookup(best, totals, ["lang"]).select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """The best phrases of every language in ``documents``."""
    return collocations(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
t AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM p, (VALUES (1), (2), (3), (4)) o(m))
  GROUP BY lang, m, phrase HAVING count(*) >= 30),
s AS (
  SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
c AS (
  SELECT lang, phrase, f AS a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp FROM s, (VALUES (1), (2), (3)) o(k) WHERE k < m),
x AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, c.k, CAST(2000000::HUGEINT * c.a // (l.f::HUGEINT + r.f) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = c.lp JOIN f r ON r.lang = c.lang AND r.phrase = c.rp),
b AS (
  SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
e AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, f, unnest(list_transform(range(1, m - j + 2), lambda i: array_to_string(ws[i:i + j - 1], ' '))) AS phrase FROM s, (VALUES (2), (3)) o(j) WHERE j < m)
  GROUP BY lang, phrase),
o AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN e ON e.lang = b.lang AND e.phrase = b.phrase WHERE e.f IS NULL OR 100::HUGEINT * e.f < 80::HUGEINT * b.a)
SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, t.n, o.score FROM o JOIN t ON t.lang = o.lang WHERE o.rank <= 2000
"""
