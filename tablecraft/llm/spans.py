"""Spans of regular expressions in whole texts, with DataFrame functions only.

Spark has no function for the places of all matches. They follow from two that it has: the matches and the gaps
between them (``split`` with the same pattern), whose lengths sum up to every start and end. Places count code
points from 0, ends are exclusive. Gaps are only computed for texts with a match that is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Characters of a page, and elements of a block, as powers of 2.
PAGE, BLOCK = 9, 8
SPAN = "struct<start:int,ord:int,kind:string,end:int,match:string>"


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern (must not match the empty string) and which matches are kept."""

    name: str
    pattern: str
    keep: Callable[[Column], Column] = lambda match: F.lit(True)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where a function of an array's elements needs it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of ints, what ``step`` makes of 0 and the elements before it."""
    empty = F.expr("cast(array() as array<int>)")
    begin = lambda at: F.struct(at.alias("at"), empty.alias("out"))
    note = lambda acc, at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    along = lambda block, head: F.aggregate(block, begin(head), lambda acc, x: note(acc, step(acc["at"], x)), lambda acc: acc["out"])
    heads = lambda blocks: F.aggregate(blocks, begin(F.lit(0)), lambda acc, block: note(acc, F.aggregate(block, acc["at"], step)), lambda acc: acc["out"])
    numbers = lambda v: F.sequence(F.lit(0), F.greatest(F.shiftright(F.size(v) - 1, BLOCK), F.lit(0)))
    cut = lambda v: F.transform(numbers(v), lambda b: F.slice(v, F.shiftleft(b, BLOCK) + 1, F.lit(1 << BLOCK)))
    return once(values, lambda v: once(cut(v), lambda blocks: F.flatten(F.zip_with(blocks, heads(blocks), along))))


def pages(text: Column) -> Column:
    """A text as an array of strings of one length, for ``stretch``."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{1 << PAGE}}}"), F.lit(0))


def stretch(paged: Column, start: Column, length: Column) -> Column:
    """``length`` characters of a text from ``start`` on, from its pages."""
    first = F.shiftright(start, PAGE)
    some = F.slice(paged, first + 1, F.shiftright(start + length - 1, PAGE) - first + 1)
    return F.substring(F.array_join(some, ""), start - F.shiftleft(first, PAGE) + 1, length)


def _placed(text: Column, matches: Column, kind: Kind, order: int) -> Column:
    """The kept matches as an array of SPAN."""
    pairs = F.arrays_zip(F.slice(F.split(text, kind.pattern, -1), 1, F.size(matches)).alias("gap"), matches.alias("match"))
    span = lambda start, match: F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind.name).alias("kind"), (start + F.length(match)).alias("end"), match.alias("match"))
    before = lambda p: running(F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["match"])), lambda at, n: at + n)
    found = once(pairs, lambda p: F.zip_with(before(p), p, lambda at, x: span(at + F.length(x["gap"]), x["match"])))
    return F.when(F.exists(matches, kind.keep), F.filter(found, lambda s: kind.keep(s["match"]))).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def find(docs: DataFrame, text: str, kinds: Sequence[Kind], out: str) -> DataFrame:
    """``docs`` with ``out``: the spans of all kinds, by start, then in the order of ``kinds``. Null text: none."""
    names = [fresh([*docs.columns, out], f"_match{i}") for i in range(len(kinds))]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.withColumns({n: F.regexp_extract_all(whole, F.lit(k.pattern), F.lit(0)) for n, k in zip(names, kinds, strict=True)})
    rows = rows.withColumns({n: _placed(whole, F.col(n), k, i) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})
    return rows.withColumn(out, F.sort_array(F.concat(*names))).drop(*names)


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def mask(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with every stretch that spans cover replaced by ``mark``; null text stays null."""
    ends = F.transform(spans, lambda s: s["end"])
    piece = lambda paged, at, s: F.when(s["start"] >= at, F.concat(stretch(paged, at, s["start"] - at), F.lit(mark))).otherwise("")
    clean = lambda paged: F.array_join(F.zip_with(running(ends, lambda at, end: F.greatest(at, end)), spans, lambda at, s: piece(paged, at, s)), "")
    masked = once(pages(text), lambda paged: F.concat(clean(paged), stretch(paged, F.array_max(ends), F.length(text))))
    return F.when(F.size(spans) > 0, masked).otherwise(text)
