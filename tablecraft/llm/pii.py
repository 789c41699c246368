"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Emails, addresses (ip), payment cards (Luhn) and phone numbers are always kept once their pattern and check
hold. The method adds account numbers (IBAN, of their country's length, confirmed by mod 97) and numbers in the form of US social security
numbers, which no checksum confirms and which therefore need a word such as "ssn" nearby. Every span has a score:
its kind's prior, more with a word of its kind within REACH characters. Added kinds need MIN_SCORE.

Only DataFrame functions on each row by itself: no shuffle, no Python. Patterns are written with possessive
quantifiers, and tied to the start of a run (or the end of the match before), so that a very long run of letters
or digits costs linear time; both leave the leftmost non-overlapping matches as they are.

Defined results: a null text is an empty one and has no spans; repeated rows are scanned each; other columns pass
unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import fresh, read

#: Characters on either side in which words nearby count.
REACH = 40
#: Score that spans of added kinds need, and what a word nearby adds.
MIN_SCORE, NEARBY = 0.7, 0.4


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _between(match: Column, least: int, most: int) -> Column:
    n = F.length(_digits(match))
    return (n >= least) & (n <= most)


def _octets(match: Column) -> Column:
    """Whether all parts are at most 255, whatever their number of digits."""
    return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def mod97(iban: Column) -> Column:
    """Whether an account number leaves the remainder 1."""
    plain = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


BASE = (
    spans.Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    spans.Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets),
    spans.Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda m: _between(m, 14, 19) & F.call_function("luhn_check", _digits(m))),
    spans.Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: _between(m, 10, 15)),
)
ADDED = (
    spans.Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"),  # its head; _account() finds its end
    spans.Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
)
#: Characters of an account number by country, registered or in use without that.
LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
#: Characters that an account number of any other country may have.
LEAST, MOST = 15, 34
#: Each kind's prior score, and the words that speak for it (fixed values).
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
WORDS = {
    "email": "email|e-mail|mail|contact|write", "ip": "ip|address|host|server|login", "card": "card|visa|mastercard|amex|credit|debit|payment",
    "phone": "phone|tel|telephone|call|mobile|fax|cell", "iban": "iban|account|bank|transfer|konto|cuenta|compte", "ssn": "ssn|social security|social-security|taxpayer|tin",
}


def _account(head: Column, paged: Column) -> Column:
    """The span of the account number that begins with ``head``, null if none does.

    Words and numbers may follow, so its end is that of its country's length; without one, the last end that has the remainder 1.
    """
    country, known = F.substring(head["match"], 1, 2), F.create_map(*[F.lit(x) for pair in LENGTHS.items() for x in pair])
    own = F.try_element_at(known, country)
    lengths = F.when(own.isNotNull(), F.array(own)).otherwise(F.sequence(F.lit(MOST), F.lit(LEAST), F.lit(-1)))
    cut = lambda ahead, n: F.regexp_substr(ahead, F.concat(F.lit(r"^[A-Z0-9](?:\x20?[A-Z0-9]){"), (n - 1).cast("string"), F.lit("}(?![A-Za-z0-9])")))
    tried = lambda ahead: F.filter(F.transform(lengths, lambda n: cut(ahead, n)), lambda m: m.isNotNull() & mod97(m))
    matches = F.flatten(F.transform(F.array(spans.stretch(paged, head["start"], F.lit(2 * MOST))), tried))
    span = lambda m: F.struct(head["start"].alias("start"), head["ord"].alias("ord"), head["kind"].alias("kind"), (head["start"] + F.length(m)).alias("end"), m.alias("match"))
    return F.get(F.transform(matches, span), F.lit(0))


def score(span: Column, paged: Column) -> Column:
    """The kind's prior, plus NEARBY if one of its words is within REACH characters; 1 at most. ``paged``: the text's pages."""
    begin = F.greatest(span["start"] - REACH, F.lit(0))
    near = F.concat(spans.stretch(paged, begin, span["start"] - begin), F.lit(" "), spans.stretch(paged, span["end"], F.lit(REACH)))
    out = F.lit(0.0)
    for kind, prior in PRIOR.items():
        lift = F.when(near.rlike(rf"(?i)(?<![A-Za-z])(?:{WORDS[kind]})(?![A-Za-z])"), F.lit(NEARBY)).otherwise(F.lit(0.0))
        out = F.when(span["kind"] == kind, F.least(F.lit(prior) + lift, F.lit(1.0))).otherwise(out)
    return out


def scan(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with the array ``out`` of (start, ord, kind, end, match, score) of all personal data in the text."""
    every, paged = fresh([*docs.columns, out], "_spans"), fresh([*docs.columns, out], "_pages")
    found = spans.find(docs, text, [*BASE, *ADDED], every).withColumn(paged, F.when(F.size(every) > 0, spans.pages(F.col(f"`{text}`"))))
    ended = F.transform(every, lambda s: F.when(s["kind"] == "iban", _account(s, F.col(paged))).otherwise(s))
    found = found.withColumn(every, F.filter(ended, lambda s: s.isNotNull()))
    scored = F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), s["end"].alias("end"), s["match"].alias("match"), score(s, F.col(paged)).alias("score")))
    none = F.filter(scored, lambda s: F.lit(False))
    kept = F.filter(scored, lambda s: (s["ord"] < len(BASE)) | (s["score"] >= MIN_SCORE))
    return found.withColumn(out, F.when(F.size(every) > 0, kept).otherwise(none)).drop(every, paged)


def redact(docs: DataFrame, text: str = "text", mark: str = "[PII]") -> DataFrame:
    """``docs`` with all personal data in ``text`` replaced by ``mark``."""
    at = fresh(docs.columns, "_pii")
    return scan(docs, text, at).withColumn(text, spans.mask(F.col(f"`{text}`"), F.col(at), mark)).drop(at)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    rows = found.select("doc_id", "spans", base.alias("base"))
    return rows.select("doc_id", *[spans.count(F.col("base"), k.name).alias(f"n_{k.name}") for k in BASE], F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"))
