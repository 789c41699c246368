"""Secret scans: fixed patterns, and character Markov models for strings that no pattern knows.

Assignments, access keys and long hex strings are found by pattern. Other secrets are runs of 20 or more token
characters holding letters and digits that look random: two Markov models of the first order, one of random
strings, one of ordinary identifiers, are trained on labelled samples, and a run is a secret when its
log-likelihood ratio reaches THRESHOLD. Runs that spans of patterns cover completely are left to them.

Training is a group-by over the samples' character pairs; the model is a table of ALPHABET ** 2 ratios whatever
the sample. Scanning is a chain of DataFrame functions over each row by itself: no shuffle, no Python.

Defined results: a null text is an empty one and has no spans; masking leaves a null text null; repeated rows are
scanned each; other columns pass unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .common import fresh, read

ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = (
    spans.Kind("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
    spans.Kind("access", r"AKIA[A-Z0-9]{12,}"),
    spans.Kind("hex", r"[0-9a-f]{32,}"),
)
#: Characters are numbered by their ASCII code; all others share the last number.
ALPHABET = 128
#: A run's log-likelihood ratio from which it counts as random.
THRESHOLD = 14.0
#: Added to each pair's count.
SMOOTHING = 0.5
#: Labelled samples that default_samples() makes of each class.
SAMPLES = 4000
#: Words of which ordinary identifiers are made (fixed values).
WORDS = "get set list map index value count user name file path data table row column key item node parent child first last next update delete create insert select query result error message request response server client handler manager factory service config option default buffer stream reader writer parser token string number date time zone event state action render layout widget button window image color width height model view controller test main util helper common base abstract interface public private static final version release build branch commit merge source target input output module package import export session account order customer product price total report summary article news page content author category language".split()


def default_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """Labelled samples (token, random): digests in several alphabets, and identifiers joined in several styles."""
    i = F.col("id")
    digest = F.sha2(F.concat(F.lit("sample"), i.cast("string")), 256)
    base64 = F.translate(F.base64(F.unhex(digest)), "=", "")
    size = (F.lit(20) + F.pmod(i, F.lit(21))).cast("int")
    text = F.element_at(F.array(base64, F.translate(base64, "+/", "-_"), F.lower(base64), F.upper(base64), digest), (F.pmod(F.floor(i / 21), F.lit(5)) + 1).cast("int"))
    random = spark.range(n).select(F.substring(text, F.lit(1), size).alias("token"), F.lit(True).alias("random"))
    words = F.split(F.lit(" ".join(WORDS)), " ")
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    four = F.array(*[pick(k) for k in range(4)])
    caps = F.transform(four, F.initcap)
    number = F.pmod(F.xxhash64(i, F.lit(9)), F.lit(10000)).cast("string")
    styles = [
        F.concat(F.array_join(four, "_"), F.lit("_"), number), F.array_join(four, "-"), F.array_join(caps, ""),
        F.concat(pick(0), F.array_join(F.slice(caps, 2, 3), ""), number), F.concat(F.array_join(four, "/"), F.lit("/"), number),
        F.upper(F.array_join(four, "_")), F.array_join(four, ""),
    ]
    plain = spark.range(n).select(F.element_at(F.array(*styles), (F.pmod(i, F.lit(len(styles))) + 1).cast("int")).alias("token"), F.lit(False).alias("random"))
    return random.unionByName(plain)


def _code(char: Column) -> Column:
    """A character's number; 0 is kept for the place before the first character."""
    return F.least(F.ascii(char), F.lit(ALPHABET - 1))


def _chars(token: Column) -> Column:
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), _code)


def train(samples: DataFrame, smoothing: float = SMOOTHING) -> list[float]:
    """Log ratios of P(next | previous) under the two models, at previous * ALPHABET + next.

    ``samples``: token, random. The table has ALPHABET ** 2 entries however many samples there are.
    """
    codes = samples.where("token IS NOT NULL AND random IS NOT NULL").select("random", F.concat(F.array(F.lit(0)), _chars(F.col("token"))).alias("c"))
    steps = F.transform(F.slice(F.col("c"), 2, F.greatest(F.size("c") - 1, F.lit(0))), lambda x, i: F.element_at("c", i + 1) * ALPHABET + x)
    rows = codes.select("random", F.explode(steps).alias("step")).groupBy("random", "step").count().collect()
    counts = {(r["random"], r["step"]): r["count"] for r in rows}
    used = sorted({s % ALPHABET for _, s in counts})
    table = [0.0] * ALPHABET**2
    for a in range(ALPHABET):
        row = {k: [counts.get((k, a * ALPHABET + b), 0) + smoothing for b in used] for k in (True, False)}
        for i, b in enumerate(used):
            table[a * ALPHABET + b] = math.log(row[True][i] / sum(row[True])) - math.log(row[False][i] / sum(row[False]))
    return table


def ratio(token: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a token: random against ordinary."""
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in model)), ",").cast("array<float>")
    step = lambda acc, c: F.struct(c.alias("at"), (acc["sum"] + F.get(table, acc["at"] * ALPHABET + c).cast("double")).alias("sum"))
    return F.aggregate(_chars(token), F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])


def markov_kind(model: list[float], threshold: float = THRESHOLD) -> spans.Kind:
    """Runs of token characters that look random."""
    keep = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (ratio(m, model) >= threshold)
    return spans.Kind("markov", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", keep)


def scan(docs: DataFrame, text: str = "text", model: list[float] | None = None, out: str = "spans") -> DataFrame:
    """``docs`` with the array ``out`` of (start, ord, kind, end, match) of all secrets in the whole text."""
    model = model or train(default_samples(docs.sparkSession))
    every = fresh(docs.columns, "_spans")
    found = spans.find(docs, text, [*BASE, markov_kind(model)], every)
    base = F.filter(every, lambda s: s["ord"] < len(BASE))
    # base spans come by start, so what they cover of a run from its start on only grows
    covered = lambda s: F.aggregate(base, s["start"], lambda pos, b: F.when(b["start"] <= pos, F.greatest(pos, b["end"])).otherwise(pos)) >= s["end"]
    kept = F.filter(every, lambda s: (s["ord"] < len(BASE)) | ~covered(s))
    return found.withColumn(out, kept).drop(every)


def redact(docs: DataFrame, text: str = "text", model: list[float] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``."""
    at = fresh(docs.columns, "_secrets")
    found = scan(docs, text, model, at)
    return found.withColumn(text, spans.mask(F.col(f"`{text}`"), F.col(at), mark)).drop(at)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every text of ``documents``."""
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    rows = found.select("doc_id", "spans", base.alias("base"))
    return rows.select("doc_id", *[spans.count(F.col("base"), k.name).alias(f"n_{k.name}") for k in BASE], F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"))
