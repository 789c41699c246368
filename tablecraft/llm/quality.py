"""Quality classifier: a generalised additive model with pairwise interactions (GA2M).

Fifteen features of the whole text are cut into at most BINS quantile bins. Boosting goes round the features in
cycles: each step fits one shallow tree (a few leaves over neighbouring bins) of one feature to the gradient and
adds a small part of it to that feature's table of bin values. Then the PAIRS pairs of features that explain most
of the remaining gradient get a table over both features' coarser bins, grown the same way by trees of depth two.
A score is the logistic function of the intercept plus one looked-up value per feature and pair.

The model is fitted on a bounded sample: at most SAMPLE labelled rows, those with the smallest hash of the
document's id, whose features alone reach the driver (SAMPLE x 15 numbers). Scoring reads every text once, in
batches of Arrow, adds table values with numpy, and shuffles nothing. The model is a few thousand numbers.

Defined results: null and empty texts have the features of an empty text and a score; null or other labels than
0 and 1 are not used; several labels of a document are several samples; without labels of both classes the model
is its intercept (share of 1 among the labels, 0.5 without any); repeated rows score alike; an empty table gives
an empty result; all other columns pass unchanged, those with a result's name are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

SAMPLE = 20_000
#: Bins of a feature, and of each feature in a pair.
BINS, PAIR_BINS = 32, 8
PAIRS, ROUNDS, RATE, LEAVES = 6, 200, 0.1, 4
#: Added to the number of rows in a leaf.
RIDGE = 5.0
FOLDS = 5
THRESHOLD = 0.3
FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "exclamation", "bar", "symbol", "comma_stop", "blank", "not_ascii",
    "repeated_next", "distinct_words", "top_word", "repeated_lines",
)
#: Classes of bytes: 1 upper, 2 digit, 3 exclamation or question mark, 4 bar, 5 other symbol, 6 comma or stop, 7 blank, 8 not ASCII.
_CLASS = np.zeros(256, np.int64)
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5
_CLASS[65:91], _CLASS[48:58], _CLASS[[33, 63]], _CLASS[124] = 1, 2, 3, 4
_CLASS[[44, 46, 39, 45]], _CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[128:] = 6, 7, 8


def features(text: str | None) -> list[float]:
    """The features of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    by = np.zeros(9) if not n else np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9) / n
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    w = len(words)
    counts = Counter(words)
    again = sum(a == b for a, b in zip(words, words[1:])) / w if w else 0.0
    shares = (len(counts) / w, max(counts.values()) / w) if w else (1.0, 0.0)
    spread = 1 - len(set(lines)) / len(lines) if lines else 0.0
    return [np.log1p(n), np.log1p(w), n / (w + 1), by[1], by[2], by[3], by[4], by[5], by[6], by[7], by[8], again, *shares, spread]


@dataclass
class Model:
    """cuts[f]: bin edges of a feature; tables[f]: its bin values; pairs: (f, g, edges of f, edges of g, table)."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, f], side="right")]
        for f, g, at_f, at_g, table in self.pairs:
            total += table[np.searchsorted(at_f, x[:, f], side="right"), np.searchsorted(at_g, x[:, g], side="right")]
        return 1 / (1 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The split of a run of bins that gains most, and where."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """The value of each bin under a tree that splits the best run of bins until it has ``leaves`` leaves."""
    runs = [(0, len(g))]
    while len(runs) < leaves:
        gain, at, k = max((*_best_cut(g[a:b], h[a:b]), k) for k, (a, b) in enumerate(runs))
        if gain <= 1e-9:
            break
        a, b = runs[k]
        runs[k : k + 1] = [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The same over a grid: one cut across either axis, then one cut across the other on each side."""
    if _best_cut(g.sum(0), h.sum(0))[0] > _best_cut(g.sum(1), h.sum(1))[0]:
        return _tree2(g.T, h.T).T
    _, at = _best_cut(g.sum(1), h.sum(1))
    return np.concatenate([np.tile(_tree(g[s].sum(0), h[s].sum(0), 2), (g[s].shape[0], 1)) for s in (slice(0, at), slice(at, None)) if g[s].shape[0]])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, pairs: int = PAIRS) -> Model:
    """Fit the model to features ``x`` (rows x FEATURES) and labels ``y`` (0 or 1)."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    model = Model(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    total = np.full(len(y), model.intercept)

    def cycle(steps) -> None:
        for _ in range(rounds):
            for cell, table, grow in steps:
                p = 1 / (1 + np.exp(-total))
                g = np.bincount(cell, y - p, table.size).reshape(table.shape)
                h = np.bincount(cell, p * (1 - p), table.size).reshape(table.shape)
                part = rate * grow(g, h)
                table += part
                np.add(total, part.ravel()[cell], out=total)

    model.cuts = [_edges(x[:, f], BINS) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    cycle([(np.searchsorted(c, x[:, f], side="right"), t, _tree) for f, (c, t) in enumerate(zip(model.cuts, model.tables, strict=True))])

    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(coarse)]
    rest, found = y - 1 / (1 + np.exp(-total)), []
    for f in range(x.shape[1]):
        for g in range(f):
            cell = bins[f] * (len(coarse[g]) + 1) + bins[g]
            sums, rows = np.bincount(cell, rest), np.bincount(cell)
            found.append((float((sums**2 / (rows + RIDGE)).sum()), f, g))
    steps = []
    for _, f, g in sorted(found, reverse=True)[:pairs]:
        table = np.zeros((len(coarse[f]) + 1, len(coarse[g]) + 1))
        model.pairs.append((f, g, coarse[f], coarse[g], table))
        steps.append((bins[f] * table.shape[1] + bins[g], table, _tree2))
    cycle(steps)
    return model


def fold(key: Column) -> Column:
    """crc32 of the id's text, modulo FOLDS; fold 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([[float(v) for v in features(t)] for t in texts], dtype=object)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit a model on at most ``sample`` labelled rows outside the held-out fold.

    ``labels``: the key and ``quality``. Rows are taken by the hash of the key, so that the sample depends on
    neither the order nor the partitions of the tables. At most ``sample`` ids and labels are broadcast, and of rows that
    repeat those ids the first ``sample`` by the hash of their features are taken.
    """
    known = labels.select(F.col(key).alias("_key"), F.col("quality").cast("int").alias("_y")).where("_y IN (0, 1)").where(fold(F.col("_key")) != 0)
    known = known.orderBy(F.xxhash64("_key"), "_key", "_y").limit(sample)
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(known), "_key")
    got = rows.select("_y", _features("_text").alias("x")).orderBy(F.xxhash64("x"), "_y").limit(sample).toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, got["_y"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 as column ``out``."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))))

    return docs.withColumn(out, scored(F.col(f"`{text}`")))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    scored = score(plain, train(docs, labels), names["text"], "_score").where(F.col("_score") >= threshold)
    return scored.select(*[F.col(n).alias(c) for c, n in names.items()])


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality; the fold that the model has not seen is marked."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
