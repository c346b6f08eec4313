"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a whole text are cut into bins at quantiles. Boosting goes round the features: each turn fits one shallow
tree to the gradient of the log loss on one feature and adds its leaves to that feature's lookup table. Then the pairs
with the largest gain left are boosted the same way, with trees that split both features once. A score is the sum of
one table entry for each feature and pair.
"""

from __future__ import annotations

import itertools
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm._common import table

#: Labelled rows the model is fitted on, at most in expectation.
SAMPLE = 20_000
THRESHOLD = 0.3
BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, LEAST = 32, 150, 8, 60, 0.1, 20

FEATURES = [
    "log_chars", "log_words", "word_length", "upper", "lower_letters", "digits", "spaces", "lines", "common_marks", "rare_marks", "other_bytes", "distinct_words", "repeated_next", "distinct_lines", "short_words",
    "long_words", "marked_ends", "sentence_ends", "most_frequent", "distinct_pairs",
]
_KIND = np.full(256, 6)
for _chars, _kind in ((range(0x41, 0x5B), 0), (range(0x61, 0x7B), 1), (range(0x30, 0x3A), 2), (b" \t", 3), (b"\n\r\x0b\x0c", 4), (b".,;:'\"-()", 5), (range(0x80, 0x100), 7)):
    _KIND[list(_chars)] = _kind


def features(text: str | None) -> list[float]:
    """Of a whole text; all but the bias of length are shares or means, 0 for an empty or null text."""
    data = (text or "").encode()
    words = data.split()
    n, k = max(1, len(data)), max(1, len(words))
    kinds = np.bincount(_KIND, np.bincount(np.frombuffer(data, np.uint8), minlength=256), 8) / n
    lines = data.split(b"\n")
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = bytes([w[-1] for w in words])
    stops = sum(map(ends.count, b".?"))
    marks = len(ends) - len(ends.translate(None, b"!#$%&*|=~^<>@+_{}[]\\/"))
    return [
        np.log1p(len(data)), np.log1p(len(words)), lengths.sum() / k, kinds[0], kinds[1], kinds[2], kinds[3], kinds[4] * 10, kinds[5], kinds[6], kinds[7], len(counts) / k,
        sum(map(bytes.__eq__, words, words[1:])) / k, len(set(lines)) / len(lines), (lengths <= 3).sum() / k, (lengths >= 12).sum() / k, marks / k, stops / k, max(counts.values(), default=0) / k, len(set(zip(words, words[1:]))) / k,
    ]


@dataclass
class Additive:
    """edges: bin edges of each feature; tables: an entry for each bin; pairs: (feature, feature, table)."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            out += t[b[:, f]]
        for f, g, t in self.pairs:
            out += t[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-out))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain and cut of a histogram of gradients."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = np.where((left_h > 1) & (right_h > 1), left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1), -1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(gain.argmax()) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) else (-1.0, 0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree with at most three leaves."""
    parts = [(0, len(g))]
    for _ in range(2):
        options = [(*_split(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, cut, a, b = max(options)
        if gain <= 0:
            break
        parts.remove((a, b))
        parts += [(a, a + cut), (a + cut, b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree that splits the rows of a two-way histogram, then each side's columns: its gain and leaf values."""
    best, out = 0.0, np.zeros_like(g)
    root = g.sum() ** 2 / (h.sum() + 1)
    for cut in range(1, len(g), max(1, len(g) // 8)):
        gain, leaves = -root, np.empty_like(g)
        for rows in (slice(0, cut), slice(cut, None)):
            a, b = g[rows].sum(0), h[rows].sum(0)
            more, at = _split(a, b)
            gain += a.sum() ** 2 / (b.sum() + 1) + max(0.0, more)
            for cols in (slice(0, at), slice(at, None)) if more > 0 else (slice(None),):
                leaves[rows, cols] = a[cols].sum() / (b[cols].sum() + 1)
        if gain > best:
            best, out = gain, leaves
    return best, out


def fit_arrays(x: np.ndarray, y: np.ndarray) -> Additive:
    """Deterministic; without rows or with one class the score is the smoothed share of ones."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    model = Additive(edges, base, [np.zeros(len(e) + 1) for e in edges], [])
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    raw = np.full(len(y), base)
    for _ in range(ROUNDS):
        for f, t in enumerate(model.tables):
            p = 1 / (1 + np.exp(-raw))
            step = RATE * _tree(np.bincount(b[:, f], y - p, len(t)), np.bincount(b[:, f], p * (1 - p), len(t)))
            t += step
            raw += step[b[:, f]]
    p = 1 / (1 + np.exp(-raw))
    wide = lambda f, g, v: np.bincount(b[:, f] * len(model.tables[g]) + b[:, g], v, len(model.tables[f]) * len(model.tables[g])).reshape(len(model.tables[f]), -1)
    gains = sorted(((_tree2(wide(f, g, y - p), wide(f, g, p * (1 - p)))[0], -f, -g) for f, g in itertools.combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(-f, -g, np.zeros((len(model.tables[-f]), len(model.tables[-g])))) for gain, f, g in gains[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for f, g, t in model.pairs:
            p = 1 / (1 + np.exp(-raw))
            step = RATE * _tree2(wide(f, g, y - p), wide(f, g, p * (1 - p)))[1]
            t += step
            raw += step[b[:, f], b[:, g]]
    return model


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts], dtype=object)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Additive:
    """Fits on labelled rows that are not held out, at most ``sample`` in expectation, chosen by a hash of the id.

    Rows without id, label or document are left out. The driver gets the sample's features, never texts.
    """
    own = labels.select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out("i"))
    n = own.count()
    drawn = own.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < min(1.0, sample / max(1, n)) * (1 << 30))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text).cast("string").alias("t"))
    rows = texts.join(F.broadcast(drawn), "i").select("i", "y", _features("t").alias("x")).collect()  # at most the sample
    rows.sort()
    x = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return fit_arrays(x, np.array([r["y"] for r in rows], dtype=float))


def scorer(model: Additive):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
        return pd.Series(model.score(x))

    return score


def quality_scores(docs: DataFrame, model: Additive, *, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; null and empty texts are scored as empty ones.

    Very long texts are read whole; repeated rows get equal results; a null id is not held out; an empty table gives no
    rows; other columns are ignored."""
    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), scorer(model)(F.col(text).cast("string")).alias("score")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, model: Additive, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model does not reject, with their columns unchanged, whatever their names. Null and empty
    texts are scored as empty ones; repeated rows share a fate; an empty table gives no rows."""
    return docs.where(scorer(model)(F.col(text).cast("string")) >= threshold)


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
