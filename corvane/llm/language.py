"""Language identification of mixed-language text: script ranges narrow candidates, Viterbi over words labels spans.

Each word has a score per learned language: the log likelihood of its hashed character n-grams. The script of its
letters narrows the languages that may claim it. A Viterbi path with a penalty for every switch labels the words; runs
of one label are the spans of a text, and the language of most words is that of the whole text.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm._common import table
from corvane.llm.bpe import Memo

BUCKETS, PENALTY, WEIGHT, SMOOTH = 1 << 16, 16.0, 0.4, 0.5
#: Documents of each language, at most in expectation, that the model is fitted on.
SAMPLE = 4000
#: First and last code point of Unicode blocks and their script.
SCRIPTS = [
    (0x41, 0x24F, "latin"), (0x250, 0x2AF, "latin"), (0x370, 0x3FF, "greek"), (0x400, 0x52F, "cyrillic"), (0x530, 0x58F, "armenian"), (0x590, 0x5FF, "hebrew"), (0x600, 0x77F, "arabic"),
    (0x900, 0x97F, "devanagari"), (0x980, 0x9FF, "bengali"), (0xA00, 0xA7F, "gurmukhi"), (0xA80, 0xAFF, "gujarati"), (0xB80, 0xBFF, "tamil"), (0xC00, 0xC7F, "telugu"), (0xC80, 0xCFF, "kannada"), (0xD00, 0xD7F, "malayalam"),
    (0xE00, 0xE7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0x1200, 0x137F, "ethiopic"), (0x1780, 0x17FF, "khmer"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x30FF, "kana"), (0x3400, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0x20000, 0x2FFFF, "han"),
]
_STARTS = np.array([s for s, _, _ in SCRIPTS])
_OTHER = re.compile(r"[\W\d_]+")


def script(char: str) -> str:
    if char < "\u0250":
        return "latin"
    i = int(np.searchsorted(_STARTS, ord(char), side="right")) - 1
    return SCRIPTS[i][2] if i >= 0 and ord(char) <= SCRIPTS[i][1] else "other"


def word(token: str) -> str:
    """The letters of a token, in lower case; empty if it has none."""
    return (token if token.isalpha() else _OTHER.sub("", token)).lower()


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of all words at once: buckets of their n-grams of one to four UTF-8 bytes, ends marked, and of each whole word;
    and the index of the word of each."""
    data = [w.encode() for w in words]
    joined = np.frombuffer(b"\0" + b"\0".join(data) + b"\0", np.uint8).astype(np.uint64)
    mark = joined == 0
    index = np.cumsum(mark) - 1
    buckets, owners = [np.fromiter(map(crc32, data), np.uint64, len(data))], [np.arange(len(data))]
    code, inner = joined, np.zeros(len(joined), bool)
    for n in range(1, 5):
        if n > 1:
            inner = inner[:-1] | mark[n - 2 : len(joined) - 1] if n > 2 else inner[:-1]
            code = code[:-1] * np.uint64(257) + joined[n - 1 :]
        fine = ~inner & ~mark[: len(code)] if n == 1 else ~inner
        # a window lies in the word of its start, or in the word after a mark at its start
        fine &= index[: len(code)] < len(data)
        buckets.append((code[fine] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40))
        owners.append(index[: len(code)][fine])
    return (np.concatenate(buckets) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owners)


class Model:
    """scores: BUCKETS x languages, log likelihoods less their mean; scripts: those of each language."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: dict[str, set[str]]):
        self.langs, self.scripts = langs, scripts
        smooth = counts + SMOOTH
        scores = np.log(smooth / smooth.sum(0, keepdims=True))
        self.scores = (WEIGHT * (scores - scores.sum(1, keepdims=True) / max(1, len(langs)))).astype("float32")


class Labeller:
    """Labels whole texts; keeps the scores of distinct words in a bounded table."""

    def __init__(self, model: Model, limit: int = 700_000):
        self.model, self.n, self.limit = model, len(model.langs), limit
        self.may = Memo(self.allowed, 100)
        self.clear()

    def clear(self):
        self.rows: dict[str, int] = {}  # of tokens; -1 without letters
        self.known: dict[str, int] = {"": -1}  # of words
        self.matrix = np.empty((0, self.n), "float32")

    def allowed(self, name: str) -> np.ndarray:
        may = np.array([name in self.model.scripts[x] for x in self.model.langs])
        return np.where(may | ~may.any(), 0, -1e4).astype("float32")

    def score(self, words: list[str]) -> np.ndarray:
        """Words x languages."""
        buckets, owners = grams(words)
        out = np.stack([np.bincount(owners, self.model.scores[buckets, k], len(words)) for k in range(self.n)], axis=1)
        return (out + np.stack([self.may[script(w[0])] for w in words])).astype("float32")

    def learn(self, texts: list[str]) -> None:
        """Adds the words of the texts that it lacks, all at once."""
        lacking = set().union(*[set(t.split()).difference(self.rows) for t in texts])
        if len(self.rows) + len(lacking) > self.limit and self.rows:
            self.clear()
            return self.learn(texts)
        of = {t: word(t) for t in sorted(lacking)}
        new = list(dict.fromkeys(w for w in of.values() if w not in self.known))
        if new:
            self.known |= {w: len(self.matrix) + i for i, w in enumerate(new)}
            self.matrix = np.concatenate([self.matrix, self.score(new)])
        self.rows |= {t: self.known[w] for t, w in of.items()}

    def emissions(self, text: str) -> np.ndarray:
        tokens = text.split()
        index = np.fromiter(map(self.rows.__getitem__, tokens), np.int64, len(tokens))
        return self.matrix[index[index >= 0]]

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best language of each word, with the penalty for each switch."""
        total = s.sum(0, dtype="float64")
        main = int(total.argmax())
        gain = np.cumsum(s - s[:, [main]], axis=0, dtype="float64")
        floor = np.minimum.accumulate(np.vstack([np.zeros((1, self.n)), gain[:-1]]), axis=0)
        if (gain - floor).max() <= PENALTY / 2:  # no stretch gains enough for any path with a switch
            return np.full(len(s), main)
        rows = s.tolist()
        best, before = rows[0], []
        for row in rows[1:]:
            top = max(best)
            before.append((best, top))
            floor = top - PENALTY
            best = [(v if v >= floor else floor) + x for v, x in zip(best, row)]
        k = best.index(max(best))
        out = [k]
        for best, top in reversed(before):
            if best[k] < top - PENALTY:
                k = best.index(top)
            out.append(k)
        return np.array(out[::-1])

    def labels(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Of each text; in groups whose new words are scored at once."""
        out = []
        for i in range(0, len(texts), 200):
            group = texts[i : i + 200]
            if self.n:
                self.learn([t for t in group if t])
            out += map(self.label, group)
        return out

    def label(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        """Language, score and spans (first word, word after the last, language); words are tokens with letters.
        The words of the text must be known (``learn``)."""
        s = self.emissions(text) if text and self.n else ()
        if not len(s):
            return "und", 0.0, []
        path = self.path(s)
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        spans = [(a, b, self.model.langs[path[a]]) for a, b in zip(cuts, cuts[1:])]
        share = np.bincount(path, minlength=self.n)
        total = s.sum(0, dtype="float64")
        most = np.flatnonzero(share == share.max())
        k = int(most[total[most].argmax()])
        own = s[path == k].sum(0, dtype="float64")
        posterior = 1 / np.exp(np.clip(own - own[k], -700, 50)).sum()
        return self.model.langs[k], float(share[k] / len(path) * posterior), spans


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            found.setdefault(lang, Counter()).update(map(word, text.split()))
    for lang, own in found.items():
        own.pop("", None)
        words, times = list(own), np.fromiter(own.values(), float, len(own))
        if not words:
            continue
        buckets, owners = grams(words)
        counts = np.bincount(buckets, times[owners], BUCKETS)
        letters: Counter = Counter()
        for w, n in own.items():
            letters[script(w[0])] += len(w) * n
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "bucket": at.astype("int32"), "script": "", "n": counts[at].astype("int64")})
        yield pd.DataFrame({"lang": lang, "bucket": np.int32(-1), "script": list(letters), "n": list(letters.values())})


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fits on rows with text and lang: of each language at most ``sample`` documents in expectation, chosen by a hash
    of the id. n-grams are counted in parallel; the driver gets at most ``BUCKETS`` counts for each language."""
    own = docs.select(F.col(id_col).alias("i"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    langs = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    names = sorted(langs)
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), {})
    share = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(min(1.0, sample / langs[n])))])
    drawn = own.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("lang", "text")
    found = drawn.mapInPandas(_count, "lang string, bucket int, script string, n long").groupBy("lang", "bucket", "script").agg(F.sum("n").alias("n")).toPandas()
    counts, letters = np.zeros((BUCKETS, len(names))), {n: Counter() for n in names}
    at = found["lang"].map(names.index)
    grams_ = found["bucket"] >= 0
    counts[found["bucket"][grams_], at[grams_]] = found["n"][grams_]
    for row in found[~grams_].itertuples():
        letters[row.lang][row.script] = row.n
    return Model(names, counts, {n: {s for s, k in c.items() if k >= 0.02 * c.total()} for n, c in letters.items()})


_LABEL = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))),
])


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and the spans of words of each row.

    A null text, one without letters, and any text under a model without languages give ``und``, 0 and no spans.
    Ties go to the language first in order. Texts are read whole; repeated rows get equal results; an empty table gives
    no rows; other columns are ignored.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # BUCKETS x languages

    @F.pandas_udf(_LABEL)
    def of(texts: pd.Series) -> pd.DataFrame:
        held = _labellers.get(key)
        if held is None:  # a worker keeps its table for all batches under one model
            _labellers.clear()
            held = _labellers[key] = Labeller(shared.value)
        rows = held.labels(list(texts))
        return pd.DataFrame({"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "spans": [[{"start": a, "end": b, "lang": x} for a, b, x in r[2]] for r in rows]})

    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text).cast("string")).alias("x")).select("doc_id", "x.*")


_labellers: dict[str, Labeller] = {}


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
