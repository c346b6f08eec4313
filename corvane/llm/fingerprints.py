"""Document fingerprints from Lempel-Ziv phrases.

A text is cut into symbols (words, marks, single characters of scripts without spaces) and parsed left to right into
dictionary phrases: each phrase is the shortest run of symbols that is not in the dictionary yet. The phrases are
hashed to 40 bits; the fingerprint is the sorted list of the ``SIZE`` smallest hashes, in hexadecimal. Two
fingerprints compare as the share of common hashes among the smallest of their union, which estimates the Jaccard
likeness of the phrase sets and is exact for documents of fewer phrases.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm._common import parts, table, text_col

SIZE, DIGITS = 64, 10
_SYMBOL = re.compile(r"[^\W⺀-￿]{1,16}|[⺀-￿]|[^\w\s]")


def parse(text: str, seen: set[str], phrase: str = "") -> tuple[list[str], str]:
    """Parses on from ``seen`` and the open ``phrase``: the new phrases and the phrase that is open at the end."""
    new = []
    for symbol in _SYMBOL.findall(text):
        phrase = f"{phrase} {symbol}"
        if phrase not in seen:
            seen.add(phrase)
            new.append(phrase)
            phrase = ""
    return new, phrase


def phrases(text: str) -> set[str]:
    """The phrase dictionary after parsing the whole text."""
    return set(parse(text, set())[0])


def hashed(new: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new)) >> np.uint64(64 - 4 * DIGITS)


def smallest(hashes: np.ndarray, size: int = SIZE) -> list[int]:
    if len(hashes) > 4 * size:
        few = np.unique(np.partition(hashes, 2 * size)[: 2 * size + 1])
        if len(few) >= size:  # but for equal hashes
            return few[:size].tolist()
    return np.unique(hashes)[:size].tolist()


def signature(text: str, size: int = SIZE) -> list[int]:
    """The smallest phrase hashes, ascending; empty if the text has no symbol."""
    return smallest(hashed(parse(text, set())[0]), size)


class Fork:
    """A text's signature, and those of texts that share its first ``keep`` characters: what they share is parsed once."""

    def __init__(self, text: str, keep: int):
        self.at = keep if keep >= len(text) else next((i for i in range(keep, 0, -1) if text[i - 1].isspace()), 0)
        self.seen: set[str] = set()
        new, self.phrase = parse(text[: self.at], self.seen)
        self.shared = hashed(new)
        self.own = self.signature(text)

    def signature(self, text: str) -> list[int]:
        return smallest(np.concatenate([self.shared, hashed(parse(text[self.at :], self.seen.copy(), self.phrase)[0])]))


def to_hex(values: list[int]) -> str:
    return "".join([f"{v:0{DIGITS}x}" for v in values])


def likeness(a: list[int], b: list[int], size: int = SIZE) -> float:
    """Of two signatures, 0 to 1; two empty ones are alike, an empty and another one are not."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    both = set(a) & set(b)
    least = sorted({*a, *b})[:size]
    return sum(v in both for v in least) / len(least)


_OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each row; null and empty texts have the empty fingerprint.

    Texts are read whole; repeated rows get equal results; an empty table gives no rows; other columns are ignored."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([to_hex(signature(t, size)) for t in texts], dtype=object)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), of(text_col(text)).alias("fingerprint"))


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by block, then kind, then id: each row of kind 0 is followed by its next document."""
    held = None
    for batch in batches:
        out = []
        for block, kind, doc_id, text in zip(batch["block"], batch["kind"], batch["doc_id"], batch["text"]):
            fork = Fork(text, len(text) - len(text) // 2)
            if held is not None and held[0] == block:
                own_id, own, of_own = held[1:]
                half = len(own) // 2
                edited = own[: len(own) - half] + text[:half]
                of_edited = of_own.signature(edited)
                out.append((own_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), to_hex(of_own.own), to_hex(of_edited), likeness(of_own.own, of_edited), likeness(of_own.own, fork.own)))
            held = None if kind else (block, None if pd.isna(doc_id) else int(doc_id), text, fork)
        frame = pd.DataFrame(out, columns=_OUT.names)
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield frame


def fingerprints_with_next(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text (the last half replaced by the start of the next document).

    "Next" is by id, then text, nulls first; the last document is followed by the first, a single one by itself. Rows
    that repeat an id follow each other. Null texts are empty; an empty table gives no rows; other columns are ignored.

    Ids are cut into ranges; the first row of each range is also sent to the range before it, so no task needs
    another's rows and each text crosses one shuffle once. The driver gets one id per range.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col(text).alias("text"))
    n = 4 * parts(spark)
    bounds = np.unique(np.array(own.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) or [0], dtype="int64"))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.fillna(np.iinfo("int64").min).to_numpy("int64"), side="right").astype("int32"))

    least = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    placed = own.withColumn("block", range_of(least))
    firsts = placed.groupBy("block").agg(F.min(least).alias("first")).orderBy("block").collect()  # a row for each range
    if not firsts:
        return spark.createDataFrame([], _OUT)
    before = [(firsts[i - 1]["block"], f["first"]) for i, f in enumerate(firsts)]
    heads = own.withColumn("first", least).join(F.broadcast(spark.createDataFrame(before, "block int, first long")), "first")
    heads = heads.groupBy("block").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"))
    rows = placed.select("block", F.lit(0).alias("kind"), "doc_id", "text").unionByName(heads.select("block", F.lit(1).alias("kind"), "doc_id", "text"))
    return rows.repartition(parts(spark), "block").sortWithinPartitions("block", "kind", "doc_id", "text").mapInPandas(_pairs, _OUT)


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_next(table(spark, sf_dir, "documents"))
