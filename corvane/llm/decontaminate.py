"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of benchmark words. For each pattern length there is a table of shifts keyed by a block of two
words: how far the search may move when that block ends at the current word. Blocks that end no pattern's prefix move
it by the whole length; where the shift is zero, the bucket of that suffix block gives the patterns to compare.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm._common import Scratch, apart, table

WINDOW = 10
#: Benchmark words whose tables a worker holds at once; a larger benchmark is searched in blocks of about this many.
BLOCK_WORDS = 100_000
#: ASCII letters and digits and all bytes of other characters make words; A-Z become lower case.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.LongType())),
])


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


class WuManber:
    """All occurrences of patterns of one length in a list of words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]], length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.bucket[pattern[length - self.block :]].append((pattern, items))
        self.bucket = dict(self.bucket)

    def search(self, doc: list[bytes]):
        """(start, items) of each occurrence, ascending."""
        n, far, shift, pair = len(doc), self.far, self.shift.get, self.block == 2
        i = self.length - 1
        while i < n:
            key = (doc[i - 1], doc[i]) if pair else (doc[i],)
            step = shift(key, far)
            if step:
                i += step
                continue
            start = i - self.length + 1
            here = tuple(doc[start : i + 1])
            for pattern, items in self.bucket[key]:
                if pattern == here:
                    yield start, items
            i += 1


def matchers(items: list[tuple[int, str | None]], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        own = words(text)
        length = min(window, len(own))
        for i in range(len(own) - length + 1 if own else 0):
            by_length[length][tuple(own[i : i + length])].add(item_id)
    return [WuManber({p: sorted(ids) for p, ids in found.items()}, n) for n, found in sorted(by_length.items())]


def occurrences(doc: list[bytes], search: list[WuManber]) -> tuple[list[list[int]], list[int]]:
    """Merged [start, end) word spans inside any occurrence, and the items that occur."""
    spans, items = [], set()
    for m in search:
        for start, ids in m.search(doc):
            spans.append([start, start + m.length])
            items.update(ids)
    return merged(spans), sorted(items)


def merged(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(map(list, spans)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _finder(shared) -> Column:
    @F.pandas_udf(_FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        search, out = shared.value, []
        for text in texts:
            doc = words(text)
            spans, items = occurrences(doc, search)
            out.append((len(doc), spans, items))
        return pd.DataFrame(out, columns=_FOUND.names)

    return find


@F.pandas_udf(_FOUND)
def _all(spans: pd.Series, items: pd.Series, texts: pd.Series) -> pd.DataFrame:
    """What several blocks of the benchmark found in a text, as one."""
    joined = lambda lists: [] if lists is None else [x for found in lists for x in found]
    return pd.DataFrame([(len(words(t)), merged(joined(s)), sorted(set(joined(i)))) for s, i, t in zip(spans, items, texts)], columns=_FOUND.names)


def with_occurrences(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, into: str = "__found") -> DataFrame:
    """``docs`` with one more column: struct n_words, spans ([start, end) of hit words, merged), items.

    Windows are ``window`` consecutive words of an item; an item of fewer, but not none, is one window. Null and empty
    texts have no words; items without words or id match nothing; rows that repeat an item count it once, repeated
    documents are searched each; an empty benchmark hits nothing, empty documents give no rows. Whole texts are
    searched, however long. Other columns pass unchanged, whatever their names.

    The benchmark goes to the workers in blocks of about ``block_words`` words. One block is searched in one pass. With
    more there is a pass over the texts for each, which writes what it found, by a hash of the text, and nothing else;
    the findings are joined to the documents at the end. So memory and what is written do not grow with the passes.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = 1 + total // (5 * block_words)
    d, back, (own,) = apart(docs, text)
    whole = F.col(own).cast("string")

    def finder(k: int) -> Column:
        block = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == k)
        return _finder(spark.sparkContext.broadcast(matchers([(r["i"], r["t"]) for r in block.collect()], window)))  # bounded by block_words

    if n_blocks == 1:
        return d.withColumn("found", finder(0)(whole)).select(*back, F.col("found").alias(into))
    scratch, names, found = Scratch(spark, "decontaminate"), [], None
    for k in range(n_blocks):
        hits = d.where(whole.isNotNull()).select(F.sha2(whole, 256).alias("by"), finder(k)(whole).alias("f")).where(F.size("f.spans") > 0)
        hits = scratch.write(hits.select("by", "f.spans", "f.items").dropDuplicates(["by"]), f"pass{k}")
        found, names = hits if found is None else found.unionByName(hits), [*names, f"pass{k}"]
    found = found.groupBy("by").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))  # a row for each block, at most
    out = d.withColumn("by", F.sha2(whole, 256)).join(found, "by", "left")
    return out.select(*back, _all(F.col("spans"), F.col("items"), whole).alias(into))


def clean(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The documents in which no benchmark window occurs, with their columns unchanged (see ``with_occurrences``)."""
    into = next(n for n in (f"found{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    return with_occurrences(docs, benchmark, into=into, **names).where(F.size(f"{into}.spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_occurrences(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "__found.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS win FROM d, ms, unnest(range(1, greatest(len(w) - m + 2, 1))) AS u(i)),
hits AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + m)) AS u(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
