"""Importance resampling towards a target distribution.

A feature is a run of one or two words, hashed to one of ``BUCKETS`` buckets. Counts of all features of the documents
and of the target give each bucket an integer gain, the log-likelihood ratio in thousandths; the gains are one array of
``BUCKETS`` numbers, whatever the input, which scores whole batches of texts by indexing. A document's weight is the mean
gain of its features; its score adds Gumbel noise that depends on its id alone, so that the highest scores are a draw
without replacement in proportion to the weights, and reruns agree.

The draw sorts nothing as a whole: scores are integers, so an exact histogram of them, summed from the top, gives the
score at which the draw ends and the rank at which each score begins; rows are numbered only within a score that
survives. There are fewer than 2^17 distinct scores, as gains and noise are logarithms of numbers below 2^64.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm._common import Scratch, apart, few, table, text_col

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 7, 25, 20
#: Letters A-Z to small ones; ASCII characters that are no letter or digit to spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WEIGHED = "n_words long, n_features long, weight long"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def features(own: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of all single words, then of all pairs of neighbours."""
    spaced = [zlib.crc32(b" ", zlib.crc32(w)) for w in own[:-1]]
    out = np.empty(max(0, 2 * len(own) - 1), np.int64)
    out[: len(own)] = np.fromiter(map(zlib.crc32, own), np.int64, len(own))
    out[len(own) :] = np.fromiter(map(zlib.crc32, own[1:], spaced), np.int64, len(spaced))
    return out % buckets


def _counted(buckets: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["text"]:
                total += np.bincount(features(words(text), buckets), minlength=buckets)
        have = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": have, "n": total[have]})

    return of


def gains(docs: DataFrame, target: DataFrame, *, text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of each bucket: s of S features of the
    documents are in it, t of T of the target. Each task sends its sums; the driver gets a row for each bucket."""
    spark = docs.sparkSession
    count = lambda df, own, name: df.select(F.col(f"`{own}`").cast("string").alias("text")).mapInPandas(_counted(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(count(docs, text, "s"), "bucket", "left").join(count(target, target_text, "t"), "bucket", "left")
    both = both.select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("s", "t")])
    rows = both.orderBy("bucket").collect()
    s, t = sum(r["s"] for r in rows), sum(r["t"] for r in rows)
    real = lambda x: F.lit(float(x)) if isinstance(x, int) else x.cast("double")
    ratio = real(F.col("t") + 1) * real(s + buckets) / (real(F.col("s") + 1) * real(t + buckets))
    frame = spark.createDataFrame([tuple(r) for r in rows], "bucket long, s long, t long")
    return np.array([r["g"] for r in frame.select("bucket", F.floor(1000 * F.log(ratio)).alias("g")).orderBy("bucket").collect()], np.int64)


def weigher(gain: np.ndarray):
    """A function of texts: n_words, n_features and weight, the floored mean gain of the features (0 without one)."""

    @F.pandas_udf(_WEIGHED)
    def of(texts: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(texts), 3), np.int64)
        for i, text in enumerate(texts):
            own = words(text)
            if own:
                found = features(own, len(gain))
                out[i] = len(own), len(found), int(gain[found].sum()) // len(found)
        return pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    return of


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (id, n_words, weight, score, …; written: it is read three times) with ``rank``: 1, 2, … over the
    floor(percent * N / 100) highest scores of the N rows with ``least`` words or more, ties to smaller ids; else null."""
    enough = F.col("n_words") >= least
    counts = scored.where(enough).groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()  # fewer than 2^17 rows
    wanted = percent * sum(r["n"] for r in counts) // 100
    starts, upto = [], 0
    for r in counts:
        if upto >= wanted:
            break
        starts.append((r["score"], upto))
        upto += r["n"]
    none = F.lit(None).cast("long")
    if not starts:
        return scored.withColumn("rank", none)
    cutoff = starts[-1][0]
    begin = few(starts, scored.sparkSession.createDataFrame(starts, "score long, before long"))
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "weight", "n_words"))
    top = scored.where(enough & (F.col("score") >= cutoff)).withColumn("r", within).join(begin, "score")
    rank = F.col("before") + F.col("r")
    top = top.withColumn("rank", F.when(rank <= wanted, rank)).drop("r", "before")
    return top.unionByName(scored.where(~(enough & (F.col("score") >= cutoff))).withColumn("rank", none))


def importance(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight, score and rank of each row of ``docs``; ``target`` has texts like those wanted.

    Null and empty texts have no features and weight 0, and too few words to be drawn; texts are read whole. Rows that
    repeat an id share its noise, and are ranked each; rows without id come last among ties. An empty table gives no
    rows, an empty target gives gains against no features. Other columns are ignored.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), text_col(f"`{text}`").alias("text"))
    of = weigher(gains(own, target, target_text=target_text, buckets=buckets))
    scored = own.select("id", of("text").alias("w")).select("id", "w.*").withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    return ranked(Scratch(docs.sparkSession, "resample").write(scored, "scored"), percent, least)


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns unchanged, whatever their names (see ``importance``).

    Texts stay where they are: rows with a score above the cutoff are taken as they are read, and only ids of the
    cutoff's own score are ranked. Rows alike in id and score at the very end of the draw all come.
    """
    d, back, (i, t) = apart(docs, id_col, text)
    of = weigher(gains(docs, target, text=text, target_text=target_text, buckets=buckets))
    with_score = d.withColumn("w", of(text_col(t))).withColumn("score", F.col("w.weight") + noise(F.col(i), seed))
    slim = with_score.select(F.col(i).alias("id"), "w.n_words", "w.weight", "score")
    top = ranked(Scratch(docs.sparkSession, "resample").write(slim, "scored"), percent, least).where("rank IS NOT NULL")
    cutoff = top.agg(F.min("score")).first()[0]
    if cutoff is None:
        return docs.limit(0)
    last = top.where(F.col("score") == cutoff).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("last")).distinct()
    enough = with_score.where(F.col("w.n_words") >= least)
    ends = enough.where(F.col("score") == cutoff).join(last, F.coalesce(F.col(i).cast("string"), F.lit("")) == F.col("last"), "left_semi")
    return enough.where(F.col("score") > cutoff).unionByName(ends).select(*back)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d) GROUP BY doc_id, f),
bf AS (SELECT f, count(*) AS n FROM (SELECT unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b) GROUP BY f),
tab AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) AS r(n)),
x AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
k AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)), lambda c, y: xor(t[1 + (xor(c, y) & 255)], c >> 8)), 4294967295) % 10000 AS bucket FROM x, tab),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN k USING (f) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM bf JOIN k USING (f) GROUP BY bucket),
g AS (SELECT r.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS gain
      FROM range(10000) AS r(bucket) LEFT JOIN s ON r.bucket = s.bucket LEFT JOIN t ON r.bucket = t.bucket),
m AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY doc_id),
v AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM v WHERE n_words >= 20)
SELECT v.doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN rank <= 25 * (SELECT count(*) FROM r) // 100 THEN rank END::BIGINT AS rank FROM v LEFT JOIN r USING (doc_id)
"""
