"""Mixing sources to target weights by systematic sampling.

The documents of a source stand in order of size, then of a hash of their id. Each expects the same number of copies,
its source's target over its size; prefix sums of the expected copies start at one random offset for the source, and a
document is emitted once for each integer that its prefix sum crosses. In order of size the words taken differ from
the target by at most about one document's size.

Ranks need no task to hold a source: rows are counted by source, size and three digits of the hash, and ranked only
among those of equal source, size and digits. Counts are summed up in three steps, none of which holds a source's: over
the blocks of ``BLOCK`` sizes of a source, the sizes of a block, and the digits of a size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm._common import WORD, Scratch, apart, table

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, 17
DIGITS, BLOCK = 3, 64


def size(text: str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes`` (a row for each source: k, source, source_size) with ``target``.

    Sources in order of code points, null last, weigh ``weights``, repeating; together they get ``share`` times all
    words, none more than ``most`` times its own; the excess is shared by weight among the others. In order of cap over
    weight the level of the others is found in one pass of running sums.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # a row for each source
    w = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    past = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(past), F.lit(0))) / F.sum("w").over(rest))
    w = w.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return w.select("k", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")).alias("target"))


def sized(docs: DataFrame, *, id_col: str, text: str, source: str) -> DataFrame:
    """``docs`` with size, k (the source, null told apart), src, h (a hash of the id, or of the text without one) and id."""
    by = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("t"), F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)))
    src = F.col(source).cast("string")
    return docs.withColumns({"size": size(text), "src": src, "k": F.when(src.isNull(), "n").otherwise(F.concat(F.lit("s"), src)), "h": F.md5(by), "id": F.col(id_col)})


def _before(rows: DataFrame, within: list[str], order: str) -> DataFrame:
    """``rows`` (n) with ``before``: the sum of n of the rows before in order."""
    w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def counted(d: DataFrame, seed: int = SEED) -> DataFrame:
    """``d`` (of ``sized``, written: it is read twice) with source_size, target and copies of each row."""
    d = d.withColumn("g", F.substring("h", 1, DIGITS))
    counts = d.groupBy("k", "size", "g").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("k", "size").agg(F.sum("n").alias("n")).withColumn("b", F.floor(F.col("size") / BLOCK))
    blocks = sizes.groupBy("k", "b").agg(F.sum("n").alias("n"))
    of_block = _before(blocks, ["k"], "b").select("k", "b", F.col("before").alias("p"))
    of_size = _before(sizes, ["k", "b"], "size").join(of_block, ["k", "b"]).select("k", "size", (F.col("before") + F.col("p")).alias("p"))
    info = _before(counts, ["k", "size"], "g").join(of_size, ["k", "size"]).select("k", "size", "g", (F.col("before") + F.col("p")).alias("before"))
    aims = targets(d.groupBy("k", F.col("src").alias("source")).agg(F.sum("size").alias("source_size")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("k"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    info = info.join(aims, "k").withColumns({"rate": rate, "u": offset})
    own = Window.partitionBy("k", "size", "g").orderBy("h", "id")
    d = d.withColumn("r", F.row_number().over(own)).join(info, ["k", "size", "g"])
    upto = lambda r: F.floor(F.col("rate") * (F.col("before") + r) + F.col("u"))
    return d.withColumn("copies", (upto(F.col("r")) - upto(F.col("r") - 1)).cast("long"))


def with_copies(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """``docs`` with columns __size, __source_size, __target and __copies (how often the mix takes the document).

    Null and empty texts have size 0; a source without words has target 0 and no copies; null sources are one source;
    rows that repeat an id are ranked each; very long texts count whole; an empty table gives no rows; other columns
    pass unchanged, whatever their names. Reruns agree. ``docs`` is written once to the shared folder, with its sizes.
    """
    d, back, (i, t, s) = apart(docs, id_col, text, source)
    d = Scratch(docs.sparkSession, "mix").write(sized(d, id_col=i, text=t, source=s), "sized")
    d = counted(d, seed)
    return d.select(*back, *[F.col(c).alias(f"__{c}") for c in ("size", "source_size", "target", "copies")])


def mix(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The mix: each document as often as it is taken (see ``with_copies``), with its columns unchanged."""
    d, back, (i, t, s) = apart(docs, id_col, text, source)
    d = Scratch(docs.sparkSession, "mix").write(sized(d, id_col=i, text=t, source=s), "sized")
    taken = counted(d, seed).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*back)


def op3_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sized(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), id_col="doc_id", text="text", source="source")
    d = counted(Scratch(spark, "mix").write(d.select("doc_id", "size", "src", "k", "h", "id"), "sized"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT k, source, sum(size)::BIGINT AS source_size FROM d GROUP BY k, source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
r AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / w AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT k, source_size, least(cap::DOUBLE, w * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio)) AS target FROM l),
n AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
      row_number() OVER (PARTITION BY d.k ORDER BY d.size, d.h, d.doc_id) AS rank,
      ('0x' || substr(md5('{SEED}:' || d.k), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
      FROM d JOIN t ON d.k = t.k),
c AS (SELECT *, (floor(rate * rank + u) - floor(rate * (rank - 1) + u))::BIGINT AS copies FROM n)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
