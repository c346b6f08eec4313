"""Row numbers without a gap, in order of the files, worked out in columns.

Within a piece of a file that one task reads, rows come in order and ``monotonically_increasing_id`` grows by one; so a row's
number is the number of rows in the pieces before, plus its distance to its piece's first id. The pieces' sizes are one
small table (a row for each piece of a file); its running sum gives the offsets.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.columns import free
from corvane.sources.scratch import Scratch

#: Pieces of files whose offsets are broadcast at most; more are joined by a shuffle.
FEW = 100_000


def _metadata(rows: DataFrame) -> list[str]:
    """What the files tell of each row; nothing for rows that are not read from files."""
    try:
        return rows.select("_metadata").schema[0].dataType.names
    except AnalysisException:
        return []


def numbered(rows: DataFrame, name: str = "ordinal") -> DataFrame:
    """``rows``, as read from files, with their number from 0 by path, then by place within the file; rows of other frames
    by task.

    The rows are read twice, the first time to count: text formats whole, as they must be parsed to tell a record from
    none, Parquet without any column. What lies behind must give the same rows in the same tasks both times, as files do
    that nobody changes meanwhile. An empty frame stays empty.
    """
    at, by, start, low, n, before = free([*rows.columns, name], "at", "by", "start", "low", "n", "before")
    told = _metadata(rows)
    if "file_path" in told:
        placed = rows.select("*", F.col("_metadata.file_path").alias(by), F.col("_metadata.file_block_start").alias(start))
    else:
        placed = rows.withColumns({by: F.lit(""), start: F.spark_partition_id().cast("long")})
    placed = placed.withColumn(at, F.monotonically_increasing_id())
    if rows.columns and "row_index" not in told:  # any hash, so that columns are read
        counted = F.count(F.when(F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))).between(-(2**63), 2**63 - 1), 1))
    else:
        counted = F.count(F.lit(1))
    pieces = Scratch(rows.sparkSession, "ordinals").write(placed.groupBy(by, start).agg(F.min(at).alias(low), counted.alias(n)), "pieces")
    upto = F.sum(n).over(Window.orderBy(by, start).rowsBetween(Window.unboundedPreceding, -1))  # a row for each piece
    offsets = pieces.select(by, start, low, F.coalesce(upto, F.lit(0)).alias(before))
    offsets = F.broadcast(offsets) if pieces.count() <= FEW else offsets
    number = (F.col(before) + F.col(at) - F.col(low)).alias(name)
    return placed.join(offsets, [by, start]).select(*[F.col(f"`{c}`") for c in rows.columns], number)
