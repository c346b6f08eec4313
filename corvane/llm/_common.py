"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.scratch import Scratch, shared_dir

__all__ = ["WORD", "Scratch", "apart", "few", "parts", "released", "shared_dir", "table", "text_col"]

#: White space of the word contracts: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a small side that is broadcast at most.
FEW = 100_000


def apart(df: DataFrame, *names: str) -> tuple[DataFrame, list, list[str]]:
    """``df`` with columns c0, c1, …, which no name of an operator's own clashes with; the columns that give the old
    names back; and the new names of ``names``."""
    new = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*new.values()), [F.col(n).alias(c) for c, n in new.items()], [new[n] for n in names]


def few(rows: list | int, df: DataFrame) -> DataFrame:
    """``df``, broadcast if it has at most ``FEW`` rows; given the rows it was made of, or their number."""
    return F.broadcast(df) if (rows if isinstance(rows, int) else len(rows)) <= FEW else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``batches``; after the last the worker, which later tasks use again, gives unused memory back."""
    yield from batches
    pa.default_memory_pool().release_unused()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_col(name: str):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
