"""Resumable transforms as Structured Streaming over files: what a checkpoint has seen is not done again."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def retrying(call: Callable[[], object], tries: int = 3, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """The result of ``call``, tried up to ``tries`` times; before the next try it waits ``base`` to the power of the
    tries that failed before. Raises RuntimeError, from the last error, if none succeeds."""
    for n in range(tries):
        try:
            return call()
        except Exception as e:  # whatever a backend raises
            last = e
            if n + 1 < tries:
                sleep(base**n)
    raise RuntimeError(f"failed {tries} times") from last


def resumable(spark: SparkSession, source: str, schema: T.StructType | str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, *, files_per_batch: int = 16, kind: str = "parquet", tries: int = 1) -> int:
    """Runs ``transform`` over the files of ``source`` that no earlier run with this checkpoint has done.

    Each batch overwrites the folder of its number under ``target``, so a batch that a crash cut short is written
    anew, once; one that fails is tried ``tries`` times, with waits between. Returns the number of batches of this run.
    """
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        retrying(lambda: transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}"), tries)
        done.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(done)
